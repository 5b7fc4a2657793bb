"""Operator 10 - n-gram Jaccard join by MinHash banding.

Documents with one set of word n-grams form a class and are represented by the
smallest id. Band and row counts follow from the similarity and the wanted
recall. Classes that share a band hash are candidates; each bucket links its
members to its smallest one only, and the components of these links are the
candidate clusters. A cluster's n-gram sets then meet in part-against-part
tasks that verify every pair exactly, count links, and return a spanning forest
instead of the pairs. Nothing is capped and no pair is ever a row.

Scale: rows shuffled are bands x classes, and n-gram sets of candidate classes
only. A cluster of up to ``part`` classes is one part; a larger one has at most
``most_parts`` parts, so each set is copied that often at most, unless its sets
are more than ``part_bytes`` a part. Within a cluster the comparisons are
quadratic, because the number of links of each text is part of the result; an
n-gram that most sets of a task hold is counted by the sets that lack it, so
near copies are compared by their differences. Memory: two parts of n-gram sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settle
from .textops import NOT_SPACE, U64, chunks_of, mix, multipliers, sequence_hash, span_hash, text_buffer, word_spans

CHUNK = 1 << 20
#: Classes in a part of a candidate cluster, parts of a cluster, and bytes of n-gram sets in a part.
PART, MOST_PARTS, PART_BYTES = 256, 64, 16 << 20
#: Clusters of more than one part whose sizes are broadcast.
BROADCAST_ROWS = 200_000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes needed so that a pair at ``similarity`` shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.999999) ** rows)))


def gram_sets(column: pa.ChunkedArray | pa.Array, n: int):
    """(first row, rows, gram hashes sorted within their document, their rows), each gram once a document.

    A text of fewer than ``n`` words, but at least one, has one gram: all its words.
    """
    data, offsets = text_buffer(column)
    for a, b in chunks_of(offsets, CHUNK):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, off, NOT_SPACE)
        tok = span_hash(part, s, e)
        docs = b - a
        count = np.bincount(row, minlength=docs)
        first = np.cumsum(count) - count
        m = max(0, len(tok) - n + 1)
        gram = sequence_hash(tok, n)
        whole = np.flatnonzero(row[:m] == row[len(row) - m :]) if m else np.zeros(0, np.int64)
        gram, grow = gram[whole], row[whole]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            h = np.zeros(len(short), U64)
            for k, by in enumerate(multipliers(0x9FB21C651E98DF25, n - 1)):
                has = count[short] > k
                h = np.where(has, h + tok[np.minimum(first[short] + k, len(tok) - 1)] * by, h)
            gram, grow = np.concatenate((gram, mix(h + count[short].astype(U64)))), np.concatenate((grow, short))
        order = np.lexsort((gram, grow))
        gram, grow = gram[order], grow[order]
        if len(gram):
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (grow[1:] != grow[:-1])))
            gram, grow = gram[new], grow[new]
        yield a, docs, gram, grow


def set_hashes(gram: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash, in two halves, of each set of grams."""
    return np.add.reduceat(mix(gram), start).view(np.int64), np.add.reduceat(mix(gram ^ U64(0x5851F42D4C957F2D)), start).view(np.int64)


def signatures(column, n: int, bands: int, rows: int) -> list[pa.Array]:
    """Set hashes, gram counts and band hashes of a batch of texts."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    total = len(column)
    h1, h2 = np.zeros(total, np.int64), np.zeros(total, np.int64)
    size = np.zeros(total, np.int64)
    band = np.zeros((total, bands), np.int64)
    for a, _, gram, row in gram_sets(column, n):
        if not len(gram):
            continue
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        at = row[start] + a
        size[at] = np.diff(np.append(start, len(gram)))
        h1[at], h2[at] = set_hashes(gram, start)
        for j in range(bands):
            h = np.full(len(start), U64(j + 1))
            for k in range(rows):
                seed = seeds[j * rows + k]
                h = mix(h + np.minimum.reduceat((gram ^ seed) * (seed | U64(1)), start))
            band[at, j] = h.view(np.int64)
    values = pa.array(band.reshape(-1), pa.int64())
    return [pa.array(h1), pa.array(h2), pa.array(size), pa.ListArray.from_arrays(np.arange(total + 1, dtype=np.int32) * bands, values)]


def _postings(gram: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents by gram, where each gram's begin, whether they are those that lack it).

    A gram that more than half of the documents hold is listed by the others.
    """
    held = np.bincount(gram)
    common = held * 2 > n_docs
    often = common[gram]
    # the table of common grams has fewer than two places for each of their entries
    table = np.zeros((int(common.sum()), n_docs), bool)
    table[(np.cumsum(common) - 1)[gram[often]], doc[often]] = True
    lacked, lacking = np.nonzero(~table)
    code = np.concatenate((gram[~often], np.flatnonzero(common)[lacked]))
    lists = np.concatenate((doc[~often], lacking))[np.argsort(code, kind="stable")]
    return lists, np.concatenate(([0], np.cumsum(np.where(common, n_docs - held, held)))), common


def shared_counts(gram: np.ndarray, begin: np.ndarray, asking: np.ndarray, asked: np.ndarray):
    """For each document of ``asking``: (document, grams shared with each of ``asked``).

    ``gram`` holds numbered grams, ``begin`` where each document's begin.
    """
    size = np.diff(begin)
    place = np.full(len(size), -1)
    place[asked] = np.arange(len(asked))
    of = np.repeat(place, size)
    lists, ptr, common = _postings(gram[of >= 0], of[of >= 0], len(asked))
    known = len(common)
    for i in asking.tolist():
        g = gram[begin[i] : begin[i + 1]]
        g = g[g < known]
        mine = common[g]
        # all asked hold each common gram but those listed
        lacking = g[mine]
        count = np.full(len(asked), len(lacking), np.int64)
        for sign, h in ((1, g[~mine]), (-1, lacking)):
            n = ptr[h + 1] - ptr[h]
            if n.any():
                at = np.repeat(ptr[h] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                count += sign * np.bincount(lists[at], minlength=len(asked))
        yield i, count


def verify_parts(table: pa.Table, similarity: float) -> pa.Table:
    """Exact similarities between two parts of a cluster: links per class and a spanning forest."""
    # a set may come once from each task that read a row of its document
    _, once = np.unique(table["node"].to_numpy(), return_index=True)
    table = table.take(pa.array(once))
    rep, side = table["node"].to_numpy(), table["side"].to_numpy()
    copies = table["copies"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), U64) for x in table["grams"]]
    size = np.array([len(s) for s in sets], np.int64)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    links = np.zeros(len(sets), np.int64)
    same = bool((side == 2).all())
    asked = np.flatnonzero(side > 0)
    sizes, weight = size[asked], copies[asked]
    root = np.arange(len(sets))
    forest = []
    for i, both in shared_counts(gram, begin, np.flatnonzero(side != 1), asked):
        hit = both >= similarity * (size[i] + sizes - both) - 1e-9
        if same:
            hit[: i + 1] = False
        j = np.flatnonzero(hit)
        if not len(j):
            continue
        links[i] += weight[j].sum()
        j = asked[j]
        links[j] += copies[i]
        # one edge to each tree that is not joined yet
        trees, first = np.unique(root[j], return_index=True)
        new = trees != root[i]
        if new.any():
            forest += [(i, k) for k in j[first[new]].tolist()]
            root[np.isin(root, trees[new])] = root[i]
    linked = np.flatnonzero(links)
    a = [rep[i] for i, _ in forest] + [rep[i] for i in linked]
    b = [rep[j] for _, j in forest] + [None] * len(linked)
    return pa.table(
        {
            "a": pa.array(a, pa.int64()),
            "b": pa.array(b, pa.int64()),
            "links": pa.array([None] * len(forest) + links[linked].tolist(), pa.int64()),
        }
    )


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9995,
    rows: int = 6,
    part: int = PART,
    most_parts: int = MOST_PARTS,
    part_bytes: int = PART_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Group texts whose sets of word ``n``-grams have a Jaccard similarity of at least ``similarity``.

    Returns (``id_col``, class_id, copy_of, n_links, stays) for each row, and
    the columns named in ``carry`` as ``with_<name>``: the smallest id of the
    connected group, the smallest id with the same set of n-grams, the number
    of other rows at or above the similarity, and whether the row has the id
    and the set that stand for its group. Texts that are null or hold no word
    have no n-grams, link to nothing and are their own class; rows with a null
    id are returned with nulls and take no part; rows of one id are judged by
    their own texts, and count as copies if these agree. Other columns are
    ignored.
    """
    bands = bands_for(similarity, recall, rows)
    extra = [f"with_{c}" for c in carry]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"with_{c}") for c in carry])
    more = "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in extra)

    def sign(batches):
        for batch in batches:
            cols = [batch["id"], *signatures(batch["text"], n, bands, rows), *[batch[c] for c in extra]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h1", "h2", "n_grams", "bands", *extra])

    sigs = settle(base.mapInArrow(sign, f"id long, h1 long, h2 long, n_grams long, bands array<long>{more}"))
    known = sigs.where("id is not null and n_grams > 0")
    grouped = known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes, some_shared = numbered(settle(grouped))
    buckets = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    least = buckets.groupBy("band", "hash").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = buckets.join(least, ["band", "hash"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    cluster = components(stars)
    placed = cluster.join(classes.select("node", "rep", "copies", "h1", "h2", "n_grams"), "node")
    large = settle(
        placed.groupBy("label")
        .agg(F.count("*").alias("n"), (F.sum("n_grams") * 8).alias("bytes"))
        .select("label", F.greatest(F.least(F.ceil(F.col("n") / part), F.lit(most_parts)), F.ceil(F.col("bytes") / part_bytes)).cast("int").alias("parts"))
        .where("parts > 1")
    )
    placed = told_to(placed, large, "label").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.select(F.col("rep").alias("id"), "node", "h1", "h2", "copies", F.col("label").alias("cluster"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    reps = base.where("id is not null").select("id", "text").join(placed, "id")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            want = np.stack((batch["h1"].to_numpy(), batch["h2"].to_numpy()), axis=1)
            node, copies = batch["node"].to_pylist(), batch["copies"].to_pylist()
            for a, docs_, gram, row in gram_sets(batch["text"], n):
                if not len(gram):
                    continue
                edge = np.searchsorted(row, np.arange(docs_ + 1))
                has = np.flatnonzero(np.diff(edge))
                own = np.stack(set_hashes(gram, edge[has]), axis=1)
                # rows of the id that have another text are not this set
                for i in has[(own == want[a + has]).all(1)].tolist():
                    if copies[a + i] == 1 or node[a + i] not in seen:
                        out[a + i] = gram[edge[i] : edge[i + 1]].tobytes()
                        if copies[a + i] > 1:
                            seen.add(node[a + i])
            keep = ["node", "copies", "cluster", "parts", "part"]
            made = pa.RecordBatch.from_arrays([*[batch[f] for f in keep], pa.array(out, pa.binary())], [*keep, "grams"])
            yield made.filter(made["grams"].is_valid())

    grams = reps.select("node", "h1", "h2", "copies", "cluster", "parts", "part", "text").mapInArrow(sets, "node long, copies long, cluster long, parts int, part int, grams binary")
    dealt = grams.select(
        "node", "copies", "cluster", "grams", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "node", "copies", "cluster", "grams",
        F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"),
    )

    def verify(table: pa.Table) -> pa.Table:
        return verify_parts(table, similarity)

    found = settle(dealt.groupBy("cluster", "p", "q").applyInArrow(verify, "a long, b long, links long"))
    groups = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = (
        classes.select("h1", "h2", "node", "rep", "copies")
        .join(groups, "node", "left")
        .join(links, "node", "left")
        .select("h1", "h2", "node", "rep", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    if some_shared:
        # the node of a group that stands first need not be the smallest number
        first = named.where(F.col("node") >= SHARED_ID).select("label").distinct().join(named, "label").groupBy("label").agg(F.min(F.struct("rep", "node")).alias("top"))
        named = told_to(named, settle(first), "label")
    else:
        named = named.withColumn("top", F.struct(F.col("label").alias("rep"), F.col("label").alias("node")))
    top = F.coalesce("top", F.struct(F.col("label").alias("rep"), F.col("label").alias("node")))
    named = named.select("h1", "h2", "rep", "links", top["rep"].alias("class_id"), (F.col("node") == top["node"]).alias("top"))
    joined = known.select("id", "h1", "h2", *extra).join(named, ["h1", "h2"])
    linked = joined.select("id", "class_id", F.col("rep").alias("copy_of"), F.col("links").alias("n_links"), (F.col("top") & (F.col("id") == F.col("rep"))).alias("stays"), *extra)
    alone = sigs.where("id is null or n_grams = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"), *extra)
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


#: Nodes from here on are sets whose smallest id also has another set.
SHARED_ID = 1 << 62


def numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """Classes with a number of their own (``rep``, or another where several sets have one ``rep``), and whether any needed another."""
    several = classes.groupBy("rep").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("own")).where("n > 1").select("rep", "own")
    several = settle(several)
    if not several.limit(1).count():
        return classes.withColumn("node", F.col("rep")), False
    other = F.lit(SHARED_ID) + F.shiftrightunsigned(F.xxhash64("h1", "h2"), 2)
    own = F.coalesce(F.col("own") == F.struct("h1", "h2"), F.lit(True))
    return settle(told_to(classes, several, "rep").withColumn("node", F.when(own, F.col("rep")).otherwise(other)).drop("own")), True


def told_to(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """A left join with a table that is broadcast where it is counted to be small, as ``key`` can be very common in ``rows``."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, key, "left")


def oracle(n: int = 5) -> str:
    """DuckDB SQL for ``ngram_join`` at a similarity of 0.8 over documents with ids, with every pair of sets that share an n-gram."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {n - 2}, 2)), lambda i: md5(array_to_string(w[i:i + {n - 1}], ' '))))) AS gs FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, gs, min(doc_id) OVER (PARTITION BY gs) AS rep, count(*) OVER (PARTITION BY gs) AS copies FROM g),
reps AS (SELECT rep, gs, copies, len(gs) AS n FROM k WHERE doc_id = rep),
t AS (SELECT rep, n, hash(unnest(gs)) AS t FROM reps),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT rep AS node, rep AS m FROM reps UNION SELECT e.b, r.m FROM r JOIN e ON r.node = e.a AND r.m < e.b),
label AS (SELECT node, min(m) AS label FROM r GROUP BY node),
links AS (SELECT e.a AS rep, sum(reps.copies) AS links FROM e JOIN reps ON reps.rep = e.b GROUP BY e.a)
SELECT d.doc_id, coalesce(label, d.doc_id) AS class_id, coalesce(k.rep, d.doc_id) AS copy_of, (coalesce(links, 0) + coalesce(copies - 1, 0))::BIGINT AS n_links, d.doc_id = coalesce(label, d.doc_id) AS stays
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN label ON label.node = k.rep LEFT JOIN links ON links.rep = k.rep"""
