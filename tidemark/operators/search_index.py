"""A kept full-text index: built from documents, kept up to date from changed ones, asked without their texts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.store import StoredTable
from .graph import kept
from .text import tokens

DOCS = "doc_id bigint, project string, doc_type string, first boolean, len int"
POSTINGS = "term string, shard int, block int, project string, first boolean, ids array<bigint>, tfs array<int>, lens array<int>, n int, top_tf int, least_len int"
#: Terms up to which an ask passes them to the scan as a filter.
PUSHED_TERMS = 256
#: Rows up to which ids, or the weights of asked terms, are broadcast.
BROADCAST_ROWS = 1_000_000
#: Characters of text that a shard is meant for; a merge reads and writes a shard in one task.
SHARD_CHARS = 16_000_000


def shards_for(docs: DataFrame, least: int = 8, shard_chars: int = SHARD_CHARS) -> int:
    """Shards that documents (content) need, so that none grows with the table."""
    return max(least, -(-(docs.agg(F.sum(F.length("content"))).first()[0] or 0) // shard_chars))


def flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of a column of lists, and how many each list has."""
    lists = lists.combine_chunks()
    return lists.flatten(), lists.value_lengths().to_numpy()


def postings_of_shard(old: pa.Table, new: pa.Table) -> pa.Table:
    """Old postings of a shard without those of the changed documents, with the new ones, in one row a term and block, in order of terms."""
    shard, changed = new["shard"][0].as_py(), new["doc_id"].to_numpy()
    order = np.lexsort((new["pick"].to_numpy(), changed))
    one = order[np.append(changed[order][1:] != changed[order][:-1], True)]
    new = new.take(one[~new["gone"].to_numpy()[one]])
    words, lens = flat(new["w"])
    said = pa.concat_arrays([old["term"].combine_chunks(), words]).dictionary_encode()
    ranks = np.empty(len(said.dictionary), np.int64)
    in_order = pc.sort_indices(said.dictionary)
    ranks[in_order] = np.arange(len(ranks))
    codes = ranks[said.indices.to_numpy()]
    by = ["block", "project", "first"]
    groups = pd.concat([old.select(by).to_pandas(), new.select(by).to_pandas()])
    group = groups.groupby(by, dropna=False).ngroup().to_numpy()
    # a document's words with their numbers
    pairs, new_tf = np.unique(np.repeat(np.arange(len(lens)), lens) * max(1, len(ranks)) + codes[len(old) :], return_counts=True)
    at, word = np.divmod(pairs, max(1, len(ranks)))
    ids, n = flat(old["ids"])
    stay, row = ~np.isin(ids.to_numpy(), changed), np.repeat(np.arange(len(old)), n)
    row = row[stay]
    joined = lambda c, fresh: np.concatenate([flat(old[c])[0].to_numpy()[stay], fresh])
    doc, tf, length = joined("ids", new["doc_id"].to_numpy()[at]), joined("tfs", new_tf), joined("lens", lens[at])
    word, kind = np.concatenate([codes[row], word]), np.concatenate([group[row], group[len(old) + at]])
    order = np.lexsort((doc, kind, word))
    doc, tf, length, word, kind = doc[order], tf[order].astype(np.int32), length[order].astype(np.int32), word[order], kind[order]
    starts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]))) if len(word) else np.array([], int)
    ends = np.append(starts[1:], len(word)) if len(word) else starts
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)), pa.int32()), pa.array(values))
    of_group = pa.Table.from_pandas(groups.iloc[np.unique(group, return_index=True)[1]], preserve_index=False).take(kind[starts])
    reduced = lambda f, values: f.reduceat(values, starts) if len(starts) else values
    columns = {"term": said.dictionary.take(in_order).take(pa.array(word[starts])), "shard": np.full(len(starts), shard, np.int32), **{c: of_group[c] for c in by}}
    columns |= {"ids": lists(doc), "tfs": lists(tf), "lens": lists(length), "n": (ends - starts).astype(np.int32), "top_tf": reduced(np.maximum, tf), "least_len": reduced(np.minimum, length)}
    schema = pa.schema([("term", pa.string()), ("shard", pa.int32()), ("block", pa.int32()), ("project", pa.string()), ("first", pa.bool_()), *[(c, pa.list_(t)) for c, t in (("ids", pa.int64()), ("tfs", pa.int32()), ("lens", pa.int32()))], *[(c, pa.int32()) for c in ("n", "top_tf", "least_len")]])
    return pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns.values()], names=list(columns)).cast(schema)


class SearchIndex:
    """Postings in blocks of a shard, project and class of documents, and the lengths of the documents.

    A shard is a partition of the stored tables, by a hash of the document, so
    changed documents rewrite their shards only. A posting row holds all
    documents of a block with a term, and the greatest frequency and the least
    length among them, from which follows a bound of what the block can score.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, blocks: int = 8, first_type: str = "knowledge"):
        self.path, self.shards, self.blocks, self.first_type = path, shards, blocks, first_type
        schema = lambda ddl: StructType.fromDDL(ddl)
        self.docs = StoredTable(spark, f"{path}/docs", schema("shard int, " + DOCS), "shard", shards, numbered=True)
        self.postings = StoredTable(spark, f"{path}/postings", schema(POSTINGS), "shard", shards, numbered=True)

    def update(self, changed: DataFrame, batch: str) -> list[int]:
        """Shards rewritten for new and changed documents (doc_id, project, doc_type, content); a null content takes a document out.

        A batch that comes again changes nothing. Of several rows of one document any one counts.
        Words are put down once and shuffled once, by shard; a shard's postings are then grouped as columns in one task.
        """
        if self.docs.seen(batch):
            return []
        here = f"{self.path}/staged/{uuid.uuid4().hex}"
        place = F.pmod(F.xxhash64("doc_id"), F.lit(self.shards)).cast("int")
        block = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(self.blocks)).cast("int")
        first = F.coalesce(F.col("doc_type") == self.first_type, F.lit(False))
        pick = F.xxhash64("project", "doc_type", "content")
        staged = changed.select(place.alias("shard"), block.alias("block"), "doc_id", "project", "doc_type", first.alias("first"), F.col("content").isNull().alias("gone"), pick.alias("pick"), tokens("content").alias("w"))
        staged.withColumn("len", F.size("w")).write.parquet(here)
        staged = changed.sparkSession.read.parquet(here)
        self.postings.merge(staged, batch, self._regroup, stable=True, dealt=True)
        return self.docs.merge(staged.drop("w"), batch, self._renew, stable=True)

    @staticmethod
    def _renew(old: DataFrame, new: DataFrame) -> DataFrame:
        new = new.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "doc_id"]), "pick").alias("r")).select("doc_id", "r.*")
        return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.where("not gone").select(*old.columns))

    def _regroup(self, old: DataFrame, new: DataFrame) -> DataFrame:
        # a number of its own, so that small shards are not put together in few tasks
        apart = lambda df: df.repartition(self.shards, "shard").groupBy("shard")
        return apart(old).cogroup(apart(new.drop("doc_type"))).applyInArrow(postings_of_shard, POSTINGS)

    def terms(self) -> DataFrame:
        """(term, df, n_rows, top_tf) of all terms."""
        return self.postings.read().groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_rows"), F.max("top_tf").alias("top_tf"))

    def ask(self, queries: DataFrame, k: int = 60, project: str | None = None, k1: float = 1.2, b: float = 0.75, block_queries: int = 256) -> DataFrame:
        """(query_id, rank, doc_id, doc_type, score, terms): the ``k`` best documents of each query (query_id, q) by BM25.

        Documents of the first type come before all others, then the score
        decides. A posting list goes to the task of its shard once for all queries
        of a block, which adds up their scores and passes on the best ``k`` of the
        shard for each; no answer is lost.
        """
        wanted = kept(queries.select("query_id", F.explode(F.array_distinct(tokens("q"))).alias("term")))
        rows = self.postings.read()
        few = [r.term for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        rows = rows.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else rows.join(wanted.select("term").distinct(), "term", "left_semi")
        docs = self.docs.read()
        stats = F.broadcast(docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")))
        df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        blocks = -(-queries.count() // block_queries) or 1
        weighed = wanted.join(df, "term").join(stats).withColumn("asked", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        weighed = kept(weighed.groupBy("term", "asked").agg(F.collect_list("query_id").alias("queries"), F.first(idf).alias("idf"), F.first("avg_len").alias("avg_len")))
        asked = rows if project is None else rows.where(F.col("project") == project)
        weighed = F.broadcast(weighed) if wanted.count() <= BROADCAST_ROWS else weighed
        met = asked.join(weighed, "term").select("shard", "asked", "first", "ids", "tfs", "lens", "queries", "idf", "avg_len")
        kind = queries.schema["query_id"].dataType.simpleString()
        arrow = to_arrow_type(queries.schema["query_id"].dataType)
        found = met.repartition(self.shards * blocks, "shard", "asked").groupBy("shard", "asked").applyInArrow(lambda lists: best_of_shard(lists, arrow, k, k1, b), f"query_id {kind}, doc_id bigint, first boolean, score double")
        best = Window.partitionBy("query_id").orderBy(F.col("first").desc(), F.col("score").desc(), "doc_id")
        top = kept(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        small = top.count() <= BROADCAST_ROWS
        named = lambda t: F.broadcast(t) if small else t
        held = asked.select("term", F.explode("ids").alias("doc_id")).join(named(top.select("doc_id").distinct()), "doc_id", "left_semi")
        terms = held.join(named(top.select("query_id", "doc_id")), "doc_id").join(wanted, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        typed = docs.select("doc_id", "doc_type").join(named(top), "doc_id")
        return typed.join(terms, ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "doc_type", "score", "terms")


def best_of_shard(lists: pa.Table, kind: pa.DataType, k: int, k1: float, b: float) -> pa.Table:
    """The ``k`` best documents of a shard for each query, from its posting lists (first, ids, tfs, lens, queries, idf, avg_len)."""
    (ids, sizes), (tfs, _), (lens, _), (queries, asking) = (flat(lists[c]) for c in ("ids", "tfs", "lens", "queries"))
    ends = np.cumsum(sizes)
    docs, place = np.unique(ids.to_numpy(), return_inverse=True)
    queries = queries.dictionary_encode()
    asks, ask = queries.dictionary, queries.indices.to_numpy()
    first = np.zeros(len(docs), bool)
    first[place] = np.repeat(lists["first"].to_numpy(), sizes)
    tf = tfs.to_numpy().astype(float)
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens.to_numpy() / lists["avg_len"][0].as_py()))
    which, idf = np.repeat(np.arange(len(lists)), asking), lists["idf"].to_numpy()
    found = []
    for mine in np.split(which[np.argsort(ask, kind="stable")], np.cumsum(np.bincount(ask))[:-1]):
        score = np.zeros(len(docs))
        for i in mine:
            # a list holds a document once
            here = slice(ends[i] - sizes[i], ends[i])
            score[place[here]] += idf[i] * gain[here]
        hit = np.flatnonzero(score)
        rounded = np.floor(score[hit] * 1e4 + 0.5) / 1e4
        order = np.lexsort((docs[hit], -rounded, ~first[hit]))[:k]
        found.append((hit[order], rounded[order]))
    best = np.concatenate([x for x, _ in found])
    query = asks.take(pa.array(np.repeat(np.arange(len(asks)), [len(x) for x, _ in found])))
    return pa.table({"query_id": query.cast(kind), "doc_id": docs[best], "first": first[best], "score": np.concatenate([x for _, x in found])})


def with_snippets(top: DataFrame, docs: DataFrame, around: int = 90) -> DataFrame:
    """Results with what stands in their texts (doc_id, content) around the first word that was asked for."""
    return top.join(docs.select("doc_id", "content"), "doc_id").select("query_id", "rank", "doc_id", "doc_type", "score", snippet(F.col("terms"), around).alias("snippet"))


def snippet(terms: Column, around: int) -> Column:
    word = r"[\p{L}\p{N}]"
    at = F.regexp_instr(F.lower("content"), F.concat(F.lit(f"(?<!{word})(?:"), F.array_join(terms, "|"), F.lit(f")(?!{word})")))
    return F.substring(F.col("content"), F.greatest(at - around, F.lit(1)), F.lit(2 * around))
