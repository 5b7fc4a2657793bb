"""Operator 4 - approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors; their number grows with the square
root of the table. Each vector is represented by the order of its ``length``
nearest pivots and posted in the inverted files of the nearest ``post`` of them.
A query visits the files of its nearest pivots, ranks what it finds there by the
footrule distance of the permutations, and what is near enough is ranked again
by true distance. How many files are visited, and how near a permutation has to
be, is fitted: a bounded set of ``trials`` vectors is searched exhaustively, and
the least effort that finds the wanted share of their neighbours is taken. On
vectors with structure that is little; on vectors without any (independent
normal components) no index of this kind does with less than a large part.

Scale: inverted files are cut into parts of about ``part`` postings, so a pivot
(or a vector) that is very common is spread; each part meets the queries that
visit it in one task and returns at most ``k`` rows per query. Queries found
short of ``k`` are compared with every vector, part by part. Only the pivots and
the trials with their neighbours reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle


def usable(v: Column) -> Column:
    """Vectors that are there, finite and not all zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first (ties by number)."""
    d = (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :length].astype(np.int16)


def places(perm: np.ndarray, n_pivots: int) -> np.ndarray:
    """The place of each pivot (row) in each permutation (column); ``length`` where it has none."""
    length = perm.shape[1]
    out = np.full((n_pivots, len(perm)), length, np.int16)
    out[perm.T.astype(np.int64), np.arange(len(perm))] = np.arange(length, dtype=np.int16)[:, None]
    return out


def footrule(place: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Sum of the differences in place between one permutation and each column of ``place``."""
    length = len(mine)
    at = place[mine].astype(np.int32)
    # pivots that only the other permutation has count by their distance from the end
    return length * (length + 1) // 2 + (np.abs(at - np.arange(length)[:, None]) - (length - at)).sum(0)


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the nearest of ``x``, ties to the smaller id."""
    dist = np.sqrt(((x - q) ** 2).sum(1))
    if len(dist) > k:
        close = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        best = close[np.lexsort((ids[close], dist[close]))[:k]]
    else:
        best = np.lexsort((ids, dist))
    return best, dist[best]


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("n_ranked", pa.int64())])


def unpacked(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["perm"].to_pylist()), np.int16).reshape(table.num_rows, -1)


def search_part(asked: pa.Table, posted: pa.Table, n_pivots: int, post: int, within: float, k: int, exhaustive: bool = False) -> pa.Table:
    """The ``k`` nearest of a part of a file for each query that visits it, and how many were ranked by true distance."""
    if not asked.num_rows or not posted.num_rows:
        return FOUND.empty_table()
    dim = len(posted["v"][0])
    x, q = matrix(posted["v"], dim), matrix(asked["v"], dim)
    ids, qids, keys = posted["id"].to_numpy(), asked["id"].to_numpy(), asked["query"].to_numpy()
    if not exhaustive:
        perm, qperm, turn = unpacked(posted), unpacked(asked).astype(np.int64), asked["turn"].to_numpy()
        place = places(perm, n_pivots)
    out: list[tuple] = []
    for i in range(len(q)):
        fresh = ids != qids[i]
        if not exhaustive:
            # a vector met in an earlier file of this query is not taken again
            if turn[i]:
                fresh &= place[qperm[i, : turn[i]]].min(0) >= post
            fresh &= footrule(place, qperm[i]) <= within
        fresh = np.flatnonzero(fresh)
        if len(fresh):
            best, dist = nearest(ids[fresh], x[fresh], q[i], k)
            out.append((np.full(len(best), keys[i]), np.full(len(best), qids[i]), ids[fresh][best], dist, np.where(np.arange(len(best)) == 0, len(fresh), 0)))
    if not out:
        return FOUND.empty_table()
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)


def effort(trials: np.ndarray, perms: np.ndarray, trial: np.ndarray, found: np.ndarray, post: int, recall: float) -> tuple[int, float]:
    """(files to visit, largest footrule) that find the share ``recall`` of the trials' neighbours.

    ``perms`` are the permutations of the ``trials`` and ``found`` those of the
    neighbour in each row, which belongs to trial number ``trial``.
    """
    length = perms.shape[1]
    place = places(found, int(max(perms.max(), found.max())) + 1)
    turn, foot = np.full(len(trial), length + 1), np.zeros(len(trial))
    for t in range(len(trials)):
        rows = np.flatnonzero(trial == t)
        if len(rows):
            mine = perms[t].astype(np.int64)
            near = place[mine][:, rows] < post
            turn[rows] = np.where(near.any(0), near.argmax(0) + 1, length + 1)
            foot[rows] = footrule(place[:, rows], mine)
    # both cuts together may lose as much as is allowed
    each = 1 - (1 - recall) / 2
    visit = int(min(length, np.quantile(turn, each, method="higher")))
    return visit, float(np.quantile(foot, each, method="higher"))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    recall: float = 0.96,
    pivots: int | None = None,
    length: int = 64,
    post: int = 8,
    trials: int = 64,
    part: int = 4096,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query, by Euclidean distance.

    ``queries`` are rows of the same shape; a row of the query's own id is not
    a candidate. Returns (query_id, rank from 1, vec_id, score, n_ranked), ties
    to the smaller vec_id; ``n_ranked`` is the number of vectors that were
    ranked by true distance for the query. Vectors that are null, zero, hold
    null or non-finite components, have a null id, or a dimension other than
    the most frequent one take no part; of repeated ids each row is a
    candidate; equal rows of a query are one query, unlike vectors of one query
    id have a ranking each. ``recall`` is the share aimed at on ``trials``
    vectors; ``pivots`` is 2 sqrt(n), from 64 to 4,096, unless given.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    good = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    pool, asked = good(vectors), good(queries).distinct()
    dims = pool.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_ranked long")
    dim, n = dims[0].dim, dims[0].n
    pool, asked = pool.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    n_pivots = max(1, min(pivots or max(64, min(4096, int(2 * n**0.5))), n // 4))
    sample = pool.orderBy(F.xxhash64("id"), "id", "v").limit(2 * n_pivots + trials).select("id", "v").toArrow()
    drawn = matrix(sample["v"], dim)
    chosen = np.unique(drawn[trials:] if len(drawn) > trials else drawn, axis=0)
    chosen = chosen[np.random.default_rng(7).permutation(len(chosen))[:n_pivots]]
    n_pivots, length = len(chosen), min(length, len(chosen))
    pivot_rows = spark.sparkContext.broadcast(chosen)
    trial_rows, trial_ids = drawn[:trials], sample["id"].to_numpy()[:trials]

    def permute(batches):
        for batch in batches:
            p = permutations(matrix(batch["v"], dim), pivot_rows.value, length)
            near = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * length, pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array([r.tobytes() for r in p], pa.binary()), near], ["id", "v", "perm", "near"])

    fields = f"id long, v array<{kind}>, perm binary, near array<short>"
    index = settle(pool.mapInArrow(permute, fields))
    asks = settle(asked.mapInArrow(permute, fields).withColumn("query", F.xxhash64("id", "v")))

    def try_all(batches):
        for batch in batches:
            x, ids = matrix(batch["v"], dim), batch["id"].to_numpy()
            for t in range(len(trial_rows)):
                other = np.flatnonzero(ids != trial_ids[t])
                best, dist = nearest(ids[other], x[other], trial_rows[t], k)
                rows = other[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t)), pa.array(ids[rows]), pa.array(dist), batch["perm"].take(pa.array(rows))], ["trial", "id", "dist", "perm"])

    order = Window.partitionBy("trial").orderBy("dist", "id")
    truth = index.select("id", "v", "perm").mapInArrow(try_all, "trial long, id long, dist double, perm binary").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("trial", "perm").toArrow()
    if truth.num_rows:
        visit, within = effort(trial_rows, permutations(trial_rows, chosen, length), truth["trial"].to_numpy(), unpacked(truth), post, recall)
    else:
        visit, within = length, float(length * (length + 1))

    postings = index.select("id", "v", "perm", F.explode(F.slice("near", 1, post).cast("array<int>")).alias("pivot"))
    sizes = postings.groupBy("pivot").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    postings = postings.join(F.broadcast(sizes), "pivot").select("id", "v", "perm", "pivot", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    visits = (
        asks.select("query", "id", "v", "perm", F.posexplode(F.slice("near", 1, visit).cast("array<int>")).alias("turn", "pivot"))
        .join(F.broadcast(sizes), "pivot")
        .select("query", "id", "v", "perm", "turn", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    schema = "query long, query_id long, vec_id long, score double, n_ranked long"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_part(left, right, n_pivots, post, within, k)

    def search_all(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_part(left, right, n_pivots, post, within, k, exhaustive=True)

    def ranked(rows: DataFrame) -> DataFrame:
        mine = Window.partitionBy("query")
        out = rows.withColumn("rank", F.row_number().over(mine.orderBy("score", "vec_id"))).withColumn("n_ranked", F.sum("n_ranked").over(mine))
        return out.where(F.col("rank") <= k)

    found = settle(ranked(visits.groupBy("pivot", "part").cogroup(postings.groupBy("pivot", "part")).applyInArrow(search, schema)))
    got = found.groupBy("query").agg(F.count("*").alias("n"))
    short = settle(asks.join(got, "query", "left").where(F.coalesce("n", F.lit(0)) < min(k, n)).select("query", "id", "v"))
    if short.limit(1).count():
        parts = -(-n // (8 * part))
        dealt = index.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"))
        every = short.select("query", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        again = ranked(every.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(search_all, schema))
        found = found.join(short.select("query"), "query", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score", "n_ranked")
