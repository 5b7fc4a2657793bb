"""Operator 2 - mixing sources to target weights by temperature (DataFrame functions only).

The token shares of the sources are raised to an exponent and normalised: 1
keeps the natural mixture, 0 makes it uniform. The exponent is bisected (32
probes a round, five bisections at once) for the largest that still reaches a
target entropy, and raised where a source would be repeated beyond a limit. The
weights become token quotas of a budget; each epoch of a source is a permutation
of its document blocks, and the last, partial epoch ends inside one block.

Scale: one pass counts tokens; all prefix sums are over at most 4,096 groups of
blocks per source, then over the blocks of a group, then over the documents of
a block, so a source that holds most of the corpus is spread like the others.
Only 33 probe rows a round reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

PROBES, ROUNDS = 32, 5
WORD = r"[^\x20\x09-\x0D]+"


def _code(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _probe(sources: DataFrame, lo: float, hi: float, cover: bool) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest repetition) at 33 exponents from ``lo`` to ``hi``."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo + (hi - lo) * i / PROBES).alias("t")) for i in range(PROBES + 1)])
    p = F.col("share")
    rows = (
        sources.select("share", "scale", F.inline(grid))
        .groupBy("i", "t")
        .agg(
            F.sum(F.pow(p, F.col("t"))).alias("z"),
            F.sum(F.pow(p, F.col("t")) * F.log(F.pow(p, F.col("t")))).alias("e"),
            F.max(F.pow(p, F.col("t") - 1)).alias("most"),
            F.min(F.pow(p, F.col("t") - 1)).alias("least"),
            F.max("scale").alias("scale"),
        )
        .orderBy("i")
        .collect()
    )
    return [(r.t, math.log(r.z) - r.e / r.z, r.most / r.least if cover else r.most / r.z * r.scale) for r in rows]


def exponent(sources: DataFrame, target: float, repeats: float, cover: bool) -> float:
    """The exponent for ``sources(share, scale)``."""
    found = []
    for kind in ("entropy", "repeats"):
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = _probe(sources, lo, hi, cover)
            if kind == "entropy":
                i = max((k for k, r in enumerate(rows) if r[1] >= target - 1e-12), default=0)
                lo, hi = rows[i][0], rows[min(i + 1, PROBES)][0]
            else:
                i = min((k for k, r in enumerate(rows) if r[2] <= repeats + 1e-9), default=PROBES)
                lo, hi = rows[max(i - 1, 0)][0], rows[i][0]
            if lo == hi:
                break
        found.append(lo if kind == "entropy" else hi)
    return max(found)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy: float = 0.95,
    repeats: float = 4.0,
    budget: int | None = None,
    block_docs: int = 1000,
    seed: int = 17,
) -> DataFrame:
    """Copies of each document in a mixture of its sources.

    ``entropy`` is the target as a part of the largest possible (the log of the
    number of sources); ``repeats`` limits the epochs of any source, and a
    ``budget`` that no mixture can fill within it is an error. ``budget`` is in tokens; None takes the least budget in which every source is seen
    whole at least once, so no document is lost. Returns (``id_col``,
    ``source_col``, n_tokens, weight, block, copies), a row for each input
    row. Null texts have no tokens and get a copy per full epoch; null sources
    are one source; sources without any token keep one copy and weight 0;
    equal ids are ordered by their tokens and may share a place; other columns
    are ignored.
    """
    base = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        )
    ).withColumn("key", F.coalesce("source", F.lit("")))
    totals = settle(base.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    grand = totals.agg(F.sum("tokens"), F.sum((F.col("tokens") > 0).cast("int"))).first()
    total, n = int(grand[0] or 0), int(grand[1] or 0)
    live = totals.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1))).withColumn("scale", F.lit(float(budget or 0) / (total or 1)))
    if budget is not None and budget > repeats * total:
        raise ValueError(f"a budget of {budget} tokens repeats {total} tokens more than {repeats} times")
    t = exponent(live, entropy * math.log(n), repeats, budget is None) if n > 1 else 1.0
    z = live.agg(F.sum(F.pow("share", F.lit(t)))).first()[0] if n else None
    z = z or 1.0
    if budget is None:
        size = F.lit((live.agg(F.max(F.col("tokens") / (F.pow("share", F.lit(t)) / z))).first()[0] or 0.0) if n else 0.0)
    else:
        size = F.lit(float(budget))
    weight = F.pow("share", F.lit(t)) / F.lit(z)
    plan = (
        live.select("key", "docs", "tokens", weight.alias("weight"), quota(weight, size, budget is None).alias("quota"))
        .select("key", "weight", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest"), "docs")
        .unionByName(totals.where("tokens = 0").select("key", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"), "docs"))
        .withColumn("blocks", F.ceil(F.col("docs") / block_docs))
    )
    hex8 = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    dealt = base.join(F.broadcast(plan) if totals.count() <= 100_000 else plan, "key").select(
        "id", "source", "key", "n_tokens", "weight", "full", "rest", (hex8(_code(F.lit(seed), F.lit("d"), F.col("id"))) % F.col("blocks")).alias("block")
    )
    dealt = dealt.withColumn("order", _code(F.lit(seed), F.col("full"), F.col("key"), F.col("block"))).withColumn("group", F.substring("order", 1, 3))
    per_block = settle(dealt.groupBy("key", "group", "order", "block").agg(F.sum("n_tokens").alias("tokens")))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_group = per_block.groupBy("key", "group").agg(F.sum("tokens").alias("tokens"))
    per_group = per_group.select("key", "group", before(Window.partitionBy("key").orderBy("group")).alias("g0"))
    starts = (
        per_block.select("key", "group", "block", before(Window.partitionBy("key", "group").orderBy("order", "block")).alias("b0"))
        .join(per_group, ["key", "group"])
        .select("key", "block", (F.col("g0") + F.col("b0")).alias("start"))
    )
    inside = Window.partitionBy("key", "block").orderBy(_code(F.lit(seed), F.col("full"), F.col("id")), "n_tokens")
    placed = dealt.join(starts, ["key", "block"]).withColumn("end", F.col("start") + F.sum("n_tokens").over(inside))
    chosen = ((F.col("rest") > 0) & (F.col("end") <= F.col("rest"))).cast("long")
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", F.round("weight", 9).alias("weight"), "block", (F.col("full") + chosen).alias("copies")
    )


def quota(weight: Column, size: Column, whole: bool) -> Column:
    """Tokens that a source gets of ``size``; with ``whole`` all of its ``tokens`` at least, however doubles round."""
    share = F.floor(weight * size + F.lit(1e-6))
    return F.greatest(share, F.col("tokens")) if whole else share


def oracle(entropy: float = 0.95, repeats: float = 4.0, block_docs: int = 1000, seed: int = 17) -> str:
    """DuckDB SQL for ``mix_sources`` over documents without a budget."""
    steps = []
    for kind, tag in (("entropy", "e"), ("repeats", "r")):
        steps.append(f"{tag}0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)")
        for k in range(ROUNDS):
            probe = f"""{tag}p{k} AS (SELECT i, t, ln(sum(pow(share, t))) - sum(pow(share, t) * ln(pow(share, t))) / sum(pow(share, t)) AS h,
  max(pow(share, t - 1)) / min(pow(share, t - 1)) AS rep
  FROM (SELECT share, i, lo + (hi - lo) * i / {PROBES} AS t FROM live, {tag}{k}, range(0, {PROBES + 1}) g(i)) GROUP BY i, t)"""
            if kind == "entropy":
                best = f"(SELECT coalesce(max(i), 0) AS i FROM {tag}p{k} WHERE h >= (SELECT {entropy} * ln(count(*)) FROM live) - 1e-12)"
                step = f"{tag}{k + 1} AS (SELECT (SELECT t FROM {tag}p{k} p WHERE p.i = b.i) AS lo, (SELECT t FROM {tag}p{k} p WHERE p.i = least(b.i + 1, {PROBES})) AS hi FROM {best} b)"
            else:
                best = f"(SELECT coalesce(min(i), {PROBES}) AS i FROM {tag}p{k} WHERE rep <= {repeats} + 1e-9)"
                step = f"{tag}{k + 1} AS (SELECT (SELECT t FROM {tag}p{k} p WHERE p.i = greatest(b.i - 1, 0)) AS lo, (SELECT t FROM {tag}p{k} p WHERE p.i = b.i) AS hi FROM {best} b)"
            steps += [probe, step]
    sections = ",\n".join(steps)
    return f"""
WITH base AS (SELECT doc_id, source, coalesce(source, '') AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
totals AS (SELECT key, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM base GROUP BY key),
live AS (SELECT *, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS share FROM totals WHERE tokens > 0),
{sections},
x AS (SELECT greatest((SELECT lo FROM e{ROUNDS}), (SELECT hi FROM r{ROUNDS})) AS t),
w AS (SELECT key, docs, tokens, pow(share, t) / (SELECT sum(pow(share, t)) FROM live, x) AS weight FROM live, x),
q AS (SELECT *, floor(weight * (SELECT max(tokens / weight) FROM w) + 1e-6)::BIGINT AS quota FROM w),
plan AS (SELECT key, weight, quota // tokens AS n_full, quota % tokens AS rest, ceil(docs / {block_docs})::BIGINT AS blocks FROM q
  UNION ALL SELECT key, 0.0, 1, 0, ceil(docs / {block_docs})::BIGINT FROM totals WHERE tokens = 0),
dealt AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '{seed}', 'd', doc_id::VARCHAR)), 1, 8))::BIGINT % blocks AS block FROM base JOIN plan USING (key)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY key ORDER BY md5(concat_ws('|', '{seed}', n_full::VARCHAR, key, block::VARCHAR)), block,
  md5(concat_ws('|', '{seed}', n_full::VARCHAR, doc_id::VARCHAR)), n_tokens) AS run_end FROM dealt)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, block, (n_full + CASE WHEN rest > 0 AND run_end <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed"""
