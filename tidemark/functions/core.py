"""Column expressions shared by the jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import kept


def segments(path: Column) -> Column:
    return F.split(path, "/")


def spread(df: DataFrame) -> DataFrame:
    """A table of few partitions dealt to all cores, where a row costs much more work than bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    return F.coalesce(*[F.when(cond, F.lit(value)) for cond, value in rules], F.lit(otherwise))


def median(col: str | Column) -> Column:
    return F.percentile(col, F.lit(0.5))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, with the true count and whether rows were left out."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("true_count", F.count("*").over(w))
    return out.where(F.col("rn") <= cap).withColumn("truncated", F.col("true_count") > cap)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400.0


def compact_key(text: Column) -> Column:
    """Lower case without the separators by which variants of a name differ."""
    return F.regexp_replace(F.lower(text), r"[-_\s./\\]+", "")


def origin_key(text: Column) -> Column:
    """Trimmed, lower case, without one trailing extension, without separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\.[a-z0-9]{1,8}$", ""), r"[-_\s./\\]+", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+")).cast("long")


def zero_filled(counts: DataFrame, key: str, kinds: Sequence[str], value: str = "n") -> DataFrame:
    """Counts with a row for each of a fixed list of kinds."""
    spark = counts.sparkSession
    all_kinds = spark.createDataFrame([(k,) for k in kinds], f"{key} string")
    return all_kinds.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def mapping(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def stretch_of(rows: DataFrame, keys: Sequence[str], value: str, parts: int = 64) -> tuple[DataFrame, Column]:
    """Rows with ``_at``, about ``parts`` values that cut each group into stretches of like size, and the number of a row's stretch.

    Where the cuts lie changes no result that is put together from whole stretches,
    as long as all of them are cut alike. Approximate percentiles depend on the order in
    which parts of a group arrive, so cuts are made once and kept.
    """
    cuts = kept(rows.groupBy(*keys).agg(F.percentile_approx(value, [(k + 1) / parts for k in range(parts - 1)], 1000).alias("_at")))
    joined = rows.join(cuts, [rows[k].eqNullSafe(cuts[k]) for k in keys]) if keys else rows.crossJoin(F.broadcast(cuts))
    for k in keys:
        joined = joined.drop(cuts[k])
    return joined, F.size(F.filter("_at", lambda x: x < F.col(value)))


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, median, nearest-rank quartiles and range of a measurement per group; unmeasured rows do not count.

    Equal values are counted first. Groups are cut into stretches, whose counts tell
    in which of them the wanted ranks lie; only there ranks are read off running
    counts, so that no group is ever held or sorted in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    cut, stretch = stretch_of(counts, keys, "_x")
    cut = cut.withColumn("_s", stretch).drop("_at")
    w = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sum"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    sums = sums.withColumn("_upto", F.sum("_sum").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_sum").over(w))
    sums = sums.withColumn("least", F.min("_low").over(w)).withColumn("most", F.max("_high").over(w)).withColumn("_before", F.col("_upto") - F.col("_sum"))
    last = F.col("_n") - 1
    wanted = [F.floor(last / 2), F.ceil(last / 2), F.bround(last * 0.25, 0), F.bround(last * 0.75, 0)]
    held = sums.where(F.exists(F.array(*[x.cast("double") for x in wanted]), lambda x: (x >= F.col("_before")) & (x < F.col("_upto"))))
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_s2"), "_before", "_n", "least", "most")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = cut.join(F.broadcast(held) if not keys else held, [*same, F.col("_s") == F.col("_s2")])
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_from", F.col("_upto") - F.col("_c"))
    at = lambda rank: F.min(F.when((F.col("_upto") > rank) & (F.col("_from") <= rank), F.col("_x")))
    return ranked.groupBy(*keys).agg(
        F.max("_n").alias("n"), (at(wanted[0]) + (at(wanted[1]) - at(wanted[0])) * 0.5).alias("median"),
        at(wanted[2]).alias("p25"), at(wanted[3]).alias("p75"), F.min("least").alias("least"), F.max("most").alias("most"),
    )


def running(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Rows with the sum of ``value`` up to each in its group; groups (not null) are cut into stretches, each summed in a task of its own."""
    cut, stretch = stretch_of(rows, [key], order)
    cut = cut.withColumn("_s", F.coalesce(stretch, F.lit(0))).drop("_at")
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    sums = cut.groupBy(key, "_s").agg(F.sum(value).alias("_sum")).select(F.col(key).alias("_k"), F.col("_s").alias("_s2"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_s2")))
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_s", "_k", "_s2", "_before")
