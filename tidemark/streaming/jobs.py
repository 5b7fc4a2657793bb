"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.graph import kept
from ..sources.store import StoredTable, add_new, replace_by


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Gap sessions of each account (account, ts) with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy("account", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def live_ledger(lines: DataFrame) -> DataFrame:
    """Timing lines parsed as they arrive; lines without a measurement are not passed on."""
    from ..operators.census import timing_parse

    return timing_parse(lines).where("ms is not null")


def merge_new(table: StoredTable, keys: list[str], name: str, order: str | None = None):
    """A ``foreachBatch`` writer that adds rows whose keys the stored table does not hold.

    Only the partitions of the batch's keys are read and rewritten. The batch is
    known by the stream's name and its number, so one that is replayed changes
    nothing; the greatest ``order`` seen is kept as the table's high-water mark.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = None
        if order is not None:
            seen, former = batch.agg(F.max(order).alias("m")).first().m, table.mark()
            mark = former if seen is None else str(seen if former is None else max(seen, type(seen)(former)))
        table.merge(batch.select(*keys).dropna().distinct(), f"{name}-{number}", add_new(*keys), mark)

    return write


def scan_above(rows: DataFrame, marks: DataFrame, target: DataFrame | None, keys: list[str], order: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(new votes, the next mark): only rows above the stored high-water mark (mark) are looked at.

    ``target`` holds the votes of earlier scans, which are not repeated; with
    no mark stored all rows are scanned. The next mark is the greatest row seen,
    also where its row gave no vote.
    """
    mark = marks.agg(F.max("mark").alias("mark"))
    fresh = rows.join(F.broadcast(mark)).where(F.col("mark").isNull() | (F.col(order) > F.col("mark"))).drop("mark")
    votes = fresh.select(*keys).dropna().distinct()
    if target is not None:
        votes = votes.join(target.select(*keys), keys, "left_anti")
    after = rows.agg(F.max(order).alias("seen")).join(mark).select(F.greatest("seen", "mark").alias("mark"))
    return votes, after


def skip_unchanged(current: DataFrame, known: DataFrame, key: str = "project", signature: str = "signature") -> DataFrame:
    """Rows whose signature is new or has changed."""
    return current.join(known.select(key, signature), [key, signature], "left_anti")


def content_cache(items: DataFrame, cache: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(results found in the cache, items to compute); an entry counts only under the same fingerprint."""
    live = cache.where(F.col("fingerprint") == fingerprint)
    hashed = items.withColumn("hash", F.sha2("content", 256))
    return hashed.join(live.select("key", "hash", "result"), ["key", "hash"]), hashed.join(live, ["key", "hash"], "left_anti")


def middle(values: list[float]) -> float:
    """Median of a few measurements; NaN does not count."""
    known = sorted(v for v in values if v == v)
    half = len(known) // 2
    return math.nan if not known else known[half] if len(known) % 2 else (known[half - 1] + known[half]) / 2


def decay_states(rows: DataFrame, size: int = 4, pause: float = 0.75, resume: float = 0.9, cap: int = 3) -> DataFrame:
    """Actions for each host from its live timings (host, pos, ms), rows of a batch in order of ``pos`` and ``ms``; as ``rolling_decay`` decides."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, recent, pauses = state.get if state.exists else ([], [], 0)
        first, recent = list(first), list(recent)
        baseline = middle(first) if len(first) == size else None
        actions = []
        rows_ = pd.concat(list(batches)).sort_values(["pos", "ms"])
        for ms in rows_["ms"].tolist():
            speed = 1.0 / ms
            if len(first) < size:
                first.append(speed)
                baseline = middle(first) if len(first) == size else None
            recent = [*recent, speed][-size:]
            action = "observing"
            if baseline is not None:
                ratio = middle(recent) / baseline
                action = "none"
                if ratio >= resume:
                    action, pauses = ("resume" if pauses else "none"), 0
                elif pauses or ratio < pause:
                    pauses += 1
                    action = "pause" if pauses <= cap else "cap_reached" if pauses == cap + 1 else "none"
            actions.append(action)
        state.update((first, recent, pauses))
        yield pd.DataFrame({"host": key[0], "pos": rows_["pos"].to_numpy(), "action": actions})

    return rows.groupBy("host").applyInPandasWithState(step, "host string, pos long, action string", "first array<double>, recent array<double>, pauses long", "append", GroupStateTimeout.NoTimeout)


def occurrence_events(conditions: DataFrame) -> DataFrame:
    """Occurrences opened, aged and closed by each condition's live readings (fingerprint, event_id, kind, aged).

    The first reading of an open occurrence that is aged gives one more sighting.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, is_open, told = state.get if state.exists else (0, False, False)
        out = []
        for event, kind, aged in pd.concat(list(batches)).sort_values("event_id")[["event_id", "kind", "aged"]].itertuples(index=False):
            if kind == "sighting" and not is_open:
                number, is_open, told = number + 1, True, bool(aged)
                out.append((key[0], event, number, "opened"))
            elif kind == "sighting" and aged and not told:
                told = True
                out.append((key[0], event, number, "aged"))
            elif kind == "resolution" and is_open:
                is_open = False
                out.append((key[0], event, number, "closed"))
        state.update((number, is_open, told))
        yield pd.DataFrame(out, columns=["fingerprint", "event_id", "occurrence", "change"])

    return conditions.groupBy("fingerprint").applyInPandasWithState(step, "fingerprint long, event_id long, occurrence long, change string", "number long, is_open boolean, told boolean", "append", GroupStateTimeout.NoTimeout)


BROKEN = "_broken"


def ingest_files(schema: StructType, target: str, journal: StoredTable, archive: str | None = None):
    """A ``foreachBatch`` writer for lines (value, file) of a landing folder: whole files in, broken ones left where they are.

    A file of which any line does not parse gives no rows and is told in the
    journal (file, outcome, lines, broken, first_broken, batch). The rows of the good files of
    a batch go to a folder of the target that is named after the files, which a
    replay writes anew; the journal names the folders that count, so what was
    written before a crash adds nothing. Then good files are moved to the archive.
    A file that the journal has as ingested is not read again.
    """
    parsed = StructType([*schema.fields, StructField(BROKEN, StringType())])

    def write(batch: DataFrame, _: int) -> None:
        # the files of one batch, which the source has listed on the driver as well
        files = sorted(r.file for r in batch.select("file").distinct().join(journal.read().where("outcome = 'ingested'").select("file"), "file", "left_anti").collect())
        if not files:
            return
        name = hashlib.md5("\n".join(files).encode()).hexdigest()
        lines = batch.where("trim(value) <> ''").where(F.col("file").isin(files)).select("file", "value", F.from_json("value", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
        lines = kept(lines.withColumn("bad", F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull()))
        told = lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("bad").alias("broken"), F.min(F.when(F.col("bad"), F.substring("value", 1, 200))).alias("first_broken"))
        told = kept(told.select("file", F.when(F.col("broken") > 0, "rejected").otherwise("ingested").alias("outcome"), "lines", "broken", "first_broken", F.lit(name).alias("batch")))
        good = told.where("outcome = 'ingested'").select("file")
        lines.join(good, "file", "left_semi").select("r.*").drop(BROKEN).write.mode("overwrite").parquet(f"{target}/{name}")
        journal.merge(told, name, replace_by("file"))
        if archive is not None:
            move(batch.sparkSession, [r.file for r in good.collect()], archive)

    return write


def ingested(spark: SparkSession, schema: StructType, target: str, journal: StoredTable) -> DataFrame:
    """The rows of all files that the journal has as ingested."""
    batches = [r.batch for r in journal.read().where("outcome = 'ingested'").select("batch").distinct().collect()]
    return spark.read.schema(schema).parquet(*[f"{target}/{b}" for b in batches]) if batches else spark.createDataFrame([], schema)


def move(spark: SparkSession, files: list[str], folder: str) -> None:
    """Move files into a folder of the same store; those that are gone were moved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for f in files:
        if fs.exists(path(f)):
            fs.rename(path(f), path(f"{folder}/{f.rsplit('/', 1)[-1]}"))


def landing(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines (value, file) of the new files of a folder; those of an ingest that are broken stay and are not read again."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).select("value", F.col("_metadata.file_path").alias("file"))


JOURNAL = "file string, outcome string, lines long, broken long, first_broken string, batch string"
