"""Timers, sessions in any order, and the journal of a landing folder."""

import datetime as dt
import glob

from pyspark.sql.types import StructType

from tidemark.operators import sequence
from tidemark.sources.store import StoredTable
from tidemark.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)


def run(spark, stream, tmp_path, name):
    with stateful.timed_state(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def test_a_silent_condition_ages(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    parts = [
        [(1, 1, h(0), "sighting"), (2, 2, h(1), "sighting"), (3, 3, h(0), "sighting")],
        [(2, 4, h(5), "resolution"), (3, 5, h(5), "sighting")],
        [(9, 6, h(200), "ruling")],
        [(3, 7, h(201), "resolution"), (3, 8, h(202), "sighting")],
    ]
    schema = "fingerprint long, event_id long, ts timestamp, kind string"
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, stateful.ageing_occurrences(stream, 24 * 3600 * 1000), tmp_path, "out")
    want = [(1, 1, "aged"), (1, 1, "opened"), (2, 1, "closed"), (2, 1, "opened"), (3, 1, "aged"), (3, 1, "closed"), (3, 1, "opened"), (3, 2, "opened")]
    assert sorted((r.fingerprint, r.occurrence, r.change) for r in got) == want


def test_sessions_in_any_order(spark, tmp_path):
    rows = [(k % 3, T0 + dt.timedelta(minutes=7 * k * (k % 5)), k, f"c{k % 4}" if k % 6 == 0 else None) for k in range(90)]
    schema = "account long, ts timestamp, id long, context string"
    want = sorted(tuple(r) for r in sequence.sessionize(spark.createDataFrame(rows, schema), 1800).select("account", "session", "n", "first_id", "started", "ended", "confidence").collect())
    for k in (2, 0, 1):
        spark.createDataFrame([r for r in rows if r[2] % 7 % 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, T0 + dt.timedelta(days=900), -1, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, stateful.context_sessions(stream, 1800, "100 days"), tmp_path, "out")
    assert sorted((r.account, r.session, r.n, r.first_id, r.started, r.ended, r.confidence) for r in got if r.account >= 0) == want


def test_accounts_of_one_bucket_keep_their_own_sessions(spark, tmp_path):
    rows = [(k % 5, T0 + dt.timedelta(minutes=11 * k), k, f"c{k % 3}" if k % 8 == 0 else None) for k in range(60)]
    schema = "account long, ts timestamp, id long, context string"
    want = sorted(tuple(r) for r in sequence.sessionize(spark.createDataFrame(rows, schema), 1800).select("account", "session", "n", "first_id", "confidence").collect())
    for part in (rows, [(-1, T0 + dt.timedelta(days=900), -1, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, stateful.context_sessions(stream, 1800, "100 days", buckets=1), tmp_path, "out")
    assert sorted((r.account, r.session, r.n, r.first_id, r.confidence) for r in got if r.account >= 0) == want


def test_one_bad_file_among_three_stays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", '{"x": 1}\n\n{"x": 2}\n'), ("b", '{"x": 3}\n{"x": 4\n'), ("c", '{"x": 5, "y": 1}\n')):
        (tmp_path / "in" / name).write_text(text)
    schema = StructType.fromDDL("x long")
    journal = StoredTable(spark, str(tmp_path / "journal"), StructType.fromDDL(jobs.JOURNAL), "file", parts=2)
    writer = jobs.ingest_files(schema, str(tmp_path / "rows"), journal, str(tmp_path / "done"))

    def ingest(state):
        jobs.landing(spark, str(tmp_path / "in")).writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    ingest("one")
    names = lambda folder: sorted(p.rsplit("/", 1)[-1] for p in glob.glob(str(tmp_path / folder / "*")))
    assert names("in") == ["b"] and names("done") == ["a", "c"]
    told = {r.file.rsplit("/", 1)[-1]: (r.outcome, r.lines, r.broken, r.first_broken) for r in journal.read().collect()}
    assert told == {"a": ("ingested", 2, 0, None), "b": ("rejected", 2, 1, '{"x": 4'), "c": ("ingested", 1, 0, None)}
    # a replayed batch adds nothing; a mended file and a new one come in
    (tmp_path / "in" / "a").write_text('{"x": 1}\n\n{"x": 2}\n')
    ingest("two")
    (tmp_path / "in" / "b").write_text('{"x": 3}\n{"x": 4}\n')
    (tmp_path / "in" / "d").write_text('{"x": 6}\n')
    ingest("three")
    assert sorted(r.x for r in jobs.ingested(spark, schema, str(tmp_path / "rows"), journal).collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.outcome for r in journal.read().collect()} == {"ingested"}


def test_conditions_of_one_bucket_age_by_themselves(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(k, k, h(k % 7), "sighting") for k in range(40)] + [(k, 100 + k, h(9 + k), "resolution") for k in range(0, 40, 2)] + [(None, 300, h(1), "sighting")]
    schema = "fingerprint long, event_id long, ts timestamp, kind string"
    for p in (rows, [(99, 500, h(300), "ruling")], [(3, 501, h(301), "resolution")]):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, stateful.ageing_occurrences(stream, 24 * 3600 * 1000, buckets=1), tmp_path, "out")
    # those closed a day after they began, or never, are told as aged once
    aged = {k for k in range(40) if k % 2 or 9 + k >= k % 7 + 24} | {None}
    assert sorted(str(r.fingerprint) for r in got if r.change == "aged") == sorted(map(str, aged))
    assert sorted(r.event_id for r in got if r.change == "opened") == [*range(40), 300]
    assert sorted(r.event_id for r in got if r.change == "closed") == [*range(100, 140, 2), 501]
