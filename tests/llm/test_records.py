"""Operators 2, 5 and 9, and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import warc
from tidemark.llm.decontamination import MASKS, classes, decontaminate, lossless
from tidemark.llm.mixing import mix_sources, quota
from tidemark.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, duck_rows, spark_rows
from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(connect(SF), ORACLE_SQL[name])


def test_op5_round_trip(spark):
    long = "é" * 60_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "u", long), (2, "u", None), (3, None, ""), (4, "u", "x" * 1200), (9, "u", "x" * 1200), (5, "u", "x" * 1200), (6, "u\n", "x" * 999), (7, "u", "x" * 999)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.warc_round_trip(df, segment=1000, chunk=300, records=3).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        want = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if i in (4, 5) else "response", 9 if i in (4, 5) else None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_op5_null_and_repeated_ids_over_the_segment_size(spark):
    rows = [(None, "u", "a" * 40_000), (None, "u", "b" * 70_000), (None, "v", "c"), (7, "u", "d" * 40_000), (7, "u", "e" * 90_000), (7, "u", "d" * 40_000), (3, "u", "d" * 40_000), (8, "u", "f" * 50_000), (2, "u", "f" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{warc.shared_dir(spark)}/warc-ids"
    warc.write_pages(df, path)
    records = warc.read_records(spark, path)
    ids = [r.record_id for r in records.collect()]
    assert len(ids) == len(set(ids)) > len(rows)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in warc.payloads(warc.reassemble(records)).collect()]
    refers = {3: 7, 2: 8}
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if i in refers else "response", refers.get(i), True) for i, _, h in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op5_missing_segment_is_told(spark):
    parts = warc.page_records(1, "u", b"y" * 5000, hashlib.sha1(b"y" * 5000).hexdigest(), None, 1000, 400)
    whole = [x for p in parts for x in warc.parse(p + b"\r\n\r\n")]
    assert len(whole) == len(parts) > 3 and b"".join(b for _, b in whole).endswith(b"0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"abc" * 999, 7)) == b"abc" * 999


def test_op9_tolerates_a_substitution_and_leaves_clean_texts(spark):
    rnd = random.Random(1)
    item = [f"i{rnd.randrange(900)}" for _ in range(20)]
    changed = list(item)
    changed[9] = "other"
    noise = lambda n: [f"n{rnd.randrange(900)}" for _ in range(n)]
    rows = [(1, noise(50) + item + noise(9)), (2, noise(5) + changed), (3, noise(80)), (4, item[:6] + noise(30)), (5, None), (6, [])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), 1) for i, w in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "tiny one"), (None, "x")], "item_id long, text string")
    for limit in (500_000, 0):
        got = {r.doc_id: r for r in decontaminate(docs, items, broadcast_rows=limit).collect()}
        assert {i: r.contaminated for i, r in got.items()} == {i: brute.contaminated(None if w is None else " ".join(w), [" ".join(item)]) for i, w in rows}
        assert (got[1].best_item, got[1].best_overlap) == (1, 13)
    assert decontaminate(docs.limit(0), items).count() == 0 and decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_op9_id_named_like_its_own_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight", 3), (2, "nothing here", 4)], "id long, text string, item long")
    items = spark.createDataFrame([(7, "two three four five six seven")], "item_id long, text string")
    assert sorted((r.id, r.contaminated) for r in decontaminate(docs, items, id_col="id").collect()) == [(1, True), (2, False)]


def test_op9_masks_hit_every_accepted_overlap():
    kinds = classes(MASKS, 13, 0.8)
    for length in range(1, 14):
        kind = max(k for k in kinds if k.least <= length)
        assert lossless(kind.masks, length, length - (4 * length + 4) // 5)


def test_op9_equals_brute_force_without_seeds(spark):
    rnd = random.Random(4)
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14):
        items.append((n, [f"i{n}x{k}" for k in range(n)]))
        for bad in range(4):
            for _ in range(8):
                w = list(items[-1][1])
                for k in rnd.sample(range(n), min(bad, n)):
                    w[k] = "zz"
                docs.append((len(docs) + 1, " ".join(["noise"] * rnd.randrange(4) + w + ["noise"] * rnd.randrange(3))))
    # one id or none: each row by its own text
    docs += [(None, " ".join(items[-1][1])), (None, "clean text"), (None, None), (1, "clean again"), (None, "clean text")]
    texts = [" ".join(w) for _, w in items]
    want = sorted(((i or -1, t or "", brute.contaminated(t, texts)) for i, t in docs))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.with_text or "", r.contaminated) for r in decontaminate(*frames, carry=("text",)).collect()))
    assert got == want


def test_pipeline_judges_rows_without_an_id_by_their_texts(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, item, "en", "s", 1), (None, "clean", "en", None, 5), (4, item, None, "s", 1), (4, "clean too", None, "s", 9), (5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert left.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(None, "clean", "en", None, 5), (4, "clean too", None, "s", 9), (5, None, None, None, None)], key=repr)


def test_op2_weights_and_limits(spark):
    rows = [(i, "big", "a b c d " * 5) for i in range(300)] + [(1000 + i, f"s{i % 3}", "a b " * 3) for i in range(30)] + [(2000, None, "a b"), (2001, "void", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mix_sources(docs, block_docs=10)
    got = out.collect()
    assert len(got) == len(rows) and min(r.copies for r in got) >= 1 and max(r.copies for r in got) <= 5
    assert abs(sum({r.source: r.weight for r in got}.values()) - 1) < 1e-6
    again = {r.doc_id: r.copies for r in mix_sources(docs, block_docs=10).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    with pytest.raises(ValueError):
        mix_sources(docs, budget=10**6)
    small = mix_sources(docs, budget=600, block_docs=10)
    assert small.selectExpr("sum(copies * n_tokens) as n").first().n <= 600
    assert mix_sources(docs.limit(0)).count() == 0


def test_op2_rounding_drops_no_source(spark):
    rnd = random.Random(2)
    rows = [(n, rnd.random()) for n in (rnd.randrange(10**12, 10**13) for _ in range(2000))]
    df = spark.createDataFrame([(n, w, n / w) for n, w in rows], "tokens long, weight double, size double")
    of = lambda whole: df.where(quota(F.col("weight"), F.col("size"), whole) < F.col("tokens")).count()
    assert of(True) == 0 < of(False)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, SF).where("predicted = 1").collect()}
    left = {i: t for i, t in start.items() if i not in toxic}
    assert set(kept["toxicity"]) == set(left)
    left = {i: left[i] for i, (group, _) in brute.near_groups(list(left.items())).items() if group == i}
    assert set(kept["ngram_join"]) == set(left)
    left = {i: b.decode("utf-8", "ignore") for i, _, _, _, b in brute.suffix_dedup(list(left.items()))}
    assert {i: r.text for i, r in kept["suffix_dedup"].items()} == left
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, t in left.items() if len(t) < 3000 and brute.contaminated(t, items)}
    assert bad <= set(left) - set(kept["decontamination"])
    assert set(kept["mixing"]) == set(kept["decontamination"]) and all(r.copies >= 1 for r in kept["mixing"].values())


def test_pipeline_takes_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words in here", None, None, 3), (2, "some words in here", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        left = table
        for _, stage in corpus_pipeline.STAGES:
            left = spark.createDataFrame(stage(spark, left, SF).collect(), stage(spark, left, SF).schema)
        assert left.count() == (3 if table is docs else 0)
