"""Stored tables: touched partitions only, repeated batches; the kept index against plain BM25 after updates."""

import collections
import math
import random
import re

import pyarrow as pa

from tidemark.operators.search_index import SearchIndex, best_of_shard, postings_of_shard, shards_for, with_snippets
from tidemark.sources.store import StoredTable, add_new, replace_by


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_rewrites_what_it_touches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "id long, v string")
    table = StoredTable(spark, str(tmp_path / "t"), rows.schema, "id", parts=8)
    assert table.read().count() == 0 and table.mark() is None
    assert table.merge(rows, "a", replace_by("id"), mark="1") == list(range(8))
    before = table.head()[1]
    one = spark.createDataFrame([(5, "new"), (5, "new2")], rows.schema)
    touched = table.merge(one, "b", replace_by("id"))
    after = table.head()[1]
    assert len(touched) == 1 and {p for p in before if before[p] != after[p]} == set(touched) and table.mark() == "1"
    want = sorted([(i, f"v{i}") for i in range(100) if i != 5] + [(5, "new"), (5, "new2")])
    assert content(table.read()) == want
    # a batch that comes again, also with other rows, changes nothing
    assert table.merge(spark.createDataFrame([(6, "late")], rows.schema), "b", replace_by("id")) == [] and table.head()[1] == after
    table.merge(spark.createDataFrame([(5, "x"), (500, "y"), (500, "y")], rows.schema), "c", add_new("id"), mark="9")
    assert content(table.read()) == sorted([*want, (500, "y")]) and table.mark() == "9"
    # a partition whose rows all go, and an empty batch
    gone = table.read(only=touched).select("id").collect()
    table.merge(spark.createDataFrame([(r.id, None) for r in gone], rows.schema), "d", lambda old, new: old.where("false"))
    assert not {r.id for r in table.read().collect()} & {r.id for r in gone}
    assert table.merge(rows.limit(0), "e", replace_by("id")) == [] and table.seen("e")


def bm25(docs, q, k, project=None):
    words = {d: re.findall(r"[^\W_]+", (c or "").lower()) for d, (_, _, c) in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    scores = collections.Counter()
    for term in set(re.findall(r"[^\W_]+", q.lower())):
        df = sum(term in w for w in words.values())
        for d, w in words.items():
            if term in w and project in (None, docs[d][0]):
                tf = w.count(term)
                scores[d] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    best = sorted(scores, key=lambda d: (docs[d][1] != "knowledge", -round(scores[d], 4), d))[:k]
    return [(d, round(scores[d], 4)) for d in best]


def test_index_equals_plain_bm25_after_updates(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.15)), 59)] for _ in range(rng.randint(0, 60)))
    docs = {i: (f"p{i % 3}", "knowledge" if i % 9 == 0 else "other", text()) for i in range(300)}
    index = SearchIndex(spark, str(tmp_path / "i"), shards=4, blocks=4)
    schema = "doc_id long, project string, doc_type string, content string"
    frame = lambda some: spark.createDataFrame([(i, *docs[i]) for i in some], schema)
    index.update(frame(docs), "one")
    former = dict(index.postings.head()[1])
    changed = [3, 9, 250]
    for i in changed:
        docs[i] = ("p1", docs[i][1], text())
    docs[900] = ("p0", "other", "unique w1")
    index.update(frame([*changed, 900]), "two")
    index.update(spark.createDataFrame([(5, "p2", "other", None), (7, "p1", "other", None)], schema), "three")
    index.update(frame(changed), "two")
    del docs[5], docs[7]
    assert any(former[p] == f for p, f in index.postings.head()[1].items()) or len(former) <= 4
    queries = [(0, "w0 w1"), (1, "w40 w55 unique"), (2, "nothing here"), (3, "W2, w3; w4 w50 w59"), (4, "")]
    q = spark.createDataFrame(queries, "query_id long, q string")
    for k, project in ((5, None), (60, None), (3, "p1"), (1000, None)):
        got = collections.defaultdict(list)
        for r in sorted(index.ask(q, k=k, project=project).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append((r.doc_id, r.score))
        for i, said in queries:
            assert got[i] == bm25(docs, said, k, project), (i, k, project)
    counts = {r.term: r.df for r in index.terms().collect()}
    assert counts == {w: n for w in [*words, "unique"] if (n := sum(w in c.split() for _, _, c in docs.values()))}


def test_an_ask_reads_no_text_and_skips_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "p", "other", "common " * (40 if i < 5 else 1) + f"word{i} the art of starts") for i in range(400)], "doc_id long, project string, doc_type string, content string")
    docs.write.parquet(str(tmp_path / "texts"))
    kept_docs = spark.read.parquet(str(tmp_path / "texts"))
    index = SearchIndex(spark, str(tmp_path / "i"), shards=4, blocks=16)
    index.update(kept_docs, "one")
    top = index.ask(spark.createDataFrame([(1, "common")], "query_id long, q string"), k=3)
    plan = top._jdf.queryExecution().analyzed().toString() + top._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and str(tmp_path / "texts") not in plan
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [0, 1, 2]
    art = index.ask(spark.createDataFrame([(1, "art")], "query_id long, q string"), k=1)
    assert with_snippets(art, kept_docs, around=4).first().snippet == "the art "


def test_shards_grow_with_the_texts_and_lie_apart(spark, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "'p' as project", "'other' as doc_type", "repeat('harbour lights ', 10) as content")
    assert shards_for(docs.limit(1)) == 8 and shards_for(docs, 8, 3000) == 20
    index = SearchIndex(spark, str(tmp_path / "apart"), shards=20, blocks=1)
    index.update(docs, "all")
    for table in (index.docs, index.postings):
        folders = table.head()[1]
        assert len(folders) == 20
        assert all(spark.read.parquet(f).select("shard").distinct().count() == 1 for f in folders.values())
    assert sorted((r.term, r.df) for r in index.terms().collect()) == [("harbour", 400), ("lights", 400)]


def test_a_shard_passes_on_its_best_only_and_groups_its_postings_at_once():
    lists = pa.table({"first": [False, True], "ids": [list(range(1000)), [2000, 2001]], "tfs": [[1] * 1000, [1, 1]], "lens": [[10] * 1000, [10, 20]], "queries": [[7, 8], [8]], "idf": [0.5, 0.5], "avg_len": [10.0, 10.0]})
    got = best_of_shard(lists, pa.int64(), 3, 1.2, 0.75).to_pylist()
    assert [(r["query_id"], r["doc_id"], r["first"]) for r in got] == [(7, 0, False), (7, 1, False), (7, 2, False), (8, 2000, True), (8, 2001, True), (8, 0, False)]
    row = lambda doc, words, pick=0, project="p": {"shard": 3, "block": 0, "doc_id": doc, "project": project, "first": False, "gone": words is None, "pick": pick, "w": words or [], "len": len(words or [])}
    kinds = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("project", pa.string()), ("first", pa.bool_()), ("gone", pa.bool_()), ("pick", pa.int64()), ("w", pa.list_(pa.string())), ("len", pa.int32())])
    table = lambda *rows: pa.Table.from_pylist(list(rows), schema=kinds)
    told = lambda t: [(r["term"], r["project"], r["ids"], r["tfs"], r["lens"], r["n"], r["top_tf"], r["least_len"]) for r in t.to_pylist()]
    empty = pa.table({c: pa.array([], t) for c, t in (("term", pa.string()), ("block", pa.int32()), ("project", pa.string()), ("first", pa.bool_()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())))})
    one = postings_of_shard(empty, table(row(2, ["b", "a", "b"]), row(1, ["a"]), row(1, ["z"], -5), row(4, ["a"], project=None), row(5, [])))
    assert told(one) == [("a", "p", [1, 2], [1, 1], [1, 3], 2, 1, 1), ("a", None, [4], [1], [1], 1, 1, 1), ("b", "p", [2], [2], [3], 1, 2, 3)]
    two = postings_of_shard(one, table(row(2, ["c"]), row(4, None)))
    assert told(two) == [("a", "p", [1], [1], [1], 1, 1, 1), ("c", "p", [2], [1], [1], 1, 1, 1)]
    assert told(postings_of_shard(two, table(row(1, None), row(2, None)))) == []
