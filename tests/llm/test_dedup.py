"""Operators 1, 6 and 10 against brute force, and on awkward tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.ngram_join import bands_for, ngram_join
from tidemark.llm.queries import QUERIES
from tidemark.llm.rindex import RunIndex
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_dedup import _alone, grams, suffix_dedup
from tidemark.llm.textops import mix

from . import brute

SF = "/root/testdata/sf0.001"


def awkward():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    base = " ".join(rnd.choice(vocab) for _ in range(60))
    copy = base.split()
    copy[30] = "changed"
    return [
        (5, base), (2, base), (9, " ".join(copy)), (1, None), (3, ""), (4, "a " * 300), (6, "ß é\t\n x" * 40), (7, base + " " + base), (8, "short"), (10, "short"),
        (11, " ".join(vocab * 60)), (12, "zz " + " ".join(vocab * 60)), (13, "x" * 500),
    ]


def frame(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "b", i) for i, t in rows], "doc_id long, text string, block int, n_words string, id long")


def test_op1_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF).collect())
    assert got == brute.substring_dedup([tuple(r) for r in docs])


def test_op1_awkward(spark):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, awkward())).collect())
    assert got == brute.substring_dedup(awkward())


def test_op1_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in substring_dedup(frame(spark, [(1, text), (1, text), (None, text)])).collect())
    assert got == [(-1, 20), (1, 0), (1, 0)]


def test_op6_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute.suffix_dedup([tuple(r) for r in docs])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_op6_awkward(spark, hot):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame(spark, awkward()), hot=hot).collect())
    assert got == brute.suffix_dedup(awkward())


def test_op6_short_windows(spark):
    rows = [(1, "abcabcabcabc"), (2, "xxabcabc"), (3, "aaaaaaa")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(frame(spark, rows), width=4).collect())
    assert got == brute.suffix_dedup(rows, 4)


def test_op10_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op10_ngram_join"](spark, SF).collect()}
    assert got == brute.near_groups([tuple(r) for r in docs])


def test_op10_awkward_and_split_clusters(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    near = []
    for i in range(30):
        w = list(base)
        w[rnd.randrange(120)] = f"new{i}"
        near.append((100 + i, " ".join(w)))
    rows = awkward() + near
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(frame(spark, rows), part=4).collect()}
    assert got == brute.near_groups(rows)


def test_bands_reach_the_recall():
    for rows in (4, 6, 8):
        b = bands_for(0.8, 0.999, rows)
        assert 1 - (1 - 0.8**rows) ** b >= 0.999 > 1 - (1 - 0.8**rows) ** (b - 1)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, ngram_join])
def test_empty_tables(spark, op):
    assert op(frame(spark, []).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6, unique=True), st.integers(2, 6))
def test_run_index_finds_equal_windows(strings, width):
    index = RunIndex(strings)
    root = index.equal_windows(width)
    places = {}
    for start, s in zip(index.starts.tolist(), strings, strict=True):
        for k in range(len(s) - width + 1):
            places.setdefault(s[k : k + width], set()).add(int(root[start + k]))
    assert all(len(p) == 1 for p in places.values())
    assert len({next(iter(p)) for p in places.values()}) == len(places)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_periodic_words_are_told_apart(spark, n):
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {thue_morse(n)}"), (2, f"{head} {thue_morse(n, 'b', 'a')}"), (3, f"{head} {thue_morse(n)}")]
    df = frame(spark, rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()) == brute.substring_dedup(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df).collect()) == brute.suffix_dedup(rows)
    few = [(i, t.split(" ", 9)[-1]) for i, t in rows]
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(frame(spark, few)).collect()} == brute.near_groups(few)


@pytest.mark.parametrize("parts", [1, 2])
def test_few_shuffle_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        test_op1_awkward(spark)
        test_op6_awkward(spark, 20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op6_single_contexts_skip_the_index():
    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 123, 400, dtype=np.uint8)
    k = 24
    gram = mix(grams(text, k))
    start, end = np.array([0, 200]), np.array([200, 400])
    assert _alone(text, start, end, np.array([gram[50], gram[300]]), k).all()
    # a key of two contexts, and one that stands twice in its context
    assert not _alone(text, start, end, np.array([gram[50], gram[50]]), k).any()
    twice = np.concatenate((text[:100], text[:100]))
    assert not _alone(twice, np.array([0]), np.array([200]), mix(grams(twice, k))[[5]], k).any()


def test_op10_rows_of_one_id_are_judged_by_their_own_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = list(words)
    near[30] = "changed"
    other = [f"z{i}" for i in range(30)]
    rows = [(5, " ".join(words)), (5, " ".join(other)), (5, " ".join(near)), (7, " ".join(near)), (3, " ".join(other)), (9, "alone one"), (5, " ".join(words))]
    got = sorted((r.doc_id, r.with_t, r.class_id, r.n_links, r.stays) for r in ngram_join(frame(spark, rows).withColumn("t", F.col("text")), carry=("t",)).collect())
    assert sorted((i, c, n) for i, _, c, n, _ in got) == [(3, 3, 1), (5, 3, 1), (5, 5, 3), (5, 5, 3), (5, 5, 3), (7, 5, 3), (9, 9, 0)]
    # the rows that stay hold one text of each group
    assert sorted(c for c, _ in {(c, t) for _, t, c, _, stays in got if stays}) == [3, 5, 9]


@pytest.mark.parametrize("part, most, size", [(4, 3, 1 << 20), (5, 64, 1 << 20), (1000, 64, 2000)])
def test_op10_parts_do_not_change_links(spark, part, most, size):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(frame(spark, rows), part=part, most_parts=most, part_bytes=size).collect()}
    assert got == brute.near_groups(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (72, 71)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[71] == got[72] == got[70] == 70
