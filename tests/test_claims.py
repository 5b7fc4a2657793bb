"""The shortlist against all pairs, and outcomes of claims against a plain fold."""

import difflib
import random

from pyspark.sql import functions as F

from tidemark.operators import joins, text

SF = "/root/testdata/sf0.001"


def all_pairs(claims, chunks, k=5, floor=0.15):
    out = []
    for c, claim in claims:
        scored = []
        for d, chunk in chunks:
            if claim and chunk is not None:
                m = difflib.SequenceMatcher(None, claim.casefold(), chunk.casefold())
                score = round(sum(b.size for b in m.get_matching_blocks()) / len(claim), 6)
                if score >= floor:
                    scored.append((-score, d))
        out += [(c, d, -s, n + 1) for n, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df):
    return sorted((r.claim_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())


def test_shortlist_equals_all_pairs(spark):
    chunks = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    claims = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    c, d = spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3)
    want = all_pairs(claims, chunks)
    assert got(text.shortlist(c, d)) == want
    assert got(text.shortlist(c, d, most_chars=1500)) == want
    # what the shingle filter of earlier rounds lost: chunks of the shortlist that share no three words with their claim
    three = lambda s: set(zip(*[s.lower().split()[i:] for i in range(3)], strict=False))
    texts, said = dict(chunks), dict(claims)
    assert sum(not three(said[i]) & three(texts[j]) for i, j, _, _ in want) > 0


def test_shortlist_of_crafted_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aabbcdeß ÉxyZ") for _ in range(rng.randint(0, 70)))
    claims = [(i, word()) for i in range(40)] + [(90, ""), (91, "qqq")]
    chunks = [(i, word() * rng.choice([1, 1, 8])) for i in range(60)] + [(100, None), (101, ""), (102, claims[0][1] + "e" * 400), (103, claims[0][1] + "e" * 400)]
    c, d = spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(chunks, "chunk_id long, text string")
    for k, floor in ((5, 0.15), (1, 0.4), (100, 0.0001)):
        assert got(text.shortlist(c, d, k, floor)) == all_pairs(claims, chunks, k, floor)
    assert text.shortlist(c.limit(0), d).count() == 0 and text.shortlist(c, d.limit(0)).count() == 0


def test_outcomes_equal_a_fold_from_the_newest(spark):
    rng = random.Random(4)
    n = 120
    pairs = sorted({(a, b) for a in range(n) for b in rng.choices(range(a + 1, n + 1), k=2) if b < n})
    captured, others = {i for i in range(n) if rng.random() < 0.1}, [(i, f"p{i % 4}") for i in range(0, n, 5)]
    gone, want = set(), {}
    for i in range(n - 1, -1, -1):
        newer = [b for a, b in pairs if a == i and b not in gone]
        if i in captured:
            want[i] = ("captured", None)
        elif newer:
            gone.add(i)
            want[i] = ("superseded", min(newer))
        else:
            want[i] = ("cross_project" if i % 5 == 0 else "gap", None)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    df = text.claim_outcomes(frame([(i,) for i in range(n)], "claim_id long"), frame([(i,) for i in captured], "claim_id long"), frame(pairs, "claim_id long, newer long"), frame(others, "claim_id long, other string"))
    assert {r.claim_id: (r.outcome, r.by) for r in df.collect()} == want


def test_claim_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    words = ["harbour", "lights", "in", "the", "of", "fog", "ß", "Änderung", "x"]
    rows = [(f"p{k % 3}" if k % 10 else None, k, 1000 + k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(90)]
    c = spark.createDataFrame(rows, "project string, pos long, claim_id long, claim string")

    def like(old, new):
        m = difflib.SequenceMatcher(None, old.casefold(), new.casefold())
        return sum(b.size for b in m.get_matching_blocks()) / len(old)

    want = sorted((i, j) for p, a, i, old in rows for q, b, j, new in rows if p == q and a < b and old and new and like(old, new) >= 0.5)
    for most in (text.MOST_CHARS, 900):
        assert sorted((r.claim_id, r.newer) for r in text.claim_pairs(c, most_chars=most).collect()) == want


def test_title_coherence_loses_no_pair(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    titles = lambda base: [(base + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    left, right = titles(0), titles(500)
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string")
    got = sorted((r.l_id, r.r_id, r.score) for r in joins.title_coherence(frame(left), frame(right)).where("l_id is not null and score is not null and score < 1.0").collect())
    equal_l, equal_r = {i for i, t in left if t in {u for _, u in right}}, {j for j, u in right if u in {t for _, t in left}}
    want = []
    for i, t in left:
        best = max(((round(len(set(t.split()) & set(u.split())) / len(set(t.split()) | set(u.split())), 6), -j) for j, u in right if i not in equal_l and j not in equal_r), default=(0, 0))
        if 0.5 <= best[0] < 1.0:
            want.append((i, -best[1], best[0]))
    assert got == want


def test_pair_diff_meets_by_place(spark):
    m = [(1, 0, "user", "hello there"), (1, 1, "assistant", "abc"), (1, 5, "user", "more"), (2, 0, "user", "hello there"), (2, 3, "user", "abd"), (3, 0, "user", None)]
    messages = spark.createDataFrame(m, "thread_id long, seq long, role string, content string")
    pairs = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (1, 9)], "l_id long, r_id long")
    got = {(r.l_id, r.r_id): (r.l_n, r.r_n, r.same_roles, r.same_messages, r.likeness) for r in text.pair_diff(pairs, messages).collect()}
    assert got == {(1, 2): (3, 2, False, 1, round(2 * (11 + 2) / (18 + 14), 6)), (2, 2): (2, 2, True, 2, 1.0), (3, 1): (1, 3, False, 0, 0.0)}


def test_runs_are_those_of_the_matcher_and_hopeless_pairs_stop_early():
    import difflib
    import random

    from tidemark.operators.text import ClaimSet, folded, matched_run_length

    r = random.Random(4)
    for _ in range(200):
        letters = "abcdefghij"[: r.randint(1, 10)] + " "
        claim = "".join(r.choice(letters) for _ in range(r.randint(1, 60)))
        chunk = "".join(r.choice(letters + "xyzqw") for _ in range(r.randint(1, 500)))
        if r.random() < 0.5:
            chunk = chunk[:100] + claim[r.randint(0, len(claim) - 1) :] + chunk[100:]
        own, chars = ClaimSet([(1, claim)]), folded(chunk)
        own.bounds(chars)
        found = lambda least: matched_run_length(claim, chunk, own.places(chunk, chars), own.open_upto(0), least)  # noqa: B023, E731
        want = sum(m.size for m in difflib.SequenceMatcher(None, claim, chunk).get_matching_blocks())
        assert found(0) == found(want) == want
        assert found(len(claim) + 1) is None


def test_words_beside_a_counted_table_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"p{k % 2}", f"alpha beta{k % 2} gamma " * 3) for k in range(8)], "thread_id long, project string, content string")
    terms = spark.createDataFrame([("p0", "beta0", 2.0, True), ("p1", "beta1", 1.0, True)], "project string, term string, score double, code boolean")
    votes = text.vocabulary_votes(docs, terms)
    assert sorted((r.thread_id, r.project, r.term) for r in votes.collect()) == [(k, f"p{k % 2}", f"beta{k % 2}") for k in range(8)]
    plan = votes._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    words = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],)], "w array<string>").select(text.shingles(F.col("w"), 3).alias("s"))
    assert [r.s for r in words.collect()] == [["a b c", "b c d"], ["a"]]
    assert "slice(" not in words._jdf.queryExecution().optimizedPlan().toString()
