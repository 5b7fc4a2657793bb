"""Operators on crafted rows: boundaries, ties and the published rules."""

import collections
import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import census, derive, graph, joins, scoring, sequence, text

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_doc_type_rules(spark):
    paths = ["docs/adr/1.md", "my_KNOWLEDGE.md", "CLAUDE.md", "readme.txt", "Glossary.md", "x/DECISIONS.md", "a/STATUS_1.md", "UAT_PLAN.md", "notes.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", derive.doc_type(F.col("path")).alias("t"))
    assert dict(rows(df, "path", "t")) == dict(zip(paths, ["adr", "knowledge", "claude_md", "readme", "glossary", "decisions", "plan", "uat", "unclassified"], strict=True))


def test_skip_reason_order(spark):
    data = [("raw_x/node_modules/a", "ignored"), ("node_modules/a", "ignored"), ("src/a", "ignored"), ("src/a_files", "tracked"), ("my_files/a", "tracked")]
    df = derive.scope(spark.createDataFrame(data, "path string, git_status string"))
    assert [r.skip_reason for r in df.collect()] == ["data_dir", "vendored", "gitignored", None, "data_dir"]


def test_wall_refuses_unknown_estates(spark):
    df = spark.createDataFrame([("a-personal",), ("b-work",)], "account string")
    assert rows(derive.wall(df, "work"), "account") == [("b-work",)]
    with pytest.raises(ValueError):
        derive.wall(df, "other")


def test_one_origin_counts_once(spark):
    ev = spark.createDataFrame([(1, 7, "p", "filename_xref", 0.9, "o"), (2, 7, "p", "path_mention", 0.97, "o"), (3, 7, "p", "name_alias", 0.5, "o")], "evidence_id long, thread_id long, project string, signal string, weight double, origin string")
    assert rows(scoring.combine(ev), "score", "origins") == [(0.97, 1)]


def test_signal_cap_keeps_three(spark):
    ev = spark.createDataFrame([(i, 7, "p", "filename_xref", 0.5, f"o{i}") for i in range(5)], "evidence_id long, thread_id long, project string, signal string, weight double, origin string")
    assert rows(scoring.combine(ev), "score", "origins") == [(0.875, 3)]


def test_lineage_tie_takes_the_more_specific(spark):
    reg = spark.createDataFrame([("g", "program", "G", None, None), ("p", "project", "P", "g", None), ("r", "repo", "R", "g", "p")], "id string, tier string, canonical_name string, program string, project string")
    ranked = spark.createDataFrame([(1, "p", 0.8, 2, 1), (1, "r", 0.8, 1, 2), (2, "p", 0.9, 1, 1), (2, "r", 0.8, 1, 2)], "thread_id long, project string, adjusted double, origins long, rank int")
    assert rows(scoring.collapse_lineage(ranked, reg), "thread_id", "project") == [(1, "r"), (2, "p")]


def test_decisions(spark):
    reg = spark.createDataFrame([("p", "project", "P", None, None), ("r1", "repo", "R", None, "p"), ("r2", "repo", "S", None, "p"), ("x", "repo", "X", None, None)], "id string, tier string, canonical_name string, program string, project string")
    kept = spark.createDataFrame(
        [(1, 1, "x", 0.95, 2), (2, 1, "x", 0.95, 1), (3, 1, "r1", 0.8, 2), (3, 2, "r2", 0.75, 2), (4, 1, "x", 0.8, 2), (4, 2, "r1", 0.7, 1), (5, 1, "x", 0.95, 2), (6, 1, "x", 0.99, 3), (7, 1, "x", 0.95, 2)],
        "thread_id long, rank int, project string, adjusted double, origins long",
    )
    threads = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, "q", "fuzzy"), (6, None, "manual"), (7, None, None), (8, None, None)], "thread_id long, project_link string, project_confidence string")
    got = scoring.decide(threads, kept, spark.createDataFrame([(7,)], "thread_id long"), reg)
    assert rows(got, "thread_id", "category") == [(1, "auto_link"), (2, "suggest"), (3, "suggest"), (4, "ambiguous"), (5, "downgrade"), (6, "skip_manual"), (8, "none")]
    assert got.where("thread_id = 3").first().project == "p"


def test_time_plausibility_edges(spark):
    bursts = spark.createDataFrame([("p", D(2024, 3, 1), D(2024, 3, 5))], "project string, from date, to date")
    asks = spark.createDataFrame([(1, "p", D(2024, 3, 5)), (2, "p", D(2024, 2, 15)), (3, "p", D(2024, 2, 16)), (4, "p", None), (5, "q", D(2024, 1, 1))], "thread_id long, project string, day date")
    got = dict(rows(joins.time_plausibility(asks, bursts), "thread_id", "plausibility"))
    assert (got[1], got[2], got[4], got[5]) == (1.0, 0.0, 0.7, 1.0) and 0.1 < got[3] < 1


def test_bursts_split_after_seven_days(spark):
    days = spark.createDataFrame([("p", D(2024, 1, d)) for d in (1, 8, 16)], "project string, day date")
    assert rows(sequence.bursts(days), "from", "to") == [(D(2024, 1, 1), D(2024, 1, 8)), (D(2024, 1, 16), D(2024, 1, 16))]


def test_occurrences_reopen(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([(1, 1, t(1), "sighting"), (1, 2, t(2), "resolution"), (1, 3, t(3), "sighting"), (1, 4, t(4), "ruling"), (1, 5, t(5), "ruling")], "fingerprint long, event_id long, ts timestamp, kind string")
    assert rows(sequence.occurrences(ev), "occurrence", "sightings") == [(1, 1), (2, 1)]
    assert sequence.latency_summary(sequence.occurrences(ev)).first().ruled == 1


def test_token_windows_do_not_split(spark):
    m = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((40, 40, 4000, 8))], "thread_id long, seq long, content string")
    assert rows(sequence.token_windows(m, 20), "seq", "window") == [(0, 0), (1, 0), (2, 1), (3, 2)]


def test_batch_packing(spark):
    items = spark.createDataFrame([("p", i, n) for i, n in enumerate((50, 40, 500, 20, 20, 20))], "project string, pos long, tokens long")
    got = [b for _, b in rows(sequence.batch_packing(items, 100, 90, 2), "pos", "batch")]
    assert got == [0, 0, 1, 2, 2, 3]


def test_snapshot_diff_needs_two_days(spark):
    one = spark.createDataFrame([("2024-01-01", "n", "a", 1, 1, 1)], "snapshot_date string, name string, path string, bytes long, words long, headings long")
    assert joins.snapshot_diff(one).count() == 0
    two = one.union(spark.createDataFrame([("2024-01-02", "n", "a", 2, 1, 1), ("2024-01-02", "n", "b", 1, 1, 1)], one.schema))
    assert rows(joins.snapshot_diff(two), "path", "change") == [("a", "changed"), ("b", "added")]


def test_three_way_merge_takes_only_real_edits(spark):
    mk = lambda v: spark.createDataFrame([(1, "f", v)], "thread_id long, field string, value string")
    assert joins.three_way_merge(mk("a"), mk("b"), mk("a")).first().value == "b"
    assert joins.three_way_merge(mk("a"), mk("a"), mk("c")).first().value == "c"


def test_claim_fold_skips_superseded(spark):
    c = spark.createDataFrame([("p", i, i) for i in (1, 2, 3)], "project string, pos long, claim_id long")
    own = spark.createDataFrame([(3,)], "claim_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "claim_id long, newer long")
    others = spark.createDataFrame([(1, "q")], "claim_id long, other string")
    assert rows(text.claim_outcomes(c, own, pairs, others), "claim_id", "outcome") == [(1, "cross_project"), (2, "superseded"), (3, "captured")]


def test_shortlist_reads_whole_documents(spark):
    claim = "the harbour office keeps every tide table since the flood"
    noise = lambda n: "".join(f"q{i} z{i % 7} " for i in range(n))
    texts = {1: noise(2000) + claim, 2: noise(3000), 3: claim + " " + noise(2000), 4: claim, 5: ""}
    # across the places where windows of 2,000 characters end
    texts |= {100 + k: ("y " * 2500)[: 2000 * k - 20] + claim + " y" * 900 for k in (1, 2)}
    c, d = spark.createDataFrame([(1, claim, "p")], "claim_id long, claim string, project string"), spark.createDataFrame([*texts.items(), (6, None)], "chunk_id long, text string")
    got = rows(text.shortlist(c, d), "chunk_id", "claim_id")
    assert got == [(i, 1) for i in (1, 3, 4, 101, 102)]
    # of a claim with a project only the chunks of that project
    own = d.withColumn("project", F.when(F.col("chunk_id") > 3, "p").otherwise("q"))
    assert rows(text.shortlist(c, own), "chunk_id", "claim_id") == [(i, 1) for i in (4, 101, 102)]


def words_of(x):
    return set(x.lower().split())


def texts(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrst") * 2 for _ in range(rnd.randrange(1, 9))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        w = rnd.choice(base).split()
        w[rnd.randrange(len(w))] = rnd.choice(("new", "aa", ""))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("similarity", [0.5, 0.55, 0.7])
def test_like_pairs_lose_none(spark, similarity):
    rows_ = list(enumerate(texts(60, 4)))
    got = graph.components(text.like_pairs(spark.createDataFrame(rows_, "pos long, text string"), similarity).select("a", "b"))
    label = {i: i for i, _ in rows_}
    like = lambda x, y: words_of(x) and words_of(y) and len(words_of(x) & words_of(y)) / len(words_of(x) | words_of(y)) >= similarity
    changed = True
    while changed:
        changed = False
        for i, x in rows_:
            for j, y in rows_:
                if i != j and like(x, y) and label[j] > label[i]:
                    label[j], changed = label[i], True
    size = collections.Counter(label.values())
    assert dict(rows(got, "node", "label")) == {i: c for i, c in label.items() if size[c] > 1}


def test_leaders_follow_the_order(spark):
    rnd = random.Random(6)
    pairs = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(70)})
    want: dict[int, int] = {}
    for i in range(40):
        first = next((a for a in range(i) if want[a] == a and (a, i) in pairs), None)
        want[i] = i if first is None else first
    got = graph.leaders(spark.range(40).withColumnRenamed("id", "pos"), spark.createDataFrame(pairs, "a long, b long"))
    assert dict(rows(got, "pos", "leader")) == want


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(rows(graph.components(edges), "node", "label"))
    assert {got[i] for i in range(61)} == {0} and got[501] == 500


def test_claim_similarity_is_the_matched_run_length(spark):
    pairs = [("The Harbour keeps tables", "yes, the harbour office keeps the tables"), ("abc", ""), ("", "abc"), ("x" * 30, "y" * 400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string").select("i", text.claim_similarity("a", "b").alias("s"))
    runs = lambda a, b: sum(m.size for m in difflib.SequenceMatcher(None, a.casefold(), b.casefold()).get_matching_blocks()) / len(a) if a else 0.0
    assert rows(df, "i", "s") == [(i, runs(a, b)) for i, (a, b) in enumerate(pairs)]


def test_claim_pairs_are_of_one_project_and_newer(spark):
    c = spark.createDataFrame([("p", 1, 1, "the gate closes at nine every evening"), ("p", 2, 2, "the gate closes at eight every evening"), ("p", 3, 3, "unrelated words only"), ("q", 4, 4, "the gate closes at nine every evening")], "project string, pos long, claim_id long, claim string")
    assert rows(text.claim_pairs(c), "claim_id", "newer") == [(1, 2)]


def test_fuzzy_titles_against_all_pairs(spark):
    titles = [(1, "harbour office tables"), (2, "Harbour Tables"), (3, "nothing alike"), (4, "office")]
    names = [(10, "harbour tables"), (11, "harbour office"), (12, "garden")]
    got = {r.thread_id: (r.project_id, r.score) for r in text.fuzzy_titles(spark.createDataFrame(titles, "thread_id long, title string"), spark.createDataFrame(names, "project_id long, name string")).collect()}
    want = {}
    for i, x in titles:
        for j, y in names:
            a, b = x.lower(), y.lower()
            shared = {w for w in a.split() if len(w) >= 4} & {w for w in b.split() if len(w) >= 4}
            score = 1.0 if a == b else max(difflib.SequenceMatcher(None, a, b).ratio(), len(shared) / len(b.split()))
            if score >= 0.45 and (i not in want or round(score, 6) > want[i][1]):
                want[i] = (j, round(score, 6))
    assert got == want


def test_skeletons_meet_whatever_their_beginning(spark):
    body = "keeps every tide table since the flood of that winter and shows them on request"
    s = spark.createDataFrame([(1, "c", "user", "The harbour office " + body), (2, "c", "user", "ok"), (3, "c", "user", "far away")], "skeleton_id long, conversation_id string, role string, content string")
    p = spark.createDataFrame([(7, "user", "A harbour office " + body), (8, "user", "ok"), (9, "user", "nothing")], "pool_id long, role string, content string")
    assert rows(text.fuzzy_skeleton(s, p), "skeleton_id", "pool_id") == [(1, 7), (2, 8)]


def test_budget_without_an_estimate_is_refused(spark):
    c = spark.createDataFrame([(1, 1, 5), (1, 2, None)], "g long, id long, cost long")
    with pytest.raises(ValueError):
        scoring.rank_budget(c, "g", [F.col("id")], 10, 1.0)


def test_post_condition_tells_what_is_left(spark):
    census.must_be_empty(spark.range(0), "none")
    with pytest.raises(ValueError, match="3 rows left"):
        census.must_be_empty(spark.range(3), "some")


def test_order_statistics_take_ties_nulls_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0), ("a", None), (None, 4.0), ("b", None)], "k string, x double")
    got = sorted(((r.k or "", r.n, r.median, r.p25, r.p75, r.least, r.most) for r in census.calibration(df, ["k"], "x").collect()))
    assert got == [("", 1, 4.0, 4.0, 4.0, 4.0, 4.0), ("a", 3, 1.0, 1.0, 9.0, 1.0, 9.0)]


@pytest.mark.parametrize("similarity", [0.5, 0.7])
def test_like_pairs_equal_brute_force_in_any_blocks(spark, similarity):
    rnd = random.Random(11)
    rows_ = []
    for i in range(220):
        n = rnd.choice((1, 3, 8, 20, 60, 90))
        if rows_ and rnd.random() < 0.4:
            w = rnd.choice(rows_)[2].split()
            w = [x for x in w if rnd.random() > 0.15] + [f"n{rnd.randrange(50)}" for _ in range(rnd.randrange(4))]
        else:
            w = [f"w{int(rnd.random() ** 3 * 400)}" for _ in range(n)]
        rows_.append((i, f"p{i % 2}", " ".join(w)))
    df = spark.createDataFrame(rows_, "pos long, project string, text string")
    sets = {i: frozenset(x.split()) for i, _, x in rows_}
    rep = {}
    for i, p, _ in rows_:
        rep.setdefault((p, sets[i]), i)
        rep.setdefault(("", sets[i]), i)
    for group in (None, "project"):
        own = [(i, p if group else "") for i, p, _ in rows_]
        want = {}
        for i, p in own:
            for j, q in own:
                if p == q and i < j and sets[i] and sets[j] and sets[i] != sets[j] and rep[p, sets[i]] == i and rep[p, sets[j]] == j:
                    score = round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)
                    if score >= similarity:
                        want[i, j] = score
        for blocks, most in (((250_000, 8_000_000), 1_000_000), ((200, 300), 1_000_000), ((200, 300), 20)):
            got = [(r.a, r.b, r.score) for r in text.like_pairs(df, similarity, group, blocks, most).collect()]
            assert {(a, b): s for a, b, s in got if sets[a] != sets[b]} == want and len(want) > 20
            assert sum(sets[a] == sets[b] for a, b, _ in got) == sum(1 for i, p in own if sets[i] and rep[p, sets[i]] != i)


def test_texts_are_split_into_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def said(i):
        seen.add(1)
        return f"w{i // 2} common words w{i // 4}"

    items = spark.range(40).select(F.col("id").alias("pos"), F.udf(said, "string").asNondeterministic()("id").alias("text"))
    found = {(r.a, r.b) for r in text.like_pairs(items, 0.5).collect()}
    assert {(i, i + 1) for i in range(0, 40, 2)} <= found and seen.value == 40


def test_sets_that_share_few_tokens_do_not_become_pairs(spark):
    # every two of the sets share a rare token, as a join on single tokens would pair them
    rows_ = [(i, [(min(i, j) * 100 + max(i, j)) * 7919 for j in range(100) if j != i]) for i in range(100)]
    sets = spark.createDataFrame(rows_, "pos long, h array<long>")
    begun = text.rare_beginnings(sets, 0.5, []).withColumn("side", F.lit(0)).toArrow()
    assert begun.num_rows == 100 and len(text.met_pairs(begun, 0.5)[0]) == 0


def test_stretches_are_cut_alike_whenever_they_are_read(spark, monkeypatch, request):
    # a sketch that gives other cuts each time it is computed, as one of parts that arrive in another order may
    cut = F.udf(lambda x, y: sorted(random.SystemRandom().uniform(x, y) for _ in range(63)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda col, *_: cut(F.min(col), F.max(col)))
    # a plan reads a part of it twice or computes it twice, as its optimizer likes
    spark.conf.set("spark.sql.exchange.reuse", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.exchange.reuse"))
    df = spark.range(4000).selectExpr("'a' as k", "cast((id * 7919) % 3989 as double) as x", "id")
    x = sorted(float(i * 7919 % 3989) for i in range(4000))
    for _ in range(3):
        r = core.order_statistics(df, ["k"], "x").first()
        assert (r.n, r.median, r.p25, r.p75) == (4000, (x[1999] + x[2000]) / 2, x[1000], x[2999])
        sums = {r.id: r.s for r in core.running(df.withColumn("y", F.col("id").cast("double")), "k", "y", "id", "s").collect()}
        assert sums == {i: i * (i + 1) // 2 for i in range(4000)}


def test_one_large_group_is_ranked_and_summed_in_stretches(spark):
    from tidemark.functions.core import order_statistics, running, stretch_of

    df = spark.range(4001).selectExpr("if(id < 4000, 'a', null) as k", "cast((id * 7919) % 4000 as double) as x", "id", "cast(id % 3 as bigint) as v")
    cut, stretch = stretch_of(df, ["k"], "x")
    assert cut.groupBy("k", stretch.alias("s")).count().agg({"count": "max"}).first()[0] <= 400
    got = {r.k: (r.n, r.median, r.p25, r.p75, r.least, r.most) for r in order_statistics(df, ["k"], "x").collect()}
    alone = float(4000 * 7919 % 4000)
    assert got == {"a": (4000, 1999.5, 1000.0, 2999.0, 0.0, 3999.0), None: (1, alone, alone, alone, alone, alone)}
    sums = {r.id: r.s for r in running(df.where("k is not null"), "k", "id", "v", "s").collect()}
    assert sums == {i: sum(j % 3 for j in range(i + 1)) for i in range(4000)}
