"""Needles, nearest anchors and assignments against plain versions."""

import datetime as dt
import difflib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import automaton, joins, text
from tidemark.streaming import jobs


def test_needles_of_any_length(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc é日9") for _ in range(n))
    needles = [word(rng.randint(1, 5)) for _ in range(80)] + ["", "a", "a"]
    bodies = {i: word(rng.randint(0, 60)) for i in range(120)} | {500: None, 501: ""}
    t = spark.createDataFrame(list(bodies.items()), "text_id long, body string")
    n = spark.createDataFrame([(x, "z") for x in needles], "needle string, text_id string")

    def stands(needle, body, bounded):
        places = [i for i in range(len(body)) if body.startswith(needle, i)]
        free = lambda k: not 0 <= k < len(body) or body[k] not in "abc9"
        return any(not bounded or (free(i - 1) and free(i + len(needle))) for i in places)

    for bounded in (False, True):
        want = sorted((i, x) for i, b in bodies.items() if b for x in set(needles) if x and stands(x, b, bounded))
        for most in (automaton.MOST_CHARS, 40):
            got = automaton.find_all(t, n, bounded, most)
            assert sorted((r.text_id, r.needle) for r in got.collect()) == want
    assert automaton.find_all(t, n.limit(0)).count() == 0 and automaton.find_all(t.limit(0), n).count() == 0
    assert "Exchange" not in automaton.find_all(t, n)._jdf.queryExecution().executedPlan().toString()


def test_short_templates_and_keys_of_one_word(spark):
    threads = spark.createDataFrame([(1, "x", "please fix the CLI now"), (2, "P", "none")], "thread_id long, title string, first_text string")
    projects = spark.createDataFrame([("p", "P", "CLI"), ("q", "Q", "x")], "project_id string, name string, template string")
    assert sorted((r.thread_id, r.project_id, r.rule) for r in joins.exact_link(threads, projects).collect()) == [(1, "p", 2), (2, "p", 1)]
    key = "https://example.org/" + "a" * 50
    sheet = spark.createDataFrame([(1, key), (2, key + " today"), (3, "short")], "pos long, first_message string")
    said = spark.createDataFrame([("c", f"see  {key} today"), ("d", f"see {key}")], "conversation_id string, content string")
    got = joins.prefix_map(sheet, said.limit(0), said)
    assert sorted((r.pos, r.conversation_id, r["pass"]) for r in got.collect()) == [(1, "c", 2), (1, "d", 2), (2, "c", 2)]


def nearest(items, anchors, days=14, threshold=0.6):
    """Every item against every anchor that is near in time, or against all."""
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = []
    for i, day, v in items:
        near = [(a, w) for a, d, w in anchors if d and abs((day - d).days) <= days]
        asked = [(a, w) for a, d, w in anchors if d is None] + (near or [(a, w) for a, d, w in anchors if d])
        sims = [(round(cos(v, w), 6), -a) for a, w in asked if any(v) and any(w)]
        sim, a = max(sims, default=(None, None))
        out.append((i, -a if sim is not None and sim >= threshold else None, sim))
    return out


@pytest.mark.parametrize("clusters", [0, 5])
def test_nearest_anchor_is_exact_on_both_sides_of_the_limit(spark, clusters):
    rng = random.Random(clusters)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(clusters)]
    vector = lambda: [round(x + rng.gauss(0, 0.2), 3) for x in rng.choice(centres)] if clusters else [float(rng.randint(-2, 2)) for _ in range(6)]
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 400))
    anchors = [(k, None if rng.random() < 0.7 else day(), vector()) for k in range(400)]
    anchors += [(1000 + k, d, v) for k, d, v in anchors[:40]] + [(2000, None, [0.0] * 6)]
    items = [(k, day(), vector()) for k in range(150)] + [(900, dt.date(2020, 1, 1), [0.0] * 6), (901, dt.date(2020, 1, 1), anchors[3][2]), (902, dt.date(2020, 1, 1), anchors[3][2])]
    a = spark.createDataFrame(anchors, "anchor_id long, day date, v array<double>")
    i = spark.createDataFrame(items, "item_id long, day date, v array<double>")
    want = sorted(nearest(items, anchors))
    for limit, pivots in ((10_000, 256), (0, 256), (0, 16), (0, 1), (200, 16)):
        got = sorted((r.item_id, r.anchor_id, r.sim) for r in joins.nearest_anchor(i, a, broadcast_rows=limit, pivots=pivots).collect())
        assert got == want, (limit, pivots)
    if clusters:
        # the triangle inequality leaves a part of all pairs
        targets = a.where("day is null").select("anchor_id", F.col("v").alias("w"), joins.norm("v").alias("nw"))
        asks = i.select("item_id", "v", joins.norm("v").alias("nv"))
        found = joins.metric_candidates(asks, targets, 16)
        assert {r.item_id for r in found.collect()} == {x for x, _, v in items if any(v)}


def taking_turns(skeleton, pool, times=None, least=0.9):
    """Each message in turn takes the best free row of its role (between the anchors around it)."""
    taken, out = set(), []
    for key, conv, role, said in sorted(skeleton):
        own = sorted(k for k, c, _, _ in skeleton if c == conv)
        after = next((times[k] for k in reversed(own) if k <= key and times and k in times), None)
        before = next((times[k] for k in own if k >= key and times and k in times), None)
        best, ratio = None, least
        for row, other, content, at in sorted(pool):
            if row in taken or other != role or (at is not None and ((after is not None and at < after) or (before is not None and at > before))):
                continue
            r = difflib.SequenceMatcher(None, content, said).ratio()
            if r > ratio:
                best, ratio = row, r
        if best is not None:
            taken.add(best)
            out.append((key, best, round(ratio, 6), ratio < 0.97))
    return out


@pytest.mark.parametrize("with_anchors", [False, True])
def test_skeleton_takes_turns(spark, with_anchors):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("harbour", "meadow", "lantern", "granite", "willow", "copper") for b in ("ing", "ed", "s", "er")]
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(12)]
    vary = lambda s: s if rng.random() < 0.5 else s.replace(rng.choice(s.split()), rng.choice(words), 1) + rng.choice(["", ".", "!"])
    skeleton = [(k, f"c{k % 3}", rng.choice(["user", "assistant"]), vary(rng.choice(base))) for k in range(120)]
    pool = [(k, rng.choice(["user", "assistant"]), vary(rng.choice(base)), None if rng.random() < 0.3 else k) for k in range(110)]
    times = {k: k for k in range(0, 120, 7)} if with_anchors else None
    s = spark.createDataFrame(skeleton, "skeleton_id long, conversation_id string, role string, content string")
    p = spark.createDataFrame(pool, "pool_id long, role string, content string, at long")
    a = spark.createDataFrame(list(times.items()), "skeleton_id long, at long") if times else None
    got = sorted((r.skeleton_id, r.pool_id, r.ratio, r.review) for r in text.fuzzy_skeleton(s, p, a, rarest=30).collect())
    want = taking_turns(skeleton, pool, times)
    assert len(want) > 40 and got == want


def test_equal_messages_take_one_row_each(spark):
    body = "the same long message about the harbour and its lights"
    s = spark.createDataFrame([(k, "c", "user", body) for k in range(200)], "skeleton_id long, conversation_id string, role string, content string")
    p = spark.createDataFrame([(k, "user", body + ".") for k in range(150)], "pool_id long, role string, content string")
    got = sorted((r.skeleton_id, r.pool_id) for r in text.fuzzy_skeleton(s, p).collect())
    assert got == [(k, k) for k in range(150)]


def varied(rng, said, share):
    """A text some of whose characters are left out, and as many put in."""
    out = []
    for c in said:
        r = rng.random()
        out.append("" if r < share else c + rng.choice("abcdeft .") if r > 1 - share else c)
    return "".join(out)


@pytest.mark.parametrize("least", [0.9, 0.6])
def test_ratios_of_blocks_lose_no_pair(least):
    rng = random.Random(3)
    parts = ("th", "an", "tion", "er", "re", "on", "en", "of", "ing", "ble", "st", "wh", ".", ", ", " ", " ", " ", " ", "\n", "X")
    base = ["".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 3, 20, 60, 90, 110, 200)))) for _ in range(24)]
    some = lambda: [varied(rng, rng.choice(base), rng.choice((0, 0.005, 0.01, 0.03, 0.05, 0.08))) for _ in range(70)]
    asked, pool = some(), some()
    want = [(i, j, r) for i, x in enumerate(asked) for j, y in enumerate(pool) if (r := difflib.SequenceMatcher(None, y, x).ratio()) > least]
    assert sorted(text.ratios_above(asked, pool, least)) == want and sum(len(asked[i]) >= 200 for i, *_ in want) > 3


@pytest.mark.parametrize("blocks", [text.BLOCK_TEXTS, (5, 5)])
def test_skeletons_meet_without_a_common_word(spark, blocks):
    rng = random.Random(8)
    words = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(12))
    base = [words() for _ in range(12)]
    # every word has one character replaced or one more
    other = [" ".join(w[: k % 9] + "x" + w[k % 9 + 1 :] if k < 10 else w + "y" for k, w in enumerate(b.split())) for b in base]
    assert all(not set(x.split()) & set(y.split()) for x, y in zip(base, other, strict=True))
    sides = [[(k, "user", b) for k, b in enumerate(side)] + [(50, "user", ""), (51, None, "x" * 50)] for side in (base, other)]
    s = spark.createDataFrame(sides[0], "skeleton_id long, role string, content string").selectExpr("*", "struct(xxhash64(role, content) as k) as text_key", "'c' as conversation_id")
    p = spark.createDataFrame(sides[1], "pool_id long, role string, content string")
    least = 0.85
    want = sorted((i, j) for i, r, x in sides[0] for j, q, y in sides[1] if r and r == q and difflib.SequenceMatcher(None, y, x).ratio() > least)
    got = text.skeleton_candidates(s, p, least, blocks).join(s, "text_key").select("skeleton_id", "pool_id").collect()
    assert len(want) == 13 and sorted((r.skeleton_id, r.pool_id) for r in got) == want
    assert sorted((r.skeleton_id, r.pool_id) for r in text.fuzzy_skeleton(s.drop("text_key"), p, least=least).collect()) == want


def test_exact_link_does_not_pair_copies(spark, monkeypatch):
    threads = spark.range(300).selectExpr("id as thread_id", "concat('name ', id % 3) as title", "concat('about large ring ', id % 2) as first_text")
    projects = spark.range(300).selectExpr("concat('p', 1000 + id) as project_id", "concat('name ', 1 + id % 2) as name", "if(id % 7 = 3, 'ring 1', if(id % 7 = 5, 'large', null)) as template")
    met = []
    monkeypatch.setattr(joins, "latest", lambda df, keys, order, own=joins.latest: (met.append(df.count()), own(df, keys, order))[1])
    got = {r.thread_id: (r.project_id, r.rule) for r in joins.exact_link(threads, projects).collect()}
    assert met[0] <= 2 * 300
    assert got == {i: ({1: "p1000", 2: "p1001"}[i % 3], 1) if i % 3 else ("p1003" if i % 2 else "p1005", 2) for i in range(300)}


def test_title_coherence_tells_equal_titles_as_a_star(spark):
    left = spark.createDataFrame([(i, "large ring" if i < 40 else f"old {'gear' if i % 2 else 'bolt'}") for i in range(60)], "id long, title string")
    right = spark.createDataFrame([(100 + i, "Large  RING" if i < 30 else "big old gear") for i in range(50)], "id long, title string")
    got = sorted((r.l_id, r.r_id, r.score, r.links) for r in joins.title_coherence(left, right).where("l_id is not null and score is not null").collect())
    star = [(i, 100, 1.0, 1200) for i in range(40)] + [(0, 100 + i, 1.0, 1200) for i in range(1, 30)]
    assert got == sorted(star + [(i, 130, round(2 / 3, 6), 1) for i in range(41, 60, 2)])
    alone = joins.title_coherence(left, right).where("score is null").collect()
    assert {r.l_id for r in alone if r.l_id is not None} == set(range(40, 60, 2)) and {r.r_id for r in alone if r.r_id is not None} == set(range(131, 150)) and all(r.links == 0 for r in alone)


@pytest.mark.parametrize("most", [1000, 7])
def test_title_coherence_gives_every_pair_of_equal_titles(spark, most):
    from tests.compare import connect, duck_rows, spark_rows
    from tidemark.plans import catalog

    left = [(i, "large ring" if i < 40 else f"Gear {i % 3}" if i < 50 else None) for i in range(60)]
    right = [(100 + i, "Large  RING" if i < 30 else f"gear {i % 4}") for i in range(50)]
    l, r = (spark.createDataFrame(x, "id long, title string") for x in (left, right))
    want = [(i, j) for i, x in left for j, y in right if x and x.lower() == " ".join(y.lower().split())]
    got = joins.title_coherence(l, r, every=True).where("score = 1.0")
    assert len(want) > 1200 and sorted((x.l_id, x.r_id) for x in got.collect()) == want
    named = [df.select(F.col("id").alias(f"{p}_id"), "title") for df, p in ((l.where("id < 40"), "l"), (r.where("id < 130").withColumn("title", F.lit("large ring")), "r"))]
    some = joins.equal_pairs(*named, spark.createDataFrame([("large ring", 40, 30)], "title string, l_n long, r_n long"), most)
    assert sorted((x.l_id, x.r_id) for x in some.collect()) == [(i, 100 + j) for i in range(40) for j in range(30)]
    sf = "/root/testdata/sf0.001"
    rows = spark_rows(catalog.queries()["jn_title_coherence"](spark, sf))
    assert rows == duck_rows(connect(sf), catalog.oracle_sql()["jn_title_coherence"]) and rows[0] == ["l_id", "r_id", "score"]


def test_bounds_of_names_hold_and_leave_few_to_match():
    rng = random.Random(8)
    word = lambda n, of="abcdeé日 ": "".join(rng.choice(of) for _ in range(n))
    names = [(i, word(rng.choice((0, 1, 5, 40, 63, 64, 65, 90, 230)))) for i in range(150)]
    own, matched = text.NameSet(names), []
    own.ratio = lambda title, k, ratio=own.ratio: (matched.append(k), ratio(title, k))[1]
    for title in [word(rng.choice((1, 8, 60, 120))) for _ in range(15)] + ["", names[3][1], "xyz"]:
        ratios = [difflib.SequenceMatcher(None, title, n).ratio() for _, n in names]
        assert all(title == n or 2 * m / (len(title) + len(n)) >= r - 1e-12 for m, r, (_, n) in zip(own.in_order(title), ratios, names, strict=True))
        shared = [len(own.long_words(title) & own.long_words(n)) / max(1, len(own.long_words(n))) for _, n in names]
        score, minus = max((1.0 if title == n else round(max(r, s), 6), -i) for r, s, (i, n) in zip(ratios, shared, names, strict=True))
        assert own.best(title, 0.3) == ((-minus, score) if score >= 0.3 else None)
    # texts of the same characters in other orders: counts of characters would leave all of them to be matched
    letters = list("abcdefghijklmnopqrstuvwxyz")
    mixed = ["".join(rng.sample(letters, 26)) for _ in range(300)]
    few, matched = text.NameSet([*enumerate(mixed), (300, "".join(letters))]), []
    few.ratio = lambda title, k, ratio=few.ratio: (matched.append(k), ratio(title, k))[1]
    assert few.best("".join(letters[:25]), 0.45)[0] == 300 and len(matched) < 10


def test_the_decay_stream_takes_medians_of_plain_numbers():
    for values in ([1.0], [3.0, 1.0], [0.3, 0.1, 0.2], [4.0, 1.0, 2.5, 2.0], [float("nan"), 2.0, 1.0], [float("nan")]):
        assert jobs.middle(values) == pd.Series(values).median() or math.isnan(jobs.middle(values)) and len([v for v in values if v == v]) == 0


def test_ratios_are_taken_only_where_the_order_allows(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdeé日 ") for _ in range(n))
    base = [word(rng.choice((0, 3, 30, 230))) for _ in range(40)]
    pairs = [(x, x[:k] + word(2) + x[k:]) for x in base for k in (0, 5)] + [(x, y) for x in base[:12] for y in base[:12]]
    ratio = {(x, y): difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs}
    for x, y in pairs:
        assert 2 * text.common_in_order(text.ordered_bits(y), len(y), x) >= ratio[x, y] * (len(x) + len(y)) - 1e-9
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", text.ratio_above(0.6)("x", "y").alias("r")).collect()
    assert [(r.x, r.y, r.r) for r in got] == [(x, y, ratio[x, y] if ratio[x, y] > 0.6 else None) for x, y in pairs]
    # texts of the same characters in another order never reach the matcher
    ran = []
    monkeypatch.setattr(text.difflib, "SequenceMatcher", lambda *a, own=difflib.SequenceMatcher: (ran.append(a), own(*a))[1])
    mixed = pd.Series(["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) for _ in range(50)])
    assert text.ratio_above(0.9).func(mixed, mixed[::-1]).isna().sum() >= 48 and len(ran) <= 2


def test_nearest_anchor_takes_the_smallest_of_equal_anchors_in_any_block(spark):
    v = [0.3, -0.7, 0.2]
    a = spark.createDataFrame([(k, None if k % 2 else dt.date(2024, 1, 1 + k % 28), v if k % 3 else [-x for x in v]) for k in range(300)], "anchor_id long, day date, v array<double>")
    i = spark.createDataFrame([(k, dt.date(2024, 1, 20) if k else None, v) for k in range(40)], "item_id long, day date, v array<double>")
    got = joins.nearest_anchor(i, a)
    assert {(r.item_id, r.anchor_id, r.sim) for r in got.collect()} == {(0, 1, 1.0)} | {(k, 1, 1.0) for k in range(1, 40)}
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / 28)
    asks = i.select("item_id", "day", "v", joins.norm("v").alias("nv"), F.lit(False).alias("alone"))
    pairs = joins.block_candidates(asks, a.select("anchor_id", F.col("day").alias("anchor_day"), F.col("v").alias("w"), joins.norm("v").alias("nw")), 14, bucket, block_rows=7)
    # all pairs would be 300 an item: a block tells one anchor of each vector
    assert pairs.count() < 40 * 60 and pairs.where("item_id > 0").agg(F.min("anchor_id")).first()[0] <= 1


def test_pairs_of_a_key_are_joined_but_not_sorted(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = spark.createDataFrame([(1, 10, "p", day(1)), (2, 20, "p", day(2)), (2, 21, "p", day(1)), (3, 30, "p", day(1)), (3, 31, "q", day(2)), (4, 40, "p", day(1)), (None, 50, "p", day(1))], "key long, pos long, project string, row_day date")
    said = spark.createDataFrame([(1, 100, day(3)), (2, 200, day(4)), (2, 201, day(5)), (3, 300, day(1)), (3, 301, day(1)), (9, 900, day(1)), (None, 950, day(1))], "key long, conversation_id long, conv_day date")
    got = joins.ambiguity_pairing(rows, said)
    assert sorted(map(tuple, got.collect())) == [(10, 100, "match"), (20, 201, "paired"), (21, 200, "paired"), *[(r, c, "refused") for r in (30, 31) for c in (300, 301)]]
    # no window or count stands above the join of the pairs
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, ((key") < min(plan.index("Window"), plan.index("Aggregate"))


def test_long_needles_are_found_without_an_automaton(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é日😀") for _ in range(n))
    bodies = {i: word(rng.randint(0, 400)) for i in range(60)} | {100: None, 101: "a" * 300, 102: "ab" * 150}
    needles = [b[k : k + rng.randint(20, 90)] for b in bodies.values() if b for k in (0, 3, 77, 200)] + [word(30) for _ in range(20)] + ["a" * 20, "a" * 300, "a" * 301, "ba" * 20]
    needles = [x for x in needles if len(x) >= 20]
    texts = spark.createDataFrame(list(bodies.items()), "text_id long, body string")
    said = spark.createDataFrame([(x,) for x in needles], "needle string")
    monkeypatch.setattr(joins, "find_all", None)
    monkeypatch.setattr(automaton, "SLICE_CHARS", 500)
    got = sorted(map(tuple, automaton.find_long(texts, said, 20).collect()))
    assert got == sorted({(i, x) for i, b in bodies.items() if b for x in needles if x in b})
