"""Operators 3, 4, 7 and 8: brute force, recall and held-out accuracy."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.language_id import language_id
from tidemark.llm.folds import N_SYMBOLS, SYMBOL, fold_case
from tidemark.llm.license_scan import MARKUP, Automaton, license_scan, word_hash
from tidemark.llm.license_templates import TEMPLATES
from tidemark.llm.permutation_index import footrule, nearest_neighbours, permutations, places
from tidemark.llm.queries import QUERIES
from tidemark.llm.toxicity import char_model, lattice, reader, toxicity

SF = "/root/testdata/sf0.01"


def accepts(markup, text):
    return Automaton.compile("x", markup).accepts(word_hash(text.split()))


def test_automata():
    assert accepts("a [b c] d", "a d") == 2 and accepts("a [b c] d", "a b c d") == 4 and not accepts("a [b c] d", "a b d")
    assert accepts("a {2} d", "a x d") == 3 and accepts("a {2} d", "a x y d") == 4 and not accepts("a {2} d", "a d")
    assert accepts("a [b [c] d]", "a b d e") == 3 and accepts("a [b [c] d]", "a x") == 1


def wordings(markup):
    """The shortest and the longest wording of a template, and where mandatory words stand in the shortest."""
    short, long, sure, depth = [], [], [], 0
    for part in MARKUP.findall(markup.lower()):
        if part in "[]":
            depth += 1 if part == "[" else -1
        elif part[0] == "{":
            long += [f"any{k}" for k in range(int(part[1:-1]))]
            short += [] if depth else ["any"]
        else:
            long.append(part)
            if not depth:
                sure.append(len(short))
                short.append(part)
    return short, long, sure


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_op3_template_needs_every_mandatory_word(number):
    label, markup = TEMPLATES[number]
    auto = Automaton.compile(label, markup)
    short, long, sure = wordings(markup)
    assert auto.accepts(word_hash(short)) == len(short) and auto.accepts(word_hash(long)) == len(long)
    for at in sure:
        changed = list(short)
        changed[at] = "changedword"
        assert not auto.accepts(word_hash(changed)), (label, at, short[at])
    assert not auto.accepts(word_hash(short[:-1]))


def test_op3_labels_and_awkward_rows(spark):
    mit = dict(TEMPLATES)["mit-text"].replace("{10}", "THE AUTHORS OR COPYRIGHT HOLDERS").replace("[", "").replace("]", "")
    half = mit[: len(mit) // 2]
    rows = [(1, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit), (1, half), (None, mit), (2, "word " * 300_000 + mit), (2, "word " * 300_000 + mit), (3, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, labels string, id int")
    got = sorted(((r.doc_id or 0, r.labels, r.score) for r in license_scan(df).collect()), key=repr)
    assert got == sorted([(0, "mit-text", 1.0), (1, "mit,mit-text", 1.0), (1, "", 0.0), (2, "mit-text", 1.0), (2, "mit-text", 1.0), (3, "mit,mit-mention", 1.0)], key=repr)


def test_op3_base_phrases(spark):
    rows = [(1, "MIT License; mit-license"), (2, None), (3, ""), (4, "the Apache\nLicense, Version 2.0 mit"), (5, "xmit license"), (6, "GNU General Public License general public license")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in range(1, 7)] == [
        (2, 0, 2, "mit"), (0, None, None, ""), (0, None, None, ""), (1, 1, 1, "apache"), (0, None, None, ""), (2, 1, 4, "gpl"),
    ]
    assert license_scan(df.limit(0)).count() == 0


def test_op3_on_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op3_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
        n = sum(w[i : i + len(p)] == p for p in ([b"mit", b"license"], [b"apache", b"license"], [b"general", b"public", b"license"]) for i in range(len(w)))
        assert (got[r.doc_id].n_words, got[r.doc_id].n_base) == (len(w), n)
        assert got[r.doc_id].score == 0 or got[r.doc_id].labels


def recall(found, ids, x, queries, k=10):
    hit = 0
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:k]].tolist()) & set(found[q]))
    return hit / (k * len(queries))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op4_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.to_numpy()
    found = {}
    for r in QUERIES["op4_permutation_index"](spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r.query_id, {})[r.vec_id] = (r["rank"], r.score, r.n_ranked)
    asked = ids[ids % 100 == 0].tolist()
    assert recall(found, ids, x, asked) >= 0.9
    for q in asked:
        assert sorted(rank for rank, _, _ in found[q].values()) == list(range(1, 11))
    # these vectors have no structure, and still most are never ranked by true distance
    assert np.mean([max(n for *_, n in found[q].values()) for q in asked]) < 0.6 * len(ids)


def test_op4_effort_falls_with_structure(spark):
    rng = np.random.default_rng(1)
    share = {}
    for n in (2000, 8000):
        centre = rng.normal(size=(n // 40, 24)) * 3
        x = (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, 24)) / 2).astype(np.float32)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        found, ranked = {}, {}
        for r in nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
            ranked[r.query_id] = r.n_ranked
        assert recall(found, np.arange(n), x.astype(float), range(0, n, 100)) >= 0.9
        share[n] = np.mean(list(ranked.values())) / n
    assert share[8000] < share[2000] < 0.2


def test_op4_footrule():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(30, 5)), rng.normal(size=(12, 5))
    perm = permutations(x, pivots, 7)
    for i in range(5):
        want = []
        for j in range(30):
            a, b = perm[i].tolist(), perm[j].tolist()
            at = lambda p, c: p.index(c) if c in p else 7
            want.append(sum(abs(at(a, c) - at(b, c)) for c in range(12)))
        assert footrule(places(perm, 12), perm[i].astype(int)).tolist() == want


def test_op4_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    # equal rows of a query are one query
    asked = df.where("vec_id % 2 = 0").union(df.where("vec_id = 2"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, asked).collect())
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 2), (2, 1, 0), (2, 2, 1), (2, 3, 7)]
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_op4_short_queries_meet_every_vector(spark):
    # one file and a visit that finds nothing else: the far vectors are still returned
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(100 + i, [1000.0 + i, -5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in nearest_neighbours(df, df.where("vec_id = 100"), k=10, pivots=8, post=1, recall=0.2, trials=3).collect())
    assert got == [(1, 101), (2, 102), (3, 103), (4, 39), (5, 38), (6, 37), (7, 36), (8, 35), (9, 34), (10, 33)]


def test_op7_held_out(spark):
    got = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    n = {(r.toxic, r.predicted): r["count"] for r in got.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03


def disguised(word, k):
    """A word as those who hide it write it."""
    leet = str.maketrans("aeiost", "4310$7")
    middle = len(word) // 2
    return [word.translate(leet), " ".join(word), "-".join(word), word[:middle] + word[middle] * 4 + word[middle + 1 :], ".".join(word.translate(leet))][k % 5]


def test_op7_reads_disguised_words(spark):
    """Held-out toxic texts whose telling words are disguised are found; without the decoder they hold no cue."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id").where("toxic is not null and text is not null").collect()
    words = lambda t: set(re.findall(r"[^\W\d_]+", t.lower()))
    bad, good = (collections.Counter(w for r in rows if r.toxic == x for w in words(r.text)) for x in (1, 0))
    telling = [w for w in sorted(bad, key=bad.get, reverse=True)[:400] if bad[w] >= 60 and bad[w] > 10 * good[w]]
    assert len(telling) >= 5
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic = [r for r in held if r.toxic and words(r.text) & set(telling)][:60]
    pattern = re.compile(rf"(?i)(?<!\w)({'|'.join(telling)})(?!\w)")
    made = [(10**9 + 5 * k, pattern.sub(lambda m, k=k: disguised(m[0].lower(), k), r.text)) for k, r in enumerate(toxic)]
    made = [(next(i for i in range(a, a + 10**6) if zlib.crc32(str(i).encode()) % 5 == 0), t) for a, t in ((a * 3, t) for a, t in made)]
    assert not any(words(t) & set(telling) for _, t in made)
    got = {r.doc_id: r for r in toxicity(docs.unionByName(spark.createDataFrame(made, docs.schema)), labels).where("doc_id >= 1000000000").collect()}
    found = sum(got[i].predicted for i, _ in made)
    assert found >= 0.85 * len(made) and all(got[i].n_restored > 0 for i, _ in made if got[i].predicted)


def test_op7_fold_and_empty(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ((1, "loser"), (2, None), (3, ""), (None, "x"))], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in (1, 2, 3))
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_op7_repeated_rows_and_long_texts(spark):
    ids = [i for i in range(1, 90) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"someone said {chr(97 + i % 26)}{chr(97 + i // 26)} {'loser' if k % 2 else 'friend'} {chr(99 + i // 26)}{chr(97 + i % 26)} again") for k, i in enumerate(ids)]
    rows += [(500, "calm words " * 300_000 + "loser"), (500, "calm words " * 300_000 + "loser"), (501, "calm words " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = [(r.doc_id, r.predicted) for r in toxicity(docs, labels).where("doc_id >= 500").collect()]
    assert sorted(got) == [(500, 1), (500, 1), (501, 0)]


def test_decoder_restores_words(spark):
    text = "the loser and the idiot said that a pathetic moron is stupid trash " * 20
    read = reader(char_model(spark.createDataFrame([(text,)], "text string"), "text"))
    for hidden, plain in {"l0ser": "loser", "1d10t": "idiot", "p4th3tic": "pathetic", "m.o.r.o.n": "moron", "t r a s h": "trash", "stuuupid": "stupid", "id!ot": "idiot", "p@thet!c": "pathetic"}.items():
        assert read(hidden) == plain
    assert lattice("ab") == [("a",), ("b",)]


def test_op8_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = QUERIES["op8_language_id"](spark, SF).where("held_out").join(docs, "doc_id").selectExpr("avg(cast(lang_pred = lang as int)) as a").first()
    assert r.a > 0.97


@pytest.mark.parametrize("rows, want", [([(1, None, "en"), (2, "", "en"), (3, "12 .", "en"), (4, "…", "de")], "und")])
def test_op8_und(spark, rows, want):
    df = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    got = language_id(df).collect()
    assert [r.lang_pred for r in got] == [want] * 4 and language_id(df.limit(0)).count() == 0


def brute_language(rows, known=lambda n, total: True):
    """Scores of every text by the definition: log frequency of known words, else trigrams with backoff."""
    learned = [(x, lang) for i, x, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None and x is not None]
    langs = sorted({lang for _, lang in learned})
    fold = lambda x: fold_case(np.frombuffer(x.encode(), np.uint8)).tobytes()
    words = lambda x: re.findall(rb"[A-Za-z\x80-\xff]+", fold(x))
    count = {lang: collections.Counter() for lang in langs}
    tri = {lang: collections.Counter() for lang in langs}
    for x, lang in learned:
        count[lang].update(words(x))
        s = [0, 0, *SYMBOL[np.frombuffer(fold(x), np.uint8)].tolist()]
        tri[lang].update((s[k - 2] if s[k - 1] else 0, s[k - 1], s[k]) for k in range(2, len(s)))
    total = {lang: sum(count[lang].values()) for lang in langs}
    sums = {lang: [collections.Counter() for _ in range(4)] for lang in langs}
    for lang in langs:
        for (a, b, c), n in tri[lang].items():
            for table, key in zip(sums[lang], ((a, b), (b, c), b, c), strict=True):
                table[key] += n

    def of_gram(lang, a, b, c):
        context, pair, before, last = sums[lang]
        uni = math.log((last[c] + 0.5) / (sum(last.values()) + 0.5 * N_SYMBOLS))
        back = math.log(0.4)
        two = math.log(pair[b, c] / before[b]) if pair[b, c] else back + uni
        return math.log(tri[lang][a, b, c] / context[a, b]) if tri[lang][a, b, c] else back + two

    out = {}
    for i, x, _ in rows:
        ws = words(x or "")
        if not any(ch.isalpha() for ch in x or ""):
            out[i] = ("und", 0.0)
            continue
        total_score = []
        for lang in langs:
            score = 0.0
            for w in ws:
                if any(known(count[k][w], total[k]) and count[k][w] for k in langs):
                    score += math.log(((count[lang][w] if known(count[lang][w], total[lang]) else 0) + 0.5) / (total[lang] + 1))
                else:
                    s = [0, 0, *SYMBOL[np.frombuffer(w, np.uint8)].tolist()]
                    score += sum(of_gram(lang, s[k - 2], s[k - 1], s[k]) for k in range(2, len(s)))
            total_score.append(score / len(ws) * min(len(ws), 20))
        p = np.exp(np.array(total_score) - max(total_score))
        out[i] = (langs[int(p.argmax())], float(p.max() / p.sum()))
    return out


@pytest.mark.parametrize("min_share", [0, 0.02])
def test_op8_equals_brute_force(spark, min_share):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).select("doc_id", F.col("text").substr(1, 600).alias("text"), "lang").collect()
    rows = [tuple(r) for r in docs] + [(9001, "Über zzyzx qqq", None), (9002, None, "en"), (9003, "42 !", "de"), (9004, "und the und the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_language(rows, lambda n, total: n > 1 and n >= total * min_share if min_share else n > 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(df, min_share=min_share).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-3 for i in want)


@pytest.mark.parametrize("told_share", [0.0, 0.01, 2.0])
def test_op8_words_joined_or_broadcast(spark, told_share):
    """Any word may be joined instead of broadcast; rows with equal ids and texts share their sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    rows += [(5001, "new words nobody learned " * 3, None), (5002, "", "en"), (5003, "der die zzz yyy", "de")]
    again = [*rows, rows[3], rows[3], rows[-1], rows[-3], (None, rows[0][1], "xx")]
    want = brute_language(again)
    df = spark.createDataFrame(again, "doc_id long, text string, lang string")
    got = language_id(df, min_share=0, told_share=told_share).collect()
    assert len(got) == len(again)
    for r in got:
        if r.doc_id is not None:
            assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == rows[3][0]}) == 1


def test_op8_ties_repeated_rows_and_long_texts(spark):
    rows = [(1, "aa bb", "x"), (2, "aa bb", "y"), (3, "cc dd " * 200_000, None), (3, "cc dd " * 200_000, None), (None, "aa bb", "x")]
    learned = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    assert sorted(map(str, language_id(df, min_share=0, told_share=2.0).collect())) == sorted(map(str, language_id(df, min_share=0).collect()))
    got = language_id(df).collect()
    # what is equally likely goes to the first of the learned languages
    assert len(got) == 5 and {r.lang_pred for r in got} == {"xy"[learned[0] - 1]}
