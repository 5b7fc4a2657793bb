"""Operator 8 - language identification, word first with character backoff.

Spark counts, over all texts that may be learned from, the words and the byte
trigrams of each language. A known word is scored by its log frequency in each
language; any other word is scored by trigrams, which back off to bigrams and
single symbols. Known are the words that make up at least ``min_share`` of some
language's words and occur twice, or with ``min_share`` 0 all words.

Scale: map passes that count and that score; texts are never shuffled. The
model's size has a proven bound: at most 1 / ``min_share`` known words per
language and 155**3 trigrams. With ``min_share`` 0 there is no such bound, so
only frequent words are broadcast, in ``CELLS`` numbers at most. The others
are looked up by a join: a document sends each of its rarer words with the
number of times it stands there, and gets back sums, a number a language.
Scores are integers there (``UNIT`` to a nat), so that no sum depends on the
order of its parts. Which words are broadcast changes no result. A word that
texts without a known language repeat is told too, so no key of the join holds
more than ``told_share`` of the words of a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import LETTERS, N_SYMBOLS, SYMBOL, fold_case, held_out, trigram_codes
from .shared import keep
from .textops import U64, chunks_of, span_hash, text_buffer, word_spans

CHUNK = 1 << 20
BACKOFF = np.log(0.4)
WORDS, GRAMS, OTHERS = 0, 1, 2
#: Words whose evidence a score counts.
MOST_WORDS = 20
#: Words that make up at least this share of a language are broadcast, fewer if they fill more than so many numbers.
TOLD_SHARE, CELLS = 1e-6, 1 << 25
#: Units of a nat in sums of integers.
UNIT = 1 << 20


def count_rows(batches):
    """(lang, kind, key, n) of the words and trigrams of each language in a partition; of texts without one, the words as ``OTHERS``."""
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        data, offsets = text_buffer(batch["text"])
        names = sorted(set(langs), key=lambda x: (x is None, x))
        code = np.array([names.index(x) for x in langs], np.int64)
        found: list[list[np.ndarray]] = [[] for _ in names]
        for a, b in chunks_of(offsets, CHUNK):
            part, off = fold_case(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            s, e, row = word_spans(part, off, LETTERS)
            h = span_hash(part, s, e)
            tri = trigram_codes(part, off)
            of_word, of_byte = code[a + row], np.repeat(code[a:b], np.diff(off))
            for i in np.unique(code[a:b]).tolist():
                found[i].append(h[of_word == i])
                if names[i] is None:
                    continue
                total = grams.setdefault(names[i], np.zeros(N_SYMBOLS**3, np.int64))
                total += np.bincount(tri[of_byte == i], minlength=N_SYMBOLS**3)
        for i, hashes in enumerate(found):
            key, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, U64), np.zeros(0, int))
            yield _rows(names[i] or "", OTHERS if names[i] is None else WORDS, key.view(np.int64), n)
    for lang, total in grams.items():
        code = np.flatnonzero(total)
        yield _rows(lang, GRAMS, code, total[code])


def _rows(lang: str, kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), pa.array(key, pa.int64()), pa.array(n, pa.int64())],
        ["lang", "kind", "key", "n"],
    )


class LanguageModel:
    def __init__(self, langs: list[str], words: tuple, grams: tuple, totals: np.ndarray):
        """``words`` and ``grams`` are (key, language number, count); ``totals`` the words of each language."""
        self.langs, n = langs, len(langs)
        self.totals = totals
        self.learn_words(*words)
        code, lang, count = grams
        self.codes, at = np.unique(code, return_inverse=True)
        tri = np.zeros((len(self.codes), n))
        np.add.at(tri, (at, lang), count)
        bi = np.zeros((N_SYMBOLS**2, n))
        np.add.at(bi, self.codes % N_SYMBOLS**2, tri)
        uni = bi.reshape(N_SYMBOLS, N_SYMBOLS, n).sum(0) + 0.5
        context = np.zeros((N_SYMBOLS**2, n))
        np.add.at(context, self.codes // N_SYMBOLS, tri)
        before = bi.reshape(N_SYMBOLS, N_SYMBOLS, n).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.uni = np.log(uni / uni.sum(0))
            pair = np.log(bi / before[np.arange(N_SYMBOLS**2) // N_SYMBOLS])
            self.pair = np.where(bi > 0, pair, BACKOFF + self.uni[np.arange(N_SYMBOLS**2) % N_SYMBOLS])
            full = np.log(tri / context[self.codes // N_SYMBOLS])
            self.tri = np.where(tri > 0, full, BACKOFF + self.pair[self.codes % N_SYMBOLS**2]).astype(np.float32)
        self.pair = (BACKOFF + self.pair).astype(np.float32)

    def learn_words(self, key: np.ndarray, lang: np.ndarray, count: np.ndarray) -> None:
        self.known, at = np.unique(key.view(np.uint64), return_inverse=True)
        table = np.zeros((len(self.known), len(self.langs)))
        np.add.at(table, (at, lang), count)
        self.word = np.log((table + 0.5) / (self.totals + 1.0)).astype(np.float32)

    def word_scores(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(s), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        out[hit] = self.word[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            size = e[new] - s[new]
            first = np.cumsum(size) - size
            at = np.repeat(s[new] - first, size) + np.arange(size.sum())
            sym = SYMBOL[data[at]]
            begins = np.zeros(len(sym), bool)
            begins[first] = True
            p1 = np.where(begins, 0, np.concatenate(([0], sym[:-1])))
            p2 = np.where(begins, 0, np.concatenate(([0], p1[:-1])))
            pair = p1 * N_SYMBOLS + sym
            code = p2 * N_SYMBOLS**2 + pair
            i = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
            seen = self.codes[i] == code if len(self.codes) else np.zeros(len(code), bool)
            score = self.pair[pair]
            score[seen] = self.tri[i[seen]]
            out[new] = np.add.reduceat(score, first, axis=0)
        return out


def identify(column, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    n = len(column)
    names, scores = ["und"] * n, np.zeros(n)
    data, offsets = text_buffer(column)
    for a, b in chunks_of(offsets, CHUNK):
        part, off = fold_case(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, off, LETTERS)
        if not len(s):
            continue
        h = span_hash(part, s, e)
        _, first, inv = np.unique(h, return_index=True, return_inverse=True)
        by_word = model.word_scores(part, s[first], e[first], h[first])[inv]
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        total = np.add.reduceat(by_word.astype(np.float64), start, axis=0)
        words = np.diff(np.append(start, len(row)))
        docs = row[start]
        total = total / words[:, None] * np.minimum(words, MOST_WORDS)[:, None]
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        ascii_letters = np.concatenate(([0], np.cumsum((SYMBOL[part] > 0) & (SYMBOL[part] < 27))))
        plain = ascii_letters[off[docs + 1]] > ascii_letters[off[docs]]
        for i, d in enumerate(docs.tolist()):
            if plain[i] or any(c.isalpha() for c in part[off[d] : off[d + 1]].tobytes().decode("utf-8", "ignore")):
                k = int(p[i].argmax())
                names[a + d], scores[a + d] = model.langs[k], float(p[i, k])
    return names, scores


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_share: float = 1e-5, told_share: float = TOLD_SHARE) -> DataFrame:
    """Predict the language of every text.

    Returns (``id_col``, held_out, lang_pred, score), a row for each input row.
    Learns from rows that are not held out (see ``folds``) and have a language;
    texts that are null or have no letter, and all texts if nothing was
    learned, are ``und`` with score 0. The score is the probability of the
    language if its words' mean evidence is counted for ``MOST_WORDS`` words at
    most, so that long texts keep apart from 1. Ties go to the alphabetically
    first language. Other columns are ignored. With ``min_share`` 0, words of
    a share below ``told_share`` are joined, not broadcast; no result depends on it.
    """
    base = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learned = F.expr("not held_out and lang is not null and text is not null")
    rows = base.where("text is not null" if min_share == 0 else learned).select(F.when(learned, F.col("lang")).alias("lang"), "text").mapInArrow(count_rows, "lang string, kind int, key long, n long")
    counts = keep(rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.where(F.col("kind") == WORDS).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    id_type = base.schema["id"].dataType.simpleString()
    if not langs:
        return base.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if min_share == 0:
        return by_all_words(base.withColumn("learned", learned), counts, langs, totals, id_type, told_share).withColumnRenamed("id", id_col)
    least = F.create_map(*[F.lit(x) for lang in langs for x in (lang, totals[lang] * min_share)])
    known = counts.where((F.col("kind") == WORDS) & (F.col("n") >= least[F.col("lang")]) & (F.col("n") > 1)).select("lang", "key", "n").toArrow()
    number = np.array([langs.index(x) for x in known["lang"].to_pylist()], np.int64)
    model = LanguageModel(langs, (known["key"].to_numpy(), number, known["n"].to_numpy()), gram_counts(counts, langs), np.array([totals[x] for x in langs], float))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            names, scores = identify(batch["text"], shared.value)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores)], ["id", "held_out", "lang_pred", "score"])

    return base.select("id", "held_out", "text").mapInArrow(predict, f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def gram_counts(counts: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, language number, count) of all trigrams of texts with words."""
    table = counts.where((F.col("kind") == GRAMS) & F.col("lang").isin(langs)).select("lang", "key", "n").toArrow()
    return table["key"].to_numpy(), np.array([langs.index(x) for x in table["lang"].to_pylist()], np.int64), table["n"].to_numpy()


class ToldWords:
    """What is broadcast: the trigrams, and integer scores of the frequent words."""

    def __init__(self, model: LanguageModel, keys: np.ndarray, counts: np.ndarray):
        """``counts`` has a row for each told word; a row of zeros is a frequent word that no learned text holds."""
        self.model, order = model, np.argsort(keys.view(U64))
        self.keys, counts = keys.view(U64)[order], counts[order]
        self.is_known = counts.any(1)
        self.scores = np.rint(UNIT * np.log((counts + 0.5) / (model.totals + 1.0))).astype(np.int32)
        #: Score of a known word in a language that does not have it.
        self.absent = np.rint(UNIT * np.log(0.5 / (model.totals + 1.0))).astype(np.int64)

    def read(self, column, learned: np.ndarray):
        """For each chunk of texts: (its rows, words, has a letter, sums of the scores known here, rarer words of its texts)."""
        data, offsets = text_buffer(column)
        n_langs = len(self.absent)
        for a, b in chunks_of(offsets, CHUNK):
            part, off = fold_case(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            s, e, row = word_spans(part, off, LETTERS)
            h, first, inv = np.unique(span_hash(part, s, e), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
            told = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
            score = np.zeros((len(h), n_langs), np.int64)
            hit = told.copy()
            hit[told] = self.is_known[at[told]]
            score[hit] = self.scores[at[hit]]
            # whatever is not known is read by its characters until the join tells otherwise
            rest = np.flatnonzero(~hit)
            score[rest] = np.rint(UNIT * self.model.word_scores(part, s[first[rest]], e[first[rest]], h[rest]).astype(np.float64)).astype(np.int64)
            sums, words = np.zeros((b - a, n_langs), np.int64), np.bincount(row, minlength=b - a)
            sure = learned[a:b][row] & ~told[inv]
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            if len(row):
                sums[row[start]] = np.add.reduceat(np.where(sure[:, None], self.absent, score[inv]), start, axis=0)
            rare = np.flatnonzero(~told[inv])
            pair, times = np.unique(row[rare] * max(1, len(h)) + inv[rare], return_counts=True)
            doc, word = pair // max(1, len(h)), pair % max(1, len(h))
            yield a, b, words, letters_in(part, off, words), sums, (doc, h[word], times, (self.absent - score[word]) * times[:, None])


def letters_in(part: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    plain = np.concatenate(([0], np.cumsum((SYMBOL[part] > 0) & (SYMBOL[part] < 27))))
    has = plain[off[1:]] > plain[off[:-1]]
    for d in np.flatnonzero(~has & (words > 0)).tolist():
        has[d] = any(c.isalpha() for c in part[off[d] : off[d + 1]].tobytes().decode("utf-8", "ignore"))
    return has


def by_all_words(base: DataFrame, counts: DataFrame, langs: list[str], totals: dict[str, int], id_type: str, told_share: float) -> DataFrame:
    """Predictions by the counts of all words, of which the rarer are joined."""
    n_langs, spark = len(langs), base.sparkSession
    others = counts.where(F.col("kind") == OTHERS).agg(F.sum("n")).first()[0] or 0
    share = max(told_share, (n_langs + 1) * n_langs / CELLS)
    of_lang = [F.sum(F.when((F.col("kind") == WORDS) & (F.col("lang") == lang), F.col("n"))) for lang in langs]
    by_word = counts.where(F.col("kind") != GRAMS).groupBy("key").agg(
        *[F.coalesce(n, F.lit(0)).alias(f"n{i}") for i, n in enumerate(of_lang)], F.coalesce(F.sum(F.when(F.col("kind") == OTHERS, F.col("n"))), F.lit(0)).alias("others")
    )
    sizes = [*[(f"n{i}", totals[lang]) for i, lang in enumerate(langs)], ("others", others)]
    frequent = F.greatest(*[F.when(F.col(c) > 0, F.col(c) >= F.lit(share * n)).otherwise(F.lit(False)).cast("int") for c, n in sizes]) == 1
    table = by_word.where(frequent).toArrow()
    told = np.stack([table[f"n{i}"].to_numpy() for i in range(n_langs)], 1).astype(np.float64)
    none = np.zeros(0, np.int64)
    model = LanguageModel(langs, (none, none, none), gram_counts(counts, langs), np.array([totals[x] for x in langs], float))
    shared = spark.sparkContext.broadcast(ToldWords(model, table["key"].to_numpy(), told))

    def numbers(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n_langs), pa.int32()), pa.array(x.ravel(), pa.int64()))

    def read(batches):
        for batch in batches:
            learned = batch["learned"].to_numpy(zero_copy_only=False).astype(bool)
            for a, b, words, letter, sums, _ in shared.value.read(batch["text"], learned):
                kept = [batch[c].slice(a, b - a) for c in ("id", "hash", "held_out")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), pa.array(letter), numbers(sums)], ["id", "hash", "held_out", "words", "letter", "sums"])

    def ask(batches):
        for batch in batches:
            learned = batch["learned"].to_numpy(zero_copy_only=False).astype(bool)
            for a, _, _, _, _, (doc, key, times, change) in shared.value.read(batch["text"], learned):
                sure = learned[a + doc]
                # a learned text's words are known, so that the others alone carry what changes if a word is
                offsets = np.concatenate(([0], np.cumsum(np.where(sure, 0, n_langs))))
                changes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(change[~sure].ravel(), pa.int64()))
                own = [batch[c].take(pa.array(a + doc)) for c in ("id", "hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(key.view(np.int64)), pa.array(times, pa.int64()), changes], ["id", "hash", "key", "times", "change"])

    texts = base.withColumn("hash", F.xxhash64("text"))
    inputs = texts.select("id", "hash", "held_out", F.coalesce("learned", F.lit(False)).alias("learned"), "text")
    read_rows = inputs.mapInArrow(read, f"id {id_type}, hash long, held_out boolean, words long, letter boolean, sums array<long>")
    asked = inputs.drop("held_out").mapInArrow(ask, f"id {id_type}, hash long, key long, times long, change array<long>")
    gain = [F.round(F.lit(float(UNIT)) * F.log((F.col(f"n{i}") + 0.5) / 0.5)).cast("long").alias(f"g{i}") for i in range(n_langs)]
    rare = by_word.where(~frequent & (F.greatest(F.lit(0), *[F.col(f"n{i}") for i in range(n_langs)]) > 0)).select("key", *gain)
    change = [(F.col("times") * F.col(f"g{i}") + F.coalesce(F.get("change", F.lit(i)), F.lit(0))).alias(f"v{i}") for i in range(n_langs)]
    gained = asked.join(rare, "key").select("id", "hash", *change, F.lit(0).alias("copies"))
    # equal rows ask alike, and their sums are divided among them
    marks = texts.select("id", "hash", *[F.lit(0).cast("long").alias(f"v{i}") for i in range(n_langs)], F.lit(1).alias("copies"))
    summed = gained.unionByName(marks).groupBy("id", "hash").agg(*[F.sum(c).alias(c) for c in (*[f"v{i}" for i in range(n_langs)], "copies")])
    r, g = read_rows.alias("r"), summed.alias("g")
    joined = r.join(g, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.hash") == F.col("g.hash")))
    nats = F.array(*[F.expr(f"(r.sums[{i}] + g.v{i} div g.copies) / {float(UNIT)}D / greatest(r.words, 1) * least(r.words, {MOST_WORDS})") for i in range(n_langs)])
    und = ~F.col("letter") | (F.col("words") == 0)
    best = F.array_max("nats")
    share_of_best = 1 / F.aggregate("nats", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    return joined.select("r.id", "r.held_out", "r.letter", "r.words", nats.alias("nats")).select(
        "id",
        "held_out",
        F.when(und, F.lit("und")).otherwise(F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("nats", best) - 1).cast("int"))).alias("lang_pred"),
        F.when(und, F.lit(0.0)).otherwise(share_of_best).alias("score"),
    )
