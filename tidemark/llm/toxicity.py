"""Operator 7 - toxicity of text restored by a noisy-channel decoder.

A character model (trigram counts of the whole corpus) and cue weights (words
and word beginnings, from labelled rows) are learned by Spark aggregations.
Scoring reads each text once. Plain words are scored as they are; a token with
leetspeak, letters spaced out or set apart by signs, or drawn-out letters spans
a lattice of readings, of which a Viterbi search takes the likeliest under the
character model, and the restored word is scored.

Scale: one map pass for the counts and one for the scores; texts are never
shuffled. Only labels are joined, as a broadcast of at most ``max_labels``
rows (a documented bounded sample of the labelled rows, by hash of their id).
The character model has at most 155**3 entries; a cue needs ``min_cue`` labelled rows, and as many different
surroundings, and must explain texts that stronger cues do not, so that copies of
one text do not make cues of its words. That choice is made on the driver, from
the places of likely cues in the sample's toxic rows: it is bounded by
``max_labels`` texts, not by the corpus, but grows with the length of these texts.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import LETTERS, N_SYMBOLS, SYMBOL, fold_case, held_out, trigram_codes
from .shared import settle
from .textops import NOT_SPACE, U64, chunks_of, mix, span_hash, text_buffer, word_spans

CHUNK = 1 << 20
PREFIXES = (4, 5, 6)
#: Odds of a text without a cue, as a part of the odds of all labelled rows.
NO_CUE = 0.02
#: Readings of signs used in place of letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs that may stand between the letters of one word.
BETWEEN = "-._*'~/\\:,;"
#: What it costs, in nats, to drop a sign that could be read: more than a likely letter.
DROPPED = 3.0
EDGE = ".,;:!?\"()[]{}<>&%#*'-_~/\\|+"


class CharModel:
    """Interpolated trigram log-probabilities over case-folded bytes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order].astype(float)
        last, pair = self.codes % N_SYMBOLS, self.codes // N_SYMBOLS
        self.context = np.bincount(pair, weights=self.counts, minlength=N_SYMBOLS**2)
        self.bigram = np.bincount(self.codes % N_SYMBOLS**2, weights=self.counts, minlength=N_SYMBOLS**2)
        self.before = self.bigram.reshape(N_SYMBOLS, N_SYMBOLS).sum(1)
        self.unigram = np.bincount(last, weights=self.counts, minlength=N_SYMBOLS) + 1
        self.unigram = self.unigram / self.unigram.sum()

    def log_p(self, a: int, b: int, c: int) -> float:
        code = (a * N_SYMBOLS + b) * N_SYMBOLS + c
        i = int(np.searchsorted(self.codes, code))
        tri = self.counts[i] if i < len(self.codes) and self.codes[i] == code else 0.0
        p = 0.6 * tri / max(1.0, self.context[a * N_SYMBOLS + b]) + 0.3 * self.bigram[b * N_SYMBOLS + c] / max(1.0, self.before[b]) + 0.1 * self.unigram[c]
        return math.log(p)


def lattice(token: str) -> list[tuple[str, ...]]:
    """Readings of each place of a token; an empty reading drops the place."""
    places: list[tuple[str, ...]] = []
    i = 0
    while i < len(token):
        ch, j = token[i], i + 1
        while j < len(token) and token[j] == ch:
            j += 1
        if ch.isalpha():
            places.append((ch,) if j - i == 1 else (ch, ch + ch))
        elif ch in LEET:
            options = tuple(LEET[ch]) if j - i == 1 else tuple(o for x in LEET[ch] for o in (x, x + x))
            places.append((*options, "") if ch in "!|+(" else options)
        elif ch in BETWEEN or ch.isspace():
            places.append(("",))
        i = j
    return places


def viterbi(places: list[tuple[str, ...]], model: CharModel) -> str:
    """The likeliest reading; states are the last two symbols."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in [*places, (" ",)]:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for option in options:
                x, y, s = a, b, score - (DROPPED if not option and len(options) > 1 else 0)
                for byte in option.encode():
                    c = int(SYMBOL[byte])
                    s += model.log_p(x, y, c)
                    x, y = (y, c) if c else (0, 0)
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, text + option)
        best = new
    return max(best.values())[1].strip()


def suspicious(data: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of tokens, or of stretches of spaced letters, that may hide a word."""
    if not len(s):
        return []
    letter = LETTERS[data]
    cum = np.concatenate(([0], np.cumsum(letter)))
    letters = cum[e] - cum[s]
    triple = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        triple[3:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    triples = np.cumsum(triple)
    drawn = (e - s >= 3) & (triples[e] > triples[np.minimum(s + 2, e)])
    # letters on both sides of something else
    turn = np.zeros(len(data) + 1, np.int64)
    turn[1:-1] = letter[1:] & ~letter[:-1]
    turns = np.cumsum(turn)
    inner = (letters >= 2) & (turns[e - 1] > turns[s])
    # or a sign read as a letter at either end
    sign = np.isin(data, np.frombuffer("0123456789@$".encode(), np.uint8))
    signs = np.concatenate(([0], np.cumsum(sign)))
    inner |= (letters >= 2) & (signs[e] > signs[s])
    out = [(int(row[i]), int(s[i]), int(e[i])) for i in np.flatnonzero(drawn | inner)]
    single = (e - s == 1) & letter[s]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        cut = np.flatnonzero(row[a + 1 : b] != row[a : b - 1]) + a + 1
        for p, q in zip([a, *cut.tolist()], [*cut.tolist(), b], strict=True):
            if q - p >= 3:
                out.append((int(row[p]), int(s[p]), int(e[q - 1])))
    return out


def cues(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each word and of its beginnings."""
    hashes, words = [span_hash(data, s, e)], [np.arange(len(s))]
    for k in PREFIXES:
        i = np.flatnonzero(e - s > k)
        hashes.append(mix(span_hash(data, s[i], s[i] + k) + U64(k)))
        words.append(i)
    return np.concatenate(hashes), np.concatenate(words)


def restored_words(found: list[tuple[int, int, int]], raw: bytes, read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cue hash, row, hash of the hidden form) of the words that the decoder restores."""
    words, rows, hidden = [], [], []
    for row, a, b in found:
        token = raw[a:b].decode("utf-8", "ignore").strip(EDGE).lower()
        word = read(token)
        if word and word != token:
            words.append(word.encode())
            rows.append(row)
            hidden.append(zlib.crc32(token.encode()))
    if not words:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    h, w = cues(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    return h, np.array(rows)[w], mix(np.array(hidden, U64))[w]


def doc_cues(column, read):
    """(first row, documents, cue hashes, their rows, what stands around them, restored tokens per document)."""
    data, offsets = text_buffer(column)
    for a, b in chunks_of(offsets, CHUNK):
        part, off = fold_case(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, off, LETTERS)
        h, w = cues(part, s, e)
        own = h[: len(s)]
        same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        before = np.concatenate((np.zeros(1, U64), np.where(same, own[:-1], U64(0))))[: len(s)]
        after = np.concatenate((np.where(same, own[1:], U64(0)), np.zeros(1, U64)))[: len(s)]
        around = mix(before * U64(0x9FB21C651E98DF25) + after)
        ts, te, trow = word_spans(part, off, NOT_SPACE)
        found = suspicious(part, ts, te, trow)
        rh, rrow, raround = restored_words(found, part.tobytes(), read)
        yield a, b - a, np.concatenate((h, rh)), np.concatenate((row[w], rrow)), np.concatenate((around[w], raround)), np.bincount(rrow, minlength=b - a)


def reader(model: CharModel):
    @functools.lru_cache(maxsize=200_000)
    def read(token: str) -> str:
        places = lattice(token)
        return viterbi(places, model) if places else ""

    return read


def char_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(code, n): how often each three symbols follow each other in the whole corpus."""

    def count(batches):
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            for a, b in chunks_of(offsets, CHUNK):
                codes = trigram_codes(fold_case(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                total += np.bincount(codes, minlength=N_SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str) -> CharModel:
    rows = char_counts(docs, text_col).toArrow()
    return CharModel(rows["code"].to_numpy(), rows["n"].to_numpy())


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labels: int = 50_000,
    min_cue: int = 8,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Score every text for toxicity.

    Returns (``id_col``, held_out, score, predicted, n_restored), a row for each
    input row, and the columns named in ``carry`` as ``with_<name>``. The score is the probability, on the learned rows, of the label
    given the strongest cue in the text (or none, as in null and empty texts).
    A text without a cue has ``NO_CUE`` of the odds of the labelled rows.
    Labels that are null, or of a null id, teach nothing; of several labels of
    an id the largest counts; without labels every score is 0. Other columns
    are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(char_model(docs, text_col))
    base = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"with_{c}") for c in carry])
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
        .where(~held_out("id"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labels)
    )
    # at most max_labels texts, looked at twice
    taught = settle(base.where("not held_out").join(F.broadcast(known), "id").select("toxic", F.xxhash64("id").alias("doc"), "text"))

    def learn(batches):
        read = reader(model.value)
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            keys, sides = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for a, _, h, row, _, _ in doc_cues(batch["text"], read):
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
                keys.append(h[new])
                sides.append(toxic[a + row[new]])
            key, inv = np.unique(np.concatenate(keys), return_inverse=True)
            side = np.concatenate(sides)
            n1 = np.bincount(inv, weights=side, minlength=len(key)).astype(np.int64)
            n = np.bincount(inv, minlength=len(key)).astype(np.int64)
            # the empty cue counts the rows themselves
            key = np.concatenate((key.view(np.int64), [0]))
            n1, n = np.append(n1, int(toxic.sum())), np.append(n, len(toxic))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n1), pa.array(n - n1)], ["cue", "n1", "n0"])

    counts = taught.mapInArrow(learn, "cue long, n1 long, n0 long").groupBy("cue").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    likely = counts.where((F.col("cue") == 0) | ((F.col("n1") >= min_cue) & (F.col("n1") > F.col("n0")))).toArrow()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(likely["cue"].to_numpy().view(np.uint64)))

    def surroundings(batches):
        read = reader(model.value)
        for batch in batches:
            toxic, doc = batch["toxic"].to_numpy(), batch["doc"].to_numpy()
            for a, _, h, row, around, _ in doc_cues(batch["text"], read):
                at = np.minimum(np.searchsorted(wanted.value, h), len(wanted.value) - 1)
                hit = wanted.value[at] == h
                at = a + row[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[hit].view(np.int64)), pa.array(around[hit].view(np.int64)), pa.array(doc[at]), pa.array(toxic[at].astype(np.int32))], ["cue", "around", "doc", "toxic"]
                )

    # copies of a text repeat a cue in the same surroundings, which then count once
    seen = settle(taught.mapInArrow(surroundings, "cue long, around long, doc long, toxic int").distinct())
    places = seen.groupBy("cue", "around").agg(F.max("toxic").alias("t"), F.min("toxic").alias("c"))
    counted = places.groupBy("cue").agg(F.sum("t").alias("n1"), F.sum(1 - F.col("c")).alias("n0"))
    counted = settle(counted.where((F.col("cue") != 0) & (F.col("n1") >= min_cue) & (F.col("n1") > F.col("n0"))))
    rows = seen.where("toxic = 1").join(counted.select("cue"), "cue", "left_semi").toArrow()
    counted = counted.toArrow()
    odds = np.log(cautious(counted["n1"].to_numpy().astype(float), counted["n0"].to_numpy().astype(float)))
    chosen = cover(*(rows[c].to_numpy() for c in ("cue", "around", "doc")), dict(zip(counted["cue"].to_pylist(), odds.tolist(), strict=True)))
    counted = counted.filter(pc.is_in(counted["cue"], pa.array(chosen, pa.int64())))
    base_row = likely.filter(pc.equal(likely["cue"], 0))
    parts = [(t["cue"].to_numpy(), t["n1"].to_numpy().astype(float), t["n0"].to_numpy().astype(float)) for t in (base_row, counted)]
    table = cue_weights(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        read = reader(model.value)
        cue, weight, none = shared.value
        for batch in batches:
            best = np.full(batch.num_rows, none)
            restored = np.zeros(batch.num_rows, np.int64)
            for a, n, h, row, _, fixed in doc_cues(batch["text"], read):
                restored[a : a + n] = fixed
                if len(cue):
                    at = np.minimum(np.searchsorted(cue, h), len(cue) - 1)
                    hit = cue[at] == h
                    np.maximum.at(best, row[hit] + a, weight[at[hit]])
            p = 1 / (1 + np.exp(-best))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(restored), *[batch[c] for c in extra]],
                ["id", "held_out", "score", "predicted", "n_restored", *extra],
            )

    kind = base.schema["id"].dataType.simpleString()
    extra = [f"with_{c}" for c in carry]
    more = "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in extra)
    out = base.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int, n_restored long{more}")
    return out.withColumnRenamed("id", id_col)


def cautious(n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Odds of the label, with both counts taken at the cautious end of their error."""
    return np.maximum(n1 - 2 * np.sqrt(n1), 1e-9) / (n0 + 2 * np.sqrt(n0) + 3)


def cover(cue: np.ndarray, around: np.ndarray, doc: np.ndarray, odds: dict[int, float], least: int = 2) -> np.ndarray:
    """Cues that together explain the toxic texts of the sample, taken one by one.

    Each time the cue is taken for which different surroundings in texts not yet
    explained, times its log-odds, are most; words that only stand beside a taken
    cue explain nothing more.
    """
    cues, cue = np.unique(cue, return_inverse=True)
    worth = np.maximum([odds[c] for c in cues.tolist()], 0) if len(cues) else np.zeros(0)
    _, place = np.unique(around, return_inverse=True)
    docs, doc = np.unique(doc, return_inverse=True)
    open_, taken = np.ones(len(docs), bool), []
    while len(cue):
        left = open_[doc]
        cue, place, doc = cue[left], place[left], doc[left]
        pairs = np.unique(cue.astype(np.int64) << 32 | place)
        n = np.bincount(pairs >> 32, minlength=len(cues)) if len(pairs) else np.zeros(len(cues), int)
        gain = np.where(n >= least, n * worth, 0)
        if not len(pairs) or gain.max() <= 0:
            break
        best = int(gain.argmax())
        taken.append(cues[best])
        open_[doc[cue == best]] = False
    return np.array(taken, np.int64)


def cue_weights(cue: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted cues with the log-odds they give a text, and the log-odds of a text without any.

    Counts are taken at the cautious end of their error, so that a rare cue
    has little weight.
    """
    base = cue == 0
    total1, total0 = n1[base].sum(), n0[base].sum()
    if not total1:
        return np.zeros(0, U64), np.zeros(0), -50.0
    cue, n1, n0 = cue[~base].view(np.uint64), n1[~base], n0[~base]
    weight = np.log(cautious(n1, n0))
    keep = weight > 0
    order = np.argsort(cue[keep])
    none = math.log(NO_CUE * total1 / max(1.0, total0)) if keep.any() else math.log(total1 / max(1.0, total0))
    return cue[keep][order], weight[keep][order], none
