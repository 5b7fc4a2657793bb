"""Search, similarity, claims and vocabularies over texts."""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import latest
from .graph import components, kept, leaders

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def substring_search(docs: DataFrame, needle: str, around: int = 90) -> DataFrame:
    """Documents that hold a text in any case, with the number of hits and what stands around the first."""
    low, q = F.lower("content"), needle.lower()
    at = F.instr(low, F.lit(q))
    hits = ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long")
    snippet = F.substring(F.col("content"), F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(q)))
    return docs.where(at > 0).select("doc_id", hits.alias("hits"), snippet.alias("snippet"))


def top_hits(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents of a substring search with the most hits, with their rank."""
    best = found.orderBy(F.col("hits").desc(), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("hits").desc(), "doc_id")))


def evidence_spans(pairs: DataFrame) -> DataFrame:
    """First and last position of ``needle`` in ``body``, both with white space folded and in lower case; 0 if absent."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " ")))
    start = F.instr(norm("body"), norm("needle"))
    return pairs.withColumn("start", start).withColumn("end", F.when(start > 0, start + F.length(norm("needle"))).otherwise(0))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct elements of ``a`` that are in ``b``."""
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a))), F.lit(0.0)), 6)


def shingles(words: Column, n: int = 3) -> Column:
    def of(w: Column) -> Column:
        last = F.size(w) - n
        # single words are looked up, as a slice copies all of them
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array(F.array_join(w, " ")))

    # bound once per row, so that the words are not split again for each shingle
    return F.element_at(F.transform(F.array(words), of), 1)


def ordered_bits(text: str) -> dict[str, int]:
    """For each character its places in a text, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_in_order(bits: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a text (its ``ordered_bits`` and size) and another; no matching exceeds it."""
    full = (1 << size) - 1
    open_ = full
    for c in other:
        both = open_ & bits.get(c, 0)
        if both:
            open_ = ((open_ + both) | (open_ ^ both)) & full
    return size - open_.bit_count()


def ratio_above(least: float) -> Callable[[Column, Column], Column]:
    """The sequence ratio of two texts where it is above ``least``, else null; the matcher runs only where their common subsequence allows that much."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float | None] = []
        last, bits = None, {}
        for x, y in zip(a, b, strict=True):
            x, y = x or "", y or ""
            if y != last:
                last, bits = y, ordered_bits(y)
            found = None
            if not x and not y or 2 * common_in_order(bits, len(y), x) > least * (len(x) + len(y)):
                found = difflib.SequenceMatcher(None, x, y).ratio()
            out.append(found if found is not None and found > least else None)
        return pd.Series(out, dtype="float64")

    return ratio


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class TextBlock:
    """Texts laid out in order of their length, so that many are bounded against a range of them at once."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(size, kind="stable")
        self.texts, self.size = [texts[k] for k in self.order.tolist()], size[self.order]
        self.chars = np.concatenate([np.zeros(0, np.uint32), *[code_points(t) for t in self.texts]])
        self.upto = np.concatenate(([0], np.cumsum(self.size)))
        # characters counted in 32 classes; a class holds one letter of a to z or more characters
        owner = np.repeat(np.arange(len(texts)), self.size)
        self.letters = np.bincount(owner * 32 + self.chars % 32, minlength=32 * len(texts)).reshape(-1, 32).astype(np.int32)

    def grams(self, low: int, high: int, q: int, many: int) -> np.ndarray:
        """Of some texts the grams of ``q`` characters, counted in ``many`` slots; the first, second, third of equal grams are told apart."""
        chars, size = self.chars[self.upto[low] : self.upto[high]], self.size[low:high]
        owner = np.repeat(np.arange(high - low), size)
        whole = owner[q - 1 :] == owner[: max(0, len(owner) - q + 1)]
        gram = hashes(chars, q)[: len(whole)][whole] >> np.uint64(32)
        key = np.sort((owner[: len(whole)][whole].astype(np.uint64) << np.uint64(32)) | gram)
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        nth = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        h = ((key & np.uint64(0xFFFFFFFF)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        at = (key >> np.uint64(32)) * np.uint64(many) + (h >> np.uint64(40)) % np.uint64(many)
        return np.bincount(at.astype(np.int64), minlength=(high - low) * many).reshape(-1, many)


def gram_kind(size: int) -> tuple[int, int]:
    """Characters of a gram and slots of grams for a text of so many characters; they change no result."""
    return (3, 2048) if size < 200 else (5, 1 << min(13, max(10, math.ceil(math.log2(2.5 * size)))))


def ratios_above(asked: list[str], pool: list[str], least: float, slice_: int = 2000, chunk: int = 256) -> Iterator[tuple[int, int, float]]:
    """(place in asked, place in pool, ratio) of all pairs whose sequence ratio, the asked text second, is above ``least``.

    Every pair is bounded: by its lengths, its grams and its characters, then by its
    longest common subsequence; the matcher runs where all of them allow that much. If
    m characters match in k runs, m - k (q - 1) grams of q characters lie in a run, so
    both texts have them; how many they have in common at most is a product of
    matrices of counts. Between runs a character is left over, which limits k; and
    in a text of 200 characters or more every run but one at the very beginning
    holds a character that makes up at most a hundredth of it (the matcher's own
    rule), so there are no more runs than such characters.
    """
    a, b = TextBlock(asked), TextBlock(pool)
    if least < 1:
        yield from ((i, j, 1.0) for i in a.order[a.size == 0].tolist() for j in b.order[b.size == 0].tolist())
    runs = a.size.astype(np.float64)
    for i in np.flatnonzero(a.size >= 200).tolist():
        chars = a.chars[a.upto[i] : a.upto[i + 1]]
        runs[i] = np.isin(chars, beginners(chars)).sum() + 1
    shorter, longer = least / (2 - least), (2 - least) / least
    kinds = [gram_kind(n) for n in a.size.tolist()]
    matcher, last, bits = difflib.SequenceMatcher(), -1, {}
    start = int(np.searchsorted(a.size, 1))
    while start < len(kinds):
        (q, many), stop = kinds[start], start
        while stop < len(kinds) and kinds[stop] == kinds[start]:
            stop += 1
        mine = a.grams(start, stop, q, many).astype(np.int32 if a.size[stop - 1] >= 1 << 16 else np.uint16)
        first, end = np.searchsorted(b.size, [a.size[start] * shorter - 1e-6, a.size[stop - 1] * longer + 1e-6])
        for low in range(first, end, slice_):
            high = min(low + slice_, end)
            held = (b.grams(low, high, q, many) > 0).astype(np.float32)
            near = start + np.searchsorted(a.size[start:stop], [b.size[low] * shorter - 1e-6, b.size[high - 1] * longer + 1e-6])
            for begin in range(near[0], near[1], chunk):
                some = slice(begin, min(begin + chunk, near[1]))
                x, y = low + np.searchsorted(b.size[low:high], [a.size[begin] * shorter - 1e-6, a.size[some.stop - 1] * longer + 1e-6])
                total = a.size[some, None] + b.size[None, x:y]
                most = np.minimum(runs[some, None], (1 - least) * total + 1 + 1e-5)
                common = mine[some.start - start : some.stop - start].astype(np.float32) @ held[x - low : y - low].T
                i, j = np.nonzero(common >= least / 2 * total - most * (q - 1) - 1e-3)
                i, j = i + begin, j + x
                letters = np.minimum(a.letters[i], b.letters[j]).sum(1)
                fits = 2 * letters > least * (a.size[i] + b.size[j]) - 1e-6
                for i_, j_ in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                    text, other = a.texts[i_], b.texts[j_]
                    if i_ != last:
                        last, bits = i_, ordered_bits(text)
                        matcher.set_seq2(text)
                    if 2 * common_in_order(bits, len(text), other) > least * (len(text) + len(other)) - 1e-6:
                        matcher.set_seq1(other)
                        if (ratio := matcher.ratio()) > least:
                            yield int(a.order[i_]), int(b.order[j_]), ratio
        start = stop


@F.pandas_udf(T.DoubleType())
def claim_similarity(claim: pd.Series, text: pd.Series) -> pd.Series:
    """Matched run length over the claim's length."""
    out = []
    for x, y in zip(claim, text, strict=True):
        blocks = difflib.SequenceMatcher(None, (x or "").casefold(), (y or "").casefold()).get_matching_blocks()
        out.append(sum(m.size for m in blocks) / len(x) if x else 0.0)
    return pd.Series(out)


def folded(text: str) -> np.ndarray:
    """Code points of a text without its cases."""
    return np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)


#: Slots of the tables that tell which stretches of characters a chunk holds; a shared slot only loosens a bound.
SLOTS = 1 << 18
#: Characters of a longer stretch.
STRETCH = 5
#: Of so many chunks one is matched first; which, changes no result.
FIRST = 32
#: Characters of claims that are broadcast at once.
MOST_CHARS = 2_000_000


class ClaimSet:
    """Claims laid out one after another, so that the bounds of all of them for one chunk are a few passes over arrays."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts = [i for i, _ in rows], [t.casefold() for _, t in rows]
        self.size = np.array([len(t) for _, t in rows], np.int64)
        parts = [folded(t) for _, t in rows]
        self.chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        n = np.array([len(x) for x in parts], np.int64)
        self.first = np.cumsum(n) - n
        self.filled = n > 0
        self.owner = np.repeat(np.arange(len(rows)), n)
        self.known = np.unique(self.chars)
        # for each place the slot of the stretch that begins there, and whether it lies in one claim
        self.grams = {q: (slots(self.chars, q), np.append(self.owner[q - 1 :] == self.owner[: max(0, len(self.owner) - q + 1)], np.zeros(min(q - 1, len(self.owner)), bool))) for q in range(2, STRETCH + 1)}

    def bounds(self, chunk: np.ndarray) -> np.ndarray:
        """For each claim a proven upper bound of its matched run length in a chunk.

        Every run holds a character that may begin one: in a chunk of 200 characters
        or more those that make up at most a hundredth of it (the matcher's own
        rule), else any that occurs; a run that begins both texts needs none. A run of
        ``STRETCH`` characters or more lies where all stretches of that length occur
        in the chunk, one after another; a shorter one is itself a stretch that
        occurs. What lies in none that holds a beginner can't match.
        """
        if not len(self.chars) or not len(chunk):
            return np.zeros(len(self.ids), np.int64)
        seed = np.isin(self.chars, beginners(chunk))
        heads = self.first[self.filled]
        seed[heads[self.chars[heads] == chunk[0]]] = True
        before = np.concatenate(([0], np.cumsum(seed)))
        change = np.zeros(len(self.chars) + 1, np.int64)
        for q in range(2, STRETCH + 1):
            held = np.concatenate(([False], self.held(chunk, q), [False]))
            if q < STRETCH:
                begins = np.flatnonzero(held[1:-1])
                ends = begins + q
            else:
                # consecutive stretches cover STRETCH - 1 characters more than there are of them
                begins = np.flatnonzero(held[1:] & ~held[:-1])
                ends = np.flatnonzero(held[:-1] & ~held[1:]) + q - 1
            useful = before[ends] > before[begins]
            np.add.at(change, begins[useful], 1)
            np.add.at(change, ends[useful], -1)
        may = seed | (np.cumsum(change[:-1]) > 0)
        # of all claims the characters that may match up to each place
        self.upto = np.concatenate(([0], np.cumsum(may)))
        out = np.zeros(len(self.ids), np.int64)
        out[self.filled] = np.add.reduceat(may.astype(np.int64), heads)
        return out

    def open_upto(self, c: int) -> list[int]:
        """Characters of a claim that may match in the chunk of the last ``bounds``, up to each of its places."""
        at = self.upto[self.first[c] : self.first[c] + len(self.texts[c]) + 1]
        return (at - at[0]).tolist()

    def places(self, text: str, chunk: np.ndarray) -> dict[str, list[int]]:
        """Where the characters that may begin a run and that a claim has stand in a chunk, as the matcher lists them."""
        out: dict[str, list[int]] = {}
        for j in np.flatnonzero(np.isin(chunk, np.intersect1d(beginners(chunk), self.known))).tolist():
            out.setdefault(text[j], []).append(j)
        return out

    def held(self, chunk: np.ndarray, q: int) -> np.ndarray:
        """Places whose stretch of ``q`` characters occurs in a chunk."""
        table = np.zeros(SLOTS, bool)
        table[slots(chunk, q)[: max(0, len(chunk) - q + 1)]] = True
        at, whole = self.grams[q]
        return table[at] & whole


def beginners(chunk: np.ndarray) -> np.ndarray:
    """Characters that may begin a run: in a text of 200 characters or more those that make up at most a hundredth of it, else all."""
    values, counts = np.unique(chunk, return_counts=True)
    return values[counts <= len(chunk) // 100 + 1] if len(chunk) >= 200 else values


def matched_run_length(a: str, b: str, places: dict[str, list[int]], upto: Sequence[int], least: float) -> int | None:
    """The sum of ``difflib``'s matching blocks of two texts, or None as soon as it can't reach ``least``.

    ``places`` tells where in ``b`` the characters stand that may begin a run.
    Only these characters of ``a`` are visited, in the matcher's order, so the
    blocks are the same. What is not yet matched in a window is at most what
    ``upto`` counts there, and at most as long as the window is in ``b``.
    """
    starts = [i for i, c in enumerate(a) if c in places]
    left = min(upto[-1], len(b))
    total, windows = 0, [(0, len(a), 0, len(b), left)]
    while windows:
        if total + left < least:
            return None
        alo, ahi, blo, bhi, open_ = windows.pop()
        left -= open_
        besti, bestj, best = alo, blo, 0
        runs: dict[int, int] = {}
        before = -2
        for i in starts[bisect_left(starts, alo) : bisect_left(starts, ahi)]:
            if i != before + 1:
                runs = {}
            longer: dict[int, int] = {}
            where = places[a[i]]
            for j in where[bisect_left(where, blo) :] if blo else where:
                if j >= bhi:
                    break
                k = longer[j] = runs.get(j - 1, 0) + 1
                if k > best:
                    besti, bestj, best = i - k + 1, j - k + 1, k
            runs, before = longer, i
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, best = besti - 1, bestj - 1, best + 1
        while besti + best < ahi and bestj + best < bhi and a[besti + best] == b[bestj + best]:
            best += 1
        if best:
            total += best
            for w in ((alo, besti, blo, bestj), (besti + best, ahi, bestj + best, bhi)):
                more = min(upto[w[1]] - upto[w[0]], w[3] - w[2])
                if more > 0:
                    windows.append((*w, more))
                    left += more
    return total


def slots(chars: np.ndarray, q: int) -> np.ndarray:
    """For each place the slot of the ``q`` characters that begin there (blanks beyond the end)."""
    return hashes(chars, q) % np.uint64(SLOTS)


def hashes(chars: np.ndarray, q: int) -> np.ndarray:
    more = np.append(chars, np.zeros(q - 1, np.uint32)).astype(np.uint64)
    h = np.zeros(len(chars), np.uint64)
    for k in range(q):
        h = (h ^ more[k : k + len(chars)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def shortlist(claims: DataFrame, chunks: DataFrame, k: int = 5, floor: float = 0.15, most_chars: int = MOST_CHARS) -> DataFrame:
    """The ``k`` best chunks (chunk_id, text) of each claim (claim_id, claim) by matched run length over the claim's length.

    Where both have a project, the chunks of a claim are those of its project.
    Every claim is held against every such chunk as a whole, by a bound first: a pair is
    matched on only while it may reach the floor and the claim's best ``k`` so
    far: those of the task, and of a first round over one chunk in ``FIRST``, whose
    ``k``-th best a claim's answers reach in any case. So nothing is lost. Claims
    are broadcast, as many as make up ``most_chars`` characters, else chunks are
    passed once for each part of them. A task gives ``k`` rows a claim at most.
    Ties go to the smaller chunk.
    """
    spark = claims.sparkSession
    of = (F.col("project").cast("string") if "project" in claims.columns and "project" in chunks.columns else F.lit("")).alias("project")
    asked = claims.where("claim <> ''").select(F.col("claim_id").cast("long").alias("claim_id"), "claim", of)
    total = asked.agg(F.sum(F.length("claim"))).first()[0] or 0
    parts = max(1, -(-total // most_chars))
    base = chunks.where("text is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text", of)
    if base.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # a chunk costs milliseconds, much more than to move it to an idle core
        base = base.repartition(spark.sparkContext.defaultParallelism)
    early = F.pmod(F.xxhash64("chunk_id"), F.lit(FIRST)) == 0

    def passed(part: int) -> DataFrame:
        rows = [(r.claim_id, r.claim, r.project) for r in asked.where(F.pmod(F.xxhash64("claim_id"), F.lit(parts)) == part).collect()]
        one = kept(matched(base.where(early), rows, {}))
        reached = one.groupBy("claim_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("claim_id", F.element_at("s", k).alias("s"))
        # a number for each claim of the part
        return one.unionByName(matched(base.where(~F.coalesce(early, F.lit(False))), rows, {r.claim_id: r.s for r in reached.collect()}))

    def matched(some: DataFrame, rows: list[tuple[int, str, str]], reached: dict[int, float]) -> DataFrame:
        shared = spark.sparkContext.broadcast((rows, reached))

        def run(batches):
            rows, reached = shared.value
            of_project: dict[str | None, list[tuple[int, str]]] = {}
            for i, c, p in rows:
                of_project.setdefault(p, []).append((i, c))
            sets = {p: ClaimSet(rows_) for p, rows_ in of_project.items() if p is not None}
            held = {p: ([[] for _ in own.ids], np.array([max(floor, reached.get(i, floor)) for i in own.ids])) for p, own in sets.items()}
            for batch in batches:
                for chunk, text, project in zip(*(batch[c].to_pylist() for c in ("chunk_id", "text", "project")), strict=True):
                    if project not in sets:
                        continue
                    own, (best, least) = sets[project], held[project]
                    chars, text = folded(text), text.casefold()
                    bound = own.bounds(chars) / np.maximum(own.size, 1)
                    # a bound that equals the least of the best may still win by the smaller id
                    open_ = np.flatnonzero(bound >= least - 1e-6)
                    if not len(open_):
                        continue
                    places = own.places(text, chars)
                    for c in open_.tolist():
                        size = int(own.size[c])
                        matched = matched_run_length(own.texts[c], text, places, own.open_upto(c), (least[c] - 1e-6) * size)
                        score = round(matched / size, 6) if matched is not None else -1.0
                        if score >= least[c]:
                            best[c] = sorted([*best[c], (-score, chunk)])[:k]
                            if len(best[c]) == k:
                                least[c] = max(least[c], -best[c][-1][0])
            found = [(sets[p].ids[c], chunk, -score) for p, (best, _) in held.items() for c, rows_ in enumerate(best) for score, chunk in rows_]
            ids, chunk_ids, scores = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunk_ids, pa.int64()), pa.array(scores, pa.float64())], ["claim_id", "chunk_id", "score"])

        found = some.mapInArrow(run, "claim_id long, chunk_id long, score double")
        if parts == 1:
            return found
        out = kept(found)
        shared.destroy()
        return out

    scored = reduce(DataFrame.unionByName, [passed(x) for x in range(parts)])
    w = Window.partitionBy("claim_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quote_verify(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidate claims with the reason to keep or reject them: the quote must stand in their own window."""
    j = candidates.join(windows, ["conversation_id", "window"], "left")
    malformed = F.coalesce(F.length(F.trim("quote")) == 0, F.lit(True))
    reason = F.when(malformed, "malformed").when(F.col("text").isNull(), "wrong_index").when(~F.col("text").contains(F.col("quote")), "not_literal").otherwise("kept")
    return j.select("claim_id", reason.alias("reason"))


def confirm_verify(verdicts: DataFrame) -> DataFrame:
    """A verdict counts only with a span that stands literally in the text."""
    sound = F.coalesce(F.col("verdict") & (F.col("span") != "") & F.col("text").contains(F.col("span")), F.lit(False))
    return verdicts.withColumn("confirmed", sound)


class NameSet:
    """Names laid out so that the bounds of all of them for one title are a few passes over arrays."""

    #: Characters of a name whose order counts in its bound; those beyond count as matched.
    WORD = 64
    #: Names whose matcher is held ready.
    READY = 20_000

    def __init__(self, rows: list[tuple[str, str]]):
        self.ids, self.names = [i for i, _ in rows], [n for _, n in rows]
        self.size = np.array([len(n) for n in self.names], np.int64)
        held: dict[str, dict[int, int]] = {}
        for k, name in enumerate(self.names):
            for i, c in enumerate(name[: self.WORD]):
                of = held.setdefault(c, {})
                of[k] = of.get(k, 0) | 1 << i
        # for each character the places where names hold it, as bits; of frequent ones for all names
        self.masks: dict[str, tuple[np.ndarray | None, np.ndarray]] = {}
        for c, of in held.items():
            at, bits = np.fromiter(of.keys(), np.int64, len(of)), np.fromiter(of.values(), np.uint64, len(of))
            if 8 * len(at) >= len(rows):
                every = np.zeros(len(rows), np.uint64)
                every[at] = bits
                self.masks[c] = (None, every)
            else:
                self.masks[c] = (at, bits)
        self.matchers: dict[int, difflib.SequenceMatcher] = {}
        self.words: dict[str, list[int]] = {}
        self.n_words = np.ones(len(rows))
        for k, name in enumerate(self.names):
            own = self.long_words(name)
            self.n_words[k] = max(1, len(own))
            for w in own:
                self.words.setdefault(w, []).append(k)

    @staticmethod
    def long_words(text: str) -> set[str]:
        return {w for w in re.findall(r"[^\W_]+", text) if len(w) >= 4}

    def in_order(self, title: str) -> np.ndarray:
        """For each name an upper bound of the characters that it has in common with a title in order, which no matching exceeds.

        Bit-parallel: a bit of a name is cleared for each character more of the longest common subsequence.
        """
        open_ = np.full(len(self.ids), ~np.uint64(0))
        for c in title:
            if c in self.masks:
                at, bits = self.masks[c]
                v = open_ if at is None else open_[at]
                both = v & bits
                v = (v + both) | (v ^ both)
                if at is None:
                    open_ = v
                else:
                    open_[at] = v
        # bits beyond a short name's end are never cleared
        return np.bitwise_count(~open_).astype(np.int64) + np.maximum(0, self.size - self.WORD)

    def ratio(self, title: str, k: int) -> float:
        if k not in self.matchers:
            if len(self.matchers) >= self.READY:
                self.matchers.clear()
            self.matchers[k] = difflib.SequenceMatcher(None, "", self.names[k])
        self.matchers[k].set_seq1(title)
        return self.matchers[k].ratio()

    def best(self, title: str, least: float) -> tuple[str, float] | None:
        """The name of the highest score, the first of equal ones; a name is matched only if its characters in order allow more than was found."""
        if not self.ids:
            return None
        shared = np.zeros(len(self.ids))
        for w in self.long_words(title):
            shared[self.words.get(w, [])] += 1
        shared /= self.n_words
        # two empty texts are equal
        bound = np.maximum(2 * self.in_order(title) / np.maximum(self.size + len(title), 1) if title else self.size == 0, shared)
        found = None
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < least or (found is not None and round(float(bound[k]), 6) < -found[0]):
                break
            score = 1.0 if title == self.names[k] else round(max(self.ratio(title, k), float(shared[k])), 6)
            if score >= least and (found is None or (-score, self.ids[k]) < found):
                found = (-score, self.ids[k])
        return None if found is None else (found[1], -found[0])


def fuzzy_titles(threads: DataFrame, projects: DataFrame, least: float = 0.45, most_chars: int = 2_000_000) -> DataFrame:
    """The best project for each title: sequence ratio or shared long words over the name's words; equality wins.

    Every distinct title is held against every name, by a bound on its characters
    in order first, so no pair is lost. Names are broadcast, as many as make up
    ``most_chars`` characters, else titles are passed once for each part of them.
    A few thousand titles already keep all cores busy, so they are dealt out first.
    """
    spark = threads.sparkSession
    t = threads.select("thread_id", F.lower("title").alias("title"))
    names = projects.select(F.col("project_id").cast("string").alias("project_id"), F.lower("name").alias("name")).where("name is not null")
    kind = projects.schema["project_id"].dataType
    parts = max(1, -(-(names.agg(F.sum(F.length("name"))).first()[0] or 0) // most_chars))
    cores = spark.sparkContext.defaultParallelism
    titles = t.where("title is not null").select("title").distinct().repartition(4 * cores)

    def passed(part: int) -> DataFrame:
        # ids are compared as their own type, in whose order they come
        own = projects.select("project_id", F.lower("name").alias("name")).where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r.project_id, r.name) for r in own.collect()])

        def run(batches):
            names_ = NameSet(shared.value)
            for batch in batches:
                rows = [(x, *y) for x in batch["title"].to_pylist() if (y := names_.best(x, least))]
                title, id_, score = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(title, pa.string()), pa.array([str(x) for x in id_], pa.string()), pa.array(score, pa.float64())], ["title", "project_id", "score"])

        found = titles.mapInArrow(run, "title string, project_id string, score double").withColumn("project_id", F.col("project_id").cast(kind))
        if parts == 1:
            return found
        out = kept(found)
        shared.destroy()
        return out

    every = reduce(DataFrame.unionByName, [passed(x) for x in range(parts)])
    best = latest(every, ["title"], [F.col("score").desc(), F.col("project_id")])
    return t.join(best, "title").select("thread_id", "project_id", "score")


def bracketed(skeleton: DataFrame, anchors: DataFrame) -> DataFrame:
    """Skeleton messages (conversation_id, skeleton_id) with the times (after, before) of the anchors (skeleton_id, at) around them in their conversation."""
    w = Window.partitionBy("conversation_id").orderBy("skeleton_id")
    at = skeleton.join(anchors.groupBy("skeleton_id").agg(F.min("at").alias("at")), "skeleton_id", "left")
    after = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return at.withColumn("after", after).withColumn("before", before).drop("at")


#: Texts and characters of a block that is held against another in one task.
BLOCK_TEXTS, BLOCK_CHARS = (1000, 16_000), 32_000_000


def skeleton_candidates(skeleton: DataFrame, pool: DataFrame, least: float = 0.9, block_texts: tuple[int, int] = BLOCK_TEXTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(text_key, pool_id, ratio): pool rows of the role and a sequence ratio above ``least``, for each distinct role and text of the skeleton.

    Equal texts are compared once, and each with all of its role. A ratio bounds
    the lengths, so texts are dealt to levels of length, and these into blocks; each block is
    held against those of its own and the neighbouring levels in one task, by
    bounds first (``ratios_above``). So no pair is lost, and pairs that are not alike are never shuffled.
    """
    digest = lambda *c: F.struct(F.xxhash64(*c), F.xxhash64(F.lit(1), *c), F.length(c[-1]))
    keyed = pool.where("role is not null and content is not null").withColumn("key", digest("role", "content"))
    first = keyed.groupBy("key").agg(F.min(F.struct("pool_id", "role", "content")).alias("x"))
    b = kept(first.select(F.lit(1).alias("side"), F.lit(None).cast(skeleton.schema["text_key"].dataType).alias("text_key"), "key", F.col("x.pool_id").alias("rep"), "x.role", "x.content"))
    asks = skeleton.where("role is not null and content is not null").select("text_key", "role", "content").dropDuplicates(["text_key"])
    nothing = lambda c: F.lit(None).cast(b.schema[c].dataType).alias(c)
    both = asks.select(F.lit(0).alias("side"), "text_key", nothing("key"), nothing("rep"), "role", "content").unionByName(b)
    both = both.withColumn("level", F.floor(F.log(F.greatest(F.length("content"), F.lit(1)).cast("double")) / math.log((2 - least) / least) + 1e-9).cast("int"))
    counts = kept(both.groupBy("role", "level", "side").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = min(max(total // 32, block_texts[0]), block_texts[1])
    parts = kept(counts.select("role", "level", "side", F.ceil(F.greatest(F.col("n") / most, F.col("chars") / block_chars, F.lit(1))).cast("int").alias("parts")))
    placed = both.join(beside(parts), ["role", "level", "side"]).select("side", "text_key", "rep", "role", "content", "level", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int").alias("part"))
    facing = parts.select("role", (1 - F.col("side")).alias("side"), F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)])).alias("level"), F.col("level").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    dealt = placed.join(beside(facing), ["role", "level", "side"])
    at = lambda n, x, y: F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)).alias(n)
    dealt = dealt.select("side", "text_key", "rep", "content", "role", at("al", "level", "other"), at("ap", "part", "other_part"), at("bl", "other", "level"), at("bp", "other_part", "part"))
    key, id_ = dealt.schema["text_key"].dataType, dealt.schema["rep"].dataType

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        found = list(ratios_above(*[table["content"].take(pa.array(r)).to_pylist() for r in rows], least)) if len(rows[0]) and len(rows[1]) else []
        i, j, ratio = zip(*found, strict=True) if found else ((), (), ())
        take = lambda c, r, at: table[c].take(pa.array(r[list(at)], pa.int64()))
        keys = take("text_key", rows[0], i)
        if pa.types.is_struct(keys.type):
            # a field that is never null is told as one that may be
            keys = keys.cast(pa.struct([pa.field(f.name, f.type) for f in keys.type]))
        return pa.table({"text_key": keys, "rep": take("rep", rows[1], j), "ratio": pa.array(ratio, pa.float64())})

    scored = dealt.groupBy("role", "al", "ap", "bl", "bp").applyInArrow(meet, f"text_key {key.simpleString()}, rep {id_.simpleString()}, ratio double")
    members = keyed.select("key", "pool_id").join(b.select("key", "rep"), "key").select("rep", "pool_id")
    return kept(scored).join(members, "rep").select("text_key", "pool_id", "ratio")


def assign_in_order(asks: DataFrame, lists: DataFrame) -> DataFrame:
    """(ask_id, target): each ask takes the first free target of its list, in order of ``ask_id``.

    ``asks`` (ask_id, list_id), ``lists`` (list_id, place, target) with places from
    1. Asks propose to their next target, a target holds the first of its
    proposers, and the others go on to their next, until none is refused; that is
    what taking turns gives. The k-th ask of a list begins at place k, since
    those before it take what stands earlier, so equal asks need one round.
    """
    k = F.row_number().over(Window.partitionBy("list_id").orderBy("ask_id"))
    lists = kept(lists)
    state = kept(asks.select("ask_id", "list_id", k.cast("int").alias("place")))
    while True:
        proposed = state.join(lists, ["list_id", "place"])
        holder = proposed.groupBy("target").agg(F.min("ask_id").alias("holder"))
        told = kept(proposed.join(holder, "target").select("ask_id", "list_id", "place", "target", (F.col("ask_id") == F.col("holder")).alias("held")))
        if told.where("not held").isEmpty():
            return told.select("ask_id", "target")
        state = told.select("ask_id", "list_id", (F.col("place") + F.when(F.col("held"), 0).otherwise(1)).alias("place"))


def fuzzy_skeleton(skeleton: DataFrame, pool: DataFrame, anchors: DataFrame | None = None, least: float = 0.9, sure: float = 0.97, rarest: int = 8) -> DataFrame:
    """A pool row (pool_id, role, content, at) for each skeleton message (skeleton_id, conversation_id, role, content) by sequence ratio.

    Messages take turns in order of their id: each takes the row of its role with
    the highest ratio above ``least`` that is free, the first of equal ones. With
    ``anchors`` (skeleton_id, at), a row with a time must lie between the anchors
    around the message. Matches below ``sure`` are for review. Each message is held against
    all rows of its role; ``rarest``, which once limited them to those that share a rare word, has no effect.
    """
    keyed = skeleton.withColumn("text_key", F.struct(F.xxhash64("role", "content"), F.xxhash64(F.lit(1), "role", "content"), F.length("content")))
    found = kept(skeleton_candidates(keyed, pool, least))
    if anchors is None:
        asks, fitting = keyed.select("skeleton_id", F.col("text_key").alias("list_id")), found.withColumnRenamed("text_key", "list_id")
    else:
        # messages of one text and one bracket have one list
        inside = bracketed(keyed, anchors).withColumn("list_id", F.struct("text_key", "after", "before"))
        asks = inside.select("skeleton_id", "list_id")
        lists = inside.select("list_id", "text_key", "after", "before").distinct()
        fits = F.col("at").isNull() | (F.coalesce(F.col("after") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("at") <= F.col("before"), F.lit(True)))
        fitting = lists.join(found, "text_key").join(pool.select("pool_id", "at"), "pool_id").where(fits).select("list_id", "pool_id", "ratio")
    place = F.row_number().over(Window.partitionBy("list_id").orderBy(F.col("ratio").desc(), "pool_id"))
    ranked = kept(fitting.withColumn("place", place))
    taken = assign_in_order(asks.select(F.col("skeleton_id").alias("ask_id"), "list_id"), ranked.select("list_id", "place", F.col("pool_id").alias("target")))
    out = taken.join(asks, F.col("ask_id") == F.col("skeleton_id")).join(ranked.withColumnRenamed("list_id", "of"), (F.col("list_id") == F.col("of")) & (F.col("target") == F.col("pool_id")))
    return out.select("skeleton_id", "pool_id", F.round("ratio", 6).alias("ratio"), (F.col("ratio") < sure).alias("review"))


@F.pandas_udf(T.LongType())
def matched_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters of two texts that stand in common runs, in order."""
    return pd.Series([sum(m.size for m in difflib.SequenceMatcher(None, x or "", y or "").get_matching_blocks()) for x, y in zip(a, b, strict=True)])


def pair_diff(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """Of each pair of threads: message counts, whether the roles agree in order, the messages that agree, and the likeness of the texts.

    Messages meet by their place in the thread, so that threads of any length are
    spread over tasks and none is held whole. The likeness is twice the matched
    characters of the messages that meet over all characters of both threads.
    """
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("seq"))
    own = messages.select("thread_id", "role", "content", place.alias("place"))
    side = lambda n: pairs.select("l_id", "r_id").join(own, F.col(f"{n}_id") == F.col("thread_id")).select("l_id", "r_id", "place", F.col("role").alias(f"{n}_role"), F.col("content").alias(f"{n}_text"))
    met = side("l").join(side("r"), ["l_id", "r_id", "place"], "full")
    both = F.col("l_role").isNotNull() & F.col("r_role").isNotNull()
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    each = met.select(
        "l_id", "r_id", F.col("l_role").isNotNull().alias("l"), F.col("r_role").isNotNull().alias("r"), F.coalesce(F.col("l_role") == F.col("r_role"), F.lit(False)).alias("roles"),
        F.coalesce(F.col("l_text") == F.col("r_text"), F.lit(False)).alias("same"), (size("l_text") + size("r_text")).alias("chars"),
        F.when(both & (F.col("l_text") == F.col("r_text")), size("l_text")).when(both, matched_characters("l_text", "r_text")).otherwise(0).alias("matched"),
    )
    out = each.groupBy("l_id", "r_id").agg(F.count_if("l").alias("l_n"), F.count_if("r").alias("r_n"), F.bool_and("roles").alias("same_roles"), F.count_if("same").alias("same_messages"), F.sum("matched").alias("m"), F.sum("chars").alias("c"))
    return out.where("l_n > 0 and r_n > 0").select("l_id", "r_id", "l_n", "r_n", "same_roles", "same_messages", F.round(F.coalesce(F.try_divide(2.0 * F.col("m"), "c"), F.lit(1.0)), 6).alias("likeness"))


def vocabulary(docs: DataFrame, top: int = 50, reserved: int = 12, too_common: float = 0.34) -> DataFrame:
    """Terms that mark each project: (1 + ln tf) ln(N / df), with slots kept for code-like terms."""
    terms = docs.select("project", F.explode(tokens("content")).alias("term"))
    tf = terms.groupBy("project", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count_distinct("project").alias("n_projects"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(n)).where(F.col("df") <= F.greatest(F.col("n_projects") * too_common, F.lit(1.0)))
    scored = scored.select("project", "term", F.round((1 + F.log(F.col("tf").cast("double"))) * F.log(F.col("n_projects") / F.col("df")), 6).alias("score"), F.col("term").rlike(r"[0-9_]").alias("code"))
    by = [F.col("score").desc(), F.col("term")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*by))).withColumn("code_rank", F.row_number().over(Window.partitionBy("project", "code").orderBy(*by)))
    held = ranked.withColumn("held", F.col("code") & (F.col("code_rank") <= reserved))
    order = Window.partitionBy("project").orderBy(F.col("held").desc(), "rank")
    return held.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= top).select("project", "term", "score", "code")


#: Rows of a counted table up to which texts are held against it where they are.
BROADCAST_ROWS = 200_000


def beside(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table computed once, broadcast to a join if it has at most so many rows."""
    own = kept(small)
    return F.broadcast(own) if own.count() <= rows else own


def vocabulary_votes(threads: DataFrame, terms: DataFrame, k: int = 3) -> DataFrame:
    """The strongest terms of each thread and project that the thread uses, each with weight 0.3."""
    used = threads.select("thread_id", F.explode(F.array_distinct(tokens("content"))).alias("term"))
    w = Window.partitionBy("thread_id", "project").orderBy(F.col("score").desc(), "term")
    # only words of a vocabulary are shuffled
    return used.join(beside(terms), "term").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("thread_id", "project", "term", F.lit(0.3).alias("weight"))


#: Tokens whose frequency is told to all tasks; the others count as rare, which only changes the order in which tokens are tried.
MOST_TOKENS = 1_000_000
#: Tokens of a block of sets, at least and at most.
BLOCK_TOKENS = (250_000, 8_000_000)


def rare_beginnings(sets: DataFrame, similarity: float, keys: Sequence[str], most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Of each set (pos, h: hashes of its tokens) its size n and its rarest tokens, somewhat more than the n - ceil(similarity * n) + 1 that two like sets must share one of.

    ``cut`` tells how many were taken, ``last_df`` and ``last_h`` the last of them;
    tokens of a single set are taken but left out of ``t``. Sets of up to 32 tokens are taken whole.
    """
    spark = sets.sparkSession
    df = sets.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    known = df.orderBy(F.desc("df"), "h").limit(most_tokens).toArrow()
    hashes, counts = known["h"].to_numpy(), known["df"].to_numpy()
    by_hash, whole = np.argsort(hashes), len(hashes) < most_tokens
    shared = spark.sparkContext.broadcast((hashes[by_hash], counts[by_hash]))

    def run(batches):
        known_h, known_df = shared.value
        for batch in batches:
            lists = batch["h"]
            n = lists.value_lengths().to_numpy().astype(np.int64)
            h = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known_h, h), max(0, len(known_h) - 1))
            freq = np.where(known_h[at] == h, known_df[at], 0) if len(known_h) else np.zeros(len(h), np.int32)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, freq, owner))
            h, freq = h[order], freq[order]
            first = np.cumsum(n) - n
            least = n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1
            cut = np.where(n <= 32, n, np.minimum(n, least + np.maximum(4, n // 20)))
            end = first + cut - 1
            taken = (np.arange(len(h)) - first[owner] < cut[owner]) & ((freq > 0) | (not whole))
            size = np.bincount(owner[taken], minlength=len(n))
            short = ((h ^ (h >> 32)) & 0x7FFFFFFF).astype(np.int32)[taken]
            t = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(short))
            own = [batch[c] for c in ("pos", *keys)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int32)), pa.array(cut.astype(np.int32)), pa.array(freq[end].astype(np.int32)), pa.array(h[end]), t], ["pos", *keys, "n", "cut", "last_df", "last_h", "t"])

    own = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in ("pos", *keys))
    return sets.select("pos", *keys, "h").mapInArrow(run, f"{own}, n int, cut int, last_df int, last_h long, t array<int>")


def met_pairs(cell: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the sets of two blocks (``side`` 0 and 1, or 0 alone) that may be as like as ``similarity``.

    Tokens common to two sets are all counted up to where the first of the two
    beginnings ends; beyond, at most the rest of that set is common. Rare tokens block
    the sets: a product of matrices of their slots tells how many two sets share at
    most, and only where that is enough they are counted one by one.
    """
    cell = cell.combine_chunks()
    side = cell["side"].to_numpy()
    pos, n, cut, last_df, last_h = (cell[c].to_numpy() for c in ("pos", "n", "cut", "last_df", "last_h"))
    lists = cell["t"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy().astype(np.int64)
    flat, first = lists.flatten().to_numpy(), np.cumsum(size) - size
    alone = not (side == 1).any()
    by_size = lambda rows: rows[np.argsort(n[rows], kind="stable")]
    left, right = by_size(np.flatnonzero(side == 0)), by_size(np.arange(len(side)) if alone else np.flatnonzero(side == 1))
    # slots of tokens, four for each token of the largest set; how many, changes no result
    many = 1 << min(14, max(8, int(4 * size.max(initial=1) - 1).bit_length()))
    owner = np.repeat(np.arange(len(side)), size)
    held = np.sort((owner << 32) | flat.astype(np.int64) & 0xFFFFFFFF)
    slot = ((flat.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % many

    def counted(rows: np.ndarray) -> np.ndarray:
        at = np.repeat(first[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())
        return np.bincount(np.repeat(np.arange(len(rows)), size[rows]) * many + slot[at], minlength=len(rows) * many).reshape(-1, many).astype(np.float32)

    def may(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
        ends_first = (last_df[x] < last_df[y]) | ((last_df[x] == last_df[y]) & (last_h[x] <= last_h[y]))
        most = common + np.where(ends_first, n[x] - cut[x], n[y] - cut[y])
        both = n[x].astype(np.int64) + n[y]
        return (common > 0) & (most * (1 + similarity) >= both * similarity - 1e-6) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * similarity - 1e-9)

    out_a, out_b = [], []
    # so many sets at once that their slots and their products stay small
    width = max(1, min(2000, 8_000_000 // many))
    share, rest, rough = similarity / (1 + similarity), (n - cut).astype(np.float32), 1e-5 * float(n.max(initial=0)) + 1e-3
    for low in range(0, len(right) if len(left) else 0, width):
        others = right[low : low + width]
        theirs = np.minimum(counted(others), 1)
        near = np.searchsorted(n[left], [n[others[0]] * similarity - 1e-6, n[others[-1]] / similarity + 1e-6])
        for begin in range(near[0], near[1], 500):
            some = left[begin : min(begin + 500, near[1])]
            u, v = np.searchsorted(n[others], [n[some[0]] * similarity - 1e-6, n[some[-1]] / similarity + 1e-6])
            # tokens that share a slot are all counted, so this is never too little
            common = counted(some) @ theirs[u:v].T
            of = others[u:v]
            least = (share * n[some]).astype(np.float32)[:, None] + (share * n[of]).astype(np.float32) - np.maximum(rest[some][:, None], rest[of])
            i, j = np.nonzero(common >= np.maximum(least - rough, 0.5))
            x, y = some[i], of[j]
            ok = may(x, y, common[i, j].astype(np.int64)) & ((pos[x] < pos[y]) if alone else True)
            x, y = x[ok], y[ok]
            # the few that are left are counted by their tokens
            for start in range(0, len(x), 10_000):
                x_, y_ = x[start : start + 10_000], y[start : start + 10_000]
                at = np.repeat(first[x_] - (np.cumsum(size[x_]) - size[x_]), size[x_]) + np.arange(size[x_].sum())
                key = (np.repeat(y_, size[x_]) << 32) | flat[at].astype(np.int64) & 0xFFFFFFFF
                found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
                true = np.bincount(np.repeat(np.arange(len(x_)), size[x_])[found], minlength=len(x_))
                ok = may(x_, y_, true)
                out_a.append(pos[x_[ok]])
                out_b.append(pos[y_[ok]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def like_pairs(items: DataFrame, similarity: float, group: str | None = None, block_tokens: tuple[int, int] = BLOCK_TOKENS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """All pairs (a, b, score) of items (pos, text) of a group with a token Jaccard of at least ``similarity``.

    Items with one set of tokens (told by 128 bits) form a class, compared once
    and given out as a chain. Sets of that likeness share enough of their rarest
    tokens, and their sizes differ by no more than the similarity allows. So the
    beginnings of sets are dealt to levels of size, and these into blocks; each
    block is held against those of its own and the next level in one task, where
    common tokens are counted, and only pairs that may still be like are compared
    in full. So no pair is lost, and what merely shares a token is never shuffled.
    """
    keys = [group] if group else []
    w = items.select(F.col("pos").cast("long").alias("pos"), *keys, tokens("text").alias("words")).where(F.size("words") > 0)
    # texts are split into tokens once
    sets = kept(w.select("pos", *keys, F.array_sort(F.array_distinct(F.transform("words", lambda x: F.xxhash64(x)))).alias("h")))
    digest = F.struct(F.xxhash64("h"), F.xxhash64(F.lit(1), "h"), F.size("h"))
    classes = kept(sets.select("pos", *keys, digest.alias("d")).groupBy(*keys, "d").agg(F.min("pos").alias("rep"), F.array_sort(F.collect_list("pos")).alias("all")).select("rep", "all"))
    begun = rare_beginnings(sets, similarity, keys, most_tokens).join(classes.select(F.col("rep").alias("pos")), "pos", "left_semi")
    level = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-9).cast("int")
    begun = kept(begun.withColumn("level", level))
    levels = begun.groupBy(*keys, "level").agg(F.sum(F.size("t")).alias("tokens"))
    total = levels.agg(F.sum("tokens")).first()[0] or 0
    most = min(max(total // 8, block_tokens[0]), block_tokens[1])
    levels = kept(levels.select(*keys, "level", F.greatest(F.ceil(F.col("tokens") / most), F.lit(1)).cast("int").alias("parts")))
    beside = lambda by, name: levels.select(*keys, (F.col("level") + by).alias("level"), F.col("parts").alias(name))
    placed = begun.join(levels, [*keys, "level"]).join(beside(-1, "above"), [*keys, "level"], "left").join(beside(1, "below"), [*keys, "level"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda lo, p, q, up, side: F.struct(lo.alias("lo"), p.alias("p"), q.alias("q"), F.lit(up).alias("up"), side.alias("side"))
    own, lv = F.col("part"), F.col("level")
    cells = F.concat(
        F.transform(upto("parts"), lambda q: cell(lv, F.least(own, q), F.greatest(own, q), 0, (own > q).cast("int"))),
        F.transform(upto("above"), lambda q: cell(lv, own, q, 1, F.lit(0))),
        F.transform(upto("below"), lambda q: cell(lv - 1, q, own, 1, F.lit(1))),
    )
    dealt = placed.select(*keys, "pos", "n", "cut", "last_df", "last_h", "t", F.explode(cells).alias("cell")).select(*keys, "pos", "n", "cut", "last_df", "last_h", "t", "cell.*")

    def meet(table: pa.Table) -> pa.Table:
        a, b = met_pairs(table, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # a cell that only one side fills is a block of its own level or has nothing to compare
    met = kept(dealt.groupBy(*keys, "lo", "p", "q", "up").applyInArrow(meet, "a long, b long"))
    ids = met.select(F.col("a").alias("pos")).union(met.select("b")).distinct()
    asked = sets.join(ids, "pos", "left_semi").select("pos", "h")
    j = met.join(asked.select(F.col("pos").alias("a"), F.col("h").alias("wa")), "a").join(asked.select(F.col("pos").alias("b"), F.col("h").alias("wb")), "b")
    score = F.round(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")), 6)
    near = j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).where(F.col("score") >= similarity)
    chain = F.transform(F.sequence(F.lit(2), F.size("all")), lambda i: F.struct(F.element_at("all", i - 1).alias("a"), F.element_at("all", i).alias("b")))
    return near.unionByName(classes.where(F.size("all") > 1).select(F.inline(chain)).withColumn("score", F.lit(1.0)))


def recurrence_leaders(items: DataFrame, similarity: float = 0.55, k: int = 10) -> DataFrame:
    """Leader clustering of each project's items (project, pos, conversation_id, text), ranked by their conversations.

    An item joins the first leader it is like, or leads; the ``k`` clusters of
    a project with the most conversations are returned.
    """
    pairs = kept(like_pairs(items, similarity, "project").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # of a class only the first item meets other classes; the others follow where it goes
    words = F.array_sort(F.array_distinct(tokens("text")))
    w = items.select("project", "pos", "conversation_id", words.alias("words"))
    first = w.groupBy("project", "words").agg(F.min("pos").alias("rep"))
    own = w.join(first, ["project", "words"]).withColumn("rep", F.when(F.size("words") == 0, F.col("pos")).otherwise(F.col("rep")))
    reps = own.where("pos = rep").select("pos")
    between = pairs.join(reps.select(F.col("pos").alias("a")), "a", "left_semi").join(reps.select(F.col("pos").alias("b")), "b", "left_semi")
    led = own.join(leaders(reps, between).select(F.col("pos").alias("rep"), "leader"), "rep")
    out = led.groupBy("project", "leader").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"))
    w = Window.partitionBy("project").orderBy(F.col("conversations").desc(), "leader")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recurrence_groups(items: DataFrame, pairs: DataFrame, conversations: int = 3, weeks: int = 2) -> DataFrame:
    """Single-link groups of items (pos, conversation_id, day, text) that last: enough conversations, in enough ISO weeks."""
    found = components(pairs.select("a", "b"))
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("day")), F.weekofyear("day"))
    out = items.withColumn("week", week).join(found.select(F.col("node").alias("pos"), "label"), "pos").groupBy("label").agg(
        F.count("*").alias("size"), F.count_distinct("text").alias("texts"), F.count_distinct("conversation_id").alias("conversations"), F.count_distinct("week").alias("weeks"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    return out.where((F.col("conversations") >= conversations) & (F.col("weeks") >= weeks))


def recurrence_sweep(items: DataFrame, thresholds: Sequence[float] = (0.5, 0.6, 0.7), **least: int) -> DataFrame:
    """Lasting groups and their items at each threshold; pairs are found once, at the lowest."""
    pairs = kept(like_pairs(items, min(thresholds)))
    total = lambda x: recurrence_groups(items, pairs.where(F.col("score") >= x), **least).agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("items"))
    return reduce(DataFrame.unionByName, [total(x).select(F.lit(x).alias("threshold"), "groups", "items") for x in thresholds])


def score_with(rows: DataFrame, caller: Callable[[pd.DataFrame], pd.Series], out: str = "score", kind: str = "double") -> DataFrame:
    """Rows with a column computed by an injected function, a batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: caller(pdf)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {out} {kind}")


def claim_pairs(claims: DataFrame, floor: float = 0.5, most_chars: int = MOST_CHARS) -> DataFrame:
    """(claim_id, newer): claims of a project (project, pos, claim_id, claim) at least ``floor`` like a newer one.

    Likeness is the matched run length over the older claim's length. Every claim
    is held against all older ones of its project, by the bound of ``ClaimSet``
    first, so no pair is lost; older claims are broadcast in parts of
    ``most_chars`` characters.
    """
    spark = claims.sparkSession
    base = claims.select(F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), F.col("pos").cast("long").alias("pos"), F.col("claim_id").cast("long").alias("claim_id"), "claim").where("claim <> ''")
    parts = max(1, -(-(base.agg(F.sum(F.length("claim"))).first()[0] or 0) // most_chars))

    def passed(part: int) -> DataFrame:
        shared = spark.sparkContext.broadcast([tuple(r) for r in base.where(F.pmod(F.xxhash64("claim_id"), F.lit(parts)) == part).collect()])

        def run(batches):
            old = ClaimSet([(i, c) for _, _, i, c in shared.value])
            projects, pos = np.array([p for p, *_ in shared.value], object), np.array([x for _, x, *_ in shared.value], np.int64)
            matcher = difflib.SequenceMatcher()
            for batch in batches:
                found = []
                for project, at, newer, text in zip(*(batch[c].to_pylist() for c in ("project", "pos", "claim_id", "claim")), strict=True):
                    open_ = np.flatnonzero((projects == project) & (pos < at))
                    if not len(open_):
                        continue
                    open_ = open_[old.bounds(folded(text))[open_] >= floor * old.size[open_] - 1e-9]
                    matcher.set_seq2(text.casefold())
                    for c in open_.tolist():
                        matcher.set_seq1(old.texts[c])
                        if sum(m.size for m in matcher.get_matching_blocks()) / int(old.size[c]) >= floor:
                            found.append((old.ids[c], newer))
                ids, others = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], ["claim_id", "newer"])

        found = base.mapInArrow(run, "claim_id long, newer long")
        if parts == 1:
            return found
        out = kept(found)
        shared.destroy()
        return out

    return reduce(DataFrame.unionByName, [passed(x) for x in range(parts)])


def claim_outcomes(claims: DataFrame, own: DataFrame, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Outcome of each claim: captured by its own corpus, superseded by a newer established claim, found in another project, or a gap.

    ``claims`` has claim_id; ``own`` the claims captured; ``pairs`` (claim_id,
    newer) the like claims of a project; ``others`` (claim_id, other). A claim is
    superseded by the first newer claim that is not itself superseded, unless it
    is captured; that is settled in rounds over the pairs of all projects at once.
    """
    captured = own.select(F.col("claim_id").alias("pos")).distinct()
    settled = leaders(claims.select(F.col("claim_id").alias("pos")), kept(pairs.select(F.col("newer").alias("a"), F.col("claim_id").alias("b")).distinct()), captured)
    j = settled.join(captured.withColumn("captured", F.lit(True)), "pos", "left").join(others.groupBy(F.col("claim_id").alias("pos")).agg(F.min("other").alias("other")), "pos", "left")
    newer = F.when(F.col("captured").isNull() & (F.col("leader") != F.col("pos")), F.col("leader"))
    outcome = F.when(F.col("captured"), "captured").when(newer.isNotNull(), "superseded").when(F.col("other").isNotNull(), "cross_project").otherwise("gap")
    return j.select(F.col("pos").alias("claim_id"), outcome.alias("outcome"), newer.alias("by"))


def findings(outcomes: DataFrame, with_file: DataFrame, samples: int = 5) -> DataFrame:
    """Outcomes per project that has a knowledge file, with a few samples and, for superseded claims, the days until the newer ones.

    ``outcomes`` has project, claim_id, outcome, day and newer_day.
    """
    kept_ = outcomes.join(with_file, "project", "left_semi")
    w = Window.partitionBy("project", "outcome").orderBy("claim_id")
    top = kept_.withColumn("rn", F.row_number().over(w))
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= samples, F.col("claim_id")))), ",")
    days = F.datediff("newer_day", "day")
    return top.groupBy("project", "outcome").agg(F.count("*").alias("n"), few.alias("samples"), F.min(days).alias("least_days"), F.max(days).alias("most_days"))


def run_health(claims: DataFrame, conversations: DataFrame, mapped: DataFrame, projects: DataFrame) -> DataFrame:
    """One row of what a thin run must not hide: rejected claims, conversations without a time or a project, projects without a knowledge file.

    ``claims`` has rejected, ``conversations`` session_id and real_time,
    ``mapped`` session_id, ``projects`` project and knowledge_files.
    """
    c = claims.agg(F.count("*").alias("claims"), F.count_if("rejected").alias("rejected"))
    untimed = conversations.agg(F.count("*").alias("conversations"), F.count_if(F.col("real_time").isNull()).alias("excluded"))
    unmapped = conversations.join(mapped.select("session_id").distinct(), "session_id", "left_anti").agg(F.count("*").alias("unmapped"))
    bare = projects.agg(F.count_if(F.coalesce("knowledge_files", F.lit(0)) == 0).alias("without_file"))
    one = reduce(lambda x, y: x.join(F.broadcast(y)), [c, untimed, unmapped, bare])
    return one.withColumn("rejection_rate", F.round(F.try_divide("rejected", "claims"), 6))


def checklist(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Checklist items (doc_id, line_no, line) with their section and the last verdict of each id."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    section = F.last(F.nullif(F.regexp_extract("line", r"^#+ (.+)$", 1), F.lit("")), ignorenulls=True).over(w)
    items = lines.withColumn("section", section).withColumn("item", F.regexp_extract("line", r"^- \[[ xX]\] (\S+)", 1)).where("item <> ''")
    last = results.groupBy("item").agg(F.max_by("verdict", "pos").alias("verdict"))
    return items.join(last, "item", "left").select("doc_id", "item", "section", F.col("line").rlike(r"^- \[[xX]\]").alias("ticked"), "verdict")


def lifecycle_board(docs: DataFrame, roles: dict[str, tuple[str, str]], dispositions: Sequence[str]) -> DataFrame:
    """One card for each stem of lifecycle documents (name, archived, content), apart for live and archived ones.

    ``roles`` gives the beginning and the end of the names of each role (brief,
    report, results, walk), the first that fits counts; other names are cards of
    their own if archived, else off the board. Columns: archived, else by the
    latest role (walked, built, in_flight). Kinds: pair, walk_only, unmatched.
    Findings: ``split_stem`` (live and archived), ``unstamped`` (an archived
    document without a line ``> **ARCHIVED** day · disposition``), ``mixed_disposition``,
    and ``evidence_in_results`` (a walk sheet with open boxes and no tick, whose results have ticks).
    """
    fits = lambda begin, end: F.col("name").startswith(begin) & F.col("name").endswith(end) & (F.length("name") > len(begin) + len(end))
    stem = F.coalesce(*[F.when(fits(b, e), F.expr(f"substring(name, {len(b) + 1}, length(name) - {len(b) + len(e)})")) for b, e in roles.values()], F.col("name"))
    role = F.coalesce(*[F.when(fits(b, e), F.lit(r)) for r, (b, e) in roles.items()], F.lit("other"))
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.trim(x))
    boxes = lambda marks: F.size(F.filter("lines", lambda x: F.substring(x, 1, 5).isin(*[f"- [{m}]" for m in marks]))).cast("long")
    stamp = F.get(F.filter("lines", lambda x: x.startswith("> **ARCHIVED**")), F.lit(0))
    said = F.trim(F.coalesce(F.get(F.split(stamp, "·"), F.lit(1)), F.lit("")))
    word = F.coalesce(*[F.when(F.lower(said).startswith(d), F.lit(d)) for d in dispositions], F.nullif(said, F.lit("")))
    rows = docs.select(role.alias("role"), stem.alias("stem"), "name", "archived", lines.alias("lines"))
    rows = rows.where("archived or role <> 'other'").select("role", "stem", "archived", boxes("xX~").alias("done"), boxes(" ").alias("open"), F.when(F.col("archived"), stamp.isNotNull()).alias("stamped"), F.when(F.col("archived"), word).alias("word"))
    has = lambda r: F.bool_or(F.col("role") == r).alias(r)
    first = lambda c, r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col(c))), F.lit(0)).alias(f"{r}_{c}")
    per = rows.groupBy("stem", "archived").agg(*[has(r) for r in ("brief", "report", "results", "walk")], first("done", "walk"), first("open", "walk"), first("done", "results"), F.collect_set("word").alias("words"), F.count_if(~F.col("stamped")).alias("bare"))
    split = rows.groupBy("stem").agg((F.count_distinct("archived") > 1).alias("split"))
    pair = F.when(F.col("archived"), F.col("brief") & F.col("report")).otherwise(F.col("brief"))
    alone = F.col("walk") & ~F.col("brief") & (~F.col("archived") | ~F.col("report"))
    kind = F.when(pair, "pair").when(alone, "walk_only").otherwise("unmatched")
    column = F.when(F.col("archived"), "archived").when(F.col("results"), "walked").when(F.col("report"), "built").otherwise("in_flight")
    disposition = F.when(F.size("words") > 1, "mixed").when(F.size("words") == 1, F.get("words", F.lit(0)))
    findings = F.array_join(F.array_compact(F.array(
        F.when(F.col("results") & (F.col("walk_done") == 0) & (F.col("walk_open") > 0) & (F.col("results_done") > 0), "evidence_in_results"),
        F.when(F.size("words") > 1, "mixed_disposition"), F.when(F.col("split"), "split_stem"), F.when(F.col("bare") > 0, "unstamped"),
    )), ",")
    return per.join(split, "stem").select("stem", "archived", kind.alias("kind"), column.alias("column"), disposition.alias("disposition"), F.col("walk_done").alias("done"), F.col("walk_open").alias("open"), findings.alias("findings"))


def log_calls(lines: DataFrame, start: str) -> DataFrame:
    """Multi-line log (host, pos, value) as one row per record: a line that matches ``start`` begins one."""
    w = Window.partitionBy("host").orderBy("pos")
    marked = lines.withColumn("record", F.sum(F.col("value").rlike(start).cast("int")).over(w)).where("record > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "\n")
    return marked.groupBy("host", "record").agg(F.min("pos").alias("pos"), F.count("*").alias("lines"), text.alias("text"))


def log_requests(calls: DataFrame, loads: DataFrame) -> DataFrame:
    """Records of ``log_calls`` with timings, token counts, errors, and the load events (host, pos) seen before each."""
    number = lambda k: F.regexp_extract("text", rf"{k}[=:]\s*([0-9.]+)", 1).try_cast("double")
    out = calls.select(
        "host", "record", "pos", number("ms").alias("ms"), number("prompt_tokens").alias("prompt_tokens"), number("completion_tokens").alias("completion_tokens"),
        F.col("text").rlike(r"(?i)\berror\b").alias("error"), F.lit(0).alias("load"),
    )
    marks = loads.select("host", F.lit(None).cast("long").alias("record"), "pos", *[F.lit(None).cast("double").alias(c) for c in ("ms", "prompt_tokens", "completion_tokens")], F.lit(False).alias("error"), F.lit(1).alias("load"))
    w = Window.partitionBy("host").orderBy("pos", "load").rowsBetween(Window.unboundedPreceding, -1)
    seen = out.unionByName(marks).withColumn("loads_before", F.coalesce(F.sum("load").over(w), F.lit(0)))
    return seen.where("load = 0").drop("load")
