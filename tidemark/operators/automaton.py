"""Many needles found in one pass over each text, by an Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept

#: Characters of needles in one automaton, of which each worker of an executor builds its own.
MOST_CHARS = 1_000_000
#: Characters of texts whose grams are hashed at a time.
SLICE_CHARS = 1_000_000
_BUILT: dict[str, object] = {}


def _automaton(uid: str, needles: list[tuple[int, str]]):
    """The automaton of a broadcast list, built once in a worker."""
    import ahocorasick

    if uid not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for number, needle in needles:
            a.add_word(needle, (number, len(needle)))
        a.make_automaton()
        _BUILT[uid] = a
    return _BUILT[uid]


def find_all(texts: DataFrame, needles: DataFrame, bounded: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """(text_id, needle) of all needles (needle) that stand in a text (text_id, body), each pair once.

    Needles may have any length but none; equal ones count once. With ``bounded``
    the characters beside a needle must be neither a-z nor 0-9. Needles are
    broadcast, as many as make up ``most_chars`` characters; where there are more,
    they are dealt into parts by a digest, and texts are passed once a part, one
    part at a time. Texts that are null hold nothing; texts are not shuffled.
    """
    spark = texts.sparkSession
    own = needles.select("needle").where("needle <> ''").distinct()
    total = own.agg(F.sum(F.length("needle"))).first()[0] or 0
    parts = max(1, -(-total // most_chars))
    kind = texts.schema["text_id"].dataType.simpleString()
    asked = texts.select("text_id", "body").where("body is not null")

    def passed(part: int) -> DataFrame:
        # a part holds about ``most_chars`` characters, so its size is bounded
        list_ = [r.needle for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(list(enumerate(list_)))
        uid = uuid.uuid4().hex

        def edge(text: str, at: int) -> bool:
            return not (0 <= at < len(text)) or not (text[at].isascii() and (text[at].isdigit() or text[at].islower()))

        def run(batches):
            if not shared.value:
                return
            automaton = _automaton(uid, shared.value)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch["body"].to_pylist()):
                    seen = {number for end, (number, n) in automaton.iter(text) if not bounded or (edge(text, end - n) and edge(text, end + 1))}
                    rows += [i] * len(seen)
                    found += [shared.value[x][1] for x in sorted(seen)]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch["text_id"].take(pa.array(rows)), pa.array(found, pa.string())], ["text_id", "needle"])

        found = asked.mapInArrow(run, f"text_id {kind}, needle string")
        if parts == 1:
            return found
        out = kept(found)
        shared.destroy()
        return out

    return reduce(DataFrame.unionByName, [passed(k) for k in range(parts)])


def anchors(codes: np.ndarray, starts: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some ``width`` neighbouring grams of one text.

    ``codes`` are the characters of the texts, which begin at ``starts`` (with the
    end of the last) and are separated, so that no run of ``width`` grams of two
    texts counts. Equal runs have the same least gram, the first of equal ones.
    """
    n = len(codes) - gram + 1
    if n < width:
        return np.array([], np.int64), np.array([], np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(gram):
        hashes = (hashes ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
    least = n - width + 1
    best = np.zeros(least, np.int64)
    low = hashes[:least].copy()
    for k in range(1, width):
        here = hashes[k : k + least]
        lower = here < low
        low[lower], best[lower] = here[lower], k
    at = np.arange(least)
    text = np.searchsorted(starts, at, "right")
    inside = at + width + gram - 1 <= starts[np.minimum(text, len(starts) - 1)]
    place = np.unique((at + best)[inside])
    return place, hashes[place].view(np.int64)


def _anchored(gram: int, width: int, first: bool):
    """A map of texts (id, body) to their anchors (id, hash, at); with ``first``, to that of the first run only, with the body."""

    def run(batches):
        for batch in batches:
            bodies = batch["body"].to_pylist()
            bodies = [b[: gram + width - 1] for b in bodies] if first else bodies
            low = 0
            while low < len(bodies):
                high, total = low, 0
                while high < len(bodies) and (high == low or total + len(bodies[high]) <= SLICE_CHARS):
                    total, high = total + len(bodies[high]), high + 1
                starts = np.cumsum([0, *map(len, bodies[low:high])])
                codes = np.frombuffer("".join(bodies[low:high]).encode("utf-32-le", "surrogatepass"), np.uint32)
                place, hashes = anchors(codes, starts, gram, width)
                text = np.searchsorted(starts, place, "right") - 1
                names = ["body"] if first else ["text_id", "digest"]
                ids = [batch[c].take(pa.array(low + text)) for c in names]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(hashes), pa.array((place - starts[text]).astype(np.int32))], [*(["needle"] if first else names), "hash", "at"])
                low = high

    return run


def find_long(texts: DataFrame, needles: DataFrame, least: int) -> DataFrame:
    """(text_id, needle) of all needles (needle) of at least ``least`` characters that stand in a text (text_id, body), each pair once.

    Nothing is broadcast and no task holds all needles. A needle is known by the
    least of the grams in its first ``least`` characters. Wherever the needle
    stands, that gram is among the anchors of the text; so needles and texts are
    joined on anchors, and only the stretches that a needle could fill are compared.
    """
    gram = max(1, (least + 1) // 2)
    width = least - gram + 1
    own = kept(needles.select("needle").where(F.length("needle") >= least).distinct())
    kind = texts.schema["text_id"].dataType.simpleString()
    spoken = texts.select("text_id", "body").where(F.length("body") >= least).distinct().withColumn("digest", F.xxhash64("body"))
    asks = own.select(F.col("needle").alias("body")).mapInArrow(_anchored(gram, width, True), "needle string, hash bigint, at int")
    asks = asks.groupBy("hash", F.col("at").alias("off")).agg(F.collect_set(F.length("needle")).alias("sizes"))
    places = spoken.mapInArrow(_anchored(gram, width, False), f"text_id {kind}, digest bigint, hash bigint, at int")
    met = places.join(asks, "hash").where("at >= off").select("text_id", "digest", (F.col("at") - F.col("off")).alias("start"), "sizes")
    # a digest that two texts of one id share only adds stretches to compare
    stretch = met.join(spoken, ["text_id", "digest"]).select("text_id", "body", "start", F.explode("sizes").alias("size")).where(F.col("start") + F.col("size") <= F.length("body"))
    could = stretch.select("text_id", F.substring(F.col("body"), F.col("start") + 1, F.col("size")).alias("needle")).distinct()
    return could.join(own, "needle", "left_semi").select("text_id", "needle")
