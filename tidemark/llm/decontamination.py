"""Operator 9 - benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A mask such as ``11011100101`` reads some of the tokens of a span and ignores
the others, so two spans with a substituted word under a 0 still get one hash.
Spans of documents and benchmark items meet by mask and hash; each diagonal with
a hit is verified on the real tokens: some stretch of ``window`` item tokens (or
the whole item, if shorter) agrees with the document in at least ``identity``
of its places. Items are put in classes by length, down to one token; the masks
of a class hit every overlap that the rule accepts (``lossless`` enumerates the
places of the substitutions), so no verdict hangs on the choice of seeds.

Scale: a document span is hashed in full only if its first two tokens pass a
bitmap made from the benchmark (8 to 512 KiB for a class in use; a fuller one lets more
spans through and changes no result), so the rows that leave the scan follow the true and
chance hits. While these are counted to be at most ``broadcast_rows``, they are
broadcast to the texts, which are then never shuffled. Verification carries the stretch of a text beside an item, never the text. Benchmark seeds are broadcast only
below ``broadcast_rows``; beyond, both sides are shuffled by hash.
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Masks for whole windows, for items of 10 to 12 tokens (two substitutions) and of 5 to 9 (one).
MASKS = ("11001001011", "11011011")
SHORT_MASKS = (("11111", "1100111", "110001011"), ("111", "11011"))
NOT_WORD = r"[^\p{L}\p{N}]+"
NO_ID = -(1 << 63)
#: Bits of the gate of a class: about 16 for each token of the benchmark, within these bounds.
LEAST_BITS, MOST_BITS = 16, 22


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _pick(words: Column, at: Column, mask: str) -> list[Column]:
    return [words[at + k] for k, bit in enumerate(mask) if bit == "1"]


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once for a row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def lossless(masks: tuple[str, ...], length: int, wrong: int) -> bool:
    """Whether some mask fits between any ``wrong`` substituted tokens of ``length``."""
    at = [{i + k for k, bit in enumerate(m) if bit == "1"} for m in masks for i in range(length - len(m) + 1)]
    return all(any(not places & set(bad) for places in at) for bad in itertools.combinations(range(length), wrong))


class Seeds(NamedTuple):
    """Items of at least ``least`` tokens (and fewer than the next class has) and their masks."""

    least: int
    masks: tuple[str, ...]

    @property
    def first(self) -> int:
        """Tokens at the start of all masks that the gate looks at."""
        return 2 if all(m.startswith("11") for m in self.masks) else 1

    def number(self, mask: str) -> int:
        return self.least * 100 + self.masks.index(mask)


def classes(masks: tuple[str, ...], window: int, identity: float) -> list[Seeds]:
    """Classes for all lengths; where no given masks are lossless, the run of tokens that must be left serves."""
    out: list[Seeds] = []
    known = -1
    for length in range(1, window + 1):
        wrong = length - int(np.ceil(length * identity))
        if wrong == known and wrong > 0 and length < window:
            continue
        known = wrong
        run = "1" * max(1, -(-(length - wrong) // (wrong + 1)))
        given = [masks, *SHORT_MASKS] if length == window else SHORT_MASKS
        out.append(Seeds(length, next((m for m in given if wrong and lossless(m, length, wrong)), (run,))))
    return out


def seeds(df: DataFrame, used: list[tuple[Seeds, Gate | None]]) -> DataFrame:
    """(id, pos, h) of every masked span of ``df(id, words)`` whose first tokens pass the gate of its class."""

    def spans(words: Column, kind: Seeds, gate: Gate | None) -> Column:
        last = F.size(words) - min(len(m) for m in kind.masks)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        if gate is not None:
            starts = F.filter(starts, lambda i: _passes(gate, F.xxhash64(*[words[i + k] for k in range(kind.first)])))
        hashed = lambda i, m: F.when(i + len(m) <= F.size(words), F.xxhash64(F.lit(kind.number(m)), *_pick(words, i, m)))
        return F.flatten(F.transform(starts, lambda i: F.array(*[F.struct(i.alias("pos"), hashed(i, m).alias("h")) for m in kind.masks])))

    every = let(F.col("words"), lambda w: F.concat(*[spans(w, kind, gate) for kind, gate in used]))
    # the outer form keeps the optimizer from testing the spans of a row before it makes them
    return df.select("id", F.inline_outer(every)).where("h is not null")


class Gate(NamedTuple):
    bitmap: Column
    bits: int


def _passes(gate: Gate, h: Column) -> Column:
    word = F.element_at(gate.bitmap, (F.shiftright(h.bitwiseAND(F.lit((1 << gate.bits) - 1)), 6) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def gate_of(items: DataFrame, first: int, bits: int) -> Gate:
    """``2 ** bits`` bits for the ``first`` tokens of all spans of a class of the benchmark."""
    starts = F.sequence(F.lit(0), F.size("words") - first)
    pairs = items.where(F.size("words") >= first).select(F.explode(F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(first)]))).alias("h"))
    rows = (
        pairs.select(F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("slot")
        .agg(F.bit_or("bit").alias("bits"))
    )
    found = {r.slot: r.bits for r in rows.collect()}  # at most 2 ** (bits - 6) rows
    return Gate(F.lit(np.array([found.get(i, 0) for i in range(1 << bits - 6)], np.int64)), bits)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = 13,
    identity: float = 0.8,
    broadcast_rows: int = 500_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Overlap of each document with the benchmark items.

    Returns (``id_col``, contaminated, n_items, best_item, best_overlap), a row
    for each input row: the number of items with a verified overlap, and the
    largest number of agreeing tokens in a window with its smallest item.
    Null texts have no tokens; items without tokens or with a null id take no
    part; a row's result follows from its own text, also where ids are null or
    equal; columns in ``carry`` come along as ``with_*``, others are ignored.
    """
    text = F.col(text_col)
    # rows of one id and one text have one result; the text is told by 128 bits
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("low"), F.xxhash64(F.lit(1), text).alias("high")).alias("id")
    base = docs.select(key, text.alias("text"))
    bench = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), tokens(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    kinds = classes(masks, window, identity)
    least = F.greatest(F.lit(0), *[F.when(F.size("words") >= kind.least, kind.least) for kind in kinds])
    bench = bench.withColumn("least", least)
    present = {r.least: r.n for r in bench.groupBy("least").agg(F.sum(F.size("words")).alias("n")).collect()}  # at most one row a class
    used = [kind for kind in kinds if kind.least in present] or kinds[-1:]
    of_kind = {kind: bench.where(F.col("least") == kind.least).select(F.col("item").alias("id"), "words") for kind in used}
    of_items = reduce(DataFrame.unionByName, [seeds(of_kind[kind], [(kind, None)]) for kind in used]).select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "h")
    side = bench.select("item", F.col("words").alias("item_words"))
    of_items = of_items.join(side.select("item", F.size("item_words").alias("m")), "item")
    small = of_items.count() <= broadcast_rows
    told = F.broadcast if small else lambda df: df
    gates = [(kind, gate_of(of_kind[kind], kind.first, max(LEAST_BITS, min(MOST_BITS, (16 * present.get(kind.least, 1)).bit_length())))) for kind in used]
    of_docs = seeds(base.select("id", tokens(F.col("text")).alias("words")), gates)
    # one row for each document, item and diagonal; as long as they are few, the texts stay where they are
    hits = settle(of_docs.join(told(of_items), "h").select("id", "item", "m", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    few = F.broadcast if hits.count() <= broadcast_rows else lambda df: df
    per_id = hits.groupBy("id").agg(F.collect_list(F.struct("item", "m", "shift")).alias("hits"))
    # the stretch beside the item on each diagonal, whose first token is that of item token -least(shift, 0)
    beside = lambda words: F.transform("hits", lambda x: F.struct(x["item"].alias("item"), F.least(x["shift"], F.lit(0)).alias("shift"), F.slice(words, F.greatest(x["shift"], F.lit(0)) + 1, x["m"]).alias("words")))
    stretches = base.join(few(per_id), "id").select("id", F.inline(let(tokens(F.col("text")), beside))).join(told(side), "item")
    m = F.size("item_words")
    agree = F.transform(F.col("item_words"), lambda w, j: F.when(F.get(F.col("words"), F.col("shift") + j) == w, 1).otherwise(0))
    width = F.least(m, F.lit(window))
    sums = lambda ones: F.transform(F.sequence(F.lit(0), m - width), lambda s: F.aggregate(F.slice(ones, s + 1, width), F.lit(0), lambda a, x: a + x))
    overlaps = stretches.select("id", "item", width.alias("width"), F.array_max(let(agree, sums)).alias("overlap"))
    verified = overlaps.where(F.col("overlap") >= F.ceil(F.col("width") * F.lit(identity)))
    per_doc = verified.groupBy("id").agg(
        F.count_distinct("item").alias("n_items"),
        F.max(F.struct("overlap", (-F.col("item")).alias("minus"))).alias("best"),
    )
    return (
        docs.select(F.col(id_col).alias("own_id"), key, *[F.col(c).alias(f"with_{c}") for c in carry])
        .join(few(per_doc), "id", "left")
        .select(
            F.col("own_id").alias(id_col),
            F.col("best").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            (-F.col("best.minus")).alias("best_item"),
            F.coalesce("best.overlap", F.lit(0)).cast("long").alias("best_overlap"),
            *[f"with_{c}" for c in carry],
        )
    )


def oracle(window: int = 13, identity: float = 0.8) -> str:
    """DuckDB SQL for ``decontaminate`` over documents and benchmark, without any seeds.

    An overlap that the rule accepts has that many equal tokens on one diagonal,
    so all diagonals with enough equal tokens are looked at.
    """
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    need = f"ceil(least(m, {window}) * {identity})"
    return f"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
b AS (SELECT item_id, {words} AS words, len(words) AS m FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d),
bw AS (SELECT item_id, m, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM b),
hits AS (SELECT doc_id, item_id, dw.pos - bw.pos AS shift FROM dw JOIN bw USING (w) GROUP BY 1, 2, 3, m HAVING count(*) >= {need}),
agree AS (
  SELECT doc_id, item_id, shift, least(m, {window}) AS width,
         list_transform(range(0, m), lambda j: CASE WHEN shift + j >= 0 AND d.words[shift + j + 1] = b.words[j + 1] THEN 1 ELSE 0 END) AS a
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (
  SELECT doc_id, item_id, width, list_max(list_transform(range(0, len(a) - width + 1), lambda s: list_sum(list_slice(a, s + 1, s + width)))) AS overlap FROM agree),
ok AS (SELECT * FROM best WHERE overlap >= ceil(width * {identity})),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(overlap) AS overlap FROM ok GROUP BY doc_id),
top AS (SELECT ok.doc_id, min(item_id) AS best_item FROM ok JOIN per ON ok.doc_id = per.doc_id AND ok.overlap = per.overlap GROUP BY ok.doc_id)
SELECT documents.doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, best_item, coalesce(overlap, 0)::BIGINT AS best_overlap
FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN top USING (doc_id)"""
