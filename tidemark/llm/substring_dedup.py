"""Operator 1 - substring dedup by recompression.

Rounds of run and pair naming (``recompress``) give equal word sequences equal
interior symbols. First the blocks ask which symbol phrases occur in a second
document; only windows around such shared phrases are then verified by a
128-bit hash of all their words, answered with the smallest document that has
the window. A word goes if a window over it also starts in a smaller document.

Scale: two rounds of 8 to 16 bytes for each distinct anchor or candidate window
of a block. No key arrives more than once per block, so hot passages do not
pile up. Memory: a block of texts (their number grows with the bytes of the
table), or the longest single text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .recompress import window_anchors
from .textops import NOT_SPACE, SEEDS, U64, chunks_of, mix, sequence_hash, span_hashes, text_buffer, word_spans

CHUNK = 1 << 20


def _chunks(table: pa.Table, halves: int = 2):
    """(first row, bytes, offsets, word starts, word ends, word's row, halves of the words' hashes) of part after part."""
    data, offsets = text_buffer(table["text"])
    for a, b in chunks_of(offsets, CHUNK):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, off, NOT_SPACE)
        yield a, part, off, s, e, row, span_hashes(part, s, e, SEEDS[:halves])


def window_hashes(halves: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash, in two independent halves, of the window of ``width`` words from each place on."""
    return sequence_hash(halves[0], width), sequence_hash(halves[1], width, seed=0x6C62272E07BB0142)


def _whole(row: np.ndarray, width: int) -> np.ndarray:
    """Window starts whose window stays in its document."""
    n = max(0, len(row) - width + 1)
    return np.flatnonzero(row[:n] == row[len(row) - n :])


def anchors_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block, and whether two of its documents have it."""
    keys, rows = [], []
    for a, _, _, _, _, row, (tok,) in _chunks(table, 1):
        at = _whole(row, width)
        k, r = mix(window_anchors(tok, row, width)[at]), row[at] + a
        if len(k):
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
            keys.append(k[new])
            rows.append(r[new])
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    k, r = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(k, kind="stable")
    k, r = k[order], r[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], (np.minimum.reduceat(r, first) < np.maximum.reduceat(r, first)).astype(np.uint8)


def shared_anchors(table: pa.Table) -> list[tuple]:
    keys, multi = B.unpacked(table, "a", U64), B.unpacked(table, "b", np.uint8)
    block = np.repeat(table["block"].to_numpy(), B.lengths(table, "a", 8))
    _, inv, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count > 1
    many |= np.bincount(inv, weights=multi, minlength=len(count)) > 0
    hit = many[inv]
    return B.by_block(block[hit], keys[hit])


def candidates_of(table: pa.Table, told: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Windows around shared anchors: (hash, other half, smallest id, largest id), each distinct."""
    ids, shared = B.ids_of(table), np.sort(B.unpacked(told, "a", U64))
    out = []
    for a, _, _, _, _, row, tok in _chunks(table):
        at = _whole(row, width)
        hit, _ = B.member(mix(window_anchors(tok[0], row, width)[at]), shared)
        at = at[hit]
        if len(at):
            x, y = window_hashes(tok, width)
            out.append((x[at], y[at], ids[row[at] + a]))
    if not out:
        return (np.zeros(0, U64),)
    x, y, d = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((y, x))
    x, y, d = x[order], y[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    return x[first], y[first], np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)


def first_documents(table: pa.Table) -> list[tuple]:
    """The smallest document of each window, told to blocks that have it in a larger one."""
    x, y = B.unpacked(table, "a", U64), B.unpacked(table, "b", U64)
    low, high = B.unpacked(table, "c", np.int64), B.unpacked(table, "d", np.int64)
    block = np.repeat(table["block"].to_numpy(), B.lengths(table, "a", 8))
    order = np.lexsort((y, x))
    x, y, low, high, block = x[order], y[order], low[order], high[order], block[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(low, first)[np.cumsum(new) - 1]
    late = high > least
    return [coded(*row) for row in B.by_block(block[late], x[late], y[late], least[late])]


def coded(block: int, kind: int, x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple:
    """An answer with each document's id told once, and a short number for it beside each window.

    Windows were told apart by all 128 bits; 96 of them are enough for a block to find its own.
    """
    ids, code = np.unique(least, return_inverse=True)
    return block, kind, x, short(y), code.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), ids


def short(y: np.ndarray) -> np.ndarray:
    return (y >> U64(32)).astype(np.uint32)


def decoded(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half of the windows' hashes, beginning of the other, smallest documents) of all answers, in order of the first."""
    least = [np.zeros(0, np.int64)]
    for x, code, ids in zip(*(told[c] for c in "acd"), strict=True):
        n = len(x.as_buffer()) // 8
        kind = np.uint16 if n and len(code.as_buffer()) == 2 * n else np.uint32
        least.append(np.frombuffer(ids.as_buffer(), np.int64)[np.frombuffer(code.as_buffer(), kind)])
    x, y = B.unpacked(told, "a", U64), B.unpacked(told, "b", np.uint32)
    order = np.argsort(x)
    return x[order], y[order], np.concatenate(least)[order]


def remove_repeats(table: pa.Table, told: pa.Table, width: int) -> pa.Table:
    ids = B.ids_of(table)
    x, y, least = decoded(told)
    n = table.num_rows
    n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
    for a, part, off, s, e, row, tok in _chunks(table):
        docs = len(off) - 1
        gone = np.zeros(len(s), bool)
        if len(x):
            at = _whole(row, width)
            own = window_hashes(tok, width)
            i, r = B.matches(own[0][at], x)
            late = at[i[(short(own[1][at[i]]) == y[r]) & (ids[row[at[i]] + a] > least[r])]]
            cover = np.zeros(len(s) + 1, np.int32)
            np.add.at(cover, late, 1)
            np.add.at(cover, late + width, -1)
            gone = np.cumsum(cover)[:-1] > 0
        n_words[a : a + docs] = np.bincount(row, minlength=docs)
        n_removed[a : a + docs] = np.bincount(row[gone], minlength=docs)
        # kept words, each but a document's last with the byte after it turned into a space
        s, e, row = s[~gone], e[~gone], row[~gone]
        mark = np.zeros(len(part) + 1, np.int32)
        np.add.at(mark, s, 1)
        np.add.at(mark, e, -1)
        keep = np.cumsum(mark)[:-1] > 0
        after = e[:-1][row[1:] == row[:-1]]
        text = part.copy()
        text[after] = 32
        keep[after] = True
        size = np.concatenate(([0], np.cumsum(keep)))[off]
        raw = text[keep].tobytes()
        kept[a : a + docs] = [raw[size[i] : size[i + 1]] for i in range(docs)]
    return pa.table(
        {
            "id": table["id"],
            "n_words": n_words,
            "n_removed": n_removed,
            "kept_text": pa.array([str(k, "utf-8") if isinstance(k, bytes) else k for k in kept], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(k if isinstance(k, bytes) else k.encode()).hexdigest() for k in kept], pa.string()),
        }
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, blocks: int | None = None) -> DataFrame:
    """Remove words covered by ``width``-word windows that a smaller document has too.

    Returns (``id_col``, n_words, n_removed, kept_text, kept_sha256), a row for
    each input row. Null texts are empty; a null id counts as the largest; rows
    of one id are never repeats of each other; other columns are ignored; an
    empty table gives an empty table.
    """
    n = blocks or B.block_count(docs, text_col)
    buckets = max(1, n // 2)
    base = B.in_blocks(docs, id_col, text_col, n)
    shared = B.answer(B.ask(base, lambda t: anchors_of(t, width), buckets), shared_anchors)
    first = B.answer(B.ask_again(base, shared, lambda t, r: candidates_of(t, r, width), buckets), first_documents)
    schema = "id long, n_words long, n_removed long, kept_text string, kept_sha256 string"

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        return remove_repeats(left, right, width)

    out = base.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(apply, schema)
    return out.withColumnRenamed("id", id_col)


def oracle(width: int = 13) -> str:
    """DuckDB SQL for ``substring_dedup`` over documents, with every window as a row."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT id, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
windows AS (SELECT id, doc_id, pos AS i, hash(word{"".join(f", lead(word, {k}) OVER o" for k in range(1, width))}) AS h FROM words WINDOW o AS (PARTITION BY id ORDER BY pos) QUALIFY lead(word, {width - 1}) OVER o IS NOT NULL),
late AS (SELECT id, i FROM windows JOIN (SELECT h, min(doc_id) AS first FROM windows GROUP BY h) USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT id, i + k AS pos FROM late, range({width}) t(k)),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (id, pos) GROUP BY id),
n AS (SELECT id, count(*) AS n FROM gone GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (id) LEFT JOIN n USING (id)"""
