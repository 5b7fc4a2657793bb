"""Operator 6 - suffix-array dedup with a run-length index.

Every window of ``width`` bytes has a minimizer: the smallest hash of the
``K``-byte strings inside it. Neighbouring windows share one, so a document is
cut into contexts (the stretch of windows with one minimizer). A first round of
blocks and buckets drops contexts whose minimizer occurs once in the corpus. The
others meet by minimizer; a bucket builds the run-length Burrows-Wheeler index
(``rindex``) of its distinct contexts, streams matching statistics over it, and
tells each block where each of its windows first occurs.

Scale: a context travels once per block that has it, whatever its number of
copies. A minimizer that occurs more than ``hot`` times is combined with a
second one, so that a phrase found in unlike surroundings is split between
buckets. Memory: a block of texts, a bucket of distinct contexts (both counts
grow with the bytes of the table), or the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks as B
from .rindex import RunIndex
from .textops import BASE_A, U64, chunks_of, inverse, mix, pow_table, prefix_hash, span_hashes, text_buffer

CHUNK = 1 << 20
K = 24
HOT = 20_000
#: Bytes of contexts that one index holds.
INDEX_BYTES = 1 << 20
SHARED, HOTKEYS, FIRST = 0, 2, 1


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place on; it deals the work, and equality never hangs on it."""
    prefix = prefix_hash(data, BASE_A)
    h = (prefix[k:] - prefix[:-k]) * pow_table(inverse(BASE_A), len(prefix))[: len(prefix) - k]
    return mix(h) | U64(1)


class Windows:
    """The windows of a part of a block, and their minimizers."""

    def __init__(self, row: int, part: np.ndarray, off: np.ndarray, width: int):
        self.row, self.part, self.off, self.width = row, part, off, width
        self.k = min(K, width)
        n = len(part) - width + 1
        size = np.diff(off)
        last = off[1:] - width
        ok = np.zeros(max(n, 0) + 1, np.int32)
        has = size >= width
        np.add.at(ok, off[:-1][has], 1)
        np.add.at(ok, last[has] + 1, -1)
        self.at = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
        if len(self.at):
            self.grams = grams(part, self.k)
            self.least = sliding(self.grams, width - self.k + 1, np.minimum)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers and the number of their places."""
        if not len(self.at):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        w = self.width - self.k + 1
        chosen = np.zeros(len(self.least) + 2 * (w - 1), U64)
        chosen[w - 1 + self.at] = self.least[self.at]
        places = self.grams[self.grams == sliding(chosen, w, np.maximum)]
        return np.unique(places, return_counts=True)

    def contexts(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, last window) of each stretch of windows with one key."""
        if not len(self.at):
            z = np.zeros(0, np.int64)
            return z.astype(U64), z, z
        key = self.least[self.at]
        if len(hot):
            many, _ = B.member(mix(key), hot)
            if many.any():
                second = sliding(mix(self.grams ^ U64(0x8CB92BA72F3D8DD7)), self.width - self.k + 1, np.minimum)[self.at]
                key = np.where(many, mix(key + second), key)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (self.at[1:] != self.at[:-1] + 1)) + 1
        a = np.concatenate(([0], cut))
        b = np.concatenate((cut, [len(key)])) - 1
        return mix(key[a]), self.at[a], self.at[b]


def windows_of(table: pa.Table, width: int):
    data, offsets = text_buffer(table["text"])
    for a, b in chunks_of(offsets, CHUNK):
        yield Windows(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def minimizers_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [w.keys() for w in windows_of(table, width)]
    key = mix(np.concatenate([k for k, _ in found])) if found else np.zeros(0, U64)
    count = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    if not len(key):
        return key, np.zeros(0, np.int32)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.minimum(np.add.reduceat(count, first), 1 << 30).astype(np.int32)


def shared_minimizers(table: pa.Table, hot: int) -> list[tuple]:
    key, count = B.unpacked(table, "a", U64), B.unpacked(table, "b", np.int32)
    block = np.repeat(table["block"].to_numpy(), B.lengths(table, "a", 8))
    _, inv = np.unique(key, return_inverse=True)
    total = np.bincount(inv, weights=count)[inv] if len(key) else np.zeros(0)
    rows = B.by_block(block[total > 1], key[total > 1], kind=SHARED)
    return rows + B.by_block(block[total > hot], key[total > hot], kind=HOTKEYS)


def of_kind(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pc.equal(told["kind"], kind))


def contexts_of(table: pa.Table, told: pa.Table, width: int) -> tuple:
    """Distinct contexts of a block with shared keys: (key, length, bytes, first id and place with a mark for more)."""
    ids = B.ids_of(table)
    shared = np.sort(B.unpacked(of_kind(told, SHARED), "a", U64))
    hot = np.sort(B.unpacked(of_kind(told, HOTKEYS), "a", U64))
    seen: dict[bytes, list] = {}
    for w in windows_of(table, width):
        plain, p, q = w.contexts(hot[:0])
        if len(hot):
            good, _ = B.member(plain, shared)
            near = np.zeros(len(w.part) + 1, np.int32)
            np.add.at(near, p[good], 1)
            np.add.at(near, q[good] + 1, -1)
            key, p, q = w.contexts(hot)
            good = np.cumsum(near)[p] > 0
        else:
            key = plain
            good, _ = B.member(key, shared)
        key, p, q = key[good], p[good], q[good]
        if not len(key):
            continue
        raw = w.part.tobytes()
        row = np.searchsorted(w.off, p, side="right") - 1
        place = p - w.off[row]
        for k, a, b, d, x in zip(key.tolist(), p.tolist(), (q + width).tolist(), ids[row + w.row].tolist(), place.tolist(), strict=True):
            s = raw[a:b]
            old = seen.get(s)
            if old is None:
                seen[s] = [k, d, x, 0]
            else:
                old[3] = 1
                if (d, x) < (old[1], old[2]):
                    old[1], old[2] = d, x
    if not seen:
        return (np.zeros(0, U64),)
    key = np.array([v[0] for v in seen.values()], U64)
    order = np.argsort(key, kind="stable")
    strings = list(seen)
    info = np.array([(v[1], 2 * v[2] + v[3]) for v in seen.values()], np.int64)[order]
    return key[order], np.array([len(s) for s in strings], np.int32)[order], [strings[i] for i in order.tolist()], info


def first_places(table: pa.Table, width: int, limit: int = INDEX_BYTES) -> list[tuple]:
    """Where each window of a bucket's contexts first occurs, told to the blocks that have it later.

    Contexts are indexed in groups of whole keys, of about ``limit`` bytes each.
    """
    key, length = B.unpacked(table, "a", U64), B.unpacked(table, "b", np.int32)
    info = B.unpacked(table, "d", np.int64).reshape(-1, 2)
    block = np.repeat(table["block"].to_numpy(), B.lengths(table, "b", 4))
    strings, i = [], 0
    for size, blob in zip(B.lengths(table, "b", 4).tolist(), table["c"], strict=True):
        raw = B.inflate(blob.as_buffer(), int(length[i : i + size].sum()))
        end = 0
        for n in length[i : i + size].tolist():
            strings.append(raw[end : end + n])
            end += n
        i += size
    order = np.argsort(key, kind="stable")
    group = np.cumsum(length[order].astype(np.int64)) // limit
    turn = key[order][1:] != key[order][:-1]
    # a change of group inside a key waits for the key's end
    edges, last = [0], group[0] if len(group) else 0
    for at in np.flatnonzero(turn).tolist():
        if group[at + 1] != last:
            edges.append(at + 1)
            last = group[at + 1]
    edges.append(len(order))
    found = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = order[a:b]
        found.append(_first_places([strings[j] for j in part.tolist()], key[part], info[part], block[part], width))
    return B.by_block(*(np.concatenate(x) for x in zip(*found, strict=True)), kind=FIRST) if found else []


def _first_places(strings: list[bytes], key: np.ndarray, info: np.ndarray, block: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(block, context's 128-bit hash, offset and number of windows, first id, first place less the offset)."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    id_, place, multi = info[:, 0], info[:, 1] >> 1, info[:, 1] & 1
    # first occurrence of each distinct context
    order = np.lexsort((place, id_, which))
    head = order[np.concatenate(([True], which[order][1:] != which[order][:-1]))]
    ctx_id, ctx_place = id_[head], place[head]
    distinct = list(number)
    size = np.array([len(s) for s in distinct], np.int64)
    text = np.frombuffer(b"".join(distinct), np.uint8)
    ends = np.cumsum(size)
    # a key with one context, and one place in it, has no two equal windows to look for
    alone = _alone(text, ends - size, ends, key[head], min(K, width))
    known, dense = np.unique(ctx_id, return_inverse=True)
    plain, indexed = np.flatnonzero(alone), np.flatnonzero(~alone)
    parts = [(plain, np.zeros(len(plain), np.int64), size[plain] - width + 1, ctx_id[plain], ctx_place[plain])]
    if len(indexed):
        parts.append(_indexed_runs([distinct[i] for i in indexed.tolist()], indexed, dense[indexed], known, ctx_place[indexed], width))
    run_ctx, run_off, span, run_id, run_base = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(run_ctx, kind="stable")
    run_ctx, run_off, span, run_id, run_base = run_ctx[order], run_off[order], span[order], run_id[order], run_base[order]
    # a row of the answer for each entry and each run of its context
    first_run = np.searchsorted(run_ctx, np.arange(len(distinct)))
    n_runs = np.diff(np.append(first_run, len(run_ctx)))
    entry = np.repeat(np.arange(len(which)), n_runs[which])
    r = first_run[which[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(n_runs[which]) - n_runs[which], n_runs[which])
    own = (run_id[r] == id_[entry]) & (run_base[r] == place[entry]) & (multi[entry] == 0)
    entry, r = entry[~own], r[~own]
    name = np.stack(span_hashes(text, ends - size, ends), axis=1)
    return block[entry], name[run_ctx[r]], (run_off[r] << 32) | span[r], run_id[r], run_base[r]


def _alone(text: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Contexts whose key has no other context and stands at one place only."""
    _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
    gram = mix(grams(text, k))
    hit = np.concatenate((gram == np.repeat(key, end - start)[: len(gram)], np.zeros(k, bool)))
    places = np.concatenate(([0], np.cumsum(hit)))
    return (n[inv] == 1) & (places[np.maximum(end - k + 1, start)] - places[start] == 1)


def _indexed_runs(strings: list[bytes], number: np.ndarray, dense: np.ndarray, known: np.ndarray, ctx_place: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(context, first window, windows, first id, first place less the window) of stretches with one origin."""
    index = RunIndex(strings)
    root = index.equal_windows(width)
    windows = np.array([len(s) for s in strings], np.int64) - width + 1
    ctx = np.repeat(np.arange(len(strings)), windows)
    step = np.arange(len(ctx)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = index.starts[ctx] + step
    # the least (id, place) of all equal windows
    when = (dense[ctx].astype(np.int64) << 36) + ctx_place[ctx] + step
    least = np.full(index.n, np.iinfo(np.int64).max)
    np.minimum.at(least, root[at], when)
    first = least[root[at]]
    first_id, base = known[first >> 36], (first & ((1 << 36) - 1)) - step
    cut = np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (first_id[1:] != first_id[:-1]) | (base[1:] != base[:-1])))
    a = np.flatnonzero(cut)
    return number[ctx[a]], step[a], np.diff(np.append(a, len(ctx))), first_id[a], base[a]


def cut_repeats(table: pa.Table, told: pa.Table, width: int) -> pa.Table:
    ids = B.ids_of(table)
    hot = np.sort(B.unpacked(of_kind(told, HOTKEYS), "a", U64))
    told = of_kind(told, FIRST)
    name, span = B.unpacked(told, "a", U64).reshape(-1, 2), B.unpacked(told, "b", np.int64)
    first_id, base = B.unpacked(told, "c", np.int64), B.unpacked(told, "d", np.int64)
    order = np.argsort(name[:, 0])
    (name, other), span, first_id, base = name[order].T, span[order], first_id[order], base[order]
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for w in windows_of(table, width):
        cover = np.zeros(len(w.part) + 1, np.int32)
        if len(name):
            _, p, q = w.contexts(hot)
            if len(p):
                own = span_hashes(w.part, p, q + width)
                i, r = B.matches(own[0], name)
                same = own[1][i] == other[r]
                i, r = i[same], r[same]
                row = np.searchsorted(w.off, p[i], side="right") - 1
                here, place = ids[row + w.row], p[i] - w.off[row]
                late = (first_id[r] < here) | ((first_id[r] == here) & (base[r] < place))
                a = p[i][late] + (span[r][late] >> 32)
                np.add.at(cover, a, 1)
                np.add.at(cover, a + (span[r][late] & 0xFFFFFFFF) + width - 1, -1)
        gone = np.cumsum(cover)[:-1] > 0
        keep = ~gone
        size = np.concatenate(([0], np.cumsum(keep)))[w.off]
        n_bytes.append(np.diff(w.off))
        n_removed.append(np.diff(w.off) - np.diff(size))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = w.off[:-1][np.diff(w.off) > 0]
        begins[heads] = gone[heads]
        n_spans.append(np.diff(np.concatenate(([0], np.cumsum(begins)))[w.off]))
        raw = w.part[keep].tobytes()
        kept += [raw[size[i] : size[i + 1]] for i in range(len(size) - 1)]
    flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return pa.table(
        {
            "id": table["id"],
            "n_bytes": flat(n_bytes),
            "n_removed": flat(n_removed),
            "n_spans": flat(n_spans),
            "kept": pa.array(kept, pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
    )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, blocks: int | None = None, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove bytes covered by ``width``-byte strings that also start earlier in the corpus.

    Earlier is a smaller id, or the same id and an earlier byte. Returns
    (``id_col``, n_bytes, n_removed, n_spans, kept binary, kept_sha256), a row
    for each input row, and the columns named in ``carry`` as ``with_<name>``. Null texts are empty; a null id counts as the largest;
    rows of one id are ordered by place only; other columns are ignored; an
    empty table gives an empty table. ``hot`` sets how work is dealt, never
    the result.
    """
    n = blocks or B.block_count(docs, text_col)
    buckets = max(1, n // 2)
    base = B.in_blocks(docs, id_col, text_col, n, carry)
    shared = B.answer(B.ask(base, lambda t: minimizers_of(t, width), buckets), lambda t: shared_minimizers(t, hot))
    first = B.answer(B.ask_again(base, shared, lambda t, r: contexts_of(t, r, width), buckets), lambda t: first_places(t, width))
    told = first.unionByName(shared.where(shared.kind == HOTKEYS))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        return B.with_carried(cut_repeats(left, right, width), left, carry)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string" + B.carried(base, carry)
    out = base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(apply, schema)
    return out.withColumnRenamed("id", id_col)


def oracle(width: int = 100, piece: int = 1000) -> str:
    """DuckDB SQL for ``suffix_dedup`` over documents, with every string of ``width`` bytes as a row.

    Bytes are pairs of hexadecimal digits; texts are cut into overlapping pieces, as places in short strings are found faster.
    """
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT id, doc_id, k, substr(x, k * {2 * piece} + 1, {2 * (piece + width - 1)}) AS p FROM (SELECT *, unnest(range(0, (length(x) + {2 * piece - 1}) // {2 * piece})) AS k FROM d)),
strings AS (SELECT id, doc_id, k * {piece} + i AS pos, hash(substr(p, 2 * i + 1, {2 * width})) AS h FROM pieces, range({piece}) t(i) WHERE 2 * i + {2 * width} <= length(p)),
late AS (SELECT id, pos FROM (SELECT id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS rn FROM strings) WHERE rn > 1),
marked AS (SELECT id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY id ORDER BY pos) + {width} THEN 1 ELSE 0 END AS new FROM late),
grouped AS (SELECT id, pos, sum(new) OVER (PARTITION BY id ORDER BY pos) AS g FROM marked),
runs AS (SELECT id, min(pos) AS a, max(pos) + {width} AS b FROM grouped GROUP BY id, g),
n AS (SELECT id, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY id),
edges AS (SELECT id, a, b FROM runs UNION ALL SELECT id, length(x) // 2, length(x) // 2 FROM d),
parts AS (SELECT id, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a, b), 0) AS s, a AS e FROM edges),
kept AS (SELECT id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s, e) AS x FROM parts JOIN d USING (id) WHERE e > s GROUP BY id)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (id) LEFT JOIN kept USING (id)"""
