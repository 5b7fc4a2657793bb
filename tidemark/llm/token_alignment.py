"""Operator 12 - alignment of two tokenizers' tokens by sparse products.

Each tokenizer gives an incidence matrix of tokens and bytes in compressed rows
(CSR). Gustavson's row product A.Bt links tokens that overlap in bytes. Places
where tokens of both end cut the bytes into groups; the product of the two
token-group incidence matrices links all tokens that share a group.

Both tokenizers start anew at a blank or line end after another character
(checked against the pieces of B when it is loaded; of A it follows from its
splitting rule), so texts are cut there and each distinct stretch of a block is
encoded and multiplied once; a text is then a list of stretches.

Scale: texts are never shuffled. One map pass writes, in the shared folder, for
each document the numbers of its stretches, and for each block of about
``BLOCK_BYTES`` its stretches' links and how many of its documents hold each.
Only (block, link, count) rows are shuffled, at most one for each link and
block; the counts come back to the blocks by a join, and nothing that grows with
the corpus is broadcast or collected.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

#: Where the vocabulary files are, unless told otherwise.
VOCABULARIES = "/opt/tokenizers"
#: Bytes of text whose stretches are numbered together, and most stretches of them.
BLOCK_BYTES, BLOCK_STRETCHES = 16 << 20, 200_000
#: A link is the number of A's token times this, plus that of B's; both are below it.
B_IDS = 1 << 16
#: Stretches that are encoded by themselves: those that end in a blank, or hold a character that B reads as one.
ODD = re.compile(r"▁|\s\Z")
#: From a blank or line end after another character up to the next.
STRETCH = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
PIECES = "block string, doc boolean, id {id}, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, digest string, stretches binary, links binary, held binary"


class Csr:
    """Rows of a sparse matrix: ``columns[at[i]:at[i + 1]]`` are those of row i (all values are one)."""

    def __init__(self, at: np.ndarray, columns: np.ndarray, width: int):
        self.at, self.columns, self.width = at, columns, width

    @classmethod
    def of_pairs(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        order = np.lexsort((columns, rows))
        return cls(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=height)))), columns[order], width)

    def transposed(self) -> Csr:
        height = len(self.at) - 1
        rows = np.repeat(np.arange(height), np.diff(self.at))
        return Csr.of_pairs(self.columns, rows, self.width, height)

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product, by rows: each entry of a row adds the row of ``other`` that it names."""
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        n = np.diff(other.at)[self.columns]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        code = np.repeat(rows, n) * other.width + other.columns[np.repeat(other.at[self.columns], n) + step]
        if len(code) and (code[1:] >= code[:-1]).all():
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            code, value = code[first], np.diff(np.append(first, len(code)))
        else:
            code, value = np.unique(code, return_counts=True)
        return code // other.width, code % other.width, value


def incidence(ends: np.ndarray, total: int) -> Csr:
    """Tokens and their bytes, from the place after each token's last byte."""
    return Csr(np.concatenate(([0], ends)), np.arange(total), total)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, A and B token of each link, number of overlap links of each group).

    ``ends_*`` are the places after the tokens of one stretch of bytes, which both cover.
    """
    total = int(ends_a[-1]) if len(ends_a) else 0
    overlap_a, _, _ = incidence(ends_a, total).times(incidence(ends_b, total).transposed())
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    width = len(cuts)
    of_a, of_b = Csr(np.arange(len(ends_a) + 1), group_a, width), Csr(np.arange(len(ends_b) + 1), group_b, width)
    link_a, link_b, _ = of_a.times(of_b.transposed())
    return group_a, group_b, link_a, link_b, np.bincount(group_a[overlap_a], minlength=width)


def byte_alphabet() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes the bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [i for i in range(256) if i not in set(plain)]
    return {chr(i): i for i in plain} | {chr(0x100 + k): i for k, i in enumerate(others)}


class TokenBytes:
    """Bytes of the tokens of one tokenizer."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.names = [str(i) for i in range(len(raw))]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Encoded(NamedTuple):
    """Tokens of A and of B of some stretches, one after another, how many each stretch has, and whether it fits."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    fits: np.ndarray

    @classmethod
    def interleaved(cls, parts: list[Encoded], second: np.ndarray) -> Encoded:
        """Stretches of two parts in one order, in which ``second`` tells the part."""
        order = np.empty(len(second), np.int64)
        order[~second], order[second] = np.arange(len(parts[0].n_a)), np.arange(len(parts[1].n_a)) + len(parts[0].n_a)

        def put(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = (np.cumsum(n) - n)[order]
            n = n[order]
            return tokens[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

        a, n_a, b, n_b, fits = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(*put(a, n_a), *put(b, n_b), fits[order])


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{file_a}")
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab()
        raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.table_a = TokenBytes(raw)
        rule = json.loads(self.a.to_str())["pre_tokenizer"]
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{file_b}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.table_b = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if max(len(raw), len(pieces)) > B_IDS:
            raise ValueError(f"vocabularies of more than {B_IDS} tokens")
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.blank = self.b.piece_to_id("▁")
        #: Whether no piece goes on over a place where texts are cut.
        self.cuts = rule["type"] == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"] and not any(re.search("[^▁]▁|\n| ", p) for p in own) and self.table_b.raw[self.blank] == b" "

    def stretches(self, text: str) -> list[str]:
        """The blank and the text, in parts that both tokenizers encode on their own."""
        return STRETCH.findall(" " + text) if self.cuts else [" " + text]

    def encode(self, stretches: list[str]) -> Encoded:
        """Tokens of stretches: plain ones as one text, others one by one."""
        odd = [i for i, s in enumerate(stretches) if ODD.search(s)] if self.cuts else range(len(stretches))
        if not len(odd):
            return self.encode_joined(stretches) or self.encode_each(stretches)
        is_odd = set(odd)
        parts = [x for x in ([s for i, s in enumerate(stretches) if i not in is_odd], [stretches[i] for i in odd]) if x]
        both = [self.encode_joined(x) or self.encode_each(x) if k == 0 and len(parts) == 2 else self.encode_each(x) for k, x in enumerate(parts)]
        if len(parts) == 1:
            return both[0]
        return Encoded.interleaved(both, np.array([i in is_odd for i in range(len(stretches))]))

    def encode_joined(self, stretches: list[str]) -> Encoded | None:
        """None unless both tokenizers give the bytes back and begin a token at each stretch."""
        text = "".join(stretches)
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum([len(s.encode()) for s in stretches])
        out = []
        for ids, table in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.table_a), (self.of_b([text])[0], self.table_b)):
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(table.size[ids])
            at = np.searchsorted(token_ends, ends)
            if token_ends[-1] != len(raw) or (token_ends[at] != ends).any() or not np.array_equal(table.joined(ids), raw):
                return None
            out += [ids, np.diff(at + 1, prepend=0)]
        return Encoded(*out, np.ones(len(stretches), bool))

    def encode_each(self, stretches: list[str]) -> Encoded:
        """Tokens of each stretch; those that are not given back byte for byte have none and do not fit."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        ids_b = self.of_b(stretches)
        fits = np.array([b"".join([self.table_a.raw[i] for i in a]) == s.encode() == b"".join([self.table_b.raw[i] for i in b]) for s, a, b in zip(stretches, ids_a, ids_b, strict=True)])
        flat = lambda rows: np.array([x for r, fit in zip(rows, fits, strict=True) if fit for x in r], np.int64)
        sizes = lambda rows: np.array([len(r) * bool(fit) for r, fit in zip(rows, fits, strict=True)], np.int64)
        return Encoded(flat(ids_a), sizes(ids_a), flat(ids_b), sizes(ids_b), fits)

    def of_b(self, stretches: list[str]) -> list[list[int]]:
        """Tokens of B, which puts a blank before what it encodes: it is taken from the stretch or from its tokens."""
        out = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for i, s in enumerate(stretches):
            if s == " ":
                out[i] = [self.blank]
            elif s[0] != " " and out[i][:1] == [self.blank]:
                out[i] = out[i][1:]
        return out


@functools.lru_cache(maxsize=2)
def tokenizers(folder: str, file_a: str, file_b: str) -> Tokenizers:
    return Tokenizers(folder, file_a, file_b)


class Block:
    """Stretches of some documents: each is encoded, aligned and numbered once."""

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: Tokens of A and B, groups, links and overlaps of each stretch.
        self.sizes = np.zeros((0, 5), np.int64)
        self.fits = np.zeros(0, bool)
        self.codes = [np.zeros(0, np.uint32)]
        self.docs: list[np.ndarray] = []

    def learn(self, new: list[str]) -> None:
        """Encode stretches and keep their groups and links."""
        if not new:
            return
        e = self.tools.encode(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        # one product for all stretches, whose bytes stand one after another
        group_a, group_b, link_a, link_b, overlaps = align(np.cumsum(self.tools.table_a.size[e.a]), np.cumsum(self.tools.table_b.size[e.b]))
        to_a = np.concatenate(([0], np.cumsum(e.n_a)))
        n_groups = np.zeros(len(new), np.int64)
        some = e.n_a > 0
        n_groups[some] = group_a[to_a[1:][some] - 1] - group_a[to_a[:-1][some]] + 1
        to_g = np.concatenate(([0], np.cumsum(n_groups)))
        to_l = np.searchsorted(link_a, to_a)
        over = np.concatenate(([0], np.cumsum(overlaps)))
        self.groups += self.told(e, group_a, group_b, to_g)
        self.fits = np.concatenate((self.fits, e.fits))
        self.codes.append((e.a[link_a] * B_IDS + e.b[link_b]).astype(np.uint32))
        self.sizes = np.concatenate((self.sizes, np.stack((e.n_a, e.n_b, n_groups, np.diff(to_l), np.diff(over[to_g])), axis=1)))

    def told(self, e: Encoded, group_a: np.ndarray, group_b: np.ndarray, to_g: np.ndarray) -> list[str]:
        """Groups of each stretch as ``a1,a2|b1;a3|b2,b3``."""

        def parts(token: np.ndarray, group: np.ndarray, names: list[str]) -> list[str]:
            own = [names[i] for i in token.tolist()]
            edges = np.searchsorted(group, np.arange(int(to_g[-1]) + 1)).tolist()
            return [own[a] if b == a + 1 else ",".join(own[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

        sides = zip(parts(e.a, group_a, self.tools.table_a.names), parts(e.b, group_b, self.tools.table_b.names), strict=True)
        both = [f"{a}|{b}" for a, b in sides]
        edges = to_g.tolist()
        return [both[a] if b == a + 1 else ";".join(both[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def add(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, n_overlaps, digest, numbers of the stretches) of each text."""
        cut = [self.tools.stretches(t) if t else [] for t in texts]
        known = self.number
        self.learn(list({s: None for c in cut for s in c if s not in known}))
        codes = np.concatenate(self.codes)
        self.codes = [codes]
        n_links = self.sizes[:, 3]
        first = np.cumsum(n_links) - n_links
        name, groups, out, rows = known.__getitem__, self.groups.__getitem__, [], []
        for k, c in enumerate(cut):
            numbers = np.array(list(map(name, c)), np.int32)
            if not c or not self.fits[numbers].all():
                out.append((0, 0, 0, 0, 0, "", np.zeros(0, np.int32)))
                continue
            digest = hashlib.sha256()
            for i in range(0, len(c), 1 << 14):
                digest.update(((";" if i else "") + ";".join(map(groups, numbers[i : i + (1 << 14)].tolist()))).encode())
            out.append((*self.sizes[numbers].sum(0).tolist(), digest.hexdigest(), numbers))
            rows.append((k, np.unique(numbers)))
        if rows:
            # links of all these documents at once, each told once a document
            own = np.concatenate([x for _, x in rows])
            n = n_links[own]
            code = codes[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            doc = np.repeat(np.repeat(np.array([k for k, _ in rows], np.uint64), [len(x) for _, x in rows]), n)
            each = np.unique((doc << np.uint64(32)) | code.astype(np.uint64))
            link, count = np.unique((each & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
            self.docs.append(np.stack((link.astype(np.int64), count)))
            if len(self.docs) > 8:
                self.docs = [summed(self.docs)]
        return out

    def rows(self) -> tuple[bytes, bytes]:
        """Links of all stretches (how many, how many each, and they), and (link, number of documents) of the block; compressed."""
        n = self.sizes[:, 3].astype(np.uint32)
        held = summed(self.docs)
        return packed(np.concatenate((np.array([len(n)], np.uint32), n, *self.codes))), packed(held[0].astype(np.uint32), held[1].astype(np.uint32))


def packed(*parts: np.ndarray) -> bytes:
    """Numbers of 32 bits, after their number of bytes."""
    raw = np.concatenate(parts).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: pa.Buffer, dtype=np.uint32) -> np.ndarray:
    size = int.from_bytes(blob.slice(0, 8).to_pybytes(), "little")
    return np.frombuffer(pa.decompress(blob.slice(8), decompressed_size=size, codec="zstd", asbytes=True), dtype)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of links and counts with each link once."""
    if not parts:
        return np.zeros((2, 0), np.int64)
    code, n = np.concatenate(parts, axis=1)
    keys, at = np.unique(code, return_inverse=True)
    return np.stack((keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)))


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES, file_a: str = "byte_bpe_50k.json", file_b: str = "piece_bpe_32k.model", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Links between the tokens that two tokenizers give each text.

    Returns (``id_col``, n_a, n_b, n_groups, n_links, n_overlaps, n_best,
    count_sum, groups_sha256), a row for each input row: tokens of A and of B,
    groups, pairs of tokens that share a group and pairs that overlap, links whose count of documents
    is the highest of their A token, and the sum of the counts. Texts that are
    null or empty, or that either tokenizer does not give back byte for byte,
    have no tokens: zeros and an empty digest. Every row is a document of its
    own, also with a null or repeated id; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = PIECES.format(id=kind)

    def encode(batches):
        tools = tokenizers(folder, file_a, file_b)
        block, name, size, open_rows = Block(tools), uuid.uuid4().hex, 0, False
        names = [f.split(" ")[0] for f in schema.split(", ")]

        def closed(id_type: pa.DataType) -> pa.RecordBatch:
            links, held = block.rows()
            row = {"block": name, "doc": False, "links": links, "held": held}
            kinds = {"block": pa.string(), "doc": pa.bool_(), "id": id_type, "digest": pa.string(), "stretches": pa.binary(), "links": pa.binary(), "held": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row.get(c)], kinds.get(c, pa.int64())) for c in names], names)

        for batch in batches:
            texts, done = batch["text"], 0
            while done < batch.num_rows:
                upto, here = done, 0
                while upto < batch.num_rows and (upto == done or here < 1 << 20):
                    here += len(texts[upto].as_buffer()) if texts[upto].is_valid else 0
                    upto += 1
                made = block.add(texts.slice(done, upto - done).to_pylist())
                cols = list(zip(*made, strict=True))
                n = upto - done
                arrays = [pa.array([name] * n), pa.array([True] * n), batch["id"].slice(done, n), *(pa.array(cols[k], pa.int64()) for k in range(5)), pa.array(cols[5], pa.string()), pa.array([packed(x) for x in cols[6]], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)
                done, size, open_rows = upto, size + here, True
                if size >= block_bytes or len(block.number) >= BLOCK_STRETCHES:
                    yield closed(batch["id"].type)
                    block, name, size, open_rows = Block(tools), uuid.uuid4().hex, 0, False
        if open_rows:
            yield closed(batch["id"].type)

    def unpack(batches):
        for batch in batches:
            for name, held in zip(batch["block"], batch["held"], strict=True):
                code, n = unpacked(held.as_buffer()).astype(np.int64).reshape(2, -1)
                for k in range(0, len(code), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(code[part])), pa.array(code[part]), pa.array(n[part])], ["block", "link", "n"])

    path = f"{shared_dir(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    # names of blocks are drawn in the task, so what one attempt wrote is kept as a table before anything reads it
    base.mapInArrow(encode, schema).write.parquet(path)
    pieces = docs.sparkSession.read.schema(schema).parquet(path)
    held = pieces.where("not doc").select("block", "held").mapInArrow(unpack, "block string, link long, n long")
    counts = held.groupBy("link").agg(F.sum("n").alias("n"))
    best = counts.groupBy(F.floor(F.col("link") / B_IDS).alias("a")).agg(F.max("n").alias("most"))
    told = counts.join(best, F.floor(F.col("link") / B_IDS) == F.col("a")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = held.select("block", "link").join(told, "link")

    def finish(group: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        links = unpacked(next(x for x in table["links"] if x.is_valid).as_buffer()).astype(np.int64)
        counts, code = links[1 : 1 + links[0]], links[1 + links[0] :]
        key = known["link"].to_numpy()
        order = np.argsort(key)
        key, n, top = key[order], known["n"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False).astype(np.int64)[order]
        at = np.minimum(np.searchsorted(key, code), max(0, len(key) - 1))
        # links of stretches that only texts without tokens hold have no count
        some = key[at] == code if len(key) else np.zeros(len(code), bool)
        edge = np.concatenate(([0], np.cumsum(counts)))
        of_stretch = [np.diff(np.concatenate(([0], np.cumsum(np.where(some, x[at], 0) if len(key) else np.zeros(len(code), np.int64))))[edge]) for x in (n, top)]
        rows = table.filter(table["doc"])
        held = [unpacked(x.as_buffer(), np.int32) for x in rows["stretches"]]
        sums = [[int(x[h].sum()) for h in held] for x in of_stretch]
        out = {c: rows[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps")}
        return pa.table(out | {"n_best": pa.array(sums[1], pa.int64()), "count_sum": pa.array(sums[0], pa.int64()), "groups_sha256": rows["digest"]})

    result = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_best long, count_sum long, groups_sha256 string"
    return pieces.drop("held").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, result).withColumnRenamed("id", id_col)
