"""Operator 12 against whole-text encodings and plain sets."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment as T
from tidemark.llm.queries import QUERIES

FOLDER = T.VOCABULARIES


def plain(texts):
    """Result rows of a list of texts: each is encoded as a whole, links and groups by plain loops."""
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    letters = {c: bytes([i]) for i, c in enumerate(bytes_to_letters())}
    docs = []
    for text in texts:
        links, groups, n = [], [], (0, 0)
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw_a = [b"".join(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                n = (len(ids_a), len(ids_b))
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                both, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
                for cut in both:
                    own_a, own_b = [], []
                    while i < len(ends_a) and ends_a[i] <= cut:
                        own_a.append(ids_a[i])
                        i += 1
                    while j < len(ends_b) and ends_b[j] <= cut:
                        own_b.append(ids_b[j])
                        j += 1
                    groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                    links += [(x, y) for x in own_a for y in own_b]
        docs.append((n, groups, links))
    count = collections.Counter(x for _, _, links in docs for x in set(links))
    most = collections.defaultdict(int)
    for (x, _), k in count.items():
        most[x] = max(most[x], k)
    return [(*n, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n, groups, links in docs]


def bytes_to_letters():
    """The character for each byte in a byte-level vocabulary."""
    spare = iter(range(0x100, 0x200))
    return [chr(i) if 0x21 <= i <= 0x7E or 0xA1 <= i <= 0xAC or 0xAE <= i <= 0xFF else chr(next(spare)) for i in range(256)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_crafted_texts(spark):
    rng = random.Random(2)
    pieces = ["the", "token", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", " ", "　", "\u0085", "é", "Straße", "naïve", "日本語", "🙂👩‍👩‍👧", "́", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "123456", "don't", "--", "ſ", "ﬁ", "​", "᠎", "x" * 300, ".", ",", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", " ", "\n", "a", " a", "a ", "word " * 5000, "z" * 20_000, "\n" * 3000, "the", "the", None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, links int").repartition(3)
    want = plain(texts)
    for size in (T.BLOCK_BYTES, 500):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in T.align_tokens(df, block_bytes=size).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == want[i], (i, t)
    assert T.align_tokens(df.limit(0)).count() == 0
    nulls = T.align_tokens(spark.createDataFrame([(None, "a b"), (None, "a c"), (1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in nulls) == sorted(plain(["a b", "a c", "a b", "a b"]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain([r.text for r in rows]), strict=True)}
    got = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, folder).collect()}
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in got.items()} == want
    # overlaps lie within groups, and every token overlaps something
    assert all(max(r.n_a, r.n_b) <= r.n_overlaps <= r.n_links for r in got.values())


def test_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.random((rng.integers(1, 8), 6)) < 0.4, rng.random((6, rng.integers(1, 9))) < 0.4
        a, b = (T.Csr.of_pairs(*np.nonzero(m), *m.shape) for m in (x, y))
        row, column, value = a.times(b)
        got = np.zeros((x.shape[0], y.shape[1]), int)
        got[row, column] = value
        assert (got == x.astype(int) @ y.astype(int)).all()
        assert (np.diff(a.transposed().at) == x.sum(0)).all()
