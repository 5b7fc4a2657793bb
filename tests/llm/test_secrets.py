"""Operator 11: places against a plain scan, the models' judgement, odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secret_scan as S
from tidemark.llm.queries import QUERIES

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    """(start, kind number, end) of the rules, by a plain scan."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def expected(text):
    spans = base_spans(text)
    joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return tuple(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def check(rows, texts):
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id if r.doc_id is not None else -1]
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == expected(text), text
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        assert [(a, S.KINDS.index(k), b) for k, a, b in spans if k != "markov"] == base_spans(text)
        assert spans == sorted(spans, key=lambda x: (x[1], S.KINDS.index(x[0])))
        assert all(re.fullmatch(r"[A-Za-z0-9+/_-]{16,}={0,2}", text[a:b]) for k, a, b in spans if k == "markov")


def test_crafted_texts(spark):
    pieces = ["token", "secret=token:abcdefgh", "password==", "PassWd : 'x1y2z3.=-'", "api_key=", "apikey \"=\" q", "AKIAAKIA", "AKIA" + "Q7" * 9, "AKIAx", "0f" * 13, "f" * 23, "é", "𝒳", "\n", " ", "api_key: 12345", "secret:", "\"", "ſecret=abcdefgh", "toKen=abcdefgh"]
    rng = random.Random(3)
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for i in range(150)}
    texts |= {900: None, 901: "", 902: "token=abcdef " * 3000, 903: "a1" * 200_000, -1: "secret=null-id-1"}
    df = spark.createDataFrame([(None if i < 0 else i, t, "t", 1, "m") for i, t in texts.items()], "doc_id long, text string, run string, base int, markov string")
    check(S.secret_scan(df).collect(), texts)
    twice = S.secret_scan(df.unionByName(df)).groupBy("doc_id", "spans").count()
    assert twice.where("count % 2 = 1").isEmpty()
    assert S.secret_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    check(QUERIES["op11_secret_scan"](spark, folder).collect(), texts)


def test_models_tell_random_strings_from_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    secrets = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in ((S.ALPHABET[:62], 24), (S.ALPHABET[:64], 40), ("0123456789ABCDEF", 32), (S.ALPHABET[26:62], 24)) for _ in range(25)]
    names = ["userAccountInformation", "mapreduce-framework-name", "DRIVER_MEMORY_OVERHEAD", "thermodynamically", "2024/01/17-report", "4111111111111111", "weltanschauungen/verheiratet"]
    rows = [(10_000 + i, f"see {s} here") for i, s in enumerate(secrets)] + [(20_000 + i, f"see {s} here") for i, s in enumerate(names)]
    got = {r.doc_id: r for r in S.secret_scan(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 10000").collect()}
    assert sum(got[10_000 + i].n_markov for i in range(len(secrets))) >= 0.95 * len(secrets)
    assert sum(got[20_000 + i].n_markov for i in range(len(names))) <= 2
    i = next(i for i in range(len(secrets)) if got[10_000 + i].n_markov)
    assert got[10_000 + i].spans == f"markov:4:{4 + len(secrets[i])}"


def test_sums_before(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        df = spark.createDataFrame([(list(range(n)),)], "s array<bigint>")
        assert df.select(F.expr(S.sums_before("s")).alias("b")).first().b == [i * (i - 1) // 2 for i in range(n)]
