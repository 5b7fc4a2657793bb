"""Operator 13 against a plain search over all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import conversation_repair as R
from tidemark.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_name, turn_name = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [] if fault == 0 else [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


#: (state, initial) of the pattern; accepting are 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, [(role, text)]) by a search over (row, state), from the end; ``rows`` are (role, text, fault)."""
    names = {"u": "user", "a": "assistant"}
    best = {}
    for i in range(len(rows), -1, -1):
        for q in range(4):
            options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
            if i < len(rows):
                role, text, fault = rows[i]
                c, s, out = best[i + 1, q]
                options.append((c + 4, "D" + s, out))
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    for letter, cost, initial, name in [("K", 0, role[:1], role)] + [("R", 3, x, names[x]) for x in "ua"]:
                        if (q, initial) in STEP:
                            c, s, out = best[i + 1, STEP[q, initial]]
                            options.append((c + cost + extra, letter + s, ((name, text), *out)))
            best[i, q] = min(options, default=(10**9, "", ()))
        for _ in range(4):
            for q in range(4):
                for x in "ua":
                    if (q, x) in STEP:
                        c, s, out = best[i, STEP[q, x]]
                        best[i, q] = min(best[i, q], (c + 3, "I" + s, ((names[x], ""), *out)))
    return best[0, 0]


def plain(rows, with_damage=True):
    """{conv: result} of (conv, turn, role, text) rows."""
    groups = collections.defaultdict(list)
    for r in damage(rows) if with_damage else [(c, t, *(" " if x is None else x for x in (a, b))) for c, t, a, b in rows]:
        groups[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        seen, judged = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, final = cheapest(judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        n = collections.Counter(f for *_, f in judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def result(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def crafted(n, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "u", "ünder"]
    texts = ["Yes.", "Yes.", "No", "\n", "", None, "Why?  \n", "é!", "...", "a\tb", "Done. ok", "\x0b x"]
    rows = []
    for conv in range(n):
        turn = rng.randint(-2, 2)
        for _ in range(rng.randint(1, longest)):
            rows.append((conv if conv else None, None if rng.random() < 0.03 else turn, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn}."))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, segment string, cost long, audit string"


@pytest.mark.parametrize("with_damage", [True, False])
def test_crafted(spark, with_damage):
    rows = crafted(250, 12, 4) + crafted(3, 200, 5)[40:]
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA).repartition(5)
    for segments in (1, 7, 150):
        assert result(R.repair_conversations(df, damage=with_damage, segments=segments)) == plain(rows, with_damage)


def test_one_long_conversation_over_many_segments(spark):
    rows = [(5, i, ("user", "assistant", "system")[i * 7 % 5 % 3], "Same." if i % 3 else f"Text {i}" + "." * (i % 2)) for i in range(1500)] + [(6, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)
    assert result(R.repair_conversations(df, segments=40)) == plain(rows)
    assert R.repair_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_conversations(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_conversation_repair"](spark, folder)) == plain(rows)


def test_tables_equal_single_steps():
    t, rng = R.tables(), random.Random(1)
    assert len(t.vectors) < 200
    for _ in range(300):
        symbols = [rng.randrange(R.SYMBOLS) for _ in range(rng.randint(0, 10))]
        want = R.END
        for s in reversed(symbols):
            want = R.before(s, want)
        assert R.least_costs(symbols, R.END) == want
        cut = rng.randint(0, len(symbols))
        assert R.through(R.summed_up(symbols[:cut]), R.least_costs(symbols[cut:], R.END)) == want
