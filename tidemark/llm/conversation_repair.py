"""Operator 13 - repair of conversations by Four-Russians block tables.

The rows of a conversation must read, by the initials of their roles, as
``(s?(ua)+)?``. Cheapest edits are found backward: beside each row stands the
vector of the least costs from the four states of that pattern to the end. Less
its smallest entry such a vector is one of a few, so the step over every block
of ``WIDTH`` symbols is looked up in a table of (vector, block); a block is
expanded row by row only when its edits are traced, forward, with the
ASCII-least letter among the cheapest.

Scale: rows are dealt into segments by ranges of (conversation, order), so a
conversation of any length is spread over many tasks. Segments of a conversation
that has several are summed up by their costs from each state to each state
(four by four numbers), which are put together per conversation, one small row a
segment; then each segment is traced on its own cost vector. Counts, gaps
and repeated rows are aggregates that combine before they are shuffled. Only the
digest of a conversation is bound to one task, as a SHA-256 has no parallel
form; it reads the segments one after another and holds one at a time.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import shuffle_parts
from .shared import shared_dir

#: Costs of the edits and the extra cost of a kept row that is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States of the pattern: nothing yet, after s, after u, after a; the second row of a table is where an inserted or changed row leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FORWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}
#: Where a kept row of an initial leads from each state (None: nowhere).
KEEP = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
FAR = 1 << 40
#: Symbols: the initial of a sound row or of one that is cut off, or a row that must go.
INITIALS = "sua*"
GONE = 2 * len(INITIALS)
SYMBOLS = GONE + 1
#: Rows in a block of the tables.
WIDTH = 3
SPACE = r"\x20\x09-\x0D"


def with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs if rows may be inserted first."""
    out = list(costs)
    for _ in range(len(FORWARD)):
        out = [min(c, INSERT + out[FORWARD[q]]) for q, c in enumerate(out)]
    return tuple(min(c, FAR) for c in out)


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = CUT_OFF if symbol >= len(INITIALS) else 0
        to = KEEP.get(INITIALS[symbol % len(INITIALS)], (None,) * 4)[state]
        if to is not None:
            out.append(("K", extra, to))
        out.append(("R", REROLE + extra, FORWARD[state]))
    return out


def before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a row, given those from after it (inserts included)."""
    return with_inserts(tuple(min(c + costs[to] for _, c, to in moves(symbol, q)) for q in range(4)))


def normalised(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, FAR) if c < FAR else FAR for c in costs), least


END = with_inserts((0, FAR, FAR, 0))


class Tables:
    """Steps over every block of each width up to ``WIDTH``, for every cost vector that can occur."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        # the end, and each state alone, by which segments are summed up
        for v in (END, *(with_inserts(tuple(0 if q == k else FAR for q in range(4))) for k in range(4))):
            self.add(normalised(v)[0])
        step, done = [], 0
        while done < len(self.vectors):
            step.append([])
            for symbol in range(SYMBOLS):
                v, least = normalised(before(symbol, self.vectors[done]))
                step[done].append((self.add(v), least))
            done += 1
        to, cost = np.array(step, np.int64).transpose(2, 0, 1)
        #: ``to[w][vector, block]`` and ``cost[w][vector, block]``; the last symbol of a block counts least and is the first passed.
        self.to, self.cost = {1: to}, {1: cost}
        for w in range(2, WIDTH + 1):
            after, spent = self.to[w - 1], self.cost[w - 1]
            # the rest of the block lies behind its first symbol: block = first * SYMBOLS ** (w - 1) + rest
            self.to[w] = to[after].transpose(0, 2, 1).reshape(len(to), -1)
            self.cost[w] = (cost[after] + spent[:, :, None]).transpose(0, 2, 1).reshape(len(to), -1)

    def add(self, v: tuple[int, ...]) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def of(self, costs: tuple[int, ...]) -> tuple[int, int]:
        v, least = normalised(costs)
        return self.number[v], least


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, width, number) of the blocks of a segment; a short one comes first."""
    out, at = [], 0
    while at < len(symbols):
        width = (len(symbols) - at) % WIDTH or WIDTH
        number = 0
        for s in symbols[at : at + width]:
            number = number * SYMBOLS + s
        out.append((at, width, number))
        at += width
    return out


def back(symbols: list[int], costs: tuple[int, ...]) -> tuple[list[tuple[int, int, int, int]], tuple[int, ...], int]:
    """((start, width, vector after it, cost up to that) of each block from the last to the first, vector before all, its cost)."""
    t = tables()
    vector, spent = t.of(costs)
    passed = []
    for start, width, number in reversed(blocks_of(symbols)):
        passed.append((start, width, vector, spent))
        spent += int(t.cost[width][vector, number])
        vector = int(t.to[width][vector, number])
    return passed, t.vectors[vector], spent


def least_costs(symbols: list[int], costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a segment, given those from after it."""
    _, v, spent = back(symbols, costs)
    return tuple(min(c + spent, FAR) for c in v)


def summed_up(symbols: list[int]) -> list[int]:
    """Costs of a segment from each state (slow) to each state (fast)."""
    columns = [least_costs(symbols, with_inserts(tuple(0 if q == k else FAR for q in range(4)))) for k in range(4)]
    return [columns[k][q] for q in range(4) for k in range(4)]


def through(matrix: list[int], costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(matrix[4 * q + k] + costs[k] for k in range(4)), FAR) for q in range(4))


def trace(symbols: list[int], costs: tuple[int, ...], state: int, last: bool) -> tuple[str, list[tuple[int | None, str | None]], int]:
    """(letters, (row or None, role or None) of what is kept or inserted, state after the segment).

    A segment that is not the last leaves inserts at its end to the next one.
    """
    t = tables()
    letters, kept = [], []
    for start, width, vector, _ in reversed(back(symbols, costs)[0]):
        # the block is expanded backward, then its rows are passed forward
        after = [t.vectors[vector]]
        for s in reversed(symbols[start : start + width]):
            after.append(before(s, after[-1]))
        after.reverse()
        for k in range(width):
            while True:
                here, options = after[k][state], [("I", INSERT + after[k][FORWARD[state]], FORWARD[state])]
                options += [(x, c + after[k + 1][to], to) for x, c, to in moves(symbols[start + k], state)]
                letter, _, to = min(x for x in options if x[1] == here)
                letters.append(letter)
                state = to
                if letter != "I":
                    break
                kept.append((None, ROLE_OF[to]))
            if letter != "D":
                kept.append((start + k, ROLE_OF[to] if letter == "R" else None))
    while last and costs[state] > 0:
        state = FORWARD[state]
        letters.append("I")
        kept.append((None, ROLE_OF[state]))
    return "".join(letters), kept, state


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, copy) after the damage of the contract; nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank(text_col), "[.!?]", "")).otherwise(blank(text_col))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(fault == 4, "user").otherwise(blank(role_col)).alias("role"), text.alias("text"), times.alias("times"))
    return out.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True, segments: int | None = None
) -> DataFrame:
    """Cheapest edits that give each conversation alternating roles and whole, single rows.

    Returns (``conv_col``, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256), a row for each conversation, a null one included.
    Rows are taken by turn, nulls first, then by role and text, so equal turns
    and repeated rows have one order; nulls of role and text are one blank. With
    ``damage`` rows are first damaged by the digest of their conversation and turn.
    A conversation whose rows are all gone has zeros, an empty audit and the
    digest of the empty string. Other columns are ignored.
    """
    spark = rows.sparkSession
    parts = segments or shuffle_parts(rows)
    conversations = rows.select(F.col(conv_col).alias("conv")).distinct()
    if damage:
        dealt = damaged(rows, conv_col, turn_col, role_col, text_col)
    else:
        dealt = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    dealt = dealt.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(parts, "conv", F.col("turn").asc_nulls_first(), "role", "text", "own")
    path = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    dealt.withColumn("segment", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    order = ["segment", F.col("turn").asc_nulls_first(), "role", "text", "own"]
    # a row is repeated if an earlier one has its role and text: found among the equal rows of each conversation
    same = ["conv", "role", F.length("text"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut_off = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    # first in its segment, then first among the firsts of all segments, so that no equal rows are too many for a task
    marked = kept.withColumn("again", F.row_number().over(Window.partitionBy("segment", *same).orderBy(*order)) > 1)
    firsts = marked.where("not again").withColumn("again", F.row_number().over(Window.partitionBy(*same).orderBy("segment")) > 1)
    judged = marked.where("again").unionByName(firsts).withColumn("fault", F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut_off, "truncated").otherwise("")).drop("again")
    judged_path = f"{path}-judged"
    judged.write.parquet(judged_path)
    judged = spark.read.parquet(judged_path)
    counted = judged.groupBy("conv").agg(
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.min("segment").alias("first"), F.max("segment").alias("last"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    turns = kept.select("conv", "turn").where("turn is not null").distinct().groupBy("conv").agg(F.count("turn").alias("turns"))
    wide = counted.where("first < last").select("conv", "first", "last")
    kind = kept.schema["conv"].dataType.simpleString()

    def symbol(role: str, fault: str) -> int:
        if fault in ("blank", "duplicate"):
            return GONE
        k = INITIALS.find(role[:1]) if role[:1] else -1
        return (len(INITIALS) - 1 if k < 0 else k) + (len(INITIALS) if fault == "truncated" else 0)

    def stretches(batches, columns: list[str]):
        """Runs of rows of one conversation and segment, put together over batches."""
        held, key = [], None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if row[:2] != key and held:
                    yield key, held
                    held = []
                key = row[:2]
                held.append(row)
        if held:
            yield key, held

    def sums(batches):
        for (conv, segment), held in stretches(batches, ["conv", "segment", "role", "fault"]):
            matrix = summed_up([symbol(r[2], r[3]) for r in held])
            yield pa.RecordBatch.from_pydict({"conv": pa.array([conv], conv_type), "segment": pa.array([segment], pa.int32()), "matrix": pa.array([matrix], pa.list_(pa.int64()))})

    def ends(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Costs from after each segment of a conversation to its end."""
        table = table.sort_by("segment")
        costs, out = END, []
        for matrix in reversed(table["matrix"].to_pylist()):
            out.append(list(costs))
            costs = through(matrix, costs)
        return table.select(["conv", "segment"]).append_column("costs", pa.array(out[::-1], pa.list_(pa.int64())))

    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
    by_segment = ["conv", *order]
    # at most one conversation goes on from a segment to the next, so both tables below have at most two rows a segment
    wide = F.broadcast(wide)
    joined = judged.join(wide, judged["conv"].eqNullSafe(wide["conv"]), "left").select(judged["*"], "first", "last")
    of_wide = joined.where("first is not null").select("conv", "segment", "turn", "role", "text", "own", "fault")
    of_ends = of_wide.repartition(parts, "segment").sortWithinPartitions(*by_segment).select("conv", "segment", "role", "fault").mapInArrow(sums, f"conv {kind}, segment int, matrix array<bigint>")
    of_ends = of_ends.groupBy("conv").applyInArrow(ends, f"conv {kind}, segment int, costs array<bigint>").withColumnRenamed("conv", "of").withColumnRenamed("segment", "at")
    traced = joined.join(F.broadcast(of_ends), joined["conv"].eqNullSafe(F.col("of")) & (joined["segment"] == F.col("at")), "left").select(joined["*"], "costs")

    def repair(batches):
        def told(state: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"conv": pa.array([state["conv"]], conv_type), "illegal": pa.array([state["illegal"]]), "cost": pa.array([state["cost"]]), "audit": pa.array(["".join(state["audit"])]), "digest": pa.array([state["sha"].hexdigest()])}
            )

        now: dict | None = None
        for (conv, segment), held in stretches(batches, ["conv", "segment", "role", "text", "fault", "last", "costs"]):
            if now is None or now["conv"] != conv:
                if now is not None:
                    yield told(now)
                now = {"conv": conv, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "state": START, "role": None}
            costs = tuple(held[0][6]) if held[0][6] is not None else END
            symbols = [symbol(r[2], r[4]) for r in held]
            if now["role"] is None:
                now["cost"] = least_costs(symbols, costs)[START]
            letters, kept, now["state"] = trace(symbols, costs, now["state"], held[0][5] is None or held[0][5] == segment)
            now["audit"].append(letters)
            for k, role in kept:
                piece = f"{role if role is not None else held[k][2]}:{held[k][3] if k is not None else ''}"
                now["sha"].update((("\n" if now["any"] else "") + piece).encode())
                now["any"] = True
            for r in held:
                if now["role"] is not None and now["role"][:1] + r[2][:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["role"] = r[2]
        if now is not None:
            yield told(now)

    # conversations of one segment stay with it; those of several are read in order by one task each
    place = F.when(F.col("first").isNull(), F.col("segment")).otherwise(F.pmod(F.xxhash64("conv"), F.lit(parts)).cast("int"))
    repaired = (
        traced.repartition(parts, place).sortWithinPartitions(*by_segment).select("conv", "segment", "role", "text", "fault", "last", "costs")
        .mapInArrow(repair, f"conv {kind}, illegal long, cost long, audit string, digest string")
    )
    found = counted.join(turns, counted["conv"].eqNullSafe(turns["conv"]), "left").select(counted["*"], "turns")
    out = conversations.join(found, conversations["conv"].eqNullSafe(found["conv"]), "left").select(conversations["conv"], "blank", "duplicate", "truncated", "low", "high", "turns")
    out = out.join(repaired, out["conv"].eqNullSafe(repaired["conv"]), "left").select(out["*"], "illegal", "cost", "audit", "digest")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("conv").alias(conv_col),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[none(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL for ``repair_conversations`` over conversations, without tables of blocks.

    Costs and letters of the four states are strings, twelve digits and then the
    letters, so that the least string is the cheapest and then the ASCII-least;
    a fold goes over a conversation's rows from the last one.
    """
    plus = lambda x, cost, letter: f"lpad((({x})[1:12]::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || ({x})[13:]"
    state = lambda q: f"x[{q + 1}]"
    extra = f"(CASE WHEN r[2] = 't' THEN {CUT_OFF} ELSE 0 END)"

    def step(q: int) -> str:
        kept = " ".join(f"WHEN r[1] = '{c}' THEN {plus(state(to[q]), extra, 'K')}" for c, to in KEEP.items() if to[q] is not None)
        moved = f"least({plus(state(FORWARD[q]), f'({REROLE} + {extra})', 'R')}, CASE {kept} END)"
        return f"least({plus(state(q), DELETE, 'D')}, CASE WHEN r[2] <> 'g' THEN {moved} END)"

    def closed(x: str) -> str:
        own = lambda q: f"({x})[{q + 1}]"
        user, reply = f"least({own(AFTER_U)}, {plus(own(AFTER_A), INSERT, 'I')})", f"least({own(AFTER_A)}, {plus(own(AFTER_U), INSERT, 'I')})"
        return f"[least({own(START)}, {plus(user, INSERT, 'I')}), least({own(AFTER_S)}, {plus(user, INSERT, 'I')}), {user}, {reply}]"

    far = f"'{10**11}'"
    zero = "'000000000000'"
    ends = closed(f"[{zero}, lpad({far}, 12, '0'), lpad({far}, 12, '0'), {zero}]")
    one = f"[{', '.join(step(q) for q in range(4))}]"
    name = "coalesce({}::VARCHAR, ' ')"
    return f"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
named AS (SELECT conv_id, {name.format("conv_id")} AS conv, turn, {name.format("role")} AS role, {name.format("text")} AS text, {name.format("conv_id")} || ':' || {name.format("turn")} AS key FROM conversations),
faulty AS (SELECT conv, turn, role, text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(tab[((xor(c, b) & 255) + 1)::BIGINT], c >> 8))) % 20 AS fault FROM named, crc_table),
damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faulty),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n, role[1:1] AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY n) || initial AS two FROM placed),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(n > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal, list([initial, CASE WHEN fault IN ('blank', 'duplicate') THEN 'g' WHEN fault = 'truncated' THEN 't' ELSE 'n' END] ORDER BY n DESC) AS symbols FROM judged GROUP BY conv),
solved AS (SELECT * EXCLUDE (symbols), (list_reduce(list_prepend({ends}, symbols), lambda x, r: list_transform([{one}], lambda y: {closed('y')})[1]))[1] AS best FROM counted),
letters AS (SELECT conv, unnest(string_split(best[13:], '')) AS letter, unnest(range(1, length(best) - 11)) AS j FROM solved WHERE length(best) > 12),
numbered AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS n, sum((letter <> 'D')::INT) OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv ORDER BY j)),
told AS (SELECT numbered.*, judged.role, coalesce(CASE WHEN letter <> 'I' THEN judged.text END, '') AS text FROM numbered LEFT JOIN judged USING (conv, n) WHERE letter <> 'D'),
opened AS (SELECT conv, max((letter = 'K' AND k = 1 AND role[1:1] = 's')::INT) AS s FROM told GROUP BY conv),
repaired AS (SELECT conv, string_agg((CASE WHEN letter = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS text FROM told JOIN opened USING (conv) GROUP BY conv),
every AS (SELECT DISTINCT conv_id, conv FROM named)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best[1:12]::BIGINT, 0) AS cost, coalesce(best[13:], '') AS audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
FROM every LEFT JOIN solved USING (conv) LEFT JOIN repaired USING (conv)"""
