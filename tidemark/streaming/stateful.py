"""Stream processors with timers: occurrences that age while nothing comes, sessions that end by gap or context."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that has timers."""
    former = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, former)


def millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


class Ageing(StatefulProcessor):
    """State of each condition: its occurrence's number, whether it is open and told as aged, and when it is due.

    A key is a bucket of conditions, so that state and timers are asked for once a bucket, not once a condition;
    bucket -1 is that of the condition null.
    """

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("occurrences", "fingerprint long, number long, is_open boolean, told boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._held()
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for fingerprint, event, ms, kind in zip(batch["fingerprint"].tolist(), batch["event_id"].tolist(), millis(batch["ts"]), batch["kind"].tolist(), strict=True):
            number, is_open, told, due = state.get(fingerprint, (0, False, False, 0))
            if is_open and not told and ms >= due:
                told = True
                out.append((fingerprint, None, number, "aged"))
            if kind == "sighting" and not is_open:
                number, is_open, told, due = number + 1, True, False, ms + self.age_ms
                out.append((fingerprint, event, number, "opened"))
            elif kind == "resolution" and is_open:
                is_open = False
                out.append((fingerprint, event, number, "closed"))
            state[fingerprint] = (number, is_open, told, due)
        self._keep(state)
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, now = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out = []
        for fingerprint, (number, is_open, told, due) in state.items():
            if is_open and not told and due <= now:
                state[fingerprint] = (number, True, True, due)
                out.append((fingerprint, None, number, "aged"))
        self._keep(state)
        yield self._told(key, out)

    def _held(self) -> dict[int, tuple]:
        return {r[0]: tuple(r[1:]) for r in self.state.get()} if self.state.exists() else {}

    def _keep(self, state: dict[int, tuple]) -> None:
        """The state of all conditions, with one timer for the first that is due."""
        self.state.put([(fingerprint, *s) for fingerprint, s in state.items()])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waiting = [due for _, is_open, told, due in state.values() if is_open and not told]
        if waiting:
            self.handle.registerTimer(min(waiting))

    @staticmethod
    def _told(key: tuple, out: list[tuple]) -> pd.DataFrame:
        out = [(None, *r[1:]) for r in out] if key[0] == -1 else out
        return pd.DataFrame(out, columns=["fingerprint", "event_id", "occurrence", "change"]).astype({"fingerprint": "Int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


#: Buckets of accounts or conditions; a running stream must keep their number.
BUCKETS = 512


def ageing_occurrences(conditions: DataFrame, age_ms: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Occurrences opened, aged and closed from readings (fingerprint, event_id, ts, kind); conditions are dealt into ``buckets``.

    An occurrence that is open ``age_ms`` after it began is told as aged once: by
    a timer when the watermark passes that time, with no row of its own, or when
    a later reading of the condition shows that it passed.
    """
    dealt = conditions.withWatermark("ts", late).withColumn("bucket", F.when(F.col("fingerprint").isNull(), -1).otherwise(F.pmod(F.xxhash64("fingerprint"), F.lit(buckets))))
    # pandas would turn numbers beside a null into floats
    dealt = dealt.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(0)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Ageing(age_ms), "fingerprint long, event_id long, occurrence long, change string", "Append", "eventTime")


class ContextSessions(StatefulProcessor):
    """Rows wait in order of time until the watermark has passed them; then they go on the open session of their account or end it.

    A key is a bucket of accounts, so that state and timers are asked for once a bucket, not once an account.
    """

    def __init__(self, gap_s: int):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "account long, ms long, id long, context string")
        self.open = handle.getListState("open", "account long, number long, context string, started long, ended long, n long, first_id long, gaps long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        contexts = [c if isinstance(c, str) else None for c in batch["context"]]
        yield self._advance(list(zip(batch["account"].tolist(), millis(batch["ts"]), batch["id"].tolist(), contexts, strict=True)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, fresh: list[tuple], mark: int) -> pd.DataFrame:
        state = {r[0]: tuple(r[1:]) for r in self.open.get()} if self.open.exists() else {}
        waiting: dict[int, list[tuple]] = {}
        for account, *row in [*(self.waiting.get() if self.waiting.exists() else ()), *fresh]:
            waiting.setdefault(account, []).append(tuple(row))
        out, left, due = [], [], []
        for account in {**state, **waiting}:
            rows = sorted(waiting.get(account, []), key=lambda r: (r[0], r[1]))
            passed = [r for r in rows if r[0] < mark]
            state[account] = now = self._folded(account, passed, state.get(account, (0, "", 0, 0, 0, 0, 0)), mark, out)
            left += [(account, *r) for r in rows[len(passed) :]]
            if len(rows) > len(passed):
                # when the first waiting row has been passed
                due.append(max(mark, rows[len(passed)][0]) + 1)
            elif now[4]:
                # when the open session can get no more rows
                due.append(now[3] + (self.gap_s + 1) * 1000)
        self.waiting.put(left) if left else self.waiting.clear()
        self.open.put([(account, *s) for account, s in state.items()])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(min(due))
        return pd.DataFrame(out, columns=["account", "session", "started", "ended", "n", "first_id", "confidence"])

    def _folded(self, account: int, passed: list[tuple], held: tuple, mark: int, out: list[tuple]) -> tuple:
        """The state of an account after rows that the watermark has passed; sessions that ended go to ``out``."""
        number, context, started, ended, n, first, gaps = held

        def end() -> None:
            average = gaps / (n - 1) if n > 1 else 0.0
            out.append((account, number, pd.Timestamp(started, unit="ms"), pd.Timestamp(ended, unit="ms"), n, first, max(0.0, min(1.0, 1 - average / self.gap_s))))

        for ms, id_, told in passed:
            now = told if told is not None else context
            gap = ms // 1000 - ended // 1000
            if n and (gap > self.gap_s or now != context):
                end()
                n = 0
            if n:
                gaps, ended, n = gaps + gap, ms, n + 1
            else:
                number, started, ended, n, first, gaps = number + 1, ms, ms, 1, id_, 0
            context = now
        if n and mark // 1000 - ended // 1000 > self.gap_s:
            end()
            n = 0
        return number, context, started, ended, n, first, gaps

    def close(self) -> None:
        pass


def context_sessions(rows: DataFrame, gap_s: int = 1800, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Sessions of each account (account, ts, id, context) as ``sessionize`` cuts them, told once they can no longer change.

    Rows may come in any order within the watermark; the state holds the rows
    that it has not passed, and one open session an account; accounts are dealt into ``buckets``.
    """
    schema = "account long, session long, started timestamp, ended timestamp, n long, first_id long, confidence double"
    dealt = rows.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("account"), F.lit(buckets)))
    out = dealt.groupBy("bucket").transformWithStateInPandas(ContextSessions(gap_s), schema, "Append", "eventTime")
    return out.withColumn("confidence", F.round("confidence", 6))
