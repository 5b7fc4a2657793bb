"""Windows, sequences and ordered folds."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import latest, running
from .graph import kept


def bursts(days: DataFrame, gap: int = 7, first_seen: DataFrame | None = None) -> DataFrame:
    """Distinct days of each project as islands without a gap of more than ``gap`` days.

    A project's earliest island is widened to its ``first_seen`` (project,
    first_seen), if that is earlier.
    """
    w = Window.partitionBy("project").orderBy("day")
    marked = days.select("project", "day").distinct().withColumn("new", (F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(0)) > gap).cast("int"))
    out = marked.withColumn("g", F.sum("new").over(w)).groupBy("project", "g").agg(F.min("day").alias("from"), F.max("day").alias("to"), F.count("*").alias("days"))
    if first_seen is not None:
        seen = first_seen.groupBy("project").agg(F.min("first_seen").alias("seen"))
        out = out.join(seen, "project", "left").withColumn("from", F.when(F.col("g") == 0, F.least("from", "seen")).otherwise(F.col("from"))).drop("seen")
    return out.drop("g")


def sessionize(rows: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Sessions of each account (account, ts, id, context): a new one after a long gap or when the carried context changes.

    The context of a row is the last one seen. Confidence falls with the average gap.
    """
    w = Window.partitionBy("account").orderBy("ts", "id")
    carried = rows.withColumn("ctx", F.coalesce(F.last("context", ignorenulls=True).over(w), F.lit("")))
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    marked = carried.withColumn("gap", gap).withColumn("new", (F.coalesce(F.col("gap") > gap_s, F.lit(True)) | (F.col("ctx") != F.lag("ctx").over(w))).cast("int"))
    numbered = marked.withColumn("session", F.sum("new").over(w))
    inner = F.when(F.col("new") == 0, F.col("gap"))
    out = numbered.groupBy("account", "session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.min_by("id", F.struct("ts", "id")).alias("first_id"),
        (1 - F.coalesce(F.avg(inner), F.lit(0.0)) / gap_s).alias("c"),
    )
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))), 6)).drop("c")


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """Rows of one batch hash as a thread, with their place in it (single rows too)."""
    w = Window.partitionBy("hash").orderBy("ts", "id")
    return rows.where("hash is not null").select("id", F.concat(F.lit("batch-"), F.substring("hash", 1, 8)).alias("thread_id"), (F.row_number().over(w) - 1).alias("seq"))


def fingerprint_threads(rows: DataFrame) -> DataFrame:
    """The threads of ``fingerprint_groups`` (rows with content): title, times and the queue row that each one gets."""
    first = F.min_by(F.coalesce("content", F.lit("")), F.struct("ts", "id"))
    per = rows.where("hash is not null").groupBy("hash").agg(F.substring(first, 1, 60).alias("title"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    return per.select(F.concat(F.lit("batch-"), F.substring("hash", 1, 8)).alias("thread_id"), title.alias("title"), "created_at", "updated_at", F.lit("thread_grouping").alias("type"), F.lit("pending").alias("status"), "n")


def annotated(rows: DataFrame) -> DataFrame:
    """All rows of an append-only map, each marked whether it is the current one of its key."""
    key = F.coalesce(F.col("session_id") != "", F.lit(False))
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("pos").desc())) == 1
    return rows.withColumn("is_current", key & last & (F.col("status") != "revoked"))


def latest_wins(rows: DataFrame) -> DataFrame:
    """The last row of each key, unless it revokes the key."""
    return latest(rows.where("session_id is not null and session_id <> ''"), ["session_id"], [F.col("pos").desc()]).where("status <> 'revoked'")


def conversation_time(sessions: DataFrame) -> DataFrame:
    """Real time of each conversation: newest message, else file, else folder time, with its source."""
    per = sessions.groupBy("conversation_id").agg(F.max("ts").alias("m"), F.max("mtime").alias("f"), F.max("folder_time").alias("d"))
    source = F.when(F.col("m").isNotNull(), "message").when(F.col("f").isNotNull(), "file").when(F.col("d").isNotNull(), "folder").otherwise("none")
    return per.select("conversation_id", F.coalesce("m", "f", "d").alias("real_time"), source.alias("source"), (source == "none").alias("excluded"))


def first_user_message(messages: DataFrame) -> DataFrame:
    """The first user text of each conversation, by (session_rank, ts, seq)."""
    return messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", F.struct("session_rank", "ts", "seq")).alias("first_user"))


def heading_chunks(docs: DataFrame, heading: str = r"^(#{1,6}) ") -> DataFrame:
    """Texts cut at their headings: level, first line and text; text before the first heading goes; no heading gives one whole chunk."""
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line0", "line"))
    level = F.length(F.regexp_extract("line", heading, 1))
    w = Window.partitionBy("doc_id").orderBy("line0")
    marked = lines.withColumn("level", level).withColumn("chunk", F.sum((F.col("level") > 0).cast("int")).over(w))
    kept = marked.withColumn("chunks", F.max("chunk").over(Window.partitionBy("doc_id"))).where("chunk > 0 or chunks = 0")
    return kept.groupBy("doc_id", "chunk").agg(
        F.max("level").alias("level"), (F.min("line0") + 1).cast("long").alias("start_line"), F.max(F.col("chunks") == 0).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line0", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )


def order_conflict(rows: DataFrame) -> DataFrame:
    """Threads whose times do not follow their order, with the share of matched rows and the gaps."""
    w = Window.partitionBy("thread_id").orderBy("seq")
    back = F.lag("ts").over(w) > F.col("ts")
    return rows.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("thread_id").agg(
        F.max("back").alias("conflict"), F.count_if(F.col("ts").isNull()).alias("unmatched"), F.round(F.count_if(F.col("ts").isNotNull()) / F.count("*"), 6).alias("match_rate")
    )


def occurrences(events: DataFrame) -> DataFrame:
    """Occurrences of each condition: opened by a sighting when none is open, closed by a resolution.

    Rulings belong to the occurrence that is open, or was last open, when they are made.
    """
    w = Window.partitionBy("fingerprint").orderBy("ts", "event_id")
    state = F.last(F.when(F.col("kind") != "ruling", F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("kind") == "sighting") & (F.coalesce(state, F.lit("resolution")) == "resolution")
    numbered = events.withColumn("opens", opens.cast("int")).withColumn("occurrence", F.sum("opens").over(w))
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    return numbered.where("occurrence > 0").groupBy("fingerprint", "occurrence").agg(
        F.min("ts").alias("opened"), at("resolution").alias("resolved"), at("ruling").alias("first_ruling"), F.count_if(F.col("kind") == "sighting").alias("sightings")
    )


def latency_summary(found: DataFrame, as_of: str | None = None) -> DataFrame:
    """Occurrences raised, ruled, resolved without a ruling and still open, the median hours to the first ruling, and the days the oldest has been open.

    ``as_of`` is the newest time in the table unless it is given.
    """
    hours = (F.unix_timestamp("first_ruling") - F.unix_timestamp("opened")) / 3600.0
    newest = F.max(F.greatest("opened", "resolved", "first_ruling"))
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp")) if as_of else F.unix_timestamp(newest)
    oldest = F.unix_timestamp(F.min(F.when(F.col("resolved").isNull(), F.col("opened"))))
    return found.agg(
        F.count("*").alias("raised"), F.count("first_ruling").alias("ruled"), F.count_if(F.col("resolved").isNotNull() & F.col("first_ruling").isNull()).alias("resolved_unruled"),
        F.count_if(F.col("resolved").isNull()).alias("still_open"), F.round(F.percentile(hours, F.lit(0.5)), 6).alias("median_hours"), F.round((now - oldest) / 86400.0, 6).alias("oldest_open_days"),
    )


def rolling_decay(rows: DataFrame, size: int = 4, pause: float = 0.75, resume: float = 0.9, cap: int = 3) -> DataFrame:
    """Speed (1 / ms) of each unit against the median of the first ``size``, and what follows from it.

    Pausing starts below ``pause`` and ends at ``resume``; after ``cap`` pauses
    in a row the run goes on (``cap_reached``) until it has recovered. The
    action of a row is observing, none, pause, cap_reached or resume.
    """
    w = Window.partitionBy("host").orderBy("ts", "pos", "ms")
    numbered = rows.withColumn("n", F.row_number().over(w)).withColumn("speed", 1.0 / F.col("ms"))
    near = F.array_sort(F.array_compact(F.array("speed", *[F.lag("speed", k).over(w) for k in range(1, size)])))
    half = lambda up: F.element_at("near", F.floor((F.size("near") + 1 + up) / 2).cast("int"))
    rolling = numbered.withColumn("near", near).withColumn("rolling", (half(0) + half(1)) / 2).drop("near")
    base = numbered.where(F.col("n") <= size).groupBy("host").agg(F.percentile("speed", F.lit(0.5)).alias("baseline"))
    out = rolling.join(base, "host").withColumn("ratio", F.when(F.col("n") >= size, F.col("rolling") / F.col("baseline")))
    # a slow stretch begins at a row below the lower line and ends at one above the upper
    cross = F.when(F.col("ratio") < pause, 1).when(F.col("ratio") >= resume, 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = out.withColumn("slow", F.coalesce(F.last(cross, ignorenulls=True).over(upto), F.lit(0)))
    before = F.coalesce(F.lag("slow").over(w), F.lit(0))
    marked = marked.withColumn("was", before).withColumn("stretch", F.sum(((F.col("slow") == 1) & (before == 0)).cast("int")).over(upto))
    count = F.row_number().over(Window.partitionBy("host", "stretch", "slow").orderBy("ts", "pos", "ms"))
    action = (
        F.when(F.col("ratio").isNull(), "observing").when((F.col("slow") == 0) & (F.col("was") == 1), "resume").when(F.col("slow") == 0, "none")
        .when(count <= cap, "pause").when(count == cap + 1, "cap_reached").otherwise("none")
    )
    state = F.when(F.col("slow") == 0, "run").when(count <= cap, "pause").otherwise("capped")
    return marked.select("host", "pos", F.round("ratio", 6).alias("ratio"), state.alias("state"), action.alias("action"))


def token_windows(messages: DataFrame, budget: int) -> DataFrame:
    """Ordered messages of each conversation packed into windows of at most ``budget`` tokens; no message is split."""
    size = F.floor(F.length("content") / 4).cast("long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.assign(window=_fold(pdf["tokens"], budget))[["thread_id", "seq", "tokens", "window"]]

    return messages.select("thread_id", "seq", size.alias("tokens")).groupBy("thread_id").applyInPandas(pack, "thread_id long, seq long, tokens long, window long")


#: Runs of small items that are folded in one call.
RUNS = 256


def batch_packing(items: DataFrame, small: int, budget: int, members: int) -> DataFrame:
    """Small items (project, pos, tokens) packed in order into batches; a large one stands alone and ends the batch.

    Each large item is a new start, so only the small ones between two of them
    are folded together, ``RUNS`` runs in a call; running sums over stretches of a
    project then number its batches.
    """
    sized = items.withColumn("large", F.col("tokens") > small).withColumn("_one", F.col("large").cast("long"))
    runs = kept(running(sized, "project", "pos", "_one", "run").select("project", "pos", "tokens", "large", "run"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        now, batch, used, count, out = None, 0, 0, 0, []
        for run, n in zip(pdf["run"].tolist(), pdf["tokens"].tolist(), strict=True):
            if run != now:
                now, batch, used, count = run, 0, 0, 0
            if count and (used + n > budget or count >= members):
                batch, used, count = batch + 1, 0, 0
            out.append(batch)
            used, count = used + n, count + 1
        return pdf.assign(local=out)[["project", "pos", "run", "local"]]

    packed = kept(runs.where("not large").select("project", "pos", "tokens", "run").groupBy("project", F.floor(F.col("run") / RUNS)).applyInPandas(lambda _, pdf: pack(pdf), "project string, pos long, run long, local long"))
    n = runs.groupBy("project", "run").agg(F.max(F.col("large").cast("long")).alias("own")).join(packed.groupBy("project", "run").agg((F.max("local") + 1).alias("b")), ["project", "run"], "left")
    n = n.withColumn("_all", F.col("own") + F.coalesce("b", F.lit(0)))
    first = running(n, "project", "run", "_all", "_upto").select("project", "run", "own", (F.col("_upto") - F.col("_all")).alias("first"))
    large = runs.where("large").select("project", "pos", "run", F.lit(None).cast("long").alias("local"))
    out = packed.unionByName(large).join(first, ["project", "run"])
    return out.select("project", "pos", (F.col("first") + F.coalesce(F.col("own") + F.col("local"), F.lit(0))).alias("batch"))


def _fold(sizes: Iterable[int], budget: int) -> list[int]:
    window, used, out = 0, 0, []
    for i, n in enumerate(sizes):
        if i and used + n > budget:
            window, used = window + 1, 0
        out.append(window)
        used += n
    return out
