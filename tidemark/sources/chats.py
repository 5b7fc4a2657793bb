"""Sources and sinks for conversations, sessions, snapshots and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPORT = """uuid string, name string, created_at string, project_name string,
  chat_messages array<struct<uuid: string, sender: string, text: string, created_at: string, attachments: array<struct<file_name: string, extracted_content: string>>>>"""
SESSION = "type string, uuid string, timestamp string, customTitle string, aiTitle string, message struct<role: string, content: array<struct<type: string, text: string>>>"
BOOKKEEPING = ("summary", "progress", "system", "file-history-snapshot")


def chat_export(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested export JSON (``value``) as (threads, messages, attachments); messages are numbered by time."""
    c = raw.select(F.from_json("value", EXPORT).alias("c")).select("c.*").where("uuid is not null")
    linked = F.nullif("project_name", F.lit(""))
    threads = c.select(
        F.col("uuid").alias("thread_id"), F.col("name").alias("title"), F.try_to_timestamp("created_at").alias("created_at"), linked.alias("project_link"),
        F.when(linked.isNotNull(), "exact").alias("project_confidence"),
    )
    each = c.select(F.col("uuid").alias("thread_id"), F.explode("chat_messages").alias("m"))
    w = Window.partitionBy("thread_id").orderBy("m.created_at", "m.uuid")
    messages = each.select(
        "thread_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.coalesce("m.uuid", F.substring(F.sha2(F.concat_ws(":", "thread_id", "m.created_at"), 256), 1, 16)).alias("message_id"),
        F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"), F.col("m.text").alias("content"),
    )
    files = each.select("thread_id", F.col("m.uuid").alias("message_id"), F.explode("m.attachments").alias("a"))
    attachments = files.select(F.substring(F.sha2(F.concat_ws(":", "message_id", "a.file_name"), 256), 1, 16).alias("attachment_id"), "message_id", F.col("a.file_name").alias("filename"))
    return threads, messages, attachments


def html_text(html: Column) -> Column:
    """Text of an HTML fragment: scripts and tags out, code in fences, breaks kept as lines, the common entities unescaped."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<pre[^>]*>", "\n```\n"), r"(?i)</pre>", "\n```\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n"), r"<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\n{2,}", "\n"))


def activity_html(rows: DataFrame) -> DataFrame:
    """Activity rows (id, prompt, html, attachments): a user and an assistant message, or an activity log entry where no prompt was made."""
    answer = html_text(F.col("html"))
    turn = F.nullif(F.regexp_extract(F.coalesce("attachments", F.lit("")), r"([0-9a-f]{16})", 1), F.lit(""))
    asked = F.coalesce(F.length("prompt") > 0, F.lit(False))
    entry = lambda when, seq, role, text: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(role).alias("role"), text.alias("content")))
    has = F.coalesce(F.length(answer) > 0, F.lit(False))
    parts = F.array_compact(F.array(entry(asked, 0, "user", F.col("prompt")), entry(asked & has, 1, "assistant", answer), entry(~asked, 0, "activity_log", F.coalesce(answer, F.lit("")))))
    return rows.select("id", turn.alias("turn_hash"), F.inline(parts))


def md_transcript(files: DataFrame) -> DataFrame:
    """Markdown transcripts (path, content) with ``**User:**`` and ``**Assistant:**`` marks as turns; empty turns go."""
    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", "")
    lines = files.select(F.concat(F.lit("mdmanual-"), F.substring(F.sha1("path"), 1, 12)).alias("thread_id"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^\*\*(User|Assistant):\*\*", 1)
    w = Window.partitionBy("thread_id").orderBy("pos")
    told = lines.withColumn("mark", mark).withColumn("turn", F.sum((F.col("mark") != "").cast("int")).over(w)).where("turn > 0")
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", r"^\*\*(User|Assistant):\*\* ?", "").alias("line")))), lambda x: x["line"]), "\n"))
    return told.groupBy("thread_id", "turn").agg(F.lower(F.max("mark")).alias("role"), text.alias("content")).where("content <> ''")


def jsonl_sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Session lines (session_id, line_no, value) as (messages, counts of other records per session, titles).

    Only text blocks are kept, bad lines are counted. A message has its own
    uuid, else one made of its session and place. A session's title is the last
    one set by hand, else the last made one, else the beginning of the first
    user text.
    """
    r = lines.withColumn("r", F.from_json("value", SESSION))
    title = F.col("r.type").isin("custom-title", "ai-title")
    kind = F.when(F.col("r.type").isNull(), "bad_line").when(F.col("r.type").isin(*BOOKKEEPING), "bookkeeping").when(title, "title").otherwise("message")
    r = r.withColumn("kind", kind)
    text = F.array_join(F.transform(F.filter("r.message.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    found = r.where("kind = 'message'").select("session_id", "line_no", "r.uuid", F.col("r.message.role").alias("role"), text.alias("content"), F.try_to_timestamp("r.timestamp").alias("ts")).where("content <> ''")
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")) - 1
    made = F.substring(F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.col("seq").cast("string")), 256), 1, 32)
    messages = found.withColumn("seq", seq.cast("long")).withColumn("message_id", F.coalesce("uuid", made)).drop("uuid")
    last = lambda kind, field: F.max_by(F.when(F.col("r.type") == kind, F.col(f"r.{field}")), F.when((F.col("r.type") == kind) & F.col(f"r.{field}").isNotNull(), F.col("line_no")))
    set_ = r.groupBy("session_id").agg(last("custom-title", "customTitle").alias("custom"), last("ai-title", "aiTitle").alias("made"))
    said = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "line_no").alias("said"))
    short = F.when(F.length("said") > 80, F.concat(F.substring("said", 1, 80), F.lit("…"))).otherwise(F.col("said"))
    titles = set_.join(said, "session_id", "left").select("session_id", F.coalesce("custom", "made", short).alias("title"))
    return messages, r.groupBy("session_id", "kind").agg(F.count("*").alias("n")), titles


def transcript_census(messages: DataFrame, failures: DataFrame) -> DataFrame:
    """Per store: conversations, sub-sessions, messages, bytes, the range of times, and the files that failed (store, path)."""
    per = messages.groupBy("store").agg(
        F.count_distinct("thread_id").alias("sessions"), F.count_distinct(F.when(F.col("is_sidechain"), F.col("session_id"))).alias("sub_sessions"), F.count("*").alias("messages"),
        F.sum(F.octet_length("content")).alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    bad = failures.groupBy("store").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("failed"))
    return per.join(bad, "store", "full").withColumn("failed", F.coalesce("failed", F.lit("")))


def session_upsert(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded threads over stored ones; a link set by hand or exactly is never weakened."""
    s = stored.select("thread_id", *[F.col(c).alias(f"old_{c}") for c in ("title", "project_link", "project_confidence")])
    j = loaded.join(s, "thread_id", "full")
    keep = F.coalesce(F.col("old_project_confidence").isin("manual", "exact"), F.lit(False))
    pick = lambda c: F.when(keep, F.col(f"old_{c}")).otherwise(F.coalesce(c, f"old_{c}")).alias(c)
    return j.select("thread_id", F.coalesce("title", "old_title").alias("title"), pick("project_link"), pick("project_confidence"))


def message_upsert(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded messages (message_id, thread_id, seq, role, content, created_at) over stored ones of the same id.

    Text, place and time are renewed; the thread and the role stay.
    """
    s = stored.select("message_id", *[F.col(c).alias(f"old_{c}") for c in ("thread_id", "seq", "role", "content", "created_at")])
    j = loaded.dropDuplicates(["message_id"]).withColumn("new", F.lit(True)).join(s, "message_id", "full")
    renewed = lambda c: F.when(F.col("new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return j.select("message_id", F.coalesce("old_thread_id", "thread_id").alias("thread_id"), renewed("seq"), F.coalesce("old_role", "role").alias("role"), renewed("content"), renewed("created_at"))


def batch_log(log: DataFrame, after: int) -> DataFrame:
    """Counts per stage of the batches after a given one."""
    return log.where(F.col("batch_id") > after).groupBy("stage").agg(*[F.sum(c).alias(c) for c in ("new", "changed", "skipped")])


def write_snapshot(rows: DataFrame, path: str, day: str) -> None:
    """Write a dated snapshot; a second one on the same day replaces that day only."""
    rows.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rows of the newest snapshot date."""
    newest = snapshots.agg(F.max("snapshot_date").alias("snapshot_date"))
    return snapshots.join(F.broadcast(newest), "snapshot_date", "left_semi")


def write_archive(files: DataFrame, path: str) -> None:
    """Bundles (name, content, generated_at) archived by the date they were made."""
    files.withColumn("generated", F.to_date("generated_at")).write.mode("append").partitionBy("generated").parquet(path)


def bundle_verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether each file's digest is the manifest's: true, false, or null where the manifest does not name it."""
    return files.select("name", F.sha2("content", 256).alias("digest")).join(manifest, "name", "left").select("name", (F.col("digest") == F.col("sha256")).alias("verified"))


def jsonl_ledger(lines: DataFrame, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of an append-only ledger; a record needs all required fields."""
    r = lines.withColumn("r", F.from_json("value", schema))
    sound = F.lit(True)
    for f in required:
        sound = sound & F.col(f"r.{f}").isNotNull()
    r = r.withColumn("sound", F.coalesce(sound, F.lit(False)))
    return r.where("sound").select("pos", "r.*"), r.where("not sound").select("pos", "value")


def markdown_documents(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """One Markdown text per thread: front matter in fixed order, then its messages in order."""
    body = messages.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.concat(F.lit("**"), m["role"], F.lit(":** "), m["content"])), "\n\n").alias("body"))
    head = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n"))
    return threads.join(body, "thread_id", "left").select("thread_id", "source", F.concat(head, F.coalesce("body", F.lit(""))).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Markdown documents written as text, one folder per source; each line of a document is a line."""
    documents.select("source", F.col("document").alias("value")).write.mode("overwrite").partitionBy("source").text(path)


def partial_overwrite(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace all old rows of the keys they touch; other rows are carried over."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
