"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import chats
from ..sources.store import StoredTable, replace_by
from ..streaming import jobs, stateful
from .catalog import query
from .sequence import DECAY, STATES


def folder(t, name: str) -> str:
    """A new folder that driver and executors share."""
    spark = t.spark
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def streamed(t, name: str, cols: list):
    """A stream over a Parquet copy of a domain table's columns."""
    path = folder(t, name)
    table = getattr(t, name).select(*cols)
    table.write.parquet(path)
    return t.spark.readStream.schema(table.schema).parquet(path)


def drained(t, stream, mode: str = "append"):
    """The rows of a stream, run until its input is used up."""
    out = folder(t, "out")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


def export_json(t):
    message = F.struct(F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), "text", F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"))
    return t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.first(F.col("conv_id").cast("string")).alias("uuid"), F.lit("t").alias("name"), F.first(F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("proj"), (F.col("conv_id") % 3).cast("string")))).alias("project_name"), F.collect_list(message).alias("chat_messages"))).alias("value"))


@query("SELECT conv_id::VARCHAR AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY lpad(turn::VARCHAR, 6, '0'), turn) - 1 AS seq, conv_id::VARCHAR || '-' || turn::VARCHAR AS message_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text AS content FROM conversations")
def src_chat_export(t):
    return chats.chat_export(export_json(t))[1]


@query("SELECT thread_id, 't' AS title, link AS project_link, CASE WHEN link IS NOT NULL THEN 'exact' END AS project_confidence FROM (SELECT DISTINCT conv_id::VARCHAR AS thread_id, CASE WHEN conv_id % 3 > 0 THEN 'proj' || (conv_id % 3)::VARCHAR END AS link FROM conversations)", name="src_chat_export_threads")
def src_chat_export_threads(t):
    return chats.chat_export(export_json(t))[0].drop("created_at")


HTML = r"""regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gis')"""
for _pattern, _text, _flags in ((r"<pre[^>]*>", r"\n```\n", "gi"), (r"</pre>", r"\n```\n", "gi"), (r"<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", r"\n", "gi"), (r"<[^>]+>", "", "gs")):
    HTML = f"regexp_replace({HTML}, '{_pattern}', '{_text}', '{_flags}')".replace(r"\n", "' || chr(10) || '")
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_name}', '{_char}')"
HTML = f"trim(regexp_replace({HTML}, '\\n{{2,}}', chr(10), 'g'))"


@query(f"""WITH h AS (SELECT page_id AS id, CASE WHEN page_id % 4 > 0 THEN url END AS prompt, {HTML} AS answer, substr(md5(url), 1, 16) AS turn_hash FROM pages)
  SELECT id, turn_hash, 0 AS seq, 'user' AS role, prompt AS content FROM h WHERE prompt IS NOT NULL UNION ALL SELECT id, turn_hash, 1, 'assistant', answer FROM h WHERE prompt IS NOT NULL AND length(answer) > 0
  UNION ALL SELECT id, turn_hash, 0, 'activity_log', coalesce(answer, '') FROM h WHERE prompt IS NULL""")
def src_activity_html(t):
    return chats.activity_html(t.pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 > 0, F.col("url")).alias("prompt"), "html", F.md5("url").alias("attachments")))


@query("""SELECT 'mdmanual-' || substr(sha1('t' || conv_id::VARCHAR), 1, 12) AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, trim(text) AS content FROM conversations WHERE trim(text) <> ''""")
def src_md_transcript(t):
    mark = F.concat(F.when(F.col("turn") % 2 == 0, "**User:** ").otherwise("**Assistant:** "), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", mark.alias("line")))), lambda x: x["line"]), "\n")
    return chats.md_transcript(t.conversations.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("---\nk: v\n---\n"), "body").alias("content")))


def session_lines(t):
    """Conversations as session files: a bad line, a summary and titles among the messages."""
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    k = F.col("turn") % 7
    kind = F.when(k == 5, "summary").when(k == 1, "ai-title").when((k == 2) & (F.col("conv_id") % 2 == 0), "custom-title").otherwise(F.col("role"))
    named = F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    row = F.to_json(F.struct(
        kind.alias("type"), F.when(kind == "custom-title", named).alias("customTitle"), F.when((kind == "ai-title") & (F.col("conv_id") % 5 > 0), named).alias("aiTitle"),
        F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("uuid"), F.struct("role", blocks.alias("content")).alias("message"),
    ))
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.when(k == 3, "{broken").otherwise(row).alias("value"))


KIND = "CASE WHEN turn % 7 = 3 THEN 'bad_line' WHEN turn % 7 = 5 THEN 'bookkeeping' WHEN turn % 7 = 1 OR (turn % 7 = 2 AND conv_id % 2 = 0) THEN 'title' WHEN role IN ('system', 'summary') THEN 'bookkeeping' ELSE 'message' END"
SAID = f"sm AS (SELECT conv_id AS session_id, turn AS line_no, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR || '-' || turn::VARCHAR END AS uuid FROM conversations WHERE {KIND} = 'message' AND text <> '')"


@query(f"SELECT conv_id AS session_id, {KIND} AS kind, count(*) AS n FROM conversations GROUP BY 1, 2")
def src_jsonl_sessions(t):
    return chats.jsonl_sessions(session_lines(t))[1]


@query(f"WITH {SAID} SELECT session_id, line_no, role, content, seq, coalesce(uuid, substr(sha256(session_id::VARCHAR || ':' || seq::VARCHAR), 1, 32)) AS message_id FROM sm", name="src_jsonl_sessions_messages")
def src_jsonl_sessions_messages(t):
    return chats.jsonl_sessions(session_lines(t))[0].drop("ts")


@query(f"""WITH {SAID}, st AS (SELECT conv_id AS session_id, arg_max(CASE WHEN turn % 7 = 2 AND conv_id % 2 = 0 THEN role || ' ' || turn::VARCHAR END, CASE WHEN turn % 7 = 2 AND conv_id % 2 = 0 THEN turn END) AS custom,
  arg_max(CASE WHEN turn % 7 = 1 AND conv_id % 5 > 0 THEN role || ' ' || turn::VARCHAR END, CASE WHEN turn % 7 = 1 AND conv_id % 5 > 0 THEN turn END) AS made FROM conversations GROUP BY 1),
  us AS (SELECT session_id, arg_min(content, line_no) AS said FROM sm WHERE role = 'user' GROUP BY 1)
  SELECT session_id, coalesce(custom, made, CASE WHEN length(said) > 80 THEN substr(said, 1, 80) || '…' ELSE said END) AS title FROM st LEFT JOIN us USING (session_id)""", name="src_jsonl_sessions_titles")
def src_jsonl_sessions_titles(t):
    return chats.jsonl_sessions(session_lines(t))[2]


@query("""WITH m AS (SELECT 's' || (conv_id % 4)::VARCHAR AS store, conv_id AS thread_id, conv_id * 10 + turn % 2 AS session_id, turn % 2 = 1 AS side, text, DATE '2024-01-01' + turn::INT AS d FROM conversations), f AS (SELECT store, string_agg(DISTINCT path, ',' ORDER BY path) AS failed FROM (SELECT 's' || (n_nationkey % 6)::VARCHAR AS store, n_name AS path FROM nation) GROUP BY 1),
  p AS (SELECT store, count(DISTINCT thread_id) AS sessions, count(DISTINCT CASE WHEN side THEN session_id END) AS sub_sessions, count(*) AS messages, sum(strlen(text))::BIGINT AS bytes, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last FROM m GROUP BY 1)
  SELECT coalesce(p.store, f.store) AS store, sessions, sub_sessions, messages, bytes, first, last, coalesce(failed, '') AS failed FROM p FULL JOIN f ON p.store = f.store""")
def src_transcript_census(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("seq").cast("int"))
    rows = t.messages.select(F.concat(F.lit("s"), (F.col("thread_id") % 4).cast("string")).alias("store"), "thread_id", (F.col("thread_id") * 10 + F.col("seq") % 2).alias("session_id"), (F.col("seq") % 2 == 1).alias("is_sidechain"), "content", day.cast("string").alias("ts"))
    return chats.transcript_census(rows, t.nation.select(F.concat(F.lit("s"), (F.col("n_nationkey") % 6).cast("string")).alias("store"), F.col("n_name").alias("path")))


@query("""WITH o AS (SELECT conv_id || '-' || turn AS message_id, conv_id AS thread_id, turn AS seq, role, text AS content FROM conversations WHERE turn % 3 > 0), n AS (SELECT conv_id || '-' || turn AS message_id, conv_id + 1 AS thread_id, turn + 100 AS seq, 'x' AS role, CASE WHEN turn % 5 > 0 THEN text || '!' END AS content FROM conversations WHERE turn % 2 = 0)
  SELECT coalesce(o.message_id, n.message_id) AS message_id, coalesce(o.thread_id, n.thread_id) AS thread_id, coalesce(n.seq, o.seq) AS seq, coalesce(o.role, n.role) AS role, CASE WHEN n.message_id IS NOT NULL THEN n.content ELSE o.content END AS content FROM o FULL JOIN n ON o.message_id = n.message_id""", name="src_session_upsert_messages")
def src_session_upsert_messages(t):
    id_, k = F.concat_ws("-", F.col("thread_id").cast("string"), F.col("seq").cast("string")), F.col("seq")
    m = t.messages.withColumn("message_id", id_).withColumn("created_at", F.lit(None).cast("timestamp"))
    fresh = m.where(k % 2 == 0).select("message_id", (F.col("thread_id") + 1).alias("thread_id"), (k + 100).alias("seq"), F.lit("x").alias("role"), F.when(k % 5 > 0, F.concat("content", F.lit("!"))).alias("content"), "created_at")
    return chats.message_upsert(m.where(k % 3 > 0), fresh).drop("created_at")


@query("""WITH n AS (SELECT thread_id, 'new ' || title AS title, 'q' AS project_link, 'fuzzy' AS project_confidence FROM threads WHERE thread_id % 3 > 0), o AS (SELECT * FROM threads WHERE thread_id % 4 > 0)
  SELECT coalesce(n.thread_id, o.thread_id) AS thread_id, coalesce(n.title, o.title) AS title, CASE WHEN o.project_confidence IN ('manual', 'exact') THEN o.project_link ELSE coalesce(n.project_link, o.project_link) END AS project_link,
  CASE WHEN o.project_confidence IN ('manual', 'exact') THEN o.project_confidence ELSE coalesce(n.project_confidence, o.project_confidence) END AS project_confidence FROM n FULL JOIN o ON n.thread_id = o.thread_id""")
def src_session_upsert(t):
    fresh = t.threads.where("thread_id % 3 > 0").select("thread_id", F.concat(F.lit("new "), "title").alias("title"), F.lit("q").alias("project_link"), F.lit("fuzzy").alias("project_confidence"))
    columns = ["thread_id", "title", "project_link", "project_confidence"]
    stored = t.threads.where("thread_id % 4 > 0").select(*columns)
    vault = StoredTable(t.spark, folder(t, "vault"), stored.schema, "thread_id")
    vault.merge(stored, "first", chats.session_upsert)
    for batch in ("second", "second"):
        vault.merge(fresh, batch, chats.session_upsert)
    return vault.read()


@query("SELECT event_type AS stage, sum(user_id)::BIGINT AS new, sum(event_id % 3)::BIGINT AS changed, sum(event_id % 2)::BIGINT AS skipped FROM events WHERE event_id > 100 GROUP BY 1")
def src_batch_log(t):
    return chats.batch_log(t.events.select(F.col("event_id").alias("batch_id"), F.col("event_type").alias("stage"), F.col("user_id").alias("new"), (F.col("event_id") % 3).alias("changed"), (F.col("event_id") % 2).alias("skipped")), 100)


@query("SELECT '2024-01-0' || (1 + n)::VARCHAR AS snapshot_date, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM docs, range(0, 2) r(n) WHERE n = 0 OR doc_id % 2 = 0 GROUP BY 1")
def src_snapshot_store(t):
    path, docs = folder(t, "snapshots"), t.docs.select("doc_id", "bytes")
    for day, rows in (("2024-01-01", docs), ("2024-01-02", docs), ("2024-01-02", docs.where("doc_id % 2 = 0"))):
        chats.write_snapshot(rows, path, day)
    return t.spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT '2024-01-02' AS snapshot_date, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM docs", name="src_snapshot_store_latest")
def src_snapshot_store_latest(t):
    path, docs = folder(t, "snapshots"), t.docs.select("doc_id", "bytes")
    for day, rows in (("2024-01-01", docs.where("doc_id % 2 = 0")), ("2024-01-02", docs)):
        chats.write_snapshot(rows, path, day)
    newest = chats.latest_snapshot(t.spark.read.parquet(path))
    return newest.groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT (DATE '2024-01-01' + (page_id % 3)::INT)::VARCHAR AS generated, count(*) AS n FROM pages GROUP BY 1", name="src_bundle_verify_archive")
def src_bundle_verify_archive(t):
    path = folder(t, "bundles")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int"))
    chats.write_archive(t.pages.select(F.col("page_id").alias("name"), F.col("html").cast("binary").alias("content"), day.alias("generated_at")), path)
    return t.spark.read.parquet(path).groupBy(F.col("generated").cast("string").alias("generated")).agg(F.count("*").alias("n"))


@query("SELECT page_id AS name, CASE WHEN page_id % 3 > 0 THEN page_id % 3 = 1 END AS verified FROM pages")
def src_bundle_verify(t):
    files = t.pages.select(F.col("page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    manifest = t.pages.where("page_id % 3 > 0").select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 3 == 1, F.sha2("html", 256)).otherwise("0").alias("sha256"))
    return chats.bundle_verify(files, manifest)


@query("SELECT event_id AS pos, user_id, event_type FROM events WHERE event_id % 6 > 1")
def src_jsonl_ledger(t):
    k = F.col("event_id") % 6
    value = F.when(k == 0, "{oops").when(k == 1, F.to_json(F.struct("user_id"))).otherwise(F.to_json(F.struct("user_id", "event_type")))
    return chats.jsonl_ledger(t.events.select(F.col("event_id").alias("pos"), value.alias("value")), "user_id long, event_type string", ["user_id", "event_type"])[0]


@query("""WITH b AS (SELECT thread_id, string_agg('**' || role || ':** ' || content, chr(10) || chr(10) ORDER BY seq, role, content) AS body FROM messages GROUP BY 1)
  SELECT thread_id, source, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || coalesce(body, '') AS document FROM threads LEFT JOIN b USING (thread_id)""")
def src_markdown_sink(t):
    return chats.markdown_documents(t.threads, t.messages)


@query("""WITH b AS (SELECT thread_id, string_agg('**' || role || ':** ' || content, chr(10) || chr(10) ORDER BY seq, role, content) AS body FROM messages GROUP BY 1)
  SELECT source, unnest(string_split('---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || coalesce(body, ''), chr(10))) AS line FROM threads LEFT JOIN b USING (thread_id)""", name="src_markdown_sink_written")
def src_markdown_sink_written(t):
    path = folder(t, "markdown")
    chats.write_documents(chats.markdown_documents(t.threads, t.messages), path)
    return t.spark.read.text(path).select("source", F.col("value").alias("line"))


@query("""WITH f AS (SELECT * FROM docs WHERE project IN ('src1', 'src2') AND doc_id % 2 = 0) SELECT doc_id, 'fresh' AS state FROM f UNION ALL SELECT doc_id, 'old' FROM docs WHERE project NOT IN (SELECT project FROM f)""")
def src_partial_overwrite(t):
    rows = t.docs.select("doc_id", "project")
    old = rows.withColumn("state", F.lit("old"))
    table = StoredTable(t.spark, folder(t, "projects"), old.schema, "project")
    table.merge(old, "first", replace_by("project"))
    table.merge(rows.where("project in ('src1', 'src2') and doc_id % 2 = 0").withColumn("state", F.lit("fresh")), "second", replace_by("project"))
    return table.read().select("doc_id", "state")


@query("""WITH m AS (SELECT user_id AS account, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 86400000000 THEN 0 ELSE 1 END AS new FROM activity), s AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY ts) AS g FROM m)
  SELECT account, count(*) AS n FROM s GROUP BY account, g""")
def st_session_window(t):
    stream = streamed(t, "activity", [F.col("user_id").alias("account"), "ts"])
    out = folder(t, "sessions")

    def keep(batch, _):
        batch.select("account", "n").write.mode("overwrite").parquet(out)

    q = jobs.session_windows(stream, "1 day", "60 days").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(out)


@query("SELECT pos, model_id, stage, floor(ms)::DOUBLE AS ms FROM ledger WHERE pos % 4 > 0")
def st_live_ledger(t):
    line = F.format_string("model=%s stage=%s ms=%s", "model_id", "stage", F.when(F.col("pos") % 4 > 0, F.floor("ms").cast("string")).otherwise("None"))
    return drained(t, jobs.live_ledger(streamed(t, "ledger", ["pos", line.alias("value")]))).select("pos", "model_id", "stage", "ms")


@query("SELECT DISTINCT user_id, event_type, (SELECT max(event_id) FROM events)::VARCHAR AS mark FROM events")
def st_incremental_scan(t):
    votes = t.events.limit(0).select("user_id", "event_type")
    table = StoredTable(t.spark, folder(t, "votes"), votes.schema, "user_id")
    for name, part in (("even", "event_id % 2 = 0"), ("third", "event_id % 3 = 0"), ("all", "true"), ("all", "true")):
        path = folder(t, "part")
        rows = t.events.where(part).select("event_id", "user_id", "event_type")
        rows.write.parquet(path)
        # the last stream begins anew, as after a lost checkpoint, and its batches are known by their names
        q = t.spark.readStream.schema(rows.schema).parquet(path).writeStream.foreachBatch(jobs.merge_new(table, ["user_id", "event_type"], name, "event_id")).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return table.read().withColumn("mark", F.lit(table.mark()))


@query("WITH v AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 7 > 0) SELECT user_id, event_type, (SELECT max(event_id) FROM events) AS mark FROM v", name="st_incremental_scan_mark")
def st_incremental_scan_mark(t):
    keys = ["user_id", "event_type"]
    rows = t.events.select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("user_id"), "event_type")
    half = rows.agg((F.max("row_id") / 2).cast("long").alias("m")).first().m
    none = t.spark.createDataFrame([], "mark long")
    first, mark = jobs.scan_above(rows.where(F.col("row_id") <= half), none, None, keys)
    second, last = jobs.scan_above(rows, mark, first, keys)
    return first.unionByName(second).join(F.broadcast(last))


@query("SELECT project, signature FROM (SELECT project, md5(count(*)::VARCHAR || project) AS signature FROM docs GROUP BY 1) WHERE project <> 'src1'")
def st_skip_unchanged(t):
    now = t.docs.groupBy("project").agg(F.count("*").alias("n")).select("project", F.md5(F.concat(F.col("n").cast("string"), "project")).alias("signature"))
    known = now.where("project = 'src1'").unionByName(now.where("project = 'src2'").withColumn("signature", F.lit("old")))
    return jobs.skip_unchanged(now, known)


@query("SELECT doc_id AS key FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def st_content_cache(t):
    items = t.documents.select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    cache = items.where("key % 3 = 0").select("key", F.sha2("content", 256).alias("hash"), F.lit(1).alias("result"), F.when(F.col("key") % 2 == 0, "f1").otherwise("f0").alias("fingerprint"))
    return jobs.content_cache(items, cache, "f1")[1].select("key")


@query("""WITH s AS (SELECT user_id AS fingerprint, event_id, event_id % 3 = 1 AS seen, event_id % 4 = 0 AS aged FROM events WHERE event_id % 3 < 2), w AS (SELECT *, coalesce(lag(seen) OVER (PARTITION BY fingerprint ORDER BY event_id), false) AS was FROM s),
  o AS (SELECT *, sum(CASE WHEN seen AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY event_id) AS occurrence FROM w),
  a AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, occurrence, seen AND aged ORDER BY event_id) AS ra FROM o)
  SELECT fingerprint, event_id, occurrence::BIGINT AS occurrence, CASE WHEN seen AND NOT was THEN 'opened' WHEN seen THEN 'aged' ELSE 'closed' END AS change FROM a WHERE (seen AND NOT was) OR (seen AND aged AND ra = 1) OR (NOT seen AND was)""")
def st_event_occurrences(t):
    return drained(t, jobs.occurrence_events(streamed(t, "sightings", ["fingerprint", "event_id", "kind", (F.col("event_id") % 4 == 0).alias("aged")])))


@query(f"""WITH l AS (SELECT pos, make_timestamp(pos) AS ts, ms, 'h' || (pos % 50)::VARCHAR AS host FROM ledger), {DECAY}, {STATES.replace("SELECT host, pos, round(ratio, 6) AS ratio, CASE WHEN slow = 0 THEN 'run' WHEN k <= 3 THEN 'pause' ELSE 'capped' END AS state,", "SELECT host, pos,")}""")
def st_rolling_decay(t):
    host = F.concat(F.lit("h"), (F.col("pos") % 50).cast("string")).alias("host")
    return drained(t, jobs.decay_states(streamed(t, "ledger", [host, "pos", "ms"])))


@query("SELECT user_id, event_type, p::VARCHAR || ' ' || CASE WHEN p = 3 THEN 'rejected' ELSE 'ingested' END AS outcome FROM (SELECT *, event_id % 5 AS p FROM events) WHERE p <> 3 UNION ALL SELECT NULL, NULL, '3 rejected'")
def st_dropzone_ingest(t):
    path, archive, target = folder(t, "landing"), folder(t, "archive"), folder(t, "rows")
    part = F.col("event_id") % 5
    # one file for each remainder; the fourth holds a line that ends early
    line = F.to_json(F.struct("user_id", "event_type", part.alias("p")))
    lines = t.events.select(part.alias("part"), F.when((part == 3) & (F.col("event_id") < 10), F.substring(line, 1, 20)).otherwise(line).alias("value"))
    for k in range(5):
        lines.where(F.col("part") == k).select("value").coalesce(1).write.mode("append").text(path)
    schema = StructType.fromDDL("user_id long, event_type string, p long")
    journal = StoredTable(t.spark, folder(t, "journal"), StructType.fromDDL(jobs.JOURNAL), "file", parts=4)
    # the second run has lost its checkpoint: what is in the journal is not added again
    for _ in range(2):
        stream = jobs.landing(t.spark, path, files_a_batch=2)
        stream.writeStream.foreachBatch(jobs.ingest_files(schema, target, journal, archive)).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start().awaitTermination()
    rows = jobs.ingested(t.spark, schema, target, journal).select("user_id", "event_type", F.concat(F.col("p").cast("string"), F.lit(" ingested")).alias("outcome"))
    told = journal.read().where("outcome = 'rejected' and broken > 0 and first_broken is not null")
    left = t.spark.read.text(path).select(F.regexp_extract("value", '"p":([0-9])', 1).alias("p")).where("p <> ''").distinct()
    # what is left in the folder is the rejected file
    return rows.unionByName(told.crossJoin(F.broadcast(left.limit(1))).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.concat("p", F.lit(" "), "outcome").alias("outcome")))


AGE_S = 3 * 86400


@query(f"""WITH s AS (SELECT user_id AS fingerprint, event_id, epoch_ms(CAST(ts AS TIMESTAMP)) AS ms, event_id % 3 = 1 AS seen, event_id % 3 = 0 AS done FROM events),
  w AS (SELECT * FROM s WHERE seen OR done), x AS (SELECT *, coalesce(lag(seen) OVER (PARTITION BY fingerprint ORDER BY ms, event_id), false) AS was FROM w),
  o AS (SELECT *, sum(CASE WHEN seen AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY ms, event_id) AS occurrence FROM x),
  op AS (SELECT fingerprint, event_id, ms, occurrence FROM o WHERE seen AND NOT was), cl AS (SELECT fingerprint, event_id, ms, occurrence FROM o WHERE done AND was),
  a AS (SELECT op.fingerprint, op.occurrence FROM op LEFT JOIN cl USING (fingerprint, occurrence) WHERE coalesce(cl.ms >= op.ms + {AGE_S}000, true)
    AND (op.ms + {AGE_S}000 <= (SELECT max(ms) - 3600000 FROM s) OR EXISTS (SELECT 1 FROM s l WHERE l.fingerprint = op.fingerprint AND l.ms >= op.ms + {AGE_S}000)))
  SELECT fingerprint, event_id, occurrence::BIGINT AS occurrence, 'opened' AS change FROM op UNION ALL SELECT fingerprint, event_id, occurrence::BIGINT, 'closed' FROM cl UNION ALL SELECT fingerprint, NULL, occurrence::BIGINT, 'aged' FROM a""", name="st_event_occurrences_aged")
def st_event_occurrences_aged(t):
    # some 256 conditions a bucket
    buckets = max(64, t.sightings.agg(F.approx_count_distinct("fingerprint")).first()[0] // 256)
    with stateful.timed_state(t.spark):
        return drained(t, stateful.ageing_occurrences(streamed(t, "sightings", ["fingerprint", "event_id", "ts", "kind"]), AGE_S * 1000, buckets=buckets))


CTX = "CASE WHEN event_id % 4 = 0 THEN event_type END"


@query(f"""WITH c AS (SELECT user_id, ts, event_id, coalesce(last_value({CTX} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS ctx FROM activity),
  m AS (SELECT *, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER w AS gap, lag(ctx) OVER w AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, CASE WHEN coalesce(gap > 86400, true) OR ctx <> prev THEN 1 ELSE 0 END AS new FROM m), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n)
  SELECT user_id AS account, session::BIGINT AS session, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, round(greatest(0.0, least(1.0, 1 - coalesce(avg(CASE WHEN new = 0 THEN gap END), 0.0) / 86400)), 6) AS confidence FROM s GROUP BY 1, 2""", name="st_session_window_context")
def st_session_window_context(t):
    path = folder(t, "activity")
    rows = t.activity.select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("context"))
    # rows in three batches that have nothing to do with their order, then one far later row, which lets all sessions end
    files = t.spark.sparkContext.defaultParallelism
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).repartition(files).write.mode("append").parquet(path)
    rows.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit(-1).cast("long").alias("account"), "ts", F.lit(-1).cast("long").alias("id"), F.lit(None).cast("string").alias("context")).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    # some 256 accounts a bucket
    buckets = max(64, rows.agg(F.approx_count_distinct("account")).first()[0] // 256)
    with stateful.timed_state(t.spark):
        return drained(t, stateful.context_sessions(stream, 86400, "200 days", buckets)).where("account >= 0").select("account", "session", "n", "first_id", "confidence")
