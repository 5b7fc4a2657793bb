"""Queries over windows and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as ops
from .catalog import query
from .diffs import BURSTS


@query(f"""WITH {BURSTS}, s AS (SELECT 'c' || o_custkey::VARCHAR AS project, min(o_orderdate)::DATE - 400 AS seen FROM orders WHERE o_custkey < 40 AND o_custkey % 3 = 0 GROUP BY 1)
  SELECT b.project, CASE WHEN "from" = min("from") OVER (PARTITION BY b.project) THEN least("from", seen) ELSE "from" END::VARCHAR AS "from", "to"::VARCHAR AS "to" FROM b LEFT JOIN s ON s.project = b.project""")
def wn_bursts(t):
    own = t.orders.where("o_custkey < 40 and o_custkey % 3 = 0").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project"))
    seen = own.agg(F.date_sub(F.to_date(F.min("o_orderdate")), 400).alias("first_seen"))
    out = ops.bursts(t.commits.select("project", F.to_date("ts").alias("day")), first_seen=seen)
    return out.select("project", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


CTX = "CASE WHEN event_id % 4 = 0 THEN event_type END"


@query(f"""WITH c AS (SELECT user_id, ts, event_id, coalesce(last_value({CTX} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS ctx FROM activity),
  m AS (SELECT *, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER w AS gap, lag(ctx) OVER w AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, CASE WHEN coalesce(gap > 86400, true) OR ctx <> prev THEN 1 ELSE 0 END AS new FROM m), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n)
  SELECT user_id AS account, session::BIGINT AS session, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, round(greatest(0.0, least(1.0, 1 - coalesce(avg(CASE WHEN new = 0 THEN gap END), 0.0) / 86400)), 6) AS confidence FROM s GROUP BY 1, 2""")
def wn_sessionize(t):
    rows = t.activity.select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("context"))
    return ops.sessionize(rows, 86400).select("account", "session", "n", "first_id", "confidence")


@query("""SELECT event_id AS id, 'batch-' || substr(h, 1, 8) AS thread_id, row_number() OVER (PARTITION BY h ORDER BY ts, event_id)::INT - 1 AS seq FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN md5(user_id::VARCHAR || event_type) END AS h FROM activity) WHERE h IS NOT NULL""")
def wn_fingerprint_groups(t):
    h = F.when(F.col("event_id") % 5 > 0, F.md5(F.concat(F.col("user_id").cast("string"), "event_type")))
    return ops.fingerprint_groups(t.activity.select(F.col("event_id").alias("id"), "ts", h.alias("hash")))


@query("""WITH a AS (SELECT *, md5(user_id::VARCHAR || event_type) AS h FROM activity WHERE event_id % 5 > 0) SELECT 'batch-' || substr(h, 1, 8) AS thread_id, CASE WHEN arg_min(c, (ts, event_id)) = '' THEN 'Untitled' ELSE arg_min(c, (ts, event_id)) END AS title, floor(epoch(min(ts)))::BIGINT AS created_at, floor(epoch(max(ts)))::BIGINT AS updated_at,
  'thread_grouping' AS type, 'pending' AS status, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE substr(event_type || ' ' || event_id::VARCHAR, 1, 60) END AS c FROM a) GROUP BY h""", name="wn_fingerprint_groups_threads")
def wn_fingerprint_groups_threads(t):
    h = F.when(F.col("event_id") % 5 > 0, F.md5(F.concat(F.col("user_id").cast("string"), "event_type")))
    content = F.when(F.col("event_id") % 3 != 0, F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    out = ops.fingerprint_threads(t.activity.select(F.col("event_id").alias("id"), "ts", h.alias("hash"), content.alias("content")))
    return out.withColumn("created_at", F.unix_timestamp("created_at")).withColumn("updated_at", F.unix_timestamp("updated_at"))


@query("SELECT session_id, pos, status, status <> 'revoked' AND pos = max(pos) OVER (PARTITION BY session_id) AS is_current FROM map_rows", name="wn_latest_wins_annotated")
def wn_latest_wins_annotated(t):
    return ops.annotated(t.map_rows).select("session_id", "pos", "status", "is_current")


@query("SELECT session_id, project_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS rn FROM map_rows) WHERE rn = 1 AND status <> 'revoked'")
def wn_latest_wins(t):
    return ops.latest_wins(t.map_rows).select("session_id", "project_id", "pos")


@query("""WITH s AS (SELECT o_custkey AS c, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS m, CASE WHEN o_custkey % 5 < 3 THEN o_orderdate + INTERVAL 1 DAY END AS f, CASE WHEN o_custkey % 7 < 5 THEN TIMESTAMP '2020-01-01' END AS d FROM orders)
  SELECT c AS conversation_id, coalesce(max(m), max(f), max(d))::DATE::VARCHAR AS real_time, CASE WHEN max(m) IS NOT NULL THEN 'message' WHEN max(f) IS NOT NULL THEN 'file' WHEN max(d) IS NOT NULL THEN 'folder' ELSE 'none' END AS source,
  max(m) IS NULL AND max(f) IS NULL AND max(d) IS NULL AS excluded FROM s GROUP BY 1""")
def wn_conversation_time(t):
    day, k = F.col("o_orderdate").cast("timestamp"), F.col("o_custkey")
    rows = t.orders.select(k.alias("conversation_id"), F.when(k % 3 == 0, day).alias("ts"), F.when(k % 5 < 3, day + F.expr("interval 1 day")).alias("mtime"), F.when(k % 7 < 5, F.lit("2020-01-01").cast("timestamp")).alias("folder_time"))
    return ops.conversation_time(rows).withColumn("real_time", F.to_date("real_time").cast("string"))


@query("SELECT thread_id AS conversation_id, arg_min(content, (seq % 3, seq)) AS first_user FROM messages WHERE role = 'user' GROUP BY 1")
def wn_first_user_message(t):
    m = t.messages.select(F.col("thread_id").alias("conversation_id"), "role", "content", "seq", (F.col("seq") % 3).alias("session_rank"), F.lit(0).alias("ts"))
    return ops.first_user_message(m)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs),
  m AS (SELECT *, length(regexp_extract(line, '^(The|Der|La|#{1,6}) ', 1)) AS level FROM l), c AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS chunk FROM m),
  k AS (SELECT *, max(chunk) OVER (PARTITION BY doc_id) AS chunks FROM c)
  SELECT doc_id, chunk::BIGINT AS chunk, max(level)::INT AS level, min(n)::BIGINT AS start_line, max(chunks = 0) AS whole, string_agg(line, chr(10) ORDER BY n) AS text FROM k WHERE chunk > 0 OR chunks = 0 GROUP BY 1, 2""")
def wn_heading_chunks(t):
    return ops.heading_chunks(t.docs, r"^(The|Der|La|#{1,6}) ")


@query("""WITH r AS (SELECT user_id AS thread_id, event_id AS seq, CASE WHEN event_id % 10 > 0 THEN CASE WHEN event_id % 50 = 7 THEN ts - INTERVAL 20 DAY ELSE ts END END AS ts FROM activity), b AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY thread_id ORDER BY seq) > ts, false) AS back FROM r)
  SELECT thread_id, max(back) AS conflict, count_if(ts IS NULL)::BIGINT AS unmatched, round(count(ts)::DOUBLE / count(*), 6) AS match_rate FROM b GROUP BY 1""")
def wn_order_conflict(t):
    ts = F.when(F.col("event_id") % 10 > 0, F.when(F.col("event_id") % 50 == 7, F.col("ts") - F.expr("interval 20 days")).otherwise(F.col("ts")))
    return ops.order_conflict(t.activity.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), ts.alias("ts")))


OCC = """s AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'ruling' THEN kind END IGNORE NULLS) OVER (PARTITION BY fingerprint ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'resolution') AS state FROM sightings),
  o AS (SELECT *, sum(CASE WHEN kind = 'sighting' AND state = 'resolution' THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY ts, event_id) AS occurrence FROM s),
  f AS (SELECT fingerprint, occurrence, min(ts) AS opened, min(CASE WHEN kind = 'resolution' THEN ts END) AS resolved, min(CASE WHEN kind = 'ruling' THEN ts END) AS first_ruling, count_if(kind = 'sighting')::BIGINT AS sightings FROM o WHERE occurrence > 0 GROUP BY 1, 2)"""


@query(f"WITH {OCC} SELECT fingerprint, occurrence::BIGINT AS occurrence, floor(epoch(opened))::BIGINT AS opened, floor(epoch(resolved))::BIGINT AS resolved, floor(epoch(first_ruling))::BIGINT AS first_ruling, sightings FROM f")
def wn_occurrences(t):
    out = ops.occurrences(t.sightings)
    return out.select("fingerprint", "occurrence", *[F.unix_timestamp(c).alias(c) for c in ("opened", "resolved", "first_ruling")], "sightings")


@query(f"""WITH {OCC} SELECT count(*) AS raised, count(first_ruling) AS ruled, count_if(resolved IS NOT NULL AND first_ruling IS NULL)::BIGINT AS resolved_unruled, count_if(resolved IS NULL)::BIGINT AS still_open,
  round(median((floor(epoch(first_ruling))::BIGINT - floor(epoch(opened))::BIGINT) / 3600.0), 6) AS median_hours,
  round((floor(epoch(max(greatest(opened, resolved, first_ruling))))::BIGINT - floor(epoch(min(CASE WHEN resolved IS NULL THEN opened END)))::BIGINT) / 86400.0, 6) AS oldest_open_days FROM f""")
def wn_latency_summary(t):
    return ops.latency_summary(ops.occurrences(t.sightings))


DECAY = """n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, pos, ms) AS n, 1.0::DOUBLE / ms AS speed FROM l), r AS (SELECT *, median(speed) OVER (PARTITION BY host ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling FROM n),
  b AS (SELECT host, median(speed) AS baseline FROM n WHERE n <= 4 GROUP BY 1), q AS (SELECT r.*, CASE WHEN n >= 4 THEN rolling / baseline END AS ratio FROM r JOIN b USING (host))"""


STATES = """sl AS (SELECT *, coalesce(last_value(CASE WHEN ratio < 0.75 THEN 1 WHEN ratio >= 0.9 THEN 0 END IGNORE NULLS) OVER (PARTITION BY host ORDER BY n), 0) AS slow FROM q),
  wa AS (SELECT *, coalesce(lag(slow) OVER (PARTITION BY host ORDER BY n), 0) AS was FROM sl), sr AS (SELECT *, sum(CASE WHEN slow = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY n) AS stretch FROM wa),
  co AS (SELECT *, row_number() OVER (PARTITION BY host, stretch, slow ORDER BY n) AS k FROM sr)
  SELECT host, pos, round(ratio, 6) AS ratio, CASE WHEN slow = 0 THEN 'run' WHEN k <= 3 THEN 'pause' ELSE 'capped' END AS state,
  CASE WHEN ratio IS NULL THEN 'observing' WHEN slow = 0 AND was = 1 THEN 'resume' WHEN slow = 0 THEN 'none' WHEN k <= 3 THEN 'pause' WHEN k = 4 THEN 'cap_reached' ELSE 'none' END AS action FROM co"""


@query(f"WITH l AS (SELECT pos, ts, ms, 'h' || (pos % 50)::VARCHAR AS host FROM ledger), {DECAY}, {STATES}")
def wn_rolling_decay(t):
    return ops.rolling_decay(t.ledger.withColumn("host", F.concat(F.lit("h"), (F.col("pos") % 50).cast("string"))))


@query("""WITH RECURSIVE m AS (SELECT thread_id, seq, floor(length(content) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS n FROM messages),
  f AS (SELECT thread_id, seq, tokens, n, 0::BIGINT AS "window", tokens AS used FROM m WHERE n = 1 UNION ALL SELECT m.thread_id, m.seq, m.tokens, m.n, f."window" + CASE WHEN f.used + m.tokens > 120 THEN 1 ELSE 0 END, CASE WHEN f.used + m.tokens > 120 THEN m.tokens ELSE f.used + m.tokens END
  FROM f JOIN m ON m.thread_id = f.thread_id AND m.n = f.n + 1) SELECT thread_id, seq, tokens, "window" FROM f""")
def wn_token_windows(t):
    return ops.token_windows(t.messages, 120)


@query("""WITH RECURSIVE m AS (SELECT 'acc' || (conv_id % 3)::VARCHAR AS project, conv_id * 1000 + turn AS pos, floor(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id * 1000 + turn) AS n FROM conversations),
  f AS (SELECT project, pos, n, 0::BIGINT AS batch, CASE WHEN tokens > 100 THEN 1 ELSE 0 END::BIGINT AS cur, CASE WHEN tokens > 100 THEN 0 ELSE tokens END AS used, CASE WHEN tokens > 100 THEN 0 ELSE 1 END::BIGINT AS cnt FROM m WHERE n = 1
    UNION ALL SELECT project, pos, n, own, CASE WHEN large THEN own + 1 ELSE own END, CASE WHEN large THEN 0 WHEN own > cur THEN tokens ELSE used + tokens END, CASE WHEN large THEN 0 WHEN own > cur THEN 1 ELSE cnt + 1 END
    FROM (SELECT m.project, m.pos, m.n, m.tokens, f.cur, f.used, f.cnt, m.tokens > 100 AS large, CASE WHEN m.tokens > 100 THEN f.cur + CASE WHEN f.cnt > 0 THEN 1 ELSE 0 END WHEN f.cnt > 0 AND (f.used + m.tokens > 300 OR f.cnt >= 6) THEN f.cur + 1 ELSE f.cur END AS own FROM f JOIN m ON m.project = f.project AND m.n = f.n + 1))
  SELECT project, pos, batch FROM f""")
def wn_batch_packing(t):
    items = t.conversations.select(F.concat(F.lit("acc"), (F.col("conv_id") % 3).cast("string")).alias("project"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    return ops.batch_packing(items, 100, 300, 6)
