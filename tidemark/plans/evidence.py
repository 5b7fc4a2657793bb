"""Queries over evidence, link decisions and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as ops
from .catalog import query

COMBINE = """bo AS (SELECT *, row_number() OVER (PARTITION BY thread_id, project, origin ORDER BY weight DESC, evidence_id) AS ro FROM evidence),
  bs AS (SELECT *, row_number() OVER (PARTITION BY thread_id, project, signal ORDER BY weight DESC, evidence_id) AS rs FROM bo WHERE ro = 1),
  sc AS (SELECT thread_id, project, round(1 - exp(sum(ln(1 - least(coalesce(weight, 0.0), 0.97)))), 6) AS score, count(DISTINCT origin) AS origins FROM bs WHERE rs <= 3 OR signal = 'name_alias' GROUP BY 1, 2),
  rk AS (SELECT *, round(score * plaus, 6) AS adjusted FROM (SELECT *, CASE WHEN (thread_id + length(project)) % 3 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS plaus FROM sc)),
  rr AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY adjusted DESC, project) AS rank FROM rk)"""


def scored(t):
    out = ops.combine(t.evidence)
    plaus = F.when((F.col("thread_id") + F.length("project")) % 3 == 0, 0.8).otherwise(1.0)
    return out, out.select("thread_id", "project", plaus.alias("plausibility"))


@query(f"WITH {COMBINE} SELECT thread_id, project, round(score, 4) AS score, origins FROM sc")
def sc_evidence_combine(t):
    return ops.combine(t.evidence).withColumn("score", F.round("score", 4))


@query(f"WITH {COMBINE} SELECT thread_id, project, round(adjusted, 4) AS adjusted, origins FROM rr")
def sc_candidate_rank(t):
    return ops.rank_candidates(*scored(t)).select("thread_id", "project", F.round("adjusted", 4).alias("adjusted"), "origins")


FOLD = """rg AS (SELECT id, CASE tier WHEN 'repo' THEN 2 WHEN 'project' THEN 1 ELSE 0 END AS spec, list_filter([id, project, program], lambda x: x IS NOT NULL) AS line, project AS parent FROM registry),
  cd AS (SELECT rr.thread_id, rr.rank, {'project': rr.project, 'adjusted': adjusted, 'origins': origins, 'spec': coalesce(spec, -1), 'line': coalesce(line, [rr.project])} AS x FROM rr LEFT JOIN rg ON rr.project = rg.id),
  fo AS (SELECT thread_id, 1::BIGINT AS rank, [x] AS kept FROM cd WHERE rank = 1 UNION ALL
    SELECT thread_id, rank, CASE WHEN i = 0 THEN list_append(kept, x) WHEN abs(kept[i].adjusted - x.adjusted) < 1e-9 AND x.spec > kept[i].spec THEN list_concat(list_concat(kept[1:i - 1], [x]), kept[i + 1:]) ELSE kept END
    FROM (SELECT fo.thread_id, cd.rank, kept, x, coalesce(list_position(list_transform(kept, lambda k: list_contains(k.line, x.project) OR list_contains(x.line, k.project)), true), 0) AS i FROM fo JOIN cd ON cd.thread_id = fo.thread_id AND cd.rank = fo.rank + 1)),
  lc AS (SELECT thread_id, rank::INT AS rank, k.project AS project, k.adjusted AS adjusted, k.origins AS origins FROM (SELECT thread_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS rank FROM (SELECT thread_id, arg_max(kept, rank) AS kept FROM fo GROUP BY 1)))"""
DECIDE = """jd AS (SELECT t.thread_id, project_link, project_confidence, o.project AS best, o.adjusted AS a1, o.origins AS o1, w.project AS second, w.adjusted AS a2, p1.parent AS par1, p2.parent AS par2 FROM threads t
    LEFT JOIN lc o ON o.thread_id = t.thread_id AND o.rank = 1 LEFT JOIN lc w ON w.thread_id = t.thread_id AND w.rank = 2 LEFT JOIN rg p1 ON p1.id = o.project LEFT JOIN rg p2 ON p2.id = w.project
    WHERE t.thread_id NOT IN (SELECT thread_id FROM rulings WHERE thread_id % 4 = 0)),
  fl AS (SELECT *, a1 - coalesce(a2, 0) AS lead, coalesce(project_confidence, 'none') = 'fuzzy' AND NOT coalesce(project_link = best, false) AS elsewhere, coalesce(par1 = par2 AND par1 <> best AND par1 <> second, false) AS sib FROM jd),
  rv AS (SELECT *, a1 >= 0.6 AND coalesce(a2, 0) >= 0.6 AND lead < 0.25 AS rivals, a1 >= 0.9 AND lead >= 0.25 AS strong FROM fl),
  ct AS (SELECT *, CASE WHEN project_confidence IN ('manual', 'exact', 'evidence') THEN 'skip_' || project_confidence WHEN best IS NULL THEN 'none' WHEN rivals AND sib THEN 'suggest' WHEN rivals THEN 'ambiguous'
    WHEN (strong OR a1 >= 0.6) AND elsewhere THEN 'downgrade' WHEN strong AND o1 >= 2 THEN 'auto_link' WHEN a1 >= 0.6 THEN 'suggest' ELSE 'none' END AS category FROM rv),
  dc AS (SELECT thread_id, category, CASE WHEN category IN ('suggest', 'ambiguous', 'downgrade', 'auto_link') THEN CASE WHEN rivals AND sib THEN par1 ELSE best END END AS project,
    CASE WHEN category IN ('suggest', 'ambiguous', 'downgrade', 'auto_link') THEN a1 END AS adjusted, CASE WHEN category = 'ambiguous' THEN second END AS rival FROM ct)"""
#: Statement up to the decisions.
DECIDED = f"WITH RECURSIVE {COMBINE}, {FOLD}, {DECIDE}"
WINNING = "wn AS (SELECT bs.thread_id, bs.project, evidence_id, signal, weight, origin FROM bs JOIN dc ON bs.thread_id = dc.thread_id AND bs.project = dc.project WHERE category = 'auto_link' AND (rs <= 3 OR signal = 'name_alias'))"


@query(f"WITH RECURSIVE {COMBINE}, {FOLD} SELECT thread_id, rank, project, round(adjusted, 4) AS adjusted, origins FROM lc")
def sc_lineage_collapse(t):
    return ops.collapse_lineage(ops.rank_candidates(*scored(t)), t.registry).withColumn("adjusted", F.round("adjusted", 4))


def decisions(t):
    kept = ops.collapse_lineage(ops.rank_candidates(*scored(t)), t.registry)
    return ops.decide(t.threads, kept, t.rulings.where("thread_id % 4 = 0"), t.registry)


@query(f"{DECIDED} SELECT thread_id, category, project, round(adjusted, 4) AS adjusted, rival FROM dc")
def sc_link_decision(t):
    return decisions(t).withColumn("adjusted", F.round("adjusted", 4))


def applied(t):
    return ops.apply_decisions(t.threads, decisions(t), t.queue, t.evidence)


@query(f"""{DECIDED} SELECT q.thread_id, q.type, q.candidate_project, q.rival_project, q.status FROM queue q LEFT JOIN dc ON dc.thread_id = q.thread_id AND category IN ('suggest', 'ambiguous', 'downgrade', 'auto_link')
  WHERE NOT (q.status = 'pending' AND q.type IN ('project_link', 'link_ambiguous', 'link_downgrade') AND dc.thread_id IS NOT NULL)
  UNION ALL SELECT thread_id, CASE category WHEN 'auto_link' THEN 'link_upgrade' WHEN 'suggest' THEN 'project_link' WHEN 'ambiguous' THEN 'link_ambiguous' ELSE 'link_downgrade' END, project, rival, CASE WHEN category = 'auto_link' THEN 'confirmed' ELSE 'pending' END
  FROM dc WHERE category IN ('suggest', 'ambiguous', 'downgrade', 'auto_link')""")
def sc_decision_apply(t):
    return applied(t)[1]


@query(f"""{DECIDED}, {WINNING}, ids AS (SELECT thread_id, string_agg(evidence_id::VARCHAR, ',' ORDER BY evidence_id) AS ids FROM wn GROUP BY 1)
  SELECT t.thread_id, CASE WHEN category = 'auto_link' THEN dc.project ELSE project_link END AS project_link, CASE WHEN category = 'auto_link' THEN 'evidence' ELSE project_confidence END AS project_confidence, ids AS evidence_ids
  FROM threads t LEFT JOIN dc ON dc.thread_id = t.thread_id LEFT JOIN ids ON ids.thread_id = t.thread_id""", name="sc_decision_apply_threads")
def sc_decision_apply_threads(t):
    ids = F.array_join(F.transform("link_evidence_ids", lambda x: x.cast("string")), ",")
    return applied(t)[0].select("thread_id", "project_link", "project_confidence", ids.alias("evidence_ids"))


@query(f"{DECIDED}, {WINNING} SELECT * FROM wn", name="sc_decision_apply_evidence")
def sc_decision_apply_evidence(t):
    return ops.winning_evidence(decisions(t), t.evidence)


@query(f"""{DECIDED}, rp AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(adjusted, 0) DESC, thread_id) AS rn FROM dc)
  SELECT category, count(*) AS n, string_agg(CASE WHEN rn <= 15 THEN thread_id::VARCHAR END, ',' ORDER BY rn) AS samples FROM rp GROUP BY 1""")
def sc_decision_report(t):
    return ops.decision_report(decisions(t))


@query("SELECT r.id, concat_ws(' > ', g.canonical_name, p.canonical_name, r.canonical_name) AS label FROM registry r LEFT JOIN registry p ON r.project = p.id LEFT JOIN registry g ON r.program = g.id")
def sc_rollup_label(t):
    return ops.rollup_label(t.registry)


@query("""SELECT o_orderkey AS thread_id, 'p' || (o_custkey % 35)::VARCHAR AS project, CASE WHEN t.thread_id IS NULL THEN 'unknown_thread' WHEN r.id IS NULL THEN 'unknown_project' ELSE 'ok' END AS result
  FROM orders LEFT JOIN threads t ON o_orderkey = t.thread_id LEFT JOIN registry r ON r.id = 'p' || (o_custkey % 35)::VARCHAR""")
def sc_human_ruling(t):
    batch = t.orders.select(F.col("o_orderkey").alias("thread_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 35).cast("string")).alias("project"))
    return ops.human_rulings(batch, t.threads, t.registry)


@query("""WITH b AS (SELECT o_orderkey AS pos, o_orderkey % 120 AS thread_id, 'p' || (o_custkey % 35)::VARCHAR AS project FROM orders), v AS (SELECT thread_id, max_by(project, pos) AS ruled FROM b WHERE thread_id IN (SELECT thread_id FROM threads) AND project IN (SELECT id FROM registry) GROUP BY 1)
  SELECT t.thread_id, coalesce(ruled, project_link) AS project_link, CASE WHEN ruled IS NOT NULL THEN 'manual' ELSE project_confidence END AS project_confidence FROM threads t LEFT JOIN v ON v.thread_id = t.thread_id""", name="sc_human_ruling_apply")
def sc_human_ruling_apply(t):
    batch = t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 120).alias("thread_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 35).cast("string")).alias("project"))
    return ops.apply_rulings(batch, t.threads, t.registry).select("thread_id", "project_link", "project_confidence")


@query("SELECT count(*) AS accepted, count(DISTINCT thread_id) AS threads, round(min(confidence), 6) AS least FROM queue WHERE status = 'pending' AND confidence >= 0.5 AND thread_id NOT IN (SELECT thread_id FROM rulings WHERE thread_id < 50)")
def sc_bulk_accept(t):
    return ops.bulk_accept(t.queue, t.rulings.where("thread_id < 50"), 0.5)[1]


@query("""WITH n AS (SELECT item_id, candidate_project AS c, 'p' || (item_id % 40)::VARCHAR AS v, item_id % 2 = 0 AS two FROM queue)
  SELECT item_id, CASE WHEN a.id IS NOT NULL THEN c END AS candidate, CASE WHEN b.id IS NOT NULL THEN v END AS rival, a.id IS NULL OR (two AND b.id IS NULL) AS unresolved FROM n LEFT JOIN registry a ON a.id = c LEFT JOIN registry b ON two AND b.id = v""")
def sc_note_backfill(t):
    note = F.when(F.col("item_id") % 2 == 0, F.concat("candidate_project", F.lit(" vs p"), (F.col("item_id") % 40).cast("string"))).otherwise(F.col("candidate_project"))
    return ops.note_backfill(t.queue.select("item_id", note.alias("note")), t.registry)


RULES = (("db-writes", "write", r"(?i)insert\s+into"), ("shell", "write", r"rm\s+-rf"), ("cloud-read", "read", r"kubectl\s+get"))


BLAST = """f AS (SELECT 'c' || (o_custkey % 15)::VARCHAR AS project, o_orderkey AS path, CASE o_orderkey % 5 WHEN 0 THEN 'insert into t --target-org MainOrg' WHEN 1 THEN 'rm -rf x' WHEN 2 THEN 'kubectl get pods' WHEN 3 THEN 'insert into y --target-org devbox # approval' ELSE 'pass' END AS line, o_orderstatus AS s FROM orders),
  h AS (SELECT *, CASE WHEN regexp_matches(line, 'kubectl\\s+get') THEN 1 WHEN contains(line, 'approval') THEN 2 WHEN contains(line, 'MainOrg') THEN 4 ELSE 3 END AS rank FROM f WHERE line <> 'pass')"""


def blast(t):
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, "insert into t --target-org MainOrg").when(k == 1, "rm -rf x").when(k == 2, "kubectl get pods").when(k == 3, "insert into y --target-org devbox # approval").otherwise("pass")
    texts = t.orders.select(F.concat(F.lit("c"), (F.col("o_custkey") % 15).cast("string")).alias("project"), F.col("o_orderkey").alias("path"), line.alias("content"))
    return ops.blast_hits(texts, RULES, "(?i)approval|gated", "(?i)prod|live|main", "(?i)dev|test", r"--target-?org\s+([A-Za-z0-9_.-]+)")


@query(f"""WITH {BLAST} SELECT project, ['none', 'read-only', 'guarded-write', 'raw-write', 'raw-write-prod'][max(rank) + 1] AS tier, count(*) AS hits, count(DISTINCT path) AS files FROM h GROUP BY 1""")
def sc_blast_tier(t):
    return ops.blast_tier(blast(t))


@query(f"WITH {BLAST} SELECT project, path, rank, CASE WHEN s = 'O' THEN 'untracked' ELSE 'dirty' END AS state FROM h WHERE rank >= 3 AND s <> 'F'", name="sc_blast_tier_critical")
def sc_blast_tier_critical(t):
    status = F.when(F.col("o_orderstatus") == "O", "??").when(F.col("o_orderstatus") == "P", " M")
    changed = t.orders.select(F.concat(F.lit("c"), (F.col("o_custkey") % 15).cast("string")).alias("project"), F.col("o_orderkey").alias("path"), status.alias("status")).where("status is not null")
    return ops.blast_critical(blast(t), changed)


@query("""WITH k AS (SELECT unnest(['context_overflow', 'timeout', 'transport', 'unknown']) AS kind), f AS (SELECT CASE WHEN o_totalprice > 400000 THEN 'context_overflow' WHEN o_orderkey % 4 = 0 THEN 'timeout' WHEN o_orderkey % 4 = 1 THEN 'unknown' ELSE 'other' END AS kind FROM orders)
  SELECT k.kind, count(f.kind) AS n, round(count(f.kind)::DOUBLE / ((SELECT count(*) FROM orders) + 5000), 6) AS rate FROM k LEFT JOIN (SELECT CASE WHEN kind = 'other' THEN 'unknown' ELSE kind END AS kind FROM f) f USING (kind) GROUP BY 1""")
def sc_fail_taxonomy(t):
    message = F.when(F.col("o_orderkey") % 4 == 0, "Request timed out").otherwise("boom")
    return ops.fail_taxonomy(t.orders.select(message.alias("message"), F.col("o_totalprice").alias("tokens")), 5000, 400000)


@query("""WITH ac AS (SELECT model_id || stage || host AS unit, round(1 - avg(CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END), 6) AS acc FROM ledger GROUP BY 1), s AS (SELECT unit, count(*) AS n, median(ms) AS median, list_sort(list(ms)) AS v FROM (SELECT model_id || stage || host AS unit, ms FROM ledger) GROUP BY 1), q AS (SELECT unit, n, median, v[round_even(0.25 * (n - 1), 0)::INT + 1] AS p25, v[round_even(0.75 * (n - 1), 0)::INT + 1] AS p75 FROM s)
  SELECT a.unit AS unit_a, b.unit AS unit_b, CASE WHEN a.n < 2 OR b.n < 2 THEN 'insufficient' WHEN a.p25 <= b.p75 AND b.p25 <= a.p75 THEN 'indistinguishable' WHEN a.median < b.median THEN a.unit ELSE b.unit END AS verdict, round((a.p75 - a.p25) / a.median, 6) AS floor_a,
  x.acc AS acceptance_a, y.acc AS acceptance_b FROM q a JOIN q b ON a.unit < b.unit JOIN ac x ON x.unit = a.unit JOIN ac y ON y.unit = b.unit""")
def sc_compare_units(t):
    return ops.compare_units(t.ledger.withColumn("unit", F.concat("model_id", "stage", "host")), "unit", "ms", F.col("pos") % 7 == 0)


@query("""WITH c AS (SELECT s_nationkey AS g, s_suppkey AS id, 10 + s_suppkey % 17 AS cost FROM supplier), r AS (SELECT *, row_number() OVER w AS rank, sum(cost) OVER w + (row_number() OVER w - 1) * 2.5 AS total FROM c WINDOW w AS (PARTITION BY g ORDER BY id % 5 DESC, id))
  SELECT g, id, rank::INT AS rank, total::DOUBLE AS total, total <= 30 AS taken FROM r""")
def sc_plan_rank_budget(t):
    c = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), (10 + F.col("s_suppkey") % 17).alias("cost"))
    return ops.rank_budget(c, "g", [(F.col("id") % 5).desc(), F.col("id")], 30, 2.5).select("g", "id", "rank", F.col("total").cast("double").alias("total"), "taken")


@query("""WITH c AS (SELECT o_orderkey AS conversation_id, 'p' || (o_custkey % 20)::VARCHAR AS project, md5(o_orderstatus) AS signature, o_orderkey % 100 AS tokens FROM orders), k AS (SELECT conversation_id, signature FROM c WHERE conversation_id % 3 > 0),
  cl AS (SELECT 'p' || (item_id % 20)::VARCHAR AS project, count(*) AS claims FROM benchmark GROUP BY 1)
  SELECT project, count(*) AS conversations, count_if(k.conversation_id IS NULL)::BIGINT AS changed, coalesce(max(claims), 0) AS claims, round(coalesce(sum(CASE WHEN k.conversation_id IS NULL THEN tokens END), 0) * 1.5::DOUBLE, 3) AS estimate_ms FROM c LEFT JOIN k USING (conversation_id, signature) LEFT JOIN cl USING (project) GROUP BY 1""")
def sc_plan_candidates(t):
    conv = t.orders.select(F.col("o_orderkey").alias("conversation_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project"), F.md5("o_orderstatus").alias("signature"), (F.col("o_orderkey") % 100).alias("tokens"))
    claims = t.benchmark.select(F.concat(F.lit("p"), (F.col("item_id") % 20).cast("string")).alias("project"))
    return ops.plan_candidates(claims, conv, conv.where("conversation_id % 3 > 0").select("conversation_id", "signature"), 1.5)


MAPPED = """mp AS (SELECT o_orderkey AS pos, o_custkey AS session_id, CASE o_orderkey % 5 WHEN 0 THEN 'ambiguous-same-project' WHEN 1 THEN 'ambiguous-different-project' WHEN 2 THEN 'unmatched' ELSE 'matched' END AS status,
  CASE WHEN o_orderkey % 5 > 2 THEN 'pass' || (1 + o_orderkey % 2)::VARCHAR END AS match_pass FROM orders)"""


def mapped(t):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "ambiguous-same-project").when(k % 5 == 1, "ambiguous-different-project").when(k % 5 == 2, "unmatched").otherwise("matched")
    return t.orders.select(k.alias("pos"), F.col("o_custkey").alias("session_id"), status.alias("status"), F.when(k % 5 > 2, F.concat(F.lit("pass"), (1 + k % 2).cast("string"))).alias("match_pass"))


@query(f"""WITH {MAPPED} SELECT pos, CASE WHEN s.session_id IS NOT NULL THEN 'none' WHEN status = 'matched' THEN 'ratify' WHEN status = 'ambiguous-same-project' THEN 'ratify_pair' WHEN status = 'ambiguous-different-project' THEN 'hand_map_or_leave' ELSE 'hand_map_only' END AS action,
  s.session_id IS NOT NULL AS ratified FROM mp LEFT JOIN (SELECT DISTINCT o_custkey AS session_id FROM orders WHERE o_orderstatus = 'P') s USING (session_id)""")
def sc_map_actions(t):
    return ops.map_actions(mapped(t), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("session_id")))


@query(f"""WITH {MAPPED}, o AS (SELECT CASE status WHEN 'matched' THEN 'matched_by_' || match_pass WHEN 'unmatched' THEN 'unmatched_sheet_rows' ELSE replace(status, '-', '_') END AS outcome FROM mp
  UNION ALL SELECT 'unmapped_local_folders_on_disk' FROM customer WHERE c_custkey NOT IN (SELECT session_id FROM mp)) SELECT k.outcome, count(o.outcome) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in ops.OUTCOMES)}]) AS outcome) k LEFT JOIN o USING (outcome) GROUP BY 1""", name="sc_map_actions_counts")
def sc_map_actions_counts(t):
    on_disk = t.customer.select(F.col("c_custkey").alias("session_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return ops.map_counts(mapped(t), ops.unmapped_folders(on_disk, mapped(t)))
