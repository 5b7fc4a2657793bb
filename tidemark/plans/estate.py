"""Queries over files, documents, commits and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core
from ..operators import census, derive, source
from .catalog import query

DOC_TYPE = """CASE WHEN regexp_matches(lower(path), '(^|/)adr/') THEN 'adr' WHEN contains(lower(stem), '_knowledge') THEN 'knowledge' WHEN lower(name) = 'claude.md' THEN 'claude_md'
  WHEN lower(name) LIKE 'readme%' THEN 'readme' WHEN lower(name) = 'glossary.md' THEN 'glossary' """ + " ".join(f"WHEN contains(upper(stem), '{m}') THEN '{k}'" for k, m in derive.TYPE_MARKERS) + " ELSE 'unclassified' END"
PROVENANCE = "CASE WHEN len(list_filter(string_split(path, '/'), lambda s: s LIKE '.%' OR s LIKE '\\_%' ESCAPE '\\' OR s IN ('output', 'logs', 'AutoFiles'))) > 0 THEN 'generated' ELSE 'authored' END"
CENSUS = f"""census AS (SELECT project, path, bytes, len(regexp_extract_all(coalesce(content, ''), '[^ \\t\\n\\r\\f]+'))::BIGINT AS words,
  len(regexp_extract_all(coalesce(content, ''), '(?m)^#{{1,6}} '))::BIGINT AS headings, nullif(regexp_extract(coalesce(content, ''), '(?m)^# (.+)$', 1), '') AS title,
  {DOC_TYPE} AS doc_type, {PROVENANCE} AS provenance
  FROM (SELECT *, string_split(path, '/')[-1] AS name, regexp_replace(string_split(path, '/')[-1], '(?i)\\.md$', '') AS stem FROM docs))"""
DATA_DIRS = ("en", "de")
VENDORED = ("fr",)


@query(f"""SELECT project, skip_reason, count(*) AS n FROM (SELECT project, CASE WHEN len(list_filter(dirs, lambda s: s IN {DATA_DIRS} OR s LIKE 'raw\\_%' ESCAPE '\\' OR s LIKE '%\\_files' ESCAPE '\\')) > 0 THEN 'data_dir'
  WHEN list_contains(dirs, 'fr') THEN 'vendored' WHEN git_status = 'ignored' THEN 'gitignored' END AS skip_reason
  FROM (SELECT *, string_split(path, '/')[1:-2] AS dirs FROM files)) GROUP BY ALL""")
def flt_scope(t):
    return derive.scope(t.files, data_dirs=DATA_DIRS, vendored=VENDORED).groupBy("project", "skip_reason").agg(F.count("*").alias("n"))


@query("SELECT thread_id, account, title FROM threads WHERE account LIKE '%-personal'")
def flt_wall(t):
    return derive.wall(t.threads, "personal").select("thread_id", "account", "title")


@query("""SELECT t.thread_id, coalesce(n, 0) AS n_messages, coalesce(n, 0) >= 4 AS substantive FROM threads t
  LEFT JOIN (SELECT thread_id, count(*) AS n FROM messages GROUP BY 1) m USING (thread_id)""")
def flt_substantive(t):
    return derive.substantive(t.threads, t.messages).select("thread_id", "n_messages", "substantive")


@query("""SELECT thread_id, 'close_suggestion' AS type, floor((epoch(TIMESTAMP '2024-12-01') - epoch(updated_at)) / 86400.0)::BIGINT AS idle_days FROM threads
  WHERE status = 'open' AND NOT suggested_close AND (epoch(TIMESTAMP '2024-12-01') - epoch(updated_at)) / 86400.0 >= 30""")
def flt_stale_close(t):
    return derive.stale_close(t.threads, "2024-12-01")


@query("""SELECT thread_id, (epoch(TIMESTAMP '2024-06-01') - epoch(updated_at))::BIGINT AS age_s,
  CASE WHEN updated_at IS NULL THEN 'MISSING' WHEN epoch(TIMESTAMP '2024-06-01') - epoch(updated_at) > 86400 THEN 'STALE' ELSE 'FRESH' END AS state FROM threads""")
def flt_freshness(t):
    return derive.freshness(t.threads.withColumnRenamed("updated_at", "generated_at"), "2024-06-01").select("thread_id", "age_s", "state")


@query("SELECT project_confidence, count(*) AS n FROM (SELECT nullif(project_confidence, 'none') AS project_confidence FROM threads) GROUP BY 1")
def flt_account_confidence_norm(t):
    return derive.normalise_confidence(t.threads).groupBy("project_confidence").agg(F.count("*").alias("n"))


@query(f"WITH {CENSUS} SELECT path, doc_type FROM census")
def prj_doc_type(t):
    return t.docs.select("path", derive.doc_type(F.col("path")).alias("doc_type"))


@query(f"WITH {CENSUS} SELECT path, provenance FROM census")
def prj_provenance(t):
    return t.docs.select("path", derive.provenance(F.col("path")).alias("provenance"))


@query("""WITH x AS (SELECT project, path, substr(sha256(project || chr(0) || path), 1, 16) AS stable_id FROM docs WHERE NOT path LIKE '/%')
  SELECT project, path, stable_id, count(DISTINCT path) OVER (PARTITION BY stable_id) > 1 AS collides FROM x""")
def prj_doc_id(t):
    return derive.doc_ids(t.docs).select("project", "path", "stable_id", "collides")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(detail)), '\\.[a-z0-9]{1,8}$', ''), '[-_ \\t\\n./\\\\]+', '', 'g') AS origin
  FROM (SELECT p_partkey, p_name AS detail FROM part)""")
def prj_origin_key(t):
    detail = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "@title").otherwise("@content"))
    return t.part.select("p_partkey", derive.evidence_origin(F.lit("name_alias"), detail).alias("origin"))


@query("SELECT conv_id, turn, trim(regexp_replace(translate(replace(lower(nfc_normalize(text || CASE WHEN turn % 2 = 0 THEN ' fi 12' ELSE ' “Straße”' END)), 'ß', 'ss'), '‘’“”–— ', '''''\"\"-- '), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS norm FROM conversations")
def prj_text_norm(t):
    # a ligature and full-width digits on one half, quotes and a sharp s on the other
    more = F.when(F.col("turn") % 2 == 0, " \ufb01 \uff11\uff12").otherwise(" “Straße”")
    return t.conversations.select("conv_id", "turn", derive.normal_text(F.concat("text", more)).alias("norm"))


@query("""WITH ign AS (SELECT DISTINCT project, path FROM files WHERE git_status = 'ignored'), dirs AS (SELECT DISTINCT project, string_split(path, '/')[1] AS d FROM files WHERE file_id % 50 = 3)
  SELECT DISTINCT f.project, f.path, CASE WHEN f2.path IS NOT NULL THEN 'tracked' WHEN i.path IS NOT NULL OR d.d IS NOT NULL THEN 'ignored' ELSE 'untracked' END AS status
  FROM files f LEFT JOIN (SELECT DISTINCT project, path FROM files WHERE git_status = 'tracked') f2 ON f.project = f2.project AND f.path = f2.path
  LEFT JOIN ign i ON f.project = i.project AND f.path = i.path LEFT JOIN dirs d ON f.project = d.project AND string_split(f.path, '/')[1] = d.d""")
def prj_git_status(t):
    files = t.files
    one = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    ignored = files.where("git_status = 'ignored'").select("project", "path").union(files.where("file_id % 50 = 3").select("project", one))
    return derive.git_status(files.select("project", "path").distinct(), files.where("git_status = 'tracked'"), ignored).select("project", "path", "status")


@query("""WITH r AS (SELECT project, md5(concat_ws('|', path, bytes::VARCHAR)) AS h FROM files)
  SELECT project, concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR,
  sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR) AS signature, count(*) AS n_files FROM r GROUP BY 1""")
def prj_signature(t):
    return derive.signature(t.files, ["project"], ["path", "bytes"])


@query("SELECT p_partkey, sha256('brand=' || p_brand || chr(10) || 'size=' || p_size::VARCHAR || chr(10) || 'type=' || p_type) AS fingerprint FROM part")
def prj_config_fingerprint(t):
    return t.part.select("p_partkey", derive.config_fingerprint({"type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("fingerprint"))


@query(f"""WITH {CENSUS} SELECT project, count(*) AS docs, sum(words)::BIGINT AS words, count_if(provenance = 'authored')::BIGINT AS authored,
  count_if(provenance = 'authored' AND doc_type <> 'unclassified')::BIGINT AS classified,
  round(100.0::DOUBLE * count_if(provenance = 'authored' AND doc_type <> 'unclassified') / nullif(count_if(provenance = 'authored'), 0), 4) AS classified_pct FROM census GROUP BY 1""")
def ag_doc_census(t):
    return census.doc_tally(census.doc_census(t.docs))


@query("""WITH n AS (SELECT project, count(*) AS n FROM docs GROUP BY 1), s AS (SELECT median(n) AS median_n, count(*) AS c FROM n)
  SELECT project, n, median_n FROM n, s WHERE c >= 3 AND n > 1.05 * median_n""")
def ag_out_of_band(t):
    return census.out_of_band(t.docs.groupBy("project").agg(F.count("*").alias("n")), factor=1.05)


ALIASES = {"1-URGENT": "urgent", "2-HIGH": "urgent", "3-MEDIUM": "normal"}


@query("""SELECT project, CASE author WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent' WHEN '3-MEDIUM' THEN 'normal' ELSE author END AS by, count(*) AS n FROM commits GROUP BY 1, 2""")
def ag_commit_ledger(t):
    return census.commit_ledger(t.commits, F.coalesce(core.mapping(ALIASES)[F.col("author")], F.col("author")))[0]


@query("SELECT project, ts::DATE::VARCHAR AS day, count(*) AS n FROM commits GROUP BY 1, 2", name="ag_commit_ledger_days")
def ag_commit_ledger_days(t):
    return census.commit_days(t.commits).withColumn("day", F.col("day").cast("string"))


@query("""SELECT project, hash, true_count, true_count > 20 AS truncated FROM (SELECT project, hash, count(*) OVER (PARTITION BY project) AS true_count,
  row_number() OVER (PARTITION BY project ORDER BY ts DESC, hash) AS rn FROM commits) WHERE rn <= 20""")
def ag_commit_ledger_newest(t):
    return census.commit_ledger(t.commits, F.col("author"), cap=20)[1].select("project", "hash", "true_count", "truncated")


@query("""SELECT c.project, coalesce(a.name, c.author) AS author, count(*) AS n FROM commits c LEFT JOIN (VALUES ('1-urgent', 'Ada'), ('5-low', 'Lin')) a(k, name) ON lower(c.author) = a.k GROUP BY 1, 2""")
def jn_author_fold(t):
    from ..operators.joins import author_fold

    aliases = t.spark.createDataFrame([("1-urgent", "Ada"), ("5-low", "Lin")], "alias string, name string")
    return author_fold(t.commits, aliases).groupBy("project", "author").agg(F.count("*").alias("n"))


SUMMARY = """sm AS (SELECT project, max_by(hash, (ts, hash)) AS latest_hash, max(ts)::DATE::VARCHAR AS latest, min(ts)::DATE::VARCHAR AS first, count(*) AS n FROM commits GROUP BY 1),
  dt AS (SELECT 'c' || (s_suppkey % 60)::VARCHAR AS project, count_if(s_suppkey % 3 = 0)::BIGINT AS dirty FROM supplier GROUP BY 1), sd AS (SELECT sm.*, coalesce(dirty, 0) AS dirty FROM sm LEFT JOIN dt USING (project))"""


def summary(t):
    files = t.supplier.select(F.concat(F.lit("c"), (F.col("s_suppkey") % 60).cast("string")).alias("project"), F.col("s_name").alias("path"), (F.col("s_suppkey") % 3 == 0).alias("dirty"))
    return census.repo_summary(t.commits, files)


@query(f"WITH {SUMMARY} SELECT * FROM sd")
def ag_repo_summary(t):
    return summary(t)


@query(f"WITH {SUMMARY} SELECT count(*) AS projects, sum(n)::BIGINT AS commits, sum(dirty)::BIGINT AS dirty, count_if(dirty > 0)::BIGINT AS dirty_projects, max(latest) AS latest FROM sd", name="ag_repo_summary_totals")
def ag_repo_summary_totals(t):
    return census.estate_totals(summary(t))


MARKERS = ("the", "der", "License")


@query(f"""WITH l AS (SELECT project, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM docs),
  h AS (SELECT *, regexp_extract(line, '\\b({"|".join(MARKERS)})\\b', 1) AS tag FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path, line_no, line) AS rn,
  count(*) OVER (PARTITION BY project) AS true_count FROM h WHERE tag <> '') SELECT project, tag, count(*) AS n, max(true_count) AS true_count FROM k WHERE rn <= 500 GROUP BY 1, 2""")
def ag_marker_census(t):
    return census.marker_census(t.docs, MARKERS).groupBy("project", "tag").agg(F.count("*").alias("n"), F.max("true_count").alias("true_count"))


@query("""SELECT project, path, git_status, len(regexp_extract_all(coalesce(content, ''), 'password=|AKIA|/the'))::BIGINT AS suspicious, CASE git_status WHEN 'tracked' THEN 0 WHEN 'untracked' THEN 1 ELSE 2 END AS rank
  FROM files WHERE NOT regexp_matches(path, '(?i)(example|sample|template)') AND (len(regexp_extract_all(coalesce(content, ''), 'password=|AKIA|/the')) > 0 OR regexp_matches(path, '(?i)(^|/)(credentials|secrets?|id_rsa|\\.env)[^/]*$'))""")
def ag_secret_suspects(t):
    return census.secret_suspects(t.files, "password=|AKIA|/the").drop("credential_file")


@query("""SELECT project, vendored, large, has_ignore, concat_ws(',', CASE WHEN vendored > 0 THEN 'tracked_vendored' END, CASE WHEN large > 0 THEN 'large_files' END, CASE WHEN NOT has_ignore THEN 'no_ignore_file' END) AS flags
  FROM (SELECT project, count_if(git_status = 'tracked' AND list_contains(string_split(path, '/'), 'fr'))::BIGINT AS vendored, count_if(bytes >= 5000)::BIGINT AS large, max(path = '.gitignore') AS has_ignore FROM files GROUP BY 1)""")
def ag_bloat_audit(t):
    return census.bloat_audit(t.files, VENDORED, 5000)


@query("""SELECT digest, count(*) AS files, count(DISTINCT project) AS projects FROM (SELECT project, sha1(content) AS digest FROM docs) GROUP BY 1 HAVING count(DISTINCT project) >= 2""")
def ag_duplicates(t):
    return census.duplicate_content(t.docs.withColumn("digest", F.sha1("content")))


@query("""WITH o AS (SELECT name, project, arg_min(d, path) AS d FROM (SELECT project, path, string_split(path, '/')[-1] AS name, CASE WHEN doc_id % 10 <> 1 THEN md5(bytes::VARCHAR) END AS d FROM
  (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY doc_id) AS rn FROM docs) WHERE rn = 1) GROUP BY 1, 2)
  SELECT name, count(*) AS projects, CASE WHEN count(DISTINCT d) = 1 AND NOT bool_or(d IS NULL) THEN 'identical' ELSE 'divergent' END AS verdict FROM o GROUP BY 1 HAVING count(*) >= 2""")
def ag_duplicates_names(t):
    one = core.latest(t.docs, ["project", "path"], [F.col("doc_id")])
    digest = F.when(F.col("doc_id") % 10 != 1, F.md5(F.col("bytes").cast("string")))
    return census.duplicate_names(one.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("digest", digest))


@query("""WITH r AS (SELECT r_name AS scope FROM region WHERE r_regionkey < 4), p AS (SELECT r_name AS scope, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1 GROUP BY 1)
  SELECT coalesce(r.scope, p.scope) AS scope, r.scope IS NOT NULL AS declared, coalesce(n, 0) AS n FROM r FULL JOIN p ON r.scope = p.scope""")
def ag_scope_summary(t):
    projects = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey <> 1").select(F.col("r_name").alias("scope"))
    return census.scope_summary(t.region.where("r_regionkey < 4").select(F.col("r_name").alias("scope")), projects)


@query("SELECT file_id, bytes AS size, CASE WHEN bytes > 6000 THEN 'oversized' ELSE 'truncated' END AS reason FROM files WHERE bytes > 6000 OR file_id % 37 = 0")
def ag_payload_audit(t):
    return census.payload_audit(t.files.select("file_id", F.col("bytes").alias("size"), (F.col("file_id") % 37 == 0).alias("truncated")), 6000).select("file_id", "size", "reason")


@query("""WITH p AS (SELECT project, min(ts)::DATE AS f, max(ts)::DATE AS l, count(DISTINCT author) AS contributors FROM commits GROUP BY 1), a AS (SELECT min(f) AS lo, max(l) AS hi FROM p)
  SELECT project, f::VARCHAR AS first, l::VARCHAR AS last, (l - f)::BIGINT AS span_days, contributors, round(coalesce((f - lo)::DOUBLE / nullif(hi - lo, 0), 0), 6) AS "offset", round(coalesce((l - f)::DOUBLE / nullif(hi - lo, 0), 0), 6) AS width FROM p, a""")
def ag_estate_timeline(t):
    return census.estate_timeline(t.commits)


RANKS = ("knowledge", "adr", "readme", "plan")


@query(f"""WITH {CENSUS} SELECT project, doc_type, count(*) AS n, min(path) AS first_path, CASE doc_type WHEN 'knowledge' THEN 0 WHEN 'adr' THEN 1 WHEN 'readme' THEN 2 WHEN 'plan' THEN 3 ELSE 4 END AS rank
  FROM census WHERE provenance = 'authored' GROUP BY 1, 2""")
def ag_doc_catalogue(t):
    return census.doc_catalogue(census.doc_census(t.docs), RANKS)


@query("""SELECT model_id, stage, cool_down, n, round(median, 6) AS median, round(v[round_even(0.25 * (n - 1), 0)::INT + 1], 6) AS p25, round(v[round_even(0.75 * (n - 1), 0)::INT + 1], 6) AS p75, round(v[1], 6) AS least, round(v[-1], 6) AS most
  FROM (SELECT model_id, stage, cool_down, count(*) AS n, median(ms) AS median, list_sort(list(ms)) AS v FROM ledger GROUP BY 1, 2, 3)""")
def ag_calibration(t):
    return census.calibration(t.ledger, ["model_id", "stage", "cool_down"], "ms")


@query("""SELECT model_id, stage, host, prompt, config, n, round(round(median, 6), 4) AS median, round(v[round_even(0.25 * (n - 1), 0)::INT + 1], 6) AS p25, round(v[round_even(0.75 * (n - 1), 0)::INT + 1], 6) AS p75, round(v[1], 6) AS least, round(v[-1], 6) AS most
  FROM (SELECT model_id, stage, host, pos % 3 AS prompt, pos % 2 AS config, count(*) AS n, median(ms) AS median, list_sort(list(ms)) AS v FROM ledger GROUP BY model_id, stage, host, pos % 3, pos % 2)""", name="ag_calibration_units")
def ag_calibration_units(t):
    return census.calibration(t.ledger.withColumn("prompt", F.col("pos") % 3).withColumn("config", F.col("pos") % 2), ["model_id", "stage", "host", "prompt", "config"], "ms").withColumn("median", F.round("median", 4))


@query("""SELECT pos, model_id, stage, floor(ms)::DOUBLE AS ms, CASE WHEN pos % 5 = 0 THEN NULL ELSE floor(ms / 2)::DOUBLE END AS tokens FROM ledger""")
def ag_timing_parse(t):
    line = F.format_string("model=%s stage=%s ms=%s tokens=%s", "model_id", "stage", F.floor("ms").cast("string"), F.when(F.col("pos") % 5 == 0, "unavailable").otherwise(F.floor(F.col("ms") / 2).cast("string")))
    return census.timing_parse(t.ledger.select("pos", line.alias("value")))


@query("SELECT thread_id, max(floor(length(content) / 4.0)::BIGINT) AS largest, max(floor(length(content) / 4.0)) > 150 AS excluded FROM messages GROUP BY 1")
def ag_oversized_filter(t):
    return census.oversized(t.messages, 150)


#: What stands in a word: letters, marks and digits of any script, as the two engines' own word boundaries do not agree on.
IN_WORD = r"[\p{L}\p{M}\p{N}_]"
MENTIONED = ("the", "der", "that", "with", "les", "que", "die")


@query(f"""WITH i AS (SELECT DISTINCT thread_id, id FROM (SELECT thread_id, unnest(regexp_extract_all(content, '{IN_WORD}+')) AS id FROM messages) WHERE id IN {MENTIONED})
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM i a JOIN i b USING (thread_id) WHERE a.id < b.id GROUP BY 1, 2""")
def ag_comention_pairs(t):
    return census.comention_pairs(t.messages, "thread_id", rf"(?<!{IN_WORD})({'|'.join(MENTIONED)})(?!{IN_WORD})")


FILES = """fi AS (SELECT project, path || CASE file_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' ELSE '' END AS path, bytes, git_status FROM files),
  fr AS (SELECT *, CASE WHEN len(list_filter(string_split(path, '/')[1:-2], lambda s: s IN ('node_modules', '.venv', 'venv', '__pycache__', '.git', 'dist', 'build', 'site-packages', 'vendor'))) > 0 THEN 'vendored' WHEN git_status = 'ignored' THEN 'ignored' END AS reason
  FROM (SELECT project, CASE WHEN bytes % 4 = 0 THEN 'vendor/' || path ELSE path END AS path, bytes, git_status FROM fi))"""


def manifest(t):
    k = F.col("file_id") % 3
    path = F.concat("path", F.when(k == 0, ".py").when(k == 1, ".MD").otherwise(""))
    return t.files.select("project", F.when(F.col("bytes") % 4 == 0, F.concat(F.lit("vendor/"), path)).otherwise(path).alias("path"), "bytes", "git_status")


@query(f"""WITH {FILES}, d AS (SELECT project, array_to_string(string_split(path, '/')[1:least(len(string_split(path, '/')) - 1, 4)], '/') AS folder, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, sum(bytes)::BIGINT AS b FROM fr WHERE reason IS NULL GROUP BY 1, 2, 3)
  SELECT project, folder, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, string_agg(ext || ':' || n::VARCHAR, ',' ORDER BY ext) AS extensions FROM d GROUP BY 1, 2""")
def ag_file_census(t):
    return census.file_census(manifest(t))


def tier_sql(where: str, name: str) -> str:
    return f"count_if({where})::BIGINT AS {name}_files, coalesce(sum(CASE WHEN {where} THEN bytes END), 0)::BIGINT AS {name}_bytes"


@query(f"""WITH {FILES} SELECT project, {tier_sql('reason IS NULL', 'working')}, {tier_sql("coalesce(reason = 'vendored', false)", 'vendored')}, {tier_sql("coalesce(reason = 'ignored', false)", 'ignored')}, {tier_sql("git_status = 'untracked'", 'risk')},
  count(*) AS files, sum(bytes)::BIGINT AS bytes FROM fr GROUP BY 1""", name="ag_file_census_tiers")
def ag_file_census_tiers(t):
    return census.file_tiers(manifest(t))


@query("SELECT coalesce(component, '(all)') AS component, files, bytes FROM (SELECT git_status AS component, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY ROLLUP (git_status))")
def ag_component_sizes(t):
    return census.component_sizes(t.files.withColumnRenamed("git_status", "component"))


# every third part's text says "import" in a docstring and a comment, every fourth goes on over lines, every eleventh has an open bracket
@query("""WITH x AS (SELECT DISTINCT p_partkey, unnest(list_filter([lower(p_brand[1:5]) || (p_size % 9)::VARCHAR, 'm' || (p_partkey % 13)::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'os' END, CASE WHEN p_partkey % 4 = 1 THEN 'json' END, CASE WHEN p_partkey % 4 = 1 THEN 'requests' END], lambda x: x IS NOT NULL)) AS name FROM part WHERE p_partkey % 11 > 0)
  SELECT name, count(*) AS n FROM x WHERE name NOT IN ('m1', 'm2', 'os', 'sys') GROUP BY 1 ORDER BY n DESC, name LIMIT 25""")
def ag_import_census(t):
    names = lambda *xs: t.spark.createDataFrame([(x,) for x in xs], "name string")
    k = F.col("p_partkey")
    first, second = F.concat(F.lower(F.substring("p_brand", 1, 5)), (F.col("p_size") % 9).cast("string")), F.concat(F.lit("m"), (k % 13).cast("string"))
    body = F.concat(
        F.when(k % 3 == 0, '"""Notes\nimport quoted\nit\'s here\n"""\n# import none\n').otherwise("x = 'import this, that'\n"),
        F.lit("import "), first, F.lit(".sub as x\nimport "), first, F.lit("\nfrom "), second, F.lit(".a import (\n    b,\n    c,\n)\n"),
        F.when(k % 2 == 0, "if x:\n    import os; y = 1\n").when(k % 4 == 1, "import json, \\\n    requests.adapters as r\n").otherwise("from .near import z\n"),
        F.when(k % 11 == 0, "f(1, [2\n").otherwise(""),
    )
    return source.import_census(core.spread(t.part).select(F.col("p_brand").alias("project"), k.alias("path"), body.alias("content")), names("m1", "m2"), names("os", "sys"))


def decision_logs(t):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "**Status:** CONFIRMED").when(k % 4 == 1, "Status: accepted").when(k % 4 == 2, "status = **Pending").otherwise("no word")
    entry = F.concat(F.lit("## "), k.cast("string"), F.lit(" — status: ASSUMED in the title\n"), status, F.lit("\n\n"))
    body = F.array_join(F.array_sort(F.collect_list(entry)), "")
    asked = F.concat(F.lit("# Notes\n## Open questions here\n"), F.repeat(F.lit("- item\n"), (F.count("*") % 3).cast("int")), F.lit("1. last\ntext\n# End\n- not one\n"))
    docs = t.orders.groupBy(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("project")).agg(body.alias("log"), asked.alias("notes"))
    return docs.select("project", F.lit("DECISIONS.md").alias("path"), F.concat(F.lit("# Log\nintro\n"), "log").alias("content")), docs.select("project", F.lit("notes.md").alias("path"), F.col("notes").alias("content"))


@query("""WITH e AS (SELECT 'p' || (o_custkey % 50)::VARCHAR AS project, CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'accepted' WHEN 2 THEN 'PENDING' ELSE 'other' END AS tier FROM orders),
  a AS (SELECT project, tier, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT project, 'PENDING', count(*) % 3 + 1 FROM e GROUP BY 1) SELECT project, tier, sum(n)::BIGINT AS n FROM a GROUP BY 1, 2""")
def ag_decision_records(t):
    return source.decision_tally(*decision_logs(t))


@query("SELECT o_clerk AS path, 'Use ' || o_clerk AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Accepted' END AS status FROM (SELECT o_orderkey, 'adr/' || o_orderkey::VARCHAR || '.md' AS o_clerk FROM orders)", name="ag_decision_records_documents")
def ag_decision_records_documents(t):
    path = F.concat(F.lit("adr/"), F.col("o_orderkey").cast("string"), F.lit(".md"))
    content = F.concat(F.lit("intro\n# Use "), path, F.lit("\n\n"), F.when(F.col("o_orderkey") % 3 == 0, "## Status\nnone\n").otherwise("**Status**: **Accepted** on Monday\n"))
    return source.decision_documents(t.orders.select(F.lit("p").alias("project"), path.alias("path"), content.alias("content"))).select("path", "title", "status")


@query("""SELECT 'm' || (o_custkey % 20)::VARCHAR AS project, o_orderkey::VARCHAR || '.py' AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'unparsed' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 13 > 0 THEN CASE o_orderstatus WHEN 'O' THEN 'log_' || lower(substr(o_orderpriority, 1, 1)) || ',orders' WHEN 'F' THEN 'parts' ELSE '' END END AS writes,
  CASE WHEN o_orderkey % 13 > 0 THEN CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN '7' ELSE '4,5' END END AS unresolved FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 5 > 0""")
def ag_write_targets(t):
    k = F.col("o_orderkey")
    both = F.concat(F.lit("    c.execute(\"update orders set a = 'delete from b'\")\n    c.executemany('INSERT OR IGNORE  INTO '\n        'log_"), F.lower(F.substring("o_orderpriority", 1, 1)), F.lit(" values (?)', rows)\n"))
    one = F.lit('    # c.execute("update none")\n    c.execute("""delete\n      from `parts`""")\n    c.execute(sql)\n')
    none = F.lit('    c.execute(f"update {name} set x = 1"); c.execute("select 1")\n    c.execute("update " + name)\n')
    body = F.when(F.col("o_orderstatus") == "O", both).when(F.col("o_orderstatus") == "F", one).otherwise(none)
    text = F.concat(F.lit('"""Docs: update this."""\n\ndef run(c, rows):\n'), F.when(k % 5 > 0, body).otherwise("    return 'update prose'\n"), F.when(k % 13 == 0, "x = 'open\n").otherwise(""))
    return source.write_targets(core.spread(t.orders).select(F.concat(F.lit("m"), (F.col("o_custkey") % 20).cast("string")).alias("project"), F.concat(k.cast("string"), F.lit(".py")).alias("path"), text.alias("content")))


CENSUS_OF = """SELECT 'confidence' AS kind, coalesce(project_confidence, 'none') AS key, count(*) AS n FROM {0} GROUP BY 2 UNION ALL SELECT 'linked', 'all', count(*) FROM {0} WHERE project_link IS NOT NULL HAVING count(*) > 0
  UNION ALL SELECT 'substantive', (thread_id % 2 = 0)::VARCHAR, count(*) FROM {0} GROUP BY 2 UNION ALL SELECT 'queue', type, count(*) FROM {1} GROUP BY 2"""


@query(f"""WITH fx AS (SELECT thread_id, CASE WHEN project_link IN (SELECT project_id FROM projects) THEN project_link END AS project_link, nullif(project_confidence, 'none') AS project_confidence FROM threads),
  q2 AS (SELECT type FROM queue UNION ALL SELECT 'orphan_link' FROM threads WHERE project_link IS NOT NULL AND project_link NOT IN (SELECT project_id FROM projects)), b AS ({CENSUS_OF.format('threads', 'queue')}), a AS ({CENSUS_OF.format('fx', 'q2')})
  SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.key, a.key) AS key, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM b FULL JOIN a ON b.kind = a.kind AND b.key = a.key""")
def ag_integrity_census(t):
    from ..operators.joins import orphan_links

    threads = t.threads.withColumn("substantive", F.col("thread_id") % 2 == 0)
    fixed, repairs = orphan_links(derive.normalise_confidence(threads), t.projects)
    census.must_be_empty(orphan_links(fixed, t.projects)[1], "links to no project")
    before = census.integrity_census(threads, t.queue)
    return census.integrity_change(before, census.integrity_census(fixed, t.queue.select("type").unionByName(repairs.select("type"))))


@query("""SELECT project, path, bytes FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY bytes DESC, path, file_id) AS rn FROM files) WHERE rn <= 20""")
def wn_topk_outliers(t):
    return core.capped(t.files, ["project"], [F.col("bytes").desc(), F.col("path"), F.col("file_id")], 20).select("project", "path", "bytes")


@query("""SELECT p_brand AS project, p_partkey AS path, CASE WHEN p_partkey % 7 > 1 THEN 1 END::BIGINT AS classes, CASE WHEN p_partkey % 7 > 1 THEN p_size % 5 END::BIGINT AS functions, CASE WHEN p_partkey % 7 > 1 THEN p_size % 3 END::BIGINT AS imports, p_partkey % 7 <= 1 AS failed FROM part""")
def ag_code_inventory(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    imports = F.when(size % 3 == 1, "import x.y, x\n").when(size % 3 == 2, "from .a import (b,\n  c)\nimport x, x.z as y\n").otherwise("# import x\n")
    body = F.concat(imports, F.lit('class A(B, metaclass=M):\n    """class of 99\n    def none(self): import y\n    """\n'), F.repeat(F.lit("    async def f(self, a={1: ')'}) -> list[int]:\n        return a  # def g(\n"), size % 5), F.when(k % 7 == 1, "class of 99\n").otherwise(""))
    return source.code_inventory(core.spread(t.part).select(F.col("p_brand").alias("project"), k.alias("path"), F.when(k % 7 > 0, body).alias("content")))
