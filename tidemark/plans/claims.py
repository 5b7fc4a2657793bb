"""Queries over texts: search, similarity, claims and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import spread
from ..operators import text as ops
from ..operators.search_index import SearchIndex, shards_for, with_snippets
from .catalog import query
from .flows import folder

TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"


def claims_of(t):
    return t.benchmark.select(F.col("item_id").alias("claim_id"), F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string")).alias("project"), F.col("item_id").alias("pos"), F.col("text").alias("claim"))


def typed(t):
    return t.docs.withColumn("doc_type", F.when(F.col("doc_id") % 7 == 0, "knowledge").otherwise("other"))


RANKED = f"""l AS (SELECT doc_id, project, CASE WHEN doc_id % 7 = 0 THEN 'knowledge' ELSE 'other' END AS doc_type, content, {TOK.format("content")} AS w FROM docs), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM l), q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format("text")}) AS term FROM benchmark),
  ix AS (SELECT doc_id, project, doc_type, len(w) AS n, unnest(w) AS term FROM l), tf AS (SELECT doc_id, project, doc_type, n, term, count(*) AS tf FROM ix WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT query_id, doc_id, project, doc_type, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)))), 4) AS score, list(term) AS terms FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def ranked_sql(where: str, k: int) -> str:
    return f"""WITH {RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_type <> 'knowledge', score DESC, doc_id) AS rank FROM s WHERE {where}),
  flat AS (SELECT doc_id, content, ' ' || regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ' AS f FROM l WHERE doc_id IN (SELECT doc_id FROM r WHERE rank <= {k})),
  p AS (SELECT r.*, content, list_min(list_filter(list_transform(terms, lambda x: instr(f, ' ' || x || ' ')), lambda i: i > 0)) AS pos FROM r JOIN flat USING (doc_id) WHERE rank <= {k})
  SELECT query_id, rank::INT AS rank, doc_id, doc_type, score, substring(content, greatest(pos - 90, 1), 180) AS snippet FROM p"""


_BUILT: dict[tuple[str, str], SearchIndex] = {}


def index_of(t, anew: bool = False) -> SearchIndex:
    """The index of a folder's documents: built once a session, a tenth of the documents from an older text that a second batch renews."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if anew or key not in _BUILT:
        index = SearchIndex(t.spark, folder(t, "index"), shards=shards_for(t.docs), blocks=1)
        old = F.col("doc_id") % 10 == 0
        docs = typed(t).select("doc_id", "project", "doc_type", "content")
        index.update(docs.withColumn("content", F.when(old, F.concat(F.lit("an older text, "), F.substring("content", 1, 200))).otherwise(F.col("content"))), "all")
        index.update(docs.where(old), "renewed")
        _BUILT[key] = index
    return _BUILT[key]


def asked(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('content')}) AS term FROM docs) GROUP BY 1", name="tx_index_build")
def tx_index_build(t):
    return index_of(t, anew=True).terms().select("term", "df")


@query(ranked_sql("true", 60))
def tx_ranked_search(t):
    return with_snippets(index_of(t).ask(asked(t)), t.docs)


@query(ranked_sql("project = 'src1'", 5), name="tx_ranked_search_project")
def tx_ranked_search_project(t):
    return with_snippets(index_of(t).ask(asked(t), k=5, project="src1"), t.docs)


HITS = "SELECT doc_id, ((length(lower(content)) - length(replace(lower(content), 'license', ''))) / 7)::BIGINT AS hits, substring(content, greatest(instr(lower(content), 'license') - 90, 1), 187) AS snippet FROM docs WHERE contains(lower(content), 'license')"


@query(HITS)
def tx_substring_search(t):
    return ops.substring_search(t.docs, "LICENSE")


@query(f"WITH h AS ({HITS}) SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id)::INT AS rank FROM h ORDER BY hits DESC, doc_id LIMIT 25", name="tx_substring_search_top")
def tx_substring_search_top(t):
    return ops.top_hits(ops.substring_search(t.docs, "LICENSE"), 25)


@query("""WITH n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS b, lower(trim(regexp_replace(substr(text, 11, 20), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS q FROM conversations)
  SELECT conv_id, turn, instr(b, q)::INT AS start, CASE WHEN instr(b, q) > 0 THEN instr(b, q) + length(q) ELSE 0 END::INT AS "end" FROM n""")
def tx_evidence_span(t):
    return ops.evidence_spans(t.conversations.select("conv_id", "turn", F.col("text").alias("body"), F.substring("text", 11, 20).alias("needle"))).select("conv_id", "turn", "start", "end")


@query(f"""WITH p AS (SELECT d.doc_id, b.item_id, list_distinct({TOK.format("b.text")}) AS x, {TOK.format("d.text")} AS y FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
  SELECT doc_id, item_id, round(len(list_intersect(x, y))::DOUBLE / len(x), 6) AS share FROM p""")
def tx_similarity(t):
    pairs = t.documents.join(t.benchmark.select("item_id", F.col("text").alias("claim")), F.col("doc_id") % 40 == F.col("item_id"))
    return pairs.select("doc_id", "item_id", ops.containment(ops.tokens("claim"), ops.tokens("text")).alias("share"))


@query()
def sc_shortlist(t):
    project = F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))
    return ops.shortlist(claims_of(t).select("claim_id", "claim", "project"), t.documents.select(F.col("doc_id").alias("chunk_id"), "text", project.alias("project")))


@query("""SELECT doc_id AS claim_id, CASE WHEN doc_id % 9 = 0 THEN 'malformed' WHEN m.seq IS NULL THEN 'wrong_index' WHEN NOT contains(m.content, CASE WHEN doc_id % 2 = 0 THEN substr(m.content, 3, 15) ELSE 'zz' || substr(m.content, 1, 4) END) THEN 'not_literal' ELSE 'kept' END AS reason
  FROM (SELECT doc_id, doc_id % 25 AS c, doc_id % 6 AS w FROM documents) d LEFT JOIN messages m ON m.thread_id = c AND m.seq = w""")
def sc_quote_verify(t):
    windows = t.messages.select(F.col("thread_id").alias("conversation_id"), F.col("seq").alias("window"), F.col("content").alias("text"))
    c = t.documents.select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 25).alias("conversation_id"), (F.col("doc_id") % 6).alias("window")).join(windows, ["conversation_id", "window"], "left")
    quote = F.when(F.col("claim_id") % 9 == 0, "").when(F.col("claim_id") % 2 == 0, F.substring("text", 3, 15)).otherwise(F.concat(F.lit("zz"), F.substring("text", 1, 4)))
    return ops.quote_verify(c.select("claim_id", "conversation_id", "window", F.coalesce(quote, F.lit("q")).alias("quote")), windows)


@query("SELECT doc_id, toxic = 1 AND doc_id % 4 > 0 AND (doc_id % 4 <> 3) AS confirmed FROM labels")
def sc_confirm_verify(t):
    k = F.col("doc_id") % 4
    rows = t.labels.select("doc_id", (F.col("toxic") == 1).alias("verdict"), F.when(k == 0, "").when(k == 3, "absent").otherwise("span").alias("span"), F.lit("a span here").alias("text"))
    return ops.confirm_verify(rows).select("doc_id", "confirmed")


@query()
def jn_fuzzy_title(t):
    names = t.messages.where("seq = 0").select(F.col("thread_id").alias("project_id"), F.substring("content", 5, 45).alias("name"))
    return ops.fuzzy_titles(t.threads, names)


@query()
def jn_skeleton_fuzzy(t):
    m = t.messages.withColumn("own", F.col("thread_id") * 1000 + F.col("seq"))
    pool = m.select(F.col("own").alias("pool_id"), "role", F.concat("content", F.lit(".")).alias("content"))
    return ops.fuzzy_skeleton(m.select(F.col("own").alias("skeleton_id"), F.col("thread_id").alias("conversation_id"), "role", "content"), pool)


@query()
def jn_pair_diff(t):
    ids = t.threads.select("thread_id")
    return ops.pair_diff(ids.select(F.col("thread_id").alias("l_id"), (F.col("thread_id") + 1).alias("r_id")), t.messages)


VOCABULARY = f"""x AS (SELECT project, unnest({TOK.format("content")}) AS term FROM docs), tf AS (SELECT project, term, count(*) AS tf FROM x GROUP BY 1, 2), n AS (SELECT count(DISTINCT project) AS n FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT project, term, round((1 + ln(tf)) * ln(n / df), 6) AS score, regexp_matches(term, '[0-9_]') AS code FROM tf JOIN df USING (term), n WHERE df <= greatest(n * 0.34, 1)),
  r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, term) AS rank, row_number() OVER (PARTITION BY project, code ORDER BY score DESC, term) AS cr FROM s),
  vo AS (SELECT project, term, score, code FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY (code AND cr <= 12) DESC, rank) AS slot FROM r) WHERE slot <= 50)"""


@query(f"WITH {VOCABULARY} SELECT * FROM vo")
def sc_vocab_fingerprint(t):
    return ops.vocabulary(t.docs)


@query(f"""WITH {VOCABULARY}, us AS (SELECT DISTINCT doc_id AS thread_id, unnest({TOK.format("content")}) AS term FROM docs)
  SELECT thread_id, project, term, 0.3::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, project ORDER BY score DESC, term) AS rn FROM us JOIN vo USING (term)) WHERE rn <= 3""")
def sc_vocab_votes(t):
    return ops.vocabulary_votes(t.docs.select(F.col("doc_id").alias("thread_id"), "content"), ops.vocabulary(t.docs))


@query(f"""WITH RECURSIVE i AS (SELECT 'a' || (conv_id % 3)::VARCHAR AS project, conv_id * 1000 + turn AS pos, conv_id AS c, list_distinct({TOK.format("text")}) AS w, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id * 1000 + turn) AS n FROM conversations),
  f AS (SELECT project, n, pos, c, pos AS leader, [{{'p': pos, 'w': w}}] AS ls FROM i WHERE n = 1 UNION ALL
    SELECT project, n, pos, c, coalesce(hit, pos), CASE WHEN hit IS NULL THEN list_append(ls, {{'p': pos, 'w': w}}) ELSE ls END
    FROM (SELECT i.*, f.ls, (list_filter(f.ls, lambda l: len(i.w) > 0 AND round(len(list_intersect(l.w, i.w))::DOUBLE / (len(l.w) + len(i.w) - len(list_intersect(l.w, i.w))), 6) >= 0.55)[1]).p AS hit FROM f JOIN i ON i.project = f.project AND i.n = f.n + 1)),
  g AS (SELECT project, leader, count(*) AS n, count(DISTINCT c) AS conversations FROM f GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY conversations DESC, leader)::INT AS rank FROM g) WHERE rank <= 10""")
def sc_recurrence_greedy(t):
    items = t.messages.select(F.concat(F.lit("a"), (F.col("thread_id") % 3).cast("string")).alias("project"), (F.col("thread_id") * 1000 + F.col("seq")).alias("pos"), F.col("thread_id").alias("conversation_id"), F.col("content").alias("text"))
    return ops.recurrence_leaders(items)


def lasting_sql(name: str, threshold: float) -> str:
    """Tables named after ``name``: the lasting groups of documents."""
    return f"""{name}e AS (SELECT a, b FROM pc WHERE score >= {threshold} UNION ALL SELECT b, a FROM pc WHERE score >= {threshold}),
  {name}r AS (SELECT DISTINCT a AS node, a AS m FROM {name}e UNION SELECT e.b, r.m FROM {name}r r JOIN {name}e e ON r.node = e.a AND r.m < e.b),
  {name}l AS (SELECT node, min(m) AS label FROM {name}r GROUP BY 1),
  {name} AS (SELECT label, count(*) AS size, count(DISTINCT text) AS texts, count(DISTINCT conversation_id) AS conversations, count(DISTINCT isoyear(day) * 100 + weekofyear(day)) AS weeks, min(day) AS first, max(day) AS last
    FROM it JOIN {name}l ON pos = node GROUP BY 1 HAVING count(DISTINCT conversation_id) >= 2 AND count(DISTINCT isoyear(day) * 100 + weekofyear(day)) >= 2)"""


ITEMS = f"""it AS (SELECT doc_id AS pos, doc_id % 97 AS conversation_id, DATE '2023-12-20' + (doc_id % 90)::INT AS day, text, list_distinct({TOK.format('text')}) AS w FROM documents WHERE len({TOK.format('text')}) > 0),
  wt AS (SELECT pos, len(w) AS n, hash(unnest(w)) AS t FROM it), pc AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS score FROM wt a JOIN wt b ON a.t = b.t AND a.pos < b.pos AND a.n <= 2.01 * b.n AND b.n <= 2.01 * a.n GROUP BY a.pos, b.pos, a.n, b.n HAVING count(*) * 3.01 >= a.n + b.n)"""


def dated_items(t):
    day = F.date_add(F.lit("2023-12-20").cast("date"), (F.col("doc_id") % 90).cast("int"))
    return t.documents.select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 97).alias("conversation_id"), day.alias("day"), "text")


@query(f"WITH RECURSIVE {ITEMS}, {lasting_sql('g', 0.7)} SELECT label, size, texts, conversations, weeks, first::VARCHAR AS first, last::VARCHAR AS last FROM g")
def sc_recurrence_components(t):
    items = dated_items(t)
    out = ops.recurrence_groups(items, ops.like_pairs(items, 0.7), conversations=2, weeks=2)
    return out.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query("WITH RECURSIVE " + ", ".join([ITEMS, *[lasting_sql(f"g{i}", x) for i, x in enumerate((0.5, 0.6, 0.7))]]) + " " + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS threshold, count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS items FROM g{i}" for i, x in enumerate((0.5, 0.6, 0.7))), name="sc_recurrence_components_sweep")
def sc_recurrence_components_sweep(t):
    return ops.recurrence_sweep(dated_items(t), conversations=2, weeks=2)


@query()
def sc_claim_match(t):
    c = claims_of(t)
    d = spread(t.documents.select("doc_id", F.lower("text").alias("text")))
    words = d.select("doc_id", F.explode(F.array_distinct(ops.shingles(ops.tokens("text"), 6))).alias("s"))
    mine = c.select("claim_id", "project", F.explode(F.array_distinct(ops.shingles(ops.tokens("claim"), 6))).alias("s"))
    hit = words.join(ops.beside(mine), "s").select("claim_id", "project", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("other")).distinct()
    # the pass over all texts is made once
    hit = ops.kept(hit)
    return ops.claim_outcomes(c, hit.where("project = other"), ops.claim_pairs(c), hit.where("project <> other"))


@query("""WITH o AS (SELECT item_id AS claim_id, 'p' || (item_id % 5)::VARCHAR AS project, CASE item_id % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'captured' ELSE 'superseded' END AS outcome, CASE WHEN item_id % 3 = 2 THEN item_id * 2 % 31 END AS days FROM benchmark),
  r AS (SELECT *, row_number() OVER (PARTITION BY project, outcome ORDER BY claim_id) AS rn FROM o WHERE project <> 'p4')
  SELECT project, outcome, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN claim_id::VARCHAR END, ',' ORDER BY claim_id) AS samples, min(days) AS least_days, max(days) AS most_days FROM r GROUP BY 1, 2""")
def ag_findings_sections(t):
    k = F.col("claim_id") % 3
    start = F.lit("2024-01-01").cast("date")
    newer = F.when(k == 2, F.date_add(start, (F.col("claim_id") * 2 % 31).cast("int")))
    out = claims_of(t).select("project", "claim_id", F.when(k == 0, "gap").when(k == 1, "captured").otherwise("superseded").alias("outcome"), start.alias("day"), newer.alias("newer_day"))
    return ops.findings(out, out.where("project <> 'p4'").select("project"))


@query("""SELECT (SELECT count(*) FROM documents) AS claims, (SELECT count_if(text LIKE '%password=%') FROM documents)::BIGINT AS rejected, (SELECT count(*) FROM customer) AS conversations, (SELECT count_if(c_custkey % 5 = 0) FROM customer)::BIGINT AS excluded,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unmapped, (SELECT count_if(n = 0) FROM (SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1))::BIGINT AS without_file,
  (SELECT round(count_if(text LIKE '%password=%') / count(*)::DOUBLE, 6) FROM documents) AS rejection_rate""")
def ag_run_health(t):
    conversations = t.customer.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 5 != 0, F.lit("2024-01-01").cast("timestamp")).alias("real_time"))
    projects = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("project")).agg(F.count("s_suppkey").alias("knowledge_files"))
    return ops.run_health(t.documents.select(F.coalesce(F.col("text").contains("password="), F.lit(False)).alias("rejected")), conversations, t.orders.select(F.col("o_custkey").alias("session_id")), projects)


@query("""WITH l AS (SELECT conv_id AS doc_id, turn, CASE turn % 3 WHEN 0 THEN '# ' || role ELSE CASE WHEN conv_id % 2 = 0 THEN '- [x] i' ELSE '- [ ] i' END || turn::VARCHAR || ' text' END AS line FROM conversations),
  s AS (SELECT *, last_value(nullif(regexp_extract(line, '^#+ (.+)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY turn) AS section, regexp_extract(line, '^- \\[[ xX]\\] (\\S+)', 1) AS item FROM l),
  r AS (SELECT 'i' || (event_id % 9)::VARCHAR AS item, max_by(event_type, event_id) AS verdict FROM events GROUP BY 1) SELECT doc_id, item, section, regexp_matches(line, '^- \\[[xX]\\]') AS ticked, verdict FROM s LEFT JOIN r USING (item) WHERE item <> ''""")
def ag_checklist_items(t):
    box = F.when(F.col("conv_id") % 2 == 0, "- [x] i").otherwise("- [ ] i")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# "), "role")).otherwise(F.concat(box, F.col("turn").cast("string"), F.lit(" text")))
    lines = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), line.alias("line"))
    return ops.checklist(lines, t.events.select(F.concat(F.lit("i"), (F.col("event_id") % 9).cast("string")).alias("item"), F.col("event_type").alias("verdict"), F.col("event_id").alias("pos")))


@query("""WITH n AS (SELECT CASE WHEN p_partkey % 10 = 9 THEN 'other' ELSE ['brief', 'report', 'results', 'walk'][p_partkey % 4 + 1] END AS role, CASE WHEN p_partkey % 10 = 9 THEN 'x' || p_partkey::VARCHAR || '.md' ELSE 's' || (p_size * 7 + p_partkey % 23)::VARCHAR END AS stem, p_partkey % 3 = 0 AS archived,
    p_partkey % 5 AS done, p_partkey % 3 AS open, p_partkey % 7 > 0 AS stamped, ['completed', 'superseded', 'never before seen'][p_size % 3 + 1] AS word FROM part),
  k AS (SELECT * FROM n WHERE archived OR role <> 'other'), sp AS (SELECT stem, count(DISTINCT archived) > 1 AS split FROM k GROUP BY 1),
  c AS (SELECT stem, archived, bool_or(role = 'brief') AS b, bool_or(role = 'report') AS r, bool_or(role = 'results') AS u, bool_or(role = 'walk') AS w, coalesce(sum(CASE WHEN role = 'walk' THEN done END), 0)::BIGINT AS done, coalesce(sum(CASE WHEN role = 'walk' THEN open END), 0)::BIGINT AS open,
    coalesce(sum(CASE WHEN role = 'results' THEN done END), 0) AS rd, count(DISTINCT CASE WHEN archived AND stamped THEN word END) AS words, any_value(CASE WHEN archived AND stamped THEN word END) AS word, count_if(archived AND NOT stamped) AS bare FROM k GROUP BY 1, 2)
  SELECT stem, archived, CASE WHEN b AND (r OR NOT archived) THEN 'pair' WHEN w AND NOT b AND (NOT r OR NOT archived) THEN 'walk_only' ELSE 'unmatched' END AS kind, CASE WHEN archived THEN 'archived' WHEN u THEN 'walked' WHEN r THEN 'built' ELSE 'in_flight' END AS "column",
    CASE WHEN words > 1 THEN 'mixed' ELSE word END AS disposition, done, open, concat_ws(',', CASE WHEN u AND done = 0 AND open > 0 AND rd > 0 THEN 'evidence_in_results' END, CASE WHEN words > 1 THEN 'mixed_disposition' END, CASE WHEN split THEN 'split_stem' END, CASE WHEN bare > 0 THEN 'unstamped' END) AS findings FROM c JOIN sp USING (stem)""")
def ag_lifecycle_board(t):
    k = F.col("p_partkey")
    stem = F.concat(F.lit("s"), (F.col("p_size") * 7 + k % 23).cast("string"))
    named = F.when(k % 4 == 0, F.concat(F.lit("BRIEF_"), stem, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("REPORT_"), stem, F.lit(".md"))).when(k % 4 == 2, F.concat(F.lit("UAT_"), stem, F.lit("_results.md"))).otherwise(F.concat(F.lit("UAT_"), stem, F.lit(".md")))
    name = F.when(k % 10 == 9, F.concat(F.lit("x"), k.cast("string"), F.lit(".md"))).otherwise(named)
    word = F.when(F.col("p_size") % 3 == 0, "Completed pair (sheet)").when(F.col("p_size") % 3 == 1, "superseded by a later one").otherwise("never before seen")
    content = F.concat(F.lit("# A card\n"), F.when(k % 7 > 0, F.concat(F.lit("> **ARCHIVED** 2024-02-03 · "), word, F.lit(" · whole\n"))).otherwise("ARCHIVED\n"), F.repeat(F.lit("- [x] a\n"), (k % 5).cast("int")), F.repeat(F.lit("  - [ ] b\n"), (k % 3).cast("int")))
    roles = {"brief": ("BRIEF_", ".md"), "report": ("REPORT_", ".md"), "results": ("UAT_", "_results.md"), "walk": ("UAT_", ".md")}
    return ops.lifecycle_board(t.part.select(name.alias("name"), (k % 3 == 0).alias("archived"), content.alias("content")), roles, ("completed", "superseded"))


@query("""WITH l AS (SELECT user_id AS host, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN '[2024] start ' || event_type ELSE '  more ' || event_type END AS value FROM events), r AS (SELECT *, sum(CASE WHEN value LIKE '[2024]%' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS record FROM l)
  SELECT host, record::BIGINT AS record, min(pos) AS pos, count(*) AS lines, string_agg(value, chr(10) ORDER BY pos) AS text FROM r WHERE record > 0 GROUP BY 1, 2""")
def ag_log_calls(t):
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[2024] start "), "event_type")).otherwise(F.concat(F.lit("  more "), "event_type"))
    return ops.log_calls(t.events.select(F.col("user_id").alias("host"), F.col("event_id").alias("pos"), value.alias("value")), r"^\[2024\]")


@query("""WITH l AS (SELECT user_id AS host, event_id AS pos, event_id % 3 = 0 AS starts, event_type, event_id % 11 = 0 AS load FROM events), r AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS record FROM l),
  g AS (SELECT host, record::BIGINT AS record, min(pos) AS pos, max(CASE WHEN starts THEN pos END)::DOUBLE AS ms, min(CASE WHEN NOT starts THEN pos END)::DOUBLE AS prompt_tokens, bool_or(event_type = 'error') AS error FROM r WHERE record > 0 GROUP BY 1, 2)
  SELECT g.host, g.record, g.pos, ms, prompt_tokens, NULL::DOUBLE AS completion_tokens, error, (SELECT count(*) FROM l WHERE load AND l.host = g.host AND l.pos < g.pos) AS loads_before FROM g""", name="ag_log_calls_requests")
def ag_log_calls_requests(t):
    id_ = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[2024] ms="), id_, F.lit(" "), "event_type")).otherwise(F.concat(F.lit("  prompt_tokens: "), id_, F.lit(" "), "event_type"))
    rows = t.events.select(F.col("user_id").alias("host"), F.col("event_id").alias("pos"), value.alias("value"))
    loads = t.events.where("event_id % 11 = 0").select(F.col("user_id").alias("host"), F.col("event_id").alias("pos"))
    return ops.log_requests(ops.log_calls(rows, r"^\[2024\]"), loads)


@query("SELECT item_id, text, length(text)::DOUBLE AS score FROM benchmark")
def ud_scorer_hook(t):
    return ops.score_with(t.benchmark, lambda pdf: pdf["text"].str.len().astype("float64"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN contains(p_type, 'STEEL') THEN 'steel' ELSE 'other' END AS kind FROM part")
def ud_rule_tables(t):
    from ..functions.core import first_match

    rules = t.spark.createDataFrame([(1, "p_size > 40", "large"), (2, "contains(p_type, 'STEEL')", "steel")], "rank int, rule string, kind string")
    chain = [(F.expr(r.rule), r.kind) for r in rules.orderBy("rank").collect()]
    return t.part.select("p_partkey", first_match(chain, "other").alias("kind"))
