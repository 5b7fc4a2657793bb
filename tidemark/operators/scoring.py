"""Evidence scoring, link decisions and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import first_match, latest, order_statistics, zero_filled
from .graph import kept

# Weights and thresholds of a link decision.
CAP, AUTO, LEAD, SUGGEST, MIN_ORIGINS = 0.97, 0.90, 0.25, 0.60, 2
COUNT_CAPS = {"vocabulary": 3, "filename_xref": 3, "path_mention": 3}
SPECIFICITY = {"repo": 2, "project": 1, "program": 0}


def used_signals(evidence: DataFrame, caps: Mapping[str, int] = COUNT_CAPS) -> DataFrame:
    """The evidence that counts: the strongest signal per origin, and of these the strongest few per capped signal."""
    best = latest(evidence, ["thread_id", "project", "origin"], [F.col("weight").desc(), F.col("evidence_id")])
    rank = F.row_number().over(Window.partitionBy("thread_id", "project", "signal").orderBy(F.col("weight").desc(), "evidence_id"))
    limit = first_match([(F.col("signal") == s, n) for s, n in caps.items()], 1 << 30)
    return best.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


def combine(evidence: DataFrame, caps: Mapping[str, int] = COUNT_CAPS) -> DataFrame:
    """Score of each thread and project: the strongest signal per origin, the strongest few per capped signal, 1 - prod(1 - w)."""
    weight = F.least(F.coalesce("weight", F.lit(0.0)), F.lit(CAP))
    return used_signals(evidence, caps).groupBy("thread_id", "project").agg(F.round(1 - F.exp(F.sum(F.log1p(-weight))), 6).alias("score"), F.count_distinct("origin").alias("origins"))


def rank_candidates(scores: DataFrame, plausibility: DataFrame) -> DataFrame:
    """Scores times plausibility, ranked within each thread."""
    out = scores.join(plausibility, ["thread_id", "project"], "left").withColumn("adjusted", F.round(F.col("score") * F.coalesce("plausibility", F.lit(1.0)), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("adjusted").desc(), "project")))


def collapse_lineage(ranked: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates folded into the stronger of their lineage; on a tie the more specific tier stays.

    The fold runs inside one expression over the short list of a thread's candidates.
    """
    spec = first_match([(F.col("tier") == k, v) for k, v in SPECIFICITY.items()], -1)
    reg = registry.select(F.col("id").alias("project"), spec.alias("spec"), F.array_compact(F.array("id", "project", "program")).alias("line"))
    c = F.struct("rank", "project", "adjusted", "origins", F.coalesce("spec", F.lit(-1)).alias("spec"), F.coalesce("line", F.array("project")).alias("line"))
    lists = ranked.join(reg, "project", "left").groupBy("thread_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    related = "(array_contains(k.line, x.project) or array_contains(x.line, k.project))"
    kept = f"""aggregate(c, slice(c, 1, 0), (acc, x) -> if(exists(acc, k -> {related}),
      transform(acc, (k, i) -> if(i = array_position(transform(acc, k -> {related}), true) - 1 and abs(k.adjusted - x.adjusted) < 1e-9 and x.spec > k.spec, x, k)),
      concat(acc, array(x))))"""
    return lists.select("thread_id", F.posexplode(F.expr(kept)).alias("i", "k")).select("thread_id", (F.col("i") + 1).alias("rank"), "k.project", "k.adjusted", "k.origins")


def decide(threads: DataFrame, survivors: DataFrame, ruled: DataFrame, registry: DataFrame) -> DataFrame:
    """The decision for each thread that no human has ruled on."""
    one = survivors.where("rank = 1").select("thread_id", F.col("project").alias("best"), F.col("adjusted").alias("a1"), F.col("origins").alias("o1"))
    two = survivors.where("rank = 2").select("thread_id", F.col("project").alias("second"), F.col("adjusted").alias("a2"))
    parent = lambda n: registry.select(F.col("id").alias(n), F.col("project").alias(f"{n}_parent"))
    j = threads.join(ruled.select("thread_id").distinct(), "thread_id", "left_anti").join(one, "thread_id", "left").join(two, "thread_id", "left")
    j = j.join(parent("best"), "best", "left").join(parent("second"), "second", "left")
    lead = F.col("a1") - F.coalesce("a2", F.lit(0.0))
    same = F.coalesce(F.col("project_link") == F.col("best"), F.lit(False))
    fuzzy_elsewhere = (F.coalesce("project_confidence", F.lit("none")) == "fuzzy") & ~same
    rivals = (F.col("a1") >= SUGGEST) & (F.coalesce("a2", F.lit(0.0)) >= SUGGEST) & (lead < LEAD)
    sibling = F.coalesce((F.col("best_parent") == F.col("second_parent")) & ~F.col("best_parent").isin("") & (F.col("best_parent") != F.col("best")) & (F.col("best_parent") != F.col("second")), F.lit(False))
    strong = (F.col("a1") >= AUTO) & (lead >= LEAD)
    category = first_match(
        [
            (F.col("project_confidence").isin("manual", "exact", "evidence"), None),
            (F.col("best").isNull(), "none"),
            (rivals & sibling, "suggest"),
            (rivals, "ambiguous"),
            ((strong | (F.col("a1") >= SUGGEST)) & fuzzy_elsewhere, "downgrade"),
            (strong & (F.col("o1") >= MIN_ORIGINS), "auto_link"),
            (F.col("a1") >= SUGGEST, "suggest"),
        ],
        "none",
    )
    locked = F.concat(F.lit("skip_"), "project_confidence")
    target = F.when(rivals & sibling, F.col("best_parent")).otherwise(F.col("best"))
    out = j.withColumn("category", F.when(F.col("project_confidence").isin("manual", "exact", "evidence"), locked).otherwise(category))
    acts = F.col("category").isin("suggest", "ambiguous", "downgrade", "auto_link")
    rival = F.when(F.col("category") == "ambiguous", F.col("second"))
    return out.select("thread_id", "category", F.when(acts, target).alias("project"), F.when(acts, F.col("a1")).alias("adjusted"), rival.alias("rival"))


def winning_evidence(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The signals that count for each automatic link, as rows to be kept with it."""
    auto = decisions.where("category = 'auto_link'").select("thread_id", "project")
    return used_signals(evidence.join(auto, ["thread_id", "project"], "left_semi")).select("thread_id", "project", "evidence_id", "signal", "weight", "origin")


def apply_decisions(threads: DataFrame, decisions: DataFrame, queue: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads with automatic links and the ids of their evidence, the queue).

    A thread that is decided again loses its own pending rows first; an
    automatic link leaves a confirmed row, a proposal a pending one.
    """
    ids = winning_evidence(decisions, evidence).groupBy("thread_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("link_evidence_ids"))
    auto = decisions.where("category = 'auto_link'").select("thread_id", F.col("project").alias("new_link")).join(ids, "thread_id", "left")
    linked = F.col("new_link").isNotNull()
    updated = (
        threads.join(auto, "thread_id", "left")
        .withColumn("project_confidence", F.when(linked, "evidence").otherwise(F.col("project_confidence")))
        .withColumn("project_link", F.coalesce("new_link", "project_link"))
        .drop("new_link")
    )
    kinds = {"auto_link": "link_upgrade", "suggest": "project_link", "ambiguous": "link_ambiguous", "downgrade": "link_downgrade"}
    kind = first_match([(F.col("category") == k, v) for k, v in kinds.items()])
    status = F.when(F.col("category") == "auto_link", "confirmed").otherwise("pending")
    fresh = decisions.withColumn("type", kind).where("type is not null").select("thread_id", "type", F.col("project").alias("candidate_project"), F.col("rival").alias("rival_project"), status.alias("status"))
    own = (F.col("status") == "pending") & F.col("type").isin("project_link", "link_ambiguous", "link_downgrade")
    acted = decisions.where(F.col("category").isin(*kinds)).select("thread_id", F.lit(True).alias("acted"))
    kept = queue.join(acted, "thread_id", "left").where(~(own & F.coalesce("acted", F.lit(False)))).select("thread_id", "type", "candidate_project", "rival_project", "status")
    return updated, kept.unionByName(fresh)


def decision_report(decisions: DataFrame, samples: int = 15) -> DataFrame:
    """Decisions per category, with the ids of the first few threads of each, the strongest first."""
    w = Window.partitionBy("category").orderBy(F.coalesce("adjusted", F.lit(0.0)).desc(), "thread_id")
    ranked = decisions.withColumn("rn", F.row_number().over(w))
    few = F.sort_array(F.collect_list(F.when(F.col("rn") <= samples, F.struct("rn", "thread_id"))))
    return ranked.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.transform(few, lambda x: x["thread_id"].cast("string")), ",").alias("samples"))


def rollup_label(registry: DataFrame) -> DataFrame:
    """Breadcrumb of each entry: program > project > repository."""
    names = lambda n: registry.select(F.col("id").alias(n), F.col("canonical_name").alias(f"{n}_name"))
    out = registry.join(names("project"), "project", "left").join(names("program"), "program", "left")
    return out.select("id", F.concat_ws(" > ", "program_name", "project_name", "canonical_name").alias("label"))


def human_rulings(batch: DataFrame, threads: DataFrame, targets: DataFrame) -> DataFrame:
    """Each ruling (thread_id, project) with its result: ok, unknown_thread or unknown_project."""
    j = batch.join(threads.select("thread_id", F.lit(True).alias("t")).distinct(), "thread_id", "left").join(targets.select(F.col("id").alias("project"), F.lit(True).alias("p")).distinct(), "project", "left")
    return j.select("thread_id", "project", first_match([(F.col("t").isNull(), "unknown_thread"), (F.col("p").isNull(), "unknown_project")], "ok").alias("result"))


def apply_rulings(batch: DataFrame, threads: DataFrame, targets: DataFrame) -> DataFrame:
    """Threads with the valid rulings of a batch (pos, thread_id, project) as links by hand; of several the last holds."""
    valid = human_rulings(batch, threads, targets).where("result = 'ok'").select("thread_id", "project").distinct()
    last = batch.join(valid, ["thread_id", "project"], "left_semi").groupBy("thread_id").agg(F.max_by("project", "pos").alias("ruled"))
    out = threads.join(last, "thread_id", "left")
    return out.withColumn("project_confidence", F.when(F.col("ruled").isNotNull(), "manual").otherwise(F.col("project_confidence"))).withColumn("project_link", F.coalesce("ruled", "project_link")).drop("ruled")


def bulk_accept(queue: DataFrame, ruled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pending rows at or above a confidence on threads without a ruling, one audit row)."""
    rows = queue.where((F.col("status") == "pending") & (F.col("confidence") >= least)).join(ruled.select("thread_id").distinct(), "thread_id", "left_anti")
    return rows, rows.agg(F.count("*").alias("accepted"), F.count_distinct("thread_id").alias("threads"), F.round(F.min("confidence"), 6).alias("least"))


def note_backfill(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate and rival parsed from a note ``a vs b``, kept only if they are known."""
    one, two = F.regexp_extract("note", r"^(\S+)", 1), F.regexp_extract("note", r" vs (\S+)", 1)
    known = lambda n: targets.select(F.col("id").alias(n), F.lit(True).alias(f"{n}_known")).distinct()
    j = queue.select("item_id", one.alias("candidate"), F.nullif(two, F.lit("")).alias("rival")).join(known("candidate"), "candidate", "left").join(known("rival"), "rival", "left")
    return j.select(
        "item_id", F.when(F.col("candidate_known"), F.col("candidate")).alias("candidate"), F.when(F.col("rival_known"), F.col("rival")).alias("rival"),
        (F.col("candidate_known").isNull() | (F.col("rival").isNotNull() & F.col("rival_known").isNull())).alias("unresolved"),
    )


def blast_hits(texts: DataFrame, rules: Sequence[tuple[str, str, str]], gate: str, prod: str, sandbox: str, target: str) -> DataFrame:
    """Lines that meet one of the rules (family, kind, pattern), the first rule of each line, with their rank.

    Writes in a file with a gate marker are guarded; the environment is read
    from the target on the line, and an unknown one ranks like production.
    """
    lines = texts.select("project", "path", F.col("content").rlike(gate).alias("guarded"), F.explode(F.split("content", "\n")).alias("line"))
    hit = F.coalesce(*[F.when(F.col("line").rlike(pattern), F.struct(F.lit(family).alias("family"), F.lit(kind).alias("kind"))) for family, kind, pattern in rules])
    alias = F.regexp_extract("line", target, 1)
    env = first_match([(alias == "", "none"), (alias.rlike(prod), "prod"), (alias.rlike(sandbox), "sandbox")], "unknown")
    rank = first_match([(F.col("h.kind") == "read", 1), (F.col("guarded"), 2), (env.isin("prod", "unknown"), 4)], 3)
    return lines.withColumn("h", hit).where("h is not null").select("project", "path", "h.family", rank.alias("rank"))


def blast_tier(hits: DataFrame) -> DataFrame:
    """Tier of each project from its lines, with the number of lines and files."""
    top = hits.groupBy("project").agg(F.max("rank").alias("rank"), F.count("*").alias("hits"), F.count_distinct("path").alias("files"))
    names = F.array(*[F.lit(x) for x in ("none", "read-only", "guarded-write", "raw-write", "raw-write-prod")])
    return top.select("project", F.element_at(names, F.col("rank") + 1).alias("tier"), "hits", "files")


def blast_critical(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with unguarded writes that are not committed: ``changed`` has project, path and a two-letter status."""
    state = F.when(F.col("status") == "??", "untracked").otherwise("dirty")
    raw = hits.where("rank >= 3").groupBy("project", "path").agg(F.max("rank").alias("rank"))
    return raw.join(changed.select("project", "path", state.alias("state")), ["project", "path"])


def fail_taxonomy(failures: DataFrame, successes: int, limit: int) -> DataFrame:
    """Failures by kind (zero filled) and each kind's share of all attempts (null if there were none)."""
    text = F.lower(F.coalesce("message", F.lit("")))
    kind = first_match([
        (text.contains("context") | (F.col("tokens") > limit), "context_overflow"), (text.contains("timeout") | text.contains("timed out"), "timeout"),
        (text.contains("connection") | text.contains("refused"), "transport"),
    ], "unknown")
    counts = failures.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n"))
    attempts = failures.agg((F.count("*") + F.lit(successes)).alias("attempts"))
    return zero_filled(counts, "kind", ["context_overflow", "timeout", "transport", "unknown"]).join(F.broadcast(attempts)).select("kind", "n", F.round(F.try_divide("n", "attempts"), 6).alias("rate"))


def compare_units(rows: DataFrame, unit: str, value: str, rejected: Column) -> DataFrame:
    """Pairs of units: too few rows, quartile ranges that overlap, or the faster one; and the share of each one's rows that is accepted."""
    # a row for each unit, read by both sides
    s = kept(order_statistics(rows, [unit], value).join(rows.groupBy(unit).agg(F.round(1 - F.avg(rejected.cast("int")), 6).alias("acceptance")), unit))
    a, b = s.select(*[F.col(c).alias(f"{c}_a") for c in s.columns]), s.select(*[F.col(c).alias(f"{c}_b") for c in s.columns])
    pairs = a.join(b, F.col(f"{unit}_a") < F.col(f"{unit}_b"))
    overlap = (F.col("p25_a") <= F.col("p75_b")) & (F.col("p25_b") <= F.col("p75_a"))
    verdict = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), "insufficient").when(overlap, "indistinguishable").when(F.col("median_a") < F.col("median_b"), F.col(f"{unit}_a")).otherwise(F.col(f"{unit}_b"))
    floor = F.round(F.try_divide(F.col("p75_a") - F.col("p25_a"), F.col("median_a")), 6)
    return pairs.select(F.col(f"{unit}_a").alias("unit_a"), F.col(f"{unit}_b").alias("unit_b"), verdict.alias("verdict"), floor.alias("floor_a"), "acceptance_a", "acceptance_b")


def rank_budget(candidates: DataFrame, group: str, order: Sequence[Column], budget: float, pause: float) -> DataFrame:
    """Candidates in rank order; the longest beginning whose cost, with a pause between, fits the budget is taken.

    A budget needs an estimate for every candidate; without one it is refused.
    """
    if candidates.where("cost is null").limit(1).count():
        raise ValueError("a budget needs the cost of every candidate")
    w = Window.partitionBy(group).orderBy(*order)
    total = F.sum("cost").over(w) + (F.row_number().over(w) - 1) * F.lit(pause)
    return candidates.withColumn("rank", F.row_number().over(w)).withColumn("total", F.round(total, 6)).withColumn("taken", F.max((total > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0)


def plan_candidates(claims: DataFrame, conversations: DataFrame, cache: DataFrame, ms_per_token: float) -> DataFrame:
    """Per project: claims, conversations, those changed since the cache, and their estimated milliseconds."""
    changed = conversations.join(cache, ["conversation_id", "signature"], "left_anti").groupBy("project").agg(F.count("*").alias("changed"), F.sum("tokens").alias("pending_tokens"))
    n = conversations.groupBy("project").agg(F.count("*").alias("conversations"))
    c = claims.groupBy("project").agg(F.count("*").alias("claims"))
    out = n.join(changed, "project", "left").join(c, "project", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out.select("project", "conversations", zero("changed"), zero("claims"), F.round(F.coalesce("pending_tokens", F.lit(0)) * ms_per_token, 3).alias("estimate_ms"))


def map_actions(rows: DataFrame, ratified: DataFrame) -> DataFrame:
    """The action offered for each candidate row (pos, session_id, status); what is ratified already is offered none."""
    done = ratified.select("session_id", F.lit(True).alias("done")).distinct()
    offered = {"matched": "ratify", "ambiguous-same-project": "ratify_pair", "ambiguous-different-project": "hand_map_or_leave"}
    already = F.coalesce("done", F.lit(False))
    action = first_match([(already, "none"), *[(F.col("status") == k, v) for k, v in offered.items()]], "hand_map_only")
    return rows.join(done, "session_id", "left").select("pos", action.alias("action"), already.alias("ratified"))


OUTCOMES = ("matched_by_pass1", "matched_by_pass2", "ambiguous_same_project", "ambiguous_different_project", "unmatched_sheet_rows", "unmapped_local_folders_on_disk")


def map_counts(rows: DataFrame, unmapped: DataFrame) -> DataFrame:
    """The six outcome counts (zero filled) of candidate rows (status, match_pass) and of folders without a row."""
    passed = lambda n: (F.col("status") == "matched") & (F.col("match_pass") == n)
    kinds = [passed("pass1"), passed("pass2"), *[F.col("status") == s for s in ("ambiguous-same-project", "ambiguous-different-project", "unmatched")]]
    outcome = first_match(list(zip(kinds, OUTCOMES, strict=False)))
    found = rows.select(outcome.alias("outcome")).unionByName(unmapped.select(F.lit(OUTCOMES[-1]).alias("outcome")))
    return zero_filled(found.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", OUTCOMES)


def unmapped_folders(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Conversations on disk (session_id, ts) that no candidate row names, with their messages and newest time."""
    left = conversations.join(rows.select("session_id").distinct(), "session_id", "left_anti")
    return left.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("ts").alias("newest"))
