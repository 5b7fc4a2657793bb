"""Aggregations and censuses over files, documents, commits and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import capped, first_match, median, order_statistics, segments, word_count
from .derive import VENDORED_DIRS, doc_type, provenance

CREDENTIAL_NAMES = r"(?i)(^|/)(credentials|secrets?|id_rsa|\.env)[^/]*$"


def doc_census(docs: DataFrame) -> DataFrame:
    """Each document with words, headings, title, type and provenance."""
    content = F.coalesce("content", F.lit(""))
    return docs.select(
        "project", "path", "bytes", word_count(content).alias("words"),
        F.regexp_count(content, F.lit(r"(?m)^#{1,6} ")).cast("long").alias("headings"),
        F.nullif(F.regexp_extract(content, r"(?m)^# (.+)$", 1), F.lit("")).alias("title"),
        doc_type(F.col("path")).alias("doc_type"), provenance(F.col("path")).alias("provenance"),
    )


def doc_tally(census: DataFrame) -> DataFrame:
    """Documents of each project by provenance, and the share of authored ones that have a type."""
    authored = F.col("provenance") == "authored"
    return census.groupBy("project").agg(
        F.count("*").alias("docs"), F.sum("words").alias("words"), F.count_if(authored).alias("authored"),
        F.count_if(authored & (F.col("doc_type") != "unclassified")).alias("classified"),
        F.round(F.try_divide(100.0 * F.count_if(authored & (F.col("doc_type") != "unclassified")), F.count_if(authored)), 4).alias("classified_pct"),
    )


def out_of_band(counts: DataFrame, factor: float = 3.0, least: int = 3) -> DataFrame:
    """Projects with more than ``factor`` times the median of documents, if at least ``least`` projects have any."""
    live = counts.where("n > 0")
    stats = live.agg(median("n").alias("median_n"), F.count("*").alias("projects"))
    return live.join(F.broadcast(stats)).where((F.col("projects") >= least) & (F.col("n") > factor * F.col("median_n"))).select("project", "n", "median_n")


def commit_ledger(commits: DataFrame, by: Column, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(commits per project and ``by``, newest ``cap`` commits of each project with the true count)."""
    counts = commits.groupBy("project", by.alias("by")).agg(F.count("*").alias("n"))
    newest = capped(commits, ["project"], [F.col("ts").desc(), F.col("hash")], cap)
    return counts, newest


def commit_days(commits: DataFrame) -> DataFrame:
    """Commits of each project and day."""
    return commits.groupBy("project", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def repo_summary(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per project: newest and first commit, their number, and the files (project, path, dirty) not committed."""
    per = commits.groupBy("project").agg(
        F.max_by("hash", F.struct("ts", "hash")).alias("latest_hash"), F.max("ts").cast("date").cast("string").alias("latest"),
        F.min("ts").cast("date").cast("string").alias("first"), F.count("*").alias("n"),
    )
    dirty = files.groupBy("project").agg(F.count_if("dirty").alias("dirty"))
    return per.join(dirty, "project", "left").withColumn("dirty", F.coalesce("dirty", F.lit(0)))


def estate_totals(summary: DataFrame) -> DataFrame:
    """All projects of a summary in one row."""
    return summary.agg(F.count("*").alias("projects"), F.sum("n").alias("commits"), F.sum("dirty").alias("dirty"), F.count_if(F.col("dirty") > 0).alias("dirty_projects"), F.max("latest").alias("latest"))


def marker_census(texts: DataFrame, tags: Sequence[str], cap: int = 500) -> DataFrame:
    """Lines that hold one of the marker words, at most ``cap`` a project with the true count."""
    lines = texts.select("project", "path", F.posexplode(F.split("content", "\n")).alias("line0", "line"))
    tag = F.regexp_extract("line", r"\b(" + "|".join(tags) + r")\b", 1)
    hits = lines.withColumn("tag", tag).where("tag <> ''").select("project", "path", (F.col("line0") + 1).alias("line_no"), "tag", "line")
    return capped(hits, ["project"], [F.col("path"), F.col("line_no"), F.col("line")], cap)


def secret_suspects(texts: DataFrame, suspicious: str, exempt: str = r"(?i)(example|sample|template)") -> DataFrame:
    """Files with suspicious lines, tracked ones first; example files are exempt."""
    n = F.regexp_count(F.coalesce("content", F.lit("")), F.lit(suspicious))
    rank = F.when(F.col("git_status") == "tracked", 0).when(F.col("git_status") == "untracked", 1).otherwise(2)
    return (
        texts.where(~F.col("path").rlike(exempt))
        .select("project", "path", "git_status", n.cast("long").alias("suspicious"), F.col("path").rlike(CREDENTIAL_NAMES).alias("credential_file"), rank.alias("rank"))
        .where("suspicious > 0 or credential_file")
    )


def bloat_audit(files: DataFrame, vendored: Sequence[str], large: int, ignore_file: str = ".gitignore") -> DataFrame:
    """Per project: tracked vendored files, large files, and the flags they raise."""
    tracked = F.col("git_status") == "tracked"
    vend = tracked & F.exists(segments(F.col("path")), lambda s: s.isin(*vendored))
    out = files.groupBy("project").agg(
        F.count_if(vend).alias("vendored"), F.count_if(F.col("bytes") >= large).alias("large"), F.max(F.coalesce(F.col("path") == ignore_file, F.lit(False))).alias("has_ignore")
    )
    flags = F.array_compact(F.array(F.when(F.col("vendored") > 0, "tracked_vendored"), F.when(F.col("large") > 0, "large_files"), F.when(~F.col("has_ignore"), "no_ignore_file")))
    return out.withColumn("flags", F.array_join(flags, ","))


def duplicate_content(files: DataFrame) -> DataFrame:
    """Digests that occur in two projects or more."""
    return (
        files.where("digest is not null").groupBy("digest").agg(F.count("*").alias("files"), F.count_distinct("project").alias("projects")).where("projects >= 2")
    )


def duplicate_names(files: DataFrame) -> DataFrame:
    """Names in two projects or more: identical if all their digests are known and agree."""
    one = files.groupBy("name", "project").agg(F.min_by("digest", "path").alias("digest"))
    return (
        one.groupBy("name")
        .agg(F.count("*").alias("projects"), F.count_distinct("digest").alias("digests"), F.bool_or(F.col("digest").isNull()).alias("unknown"))
        .where("projects >= 2")
        .select("name", "projects", F.when((F.col("digests") == 1) & ~F.col("unknown"), "identical").otherwise("divergent").alias("verdict"))
    )


def scope_summary(roots: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects per declared root, with empty roots and undeclared scopes."""
    n = projects.groupBy("scope").agg(F.count("*").alias("n"))
    return roots.withColumn("declared", F.lit(True)).join(n, "scope", "full").select("scope", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("n", F.lit(0)).alias("n"))


def payload_audit(payloads: DataFrame, limit: int) -> DataFrame:
    """Payloads beyond the size limit or marked truncated."""
    return payloads.where((F.col("size") > limit) | F.col("truncated")).withColumn("reason", F.when(F.col("size") > limit, "oversized").otherwise("truncated"))


def estate_timeline(commits: DataFrame) -> DataFrame:
    """First and last day of each project, and its place on the common axis."""
    day = F.to_date("ts")
    per = commits.groupBy("project").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct("author").alias("contributors"))
    axis = per.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    span = F.datediff("hi", "lo")
    return per.join(F.broadcast(axis)).select(
        "project", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.datediff("last", "first").cast("long").alias("span_days"), "contributors",
        F.round(F.coalesce(F.try_divide(F.datediff("first", "lo").cast("double"), span), F.lit(0.0)), 6).alias("offset"),
        F.round(F.coalesce(F.try_divide(F.datediff("last", "first").cast("double"), span), F.lit(0.0)), 6).alias("width"),
    )


def doc_catalogue(census: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Authored documents of each project and type, types in a fixed rank."""
    rank = first_match([(F.col("doc_type") == kind, i) for i, kind in enumerate(ranks)], len(ranks))
    return census.where("provenance = 'authored'").groupBy("project", "doc_type").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).withColumn("rank", rank)


def calibration(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, median, nearest-rank quartiles and range of a measurement; unmeasured rows do not count."""
    numbers = [F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "least", "most")]
    return order_statistics(rows, keys, value).select(*keys, "n", *numbers)


def timing_parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """``key=value`` lines as typed columns; ``None`` and ``unavailable`` are not measured."""
    get = lambda k: F.nullif(F.regexp_extract(value, rf"(?:^|\s){k}=([^\s]+)", 1), F.lit(""))
    num = lambda k: get(k).try_cast("double")
    return lines.select("pos", get("model").alias("model_id"), get("stage").alias("stage"), num("ms").alias("ms"), num("tokens").alias("tokens"))


def oversized(messages: DataFrame, budget: int) -> DataFrame:
    """Conversations with their largest message in tokens (four characters each) and whether it fits the budget."""
    size = F.floor(F.length("content") / 4)
    return messages.groupBy("thread_id").agg(F.max(size).alias("largest")).withColumn("excluded", F.col("largest") > budget)


def comention_pairs(texts: DataFrame, key: str, pattern: str) -> DataFrame:
    """Pairs of ids mentioned in the same unit, with the number of units."""
    ids = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("id")).distinct()
    return ids.alias("a").join(ids.alias("b"), key).where("a.id < b.id").groupBy(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).agg(F.count("*").alias("n"))


def file_census(files: DataFrame, depth: int = 4) -> DataFrame:
    """Files, bytes and extensions of each directory of the working set, directories below ``depth`` folded upward."""
    parts = segments(F.col("path"))
    folder = F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    per = files.where(mass_reason().isNull()).groupBy("project", folder.alias("folder"), ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    kinds = F.array_sort(F.collect_list(F.struct("ext", "n")))
    return per.groupBy("project", "folder").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.array_join(F.transform(kinds, lambda x: F.concat_ws(":", x["ext"], x["n"].cast("string"))), ",").alias("extensions"))


def mass_reason(vendored: Sequence[str] = VENDORED_DIRS) -> Column:
    """Why a file counts as mass: a vendored directory, else that it is ignored; null in the working set."""
    parts = segments(F.col("path"))
    return first_match([(F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda s: s.isin(*vendored)), "vendored"), (F.col("git_status") == "ignored", "ignored")])


def file_tiers(files: DataFrame) -> DataFrame:
    """Per project: files and bytes in the working set, in the mass by reason, in all, and those at risk (untracked and not ignored).

    The working set and the mass add up to all files.
    """
    r = files.withColumn("reason", mass_reason())
    n = lambda c, name: [F.count_if(c).alias(f"{name}_files"), F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).alias(f"{name}_bytes")]
    return r.groupBy("project").agg(
        *n(F.col("reason").isNull(), "working"), *n(F.coalesce(F.col("reason") == "vendored", F.lit(False)), "vendored"), *n(F.coalesce(F.col("reason") == "ignored", F.lit(False)), "ignored"),
        *n(F.col("git_status") == "untracked", "risk"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
    )


def component_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes per component and in all."""
    out = files.rollup("component").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.grouping("component").alias("g"))
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("component")).alias("component"), "files", "bytes")


def integrity_census(threads: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts of a store as (kind, key, n): threads by confidence, linked threads, the substantive flag, queue rows by type."""
    tally = lambda df, kind, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    linked = threads.where("project_link is not null")
    return reduce(DataFrame.unionByName, [tally(threads, "confidence", text("project_confidence")), tally(linked, "linked", F.lit("all")), tally(threads, "substantive", text("substantive")), tally(queue, "queue", text("type"))])


def integrity_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two censuses side by side, with the difference of each count."""
    b, a = before.withColumnRenamed("n", "n_before"), after.withColumnRenamed("n", "n_after")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return b.join(a, ["kind", "key"], "full").select("kind", "key", zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_after") - zero("n_before")).alias("change"))


def must_be_empty(rows: DataFrame, what: str) -> None:
    """The post-condition of a repair: an error tells how many rows are left."""
    left = rows.count()
    if left:
        raise ValueError(f"{left} rows left: {what}")
