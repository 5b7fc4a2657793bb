"""Filters, predicates and derived columns over files, documents and threads."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import days_between, first_match, origin_key, segments

# Directory names that hold data, vendored code or generated output, and document markers.
DATA_DIRS = ("chat_threads", "vault_staging", "Takeout", "raw_claude_files", "raw_gemini_files", "conversations")
VENDORED_DIRS = ("node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", "site-packages", "vendor")
GENERATED_DIRS = ("output", "logs", "AutoFiles")
TYPE_MARKERS = (
    ("decisions", "DECISIONS"), ("intent", "INTENT"), ("architecture", "ARCHITECTURE"), ("runbook", "RUNBOOK"), ("runbook", "PLAYBOOK"),
    ("uat", "UAT"), ("uat", "CHECKLIST"), ("plan", "PLAN"), ("plan", "STATUS"), ("brief", "BRIEF"), ("report", "REPORT"),
)


def skip_reason(path: Column, ignored: Column, data_dirs: Sequence[str] = DATA_DIRS, vendored: Sequence[str] = VENDORED_DIRS) -> Column:
    """Why a path is out of scope, the first reason in fixed order, or null."""
    dirs = F.slice(segments(path), 1, F.size(segments(path)) - 1)
    data = F.exists(dirs, lambda s: s.isin(*data_dirs) | s.startswith("raw_") | s.endswith("_files"))
    vend = F.exists(dirs, lambda s: s.isin(*vendored))
    return first_match([(data, "data_dir"), (vend, "vendored"), (ignored, "gitignored")])


def scope(files: DataFrame, **rules) -> DataFrame:
    """Files with their skip reason."""
    return files.withColumn("skip_reason", skip_reason(F.col("path"), F.col("git_status") == "ignored", **rules))


def wall(rows: DataFrame, estate: str, known: Sequence[str] = ("personal", "work")) -> DataFrame:
    """Rows of one declared estate by account suffix; any other estate is refused."""
    if estate not in known:
        raise ValueError(f"unknown estate {estate!r}")
    return rows.where(F.col("account").endswith(f"-{estate}"))


def substantive(threads: DataFrame, messages: DataFrame, least: int = 4) -> DataFrame:
    """Threads with their message count and whether it reaches ``least``."""
    n = messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"))
    out = threads.join(n, "thread_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return out.withColumn("substantive", F.col("n_messages") >= least)


def stale_close(threads: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Open threads idle for ``days`` or more and not yet flagged, as queue rows."""
    idle = days_between(F.lit(as_of).cast("timestamp"), F.col("updated_at"))
    return threads.where((F.col("status") == "open") & ~F.col("suggested_close") & (idle >= days)).select(
        "thread_id", F.lit("close_suggestion").alias("type"), F.floor(idle).alias("idle_days")
    )


def freshness(snapshots: DataFrame, as_of: str, limit_s: int = 86400) -> DataFrame:
    """Age of each snapshot and its state with a reason."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("generated_at")
    return snapshots.withColumn("age_s", age).withColumn(
        "state", first_match([(F.col("generated_at").isNull(), "MISSING"), (age > limit_s, "STALE")], "FRESH")
    )


def normalise_confidence(threads: DataFrame) -> DataFrame:
    """The legacy text ``none`` becomes null."""
    return threads.withColumn("project_confidence", F.nullif("project_confidence", F.lit("none")))


def doc_type(path: Column, markers: Sequence[tuple[str, str]] = TYPE_MARKERS) -> Column:
    """Document type from the path alone, first rule that holds."""
    parts = segments(path)
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?i)\.md$", "")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    rules = [
        (F.exists(dirs, lambda s: F.lower(s) == "adr"), "adr"),
        (F.lower(stem).contains("_knowledge"), "knowledge"),
        (F.lower(name) == "claude.md", "claude_md"),
        (F.lower(name).startswith("readme"), "readme"),
        (F.lower(name) == "glossary.md", "glossary"),
        *[(F.upper(stem).contains(mark), kind) for kind, mark in markers],
    ]
    return first_match(rules, "unclassified")


def provenance(path: Column, generated: Sequence[str] = GENERATED_DIRS) -> Column:
    """``generated`` if a segment starts with a dot or underscore or is a listed directory."""
    hit = F.exists(segments(path), lambda s: s.startswith(".") | s.startswith("_") | s.isin(*generated))
    return F.when(hit, "generated").otherwise("authored")


def doc_ids(docs: DataFrame) -> DataFrame:
    """Stable ids of relative paths; paths that leave the project are dropped; collisions are marked."""
    safe = docs.where(~F.col("path").startswith("/") & ~F.array_contains(segments(F.col("path")), ".."))
    out = safe.withColumn("stable_id", F.substring(F.sha2(F.concat("project", F.char(F.lit(0)), "path"), 256), 1, 16))
    paths = out.groupBy("stable_id").agg(F.count_distinct("project", "path").alias("n_paths"))
    return out.join(paths, "stable_id").withColumn("collides", F.col("n_paths") > 1)


def evidence_origin(signal: Column, detail: Column) -> Column:
    """Canonical key of what a signal names; an alias is the part before ``@``."""
    return origin_key(F.when(signal == "name_alias", F.split_part(detail, F.lit("@"), F.lit(1))).otherwise(detail))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility form (NFKC) without case distinctions."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def normal_text(text: Column) -> Column:
    """Compatibility form, curly quotes and dashes folded, white space collapsed, case folded."""
    folded = F.translate(compatible(text), "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(folded, r"[ \t\n\r\f]+", " "))


def git_status(files: DataFrame, tracked: DataFrame, ignored: DataFrame) -> DataFrame:
    """Status of each path: tracked, ignored (itself or a parent directory), else untracked."""
    parts = segments(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("project", "path", F.explode(prefixes).alias("prefix"))
    hit = up.join(ignored.select("project", F.col("path").alias("prefix")), ["project", "prefix"], "left_semi").select("project", "path").distinct()
    out = files.join(tracked.select("project", "path").distinct().withColumn("t", F.lit(True)), ["project", "path"], "left")
    out = out.join(hit.withColumn("i", F.lit(True)), ["project", "path"], "left")
    return out.withColumn("status", first_match([(F.col("t"), "tracked"), (F.col("i"), "ignored")], "untracked")).drop("t", "i")


def signature(files: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Digest of the sorted rows of each group and their true number.

    Row digests are combined without order, so a group of any size is summed
    on the map side and never gathered.
    """
    row = F.md5(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]))
    part = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("long"))
    return files.groupBy(*keys).agg(F.concat_ws("-", *[part(i).cast("string") for i in (1, 9, 17, 25)]).alias("signature"), F.count("*").alias("n_files"))


def config_fingerprint(settings: Mapping[str, Column]) -> Column:
    """Digest of settings in key order."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(settings[k].cast("string"), F.lit(""))) for k in sorted(settings)]), 256)
