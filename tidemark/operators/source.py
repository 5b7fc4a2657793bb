"""Statements, imports and write targets of Python source texts, and marks in lines of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of the language.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
).split()
#: Words that are keywords at the start of a statement only.
SOFT = ("match", "case", "type")
# Names of calls that run a statement, and of those that open a store.
RUN_CALLS = ("execute", "executemany", "executescript")
OPEN_CALLS = ("connect", "connect_readonly", "get_connection", "_connect")

MARK = re.compile(r"((?<!\w)[rRbBfFuU]{1,2})?(\"\"\"|'''|\"|')|#[^\n]*|\\\n|[()\[\]{}\n;:]")
PAIRS = {")": "(", "]": "[", "}": "{"}
CLOSING = {q: re.compile(r"\\.|" + q + ("" if len(q) == 3 else r"|\n"), re.DOTALL) for q in ('"""', "'''", '"', "'")}


def lex(text: str) -> Iterator[tuple[int, str, str, list[str], bool]]:
    """(line, code, what ends it, literals, broken) of each statement of a text, in order.

    Literals are taken out of the code, where ``"0"`` stands for the first of the
    statement, with its prefix; comments go, and lines are joined while a bracket
    is open or a backslash ends them. A text with an open literal or unmatched
    brackets ends with a broken statement.
    """
    code: list[str] = []
    literals: list[str] = []
    depth: list[str] = []
    at, line, begins = 0, 1, 1
    while found := MARK.search(text, at):
        code.append(text[at : found.start()])
        at, mark, quote = found.end(), found.group(), found.group(2)
        if quote:
            begun, closing = at, None
            for closing in CLOSING[quote].finditer(text, at):
                if closing.group()[0] != "\\":
                    break
                closing = None
            if closing is None or closing.group() != quote:
                yield begins, "".join(code), "", literals, True
                return
            body = text[begun : closing.start()]
            prefix = (found.group(1) or "").lower()
            if "f" in prefix:
                body = re.sub(r"\{\{|\}\}|\{[^{}]*\}", lambda m: m.group()[0] if m.group() in ("{{", "}}") else "{}", body)
            code.append(f'{prefix}"{len(literals)}"' + "\n" * body.count("\n") * bool(depth))
            literals.append(body)
            line, at = line + text.count("\n", found.start(), closing.end()), closing.end()
        elif mark[0] == "#":
            continue
        elif mark == "\\\n":
            code.append("\n" if depth else " ")
            line += 1
        elif mark in "([{":
            depth.append(mark)
            code.append(mark)
        elif mark in PAIRS:
            if not depth or depth.pop() != PAIRS[mark]:
                yield begins, "".join(code), "", literals, True
                return
            code.append(mark)
        else:
            line += mark == "\n"
            if depth:
                code.append(mark)
                continue
            if "".join(code).strip():
                yield begins, "".join(code).strip(), mark, literals, False
            code, literals, begins = [], [], line
            if mark != "\n":
                continue
            # a statement begins at its first character that is not blank
            blank = re.compile(r"[ \t\f\r\n]*").match(text, at)
            line += blank.group().count("\n")
            at, begins = blank.end(), line
    code.append(text[at:])
    yield begins, "".join(code).strip(), "", literals, bool(depth)


def statements(texts: DataFrame) -> DataFrame:
    """(project, path, line, code, ends, literals, broken) of all statements of source texts (project, path, content).

    A null text is broken. Every text has one row at least. Beside what the scan
    finds, a statement is broken if its class, function or import is malformed, or
    if two words stand side by side of which none is a keyword.
    """
    kinds = {f: texts.schema[f].dataType.simpleString() for f in ("project", "path")}

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch["content"].to_pylist()):
                rows = [(1, "", "", [], True)] if text is None else list(lex(text))
                line, code, ends, literals, broken = zip(*rows, strict=True)
                at = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch["project"].take(at), batch["path"].take(at), pa.array(line, pa.int32()), pa.array(code), pa.array(ends), pa.array(literals, pa.list_(pa.string())), pa.array(broken)],
                    ["project", "path", "line", "code", "ends", "literals", "broken"],
                )

    schema = f"project {kinds['project']}, path {kinds['path']}, line int, code string, ends string, literals array<string>, broken boolean"
    out = texts.select("project", "path", F.col("content").cast("string").alias("content")).mapInArrow(run, schema)
    word, keyword = r"[A-Za-z_]\w*", f"(?:{'|'.join(KEYWORDS)})\\b"
    side_by_side = rf"(?<![\w.])(?!{keyword})\w+[ \t]+(?!{keyword})\w"
    soft = rf"^(?:{'|'.join(SOFT)})[ \t]"
    shape = F.when(F.col("code").rlike(r"^class\b"), F.col("code").rlike(rf"(?s)^class\s+{word}\s*(?:\[.*\]\s*)?(?:\(.*\))?$") & (F.col("ends") == ":"))
    shape = shape.when(F.col("code").rlike(r"^(?:async\s+)?def\b"), F.col("code").rlike(rf"(?s)^(?:async\s+)?def\s+{word}\s*(?:\[.*\]\s*)?\(.*\)\s*(?:->.*)?$") & (F.col("ends") == ":"))
    shape = shape.when(F.col("code").rlike(r"^import\b"), F.col("code").rlike(rf"^import\s+{word}(?:\s*\.\s*{word})*(?:\s+as\s+{word})?(?:\s*,\s*{word}(?:\s*\.\s*{word})*(?:\s+as\s+{word})?)*$"))
    shape = shape.when(F.col("code").rlike(r"^from\b"), F.col("code").rlike(rf"(?s)^from\s*(?:\.\s*)*(?:{word}(?:\s*\.\s*{word})*)?\s*import\b\s*\S")).otherwise(True)
    # brackets and what they hold apart, words of one line are compared
    beside = F.col("code").rlike(side_by_side) & ~F.col("code").rlike(soft)
    return out.withColumn("broken", F.col("broken") | ~shape | beside)


def imports_of(parts: DataFrame) -> DataFrame:
    """(project, path, name, relative): top-level modules that a text's statements import, each once."""
    names = F.transform(F.split(F.regexp_replace("code", r"^import\s+", ""), ","), lambda x: F.struct(F.regexp_extract(F.trim(x), r"^\w+", 0).alias("name"), F.lit(False).alias("relative")))
    source = F.regexp_extract("code", r"^from\s*((?:\.\s*)*)(\w*)", 2)
    one = F.array(F.struct(source.alias("name"), F.col("code").rlike(r"^from\s*\.").alias("relative")))
    found = F.when(F.col("code").rlike(r"^import\b"), names).when(F.col("code").rlike(r"^from\b"), one)
    return parts.select("project", "path", F.inline(found)).where("name <> '' and not (relative and name = 'import')").distinct()


def sound(parts: DataFrame) -> DataFrame:
    """Texts (project, path) whose statements are all whole."""
    return parts.groupBy("project", "path").agg(F.bool_or("broken").alias("failed")).where("not failed").select("project", "path")


def import_census(texts: DataFrame, local: DataFrame, standard: DataFrame, cap: int = 25) -> DataFrame:
    """Top-level modules that source texts import, counted once a text, without the local and the standard ones (name).

    Texts that are broken, and imports relative to a package, do not count.
    """
    parts = statements(texts)
    names = imports_of(parts).where("not relative").select("project", "path", "name").distinct().join(sound(parts), ["project", "path"], "left_semi")
    n = names.join(local, "name", "left_anti").join(standard, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "name").limit(cap)


def code_inventory(texts: DataFrame) -> DataFrame:
    """Classes, functions and distinct imported modules of each source text; a broken text is kept as a failure without counts."""
    parts = statements(texts)
    is_ = lambda pattern: F.count_if(F.col("code").rlike(pattern))
    per = parts.groupBy("project", "path").agg(is_(r"^class\b").alias("classes"), is_(r"^(?:async\s+)?def\b").alias("functions"), F.bool_or("broken").alias("failed"))
    n = imports_of(parts).groupBy("project", "path").agg(F.count_distinct("name").alias("imports"))
    whole = lambda c: F.when(~F.col("failed"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return per.join(n, ["project", "path"], "left").select("project", "path", whole("classes"), whole("functions"), whole("imports"), "failed")


def write_targets(texts: DataFrame) -> DataFrame:
    """Tables that each source text changes, and the lines where that cannot be told: (project, path, status, writes, unresolved).

    Looks at the first argument of calls that run a statement. A literal tells
    its verb and table; a literal whose table is filled in, and any other
    argument, is unresolved; reads count nothing. Texts without a call that opens
    a store or runs a statement have no row; broken texts are ``unparsed``.
    """
    call = rf"(?<!\w)(?<!def )(?:{'|'.join(RUN_CALLS)})\("
    first = r"(?s)^\s*((?:[fru]{0,2}\"\d+\"\s*)+)(?:[,)]|$)"
    opens = F.col("code").rlike(rf"(?<!\w)(?<!def )(?:{'|'.join(RUN_CALLS + OPEN_CALLS)})\(")
    parts = statements(texts)
    calls = parts.where(F.col("code").rlike(call)).select("project", "path", "line", "literals", F.split("code", call).alias("s"))
    # what follows each call, and the line on which the call stands
    before = F.size(F.split(F.array_join(F.slice("s", F.lit(1), F.col("k")), ""), "\n")) - 1
    calls = calls.select("*", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("k")).select("project", "path", "literals", F.get("s", F.col("k")).alias("rest"), (F.col("line") + before).alias("line"))
    numbers = F.regexp_extract_all(F.regexp_extract("rest", first, 1), F.lit(r"\d+"), F.lit(0))
    text = F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda i: F.get("literals", i.cast("int"))), ""))
    said = F.regexp_replace(text, r"\s+", " ")
    asked = calls.where(~F.col("rest").rlike(r"^\s*\)")).select("project", "path", "line", said.alias("said"))
    verb = r"(?i)\b(?:insert(?: or \w+)? into|replace into|update|delete from)"
    table = F.nullif(F.regexp_extract("said", verb + r" [\"'`]?([A-Za-z_]\w*)", 1), F.lit(""))
    judged = asked.select("project", "path", "line", table.alias("table"), (F.col("said").isNull() | (table.isNull() & F.col("said").rlike(verb + r" \S*\{\}"))).alias("unresolved"))
    told = judged.groupBy("project", "path").agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("writes"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("unresolved"), F.col("line")))), ",").alias("unresolved"))
    per = parts.groupBy("project", "path").agg(F.bool_or("broken").alias("failed"), F.bool_or(opens).alias("opens")).where("failed or opens")
    whole = lambda c: F.when(~F.col("failed"), F.coalesce(F.col(c), F.lit(""))).alias(c)
    return per.join(told, ["project", "path"], "left").select("project", "path", F.when(F.col("failed"), "unparsed").otherwise("ok").alias("status"), whole("writes"), whole("unresolved"))


# Status words of decision logs and the tiers they count for.
TIERS = {"confirmed": "CONFIRMED", "assumed": "ASSUMED", "pending": "PENDING", "accepted": "accepted", "superseded": "superseded"}


def lines_of(docs: DataFrame) -> DataFrame:
    """(project, path, no, line, level, words): lines of documents, cut at blanks; headings have a level from 1 to 6, else 0."""
    cut = docs.select("project", "path", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    words = F.array_remove(F.split(F.translate("line", "\t\r", "  "), " "), "")
    marks = F.get("words", F.lit(0))
    level = F.when((F.translate(marks, "#", "") == "") & F.col("line").startswith("#") & F.length(marks).between(1, 6), F.length(marks)).otherwise(0)
    return cut.withColumn("words", words).withColumn("level", level)


def said_status(line: str) -> Column:
    """The word that follows "status" and a colon or equals sign in a line, stars aside; null if there is none."""
    after = F.slice(F.split(F.lower(F.translate(F.col(line), "*", "")), "status"), 2, 1 << 30)
    value = lambda x: F.when(F.substring(F.ltrim(x), 1, 1).isin(":", "="), F.nullif(F.regexp_extract(F.ltrim(F.substring(F.ltrim(x), 2, 1 << 30)), "^[a-z]+", 0), F.lit("")))
    return F.get(F.array_compact(F.transform(after, value)), F.lit(0))


def decision_entries(docs: DataFrame) -> DataFrame:
    """Numbered entries (``## 12``) of decision logs (project, path, content), each with its tier.

    The first status that is told below an entry's heading counts.
    """
    heading = F.regexp_extract(F.get("words", F.lit(1)), r"^\w+", 0)
    number = F.when(F.col("level") == 2, F.when(F.translate(heading, "0123456789", "") == "", heading).try_cast("long"))
    w = Window.partitionBy("project", "path").orderBy("no")
    entry = F.sum(F.col("number").isNotNull().cast("int")).over(w)
    rows = lines_of(docs).withColumn("number", number).withColumn("entry", entry).where("entry > 0")
    word = F.when(F.col("number").isNull(), said_status("line"))
    per = rows.withColumn("word", word).groupBy("project", "path", "entry").agg(F.max("number").alias("number"), F.min_by("word", F.when(F.col("word").isNotNull(), F.col("no"))).alias("word"))
    tier = F.coalesce(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])[F.coalesce("word", F.lit(""))], F.lit("other"))
    return per.select("project", "path", "number", tier.alias("tier"))


def open_questions(docs: DataFrame) -> DataFrame:
    """Sections headed "open questions" or "open decisions" (project, path, content), with their list items."""
    w = Window.partitionBy("project", "path").orderBy("no")
    word = lambda i: F.regexp_extract(F.lower(F.get("words", F.lit(i))), "^[a-z]+", 0)
    asks = (F.col("level") > 0) & (F.lower(F.get("words", F.lit(1))) == "open") & word(2).isin("questions", "decisions")
    rows = lines_of(docs).withColumn("asks", asks).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    first = F.get("words", F.lit(0))
    numbered = first.endswith(".") & (F.length(first) > 1) & (F.translate(first, "0123456789", "") == ".")
    item = (F.col("level") == 0) & (first.isin("-", "*", "+") | numbered) & (F.size("words") > 1)
    per = rows.groupBy("project", "path", "section").agg(F.bool_or("asks").alias("asks"), F.count_if(item).alias("items"))
    return per.where("asks").select("project", "path", "items")


def decision_tally(logs: DataFrame, docs: DataFrame) -> DataFrame:
    """Decisions per project and tier: entries of the logs, and the items of open questions in any document as PENDING."""
    n = decision_entries(logs).groupBy("project", "tier").agg(F.count("*").alias("n"))
    still = open_questions(docs).groupBy("project").agg(F.sum("items").alias("n")).where("n > 0").select("project", F.lit("PENDING").alias("tier"), "n")
    return n.unionByName(still).groupBy("project", "tier").agg(F.sum("n").alias("n"))


def decision_documents(docs: DataFrame) -> DataFrame:
    """Title and status of decision documents (project, path, content): the first heading of level 1, the first line that begins with "status"."""
    rows = lines_of(docs)
    title = F.when((F.col("level") == 1) & (F.size("words") > 1), F.trim(F.substring("line", 2, 1 << 30)))
    bare = F.translate("line", "*", "")
    status = F.when(F.lower(bare).startswith("status") & said_status("line").isNotNull(), F.regexp_extract(F.trim(F.substring(F.trim(F.substring(bare, 7, 1 << 30)), 2, 1 << 30)), "^[A-Za-z]+", 0))
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("no")))
    per = rows.withColumn("title", title).withColumn("status", status).groupBy("project", "path").agg(at("title").alias("title"), at("status").alias("status"))
    return per.select("project", "path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("status", F.lit("")).alias("status"))
