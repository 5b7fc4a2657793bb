"""Operator 11 - secret scans by character Markov models (DataFrame functions only).

Three rules find credentials by their form (``assign``, ``access``, ``hex``).
Beside them, two first-order Markov models of characters tell random strings
from ordinary identifiers: a run of key characters is a secret (``markov``) if
the log of its likelihood as a random string over that as an identifier reaches
``least_score``. The models are learned from labelled samples: the values that
the rules find are random, other runs of the same documents are ordinary, also
joined to names as programs have them, and drawn digests (hex and base64) stand
for random strings that the corpus does not hold. Each counts once.

Scale: one map pass; no text is shuffled, and no row is matched with another.
The models are learned from at most ``max_docs`` documents (the smallest by the
digest of their id) and are a table of ``SYMBOLS ** 2`` whole numbers. Matches
get their places from the lengths of what lies between them, with running sums
in two levels, so that a text with very many matches stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords and forms of the three rules.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Characters of identifiers; symbol 0 stands for the place before the first and for padding.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SYMBOLS = len(ALPHABET) + 1
#: Pseudo-count of each pair of characters.
UNSEEN = 0.5
#: Matches whose lengths are added up together.
STRIDE = 128


def either_case(pattern: str) -> str:
    """ASCII letters of a pattern in either case, without other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def assign_pattern() -> str:
    return f"({'|'.join(map(either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"


def run_pattern(least: int) -> str:
    """Runs of identifier characters, with the padding that may end them."""
    return f"[A-Za-z0-9+/_-]{{{least},}}={{0,2}}"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numbers(values: list[int]) -> str:
    """SQL for a constant array, read from one literal."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<int>)"


def sums_before(sizes: str) -> str:
    """SQL: for each element of an array, the sum of all before it."""
    total = lambda part: f"aggregate({part}, 0L, (a, x) -> a + x)"
    strides = f"transform(sequence(0, int((size(s) - 1) div {STRIDE})), b -> {total(f'slice(s, b * {STRIDE} + 1, {STRIDE})')})"
    firsts = let("t", strides, f"transform(t, (_, b) -> {total('slice(t, 1, b)')})")
    each = let("f", firsts, f"transform(s, (_, i) -> f[int(i div {STRIDE})] + {total(f'slice(s, int(i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE})')})")
    return let("s", sizes, f"if(size(s) > 0, {each}, cast(array() as array<bigint>))")


def places(text: str, pattern: str, value_group: int = 0) -> Column:
    """(start, end, first place of the value, match) of all matches, leftmost first, in code points."""
    p = quoted(pattern)
    found, values = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {value_group})"
    valued = f"zip_with(m, {values if value_group else 'm'}, (x, v) -> struct(x as match, bigint(length(x)) as size, bigint(length(v)) as value))"
    gaps = f"slice(split({text}, {p}, -1), 1, size(m))"
    sized = let("m", found, f"zip_with({valued}, {gaps}, (x, gap) -> struct(x.match as match, x.value as value, bigint(length(gap)) as gap, x.size as size))")
    row = "(r, b) -> struct(b + r.gap as start, b + r.gap + r.size as end, b + r.gap + r.size - r.value as value, r.match as match)"
    placed = let("rows", sized, f"zip_with(rows, {sums_before('transform(rows, r -> r.gap + r.size)')}, {row})")
    return F.expr(f"if({text} rlike {p}, {placed}, cast(array() as array<struct<start:bigint,end:bigint,value:bigint,match:string>>))")


def rule_spans(text: str) -> dict[str, Column]:
    """Kept matches of each rule."""
    assign = F.filter(places(text, assign_pattern(), 2), lambda x: x["end"] - x["value"] >= LEAST["assign"])
    # a run that is too short holds no longer one, so the least length can be part of the pattern
    access = places(text, f"{ACCESS[:-1]}{{{LEAST['access'] - 4},}}")
    return {"assign": assign, "access": access, "hex": places(text, f"{HEX[:-1]}{{{LEAST['hex']},}}")}


def run_score(run: str, ratios: list[int]) -> str:
    """SQL: sum of the ratios of the pairs of characters of a run, the place before it and its padding being symbol 0."""
    symbol = numbers([ALPHABET.find(chr(i)) + 1 for i in range(128)])
    symbols = f"concat(array(0), transform(split({run}, ''), c -> element_at({symbol}, ascii(c) + 1)))"
    pairs = f"zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> element_at({numbers(ratios)}, a * {SYMBOLS} + b + 1))"
    return let("s", symbols, f"aggregate({pairs}, 0L, (a, x) -> a + x)")


def labelled(docs: DataFrame, least: int, max_docs: int, drawn: int) -> DataFrame:
    """(random, run): values of rules and drawn digests, and other runs of the sampled documents."""
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    last = docs.select(digest.alias("d")).orderBy("d").limit(max_docs).agg(F.max("d")).first()[0]
    rules = rule_spans("text")
    sample = docs.where(digest <= F.lit(last or "")).select(F.concat(*rules.values()).alias("found"), places("text", run_pattern(least)).alias("runs"))
    marked = sample.select(
        "found",
        F.explode("runs").alias("r"),
    ).select(
        F.col("r.match").alias("run"),
        F.exists("found", lambda x: (x["value"] < F.col("r.end")) & (F.col("r.start") < x["end"])).alias("random"),
        F.exists("found", lambda x: (x["start"] < F.col("r.end")) & (F.col("r.start") < x["end"])).alias("touched"),
    )
    sha = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    of_digests = docs.sparkSession.range(drawn).select(F.explode(F.array(sha, F.base64(F.unhex(sha)))).alias("run"))
    found = marked.where("random or not touched").select(F.col("random").cast("int").alias("random"), "run")
    low, first = F.lower("run"), F.upper(F.substring("run", 1, 1))
    joined = F.concat(low, F.lit("_"), low, first, F.substring(low, 2, 1 << 30), F.lit("-"), low, F.lit("/"), F.upper("run"), F.lit("_"), F.upper("run"))
    names = found.where("random = 0").where(F.col("run").rlike("^[A-Za-z]+$")).select("random", joined.alias("run"))
    return found.unionByName(names).unionByName(of_digests.select(F.lit(1).alias("random"), "run")).distinct()


def log_ratios(sample: DataFrame) -> list[int]:
    """Thousandths of the log of (random over ordinary) for each pair of characters."""
    # stretches that share a character, so that a place is found fast in a run of any length; "^" stands before each run
    stretches = sample.select("random", F.explode(F.regexp_extract_all(F.concat(F.lit("^"), "run"), F.lit("(?=(.{2,65})).{1,64}"), F.lit(1))).alias("part"))
    each = stretches.select("random", "part", F.explode(F.sequence(F.lit(1), F.length("part") - 1)).alias("i")).select("random", F.col("part").substr(F.col("i"), F.lit(2)).alias("two"))
    symbol = lambda i: F.expr(f"instr('{ALPHABET}', substr(two, {i}, 1))")
    pairs = each.groupBy("two").agg(F.sum("random").alias("n1"), F.sum(1 - F.col("random")).alias("n0"))
    pairs = pairs.groupBy((symbol(1) * SYMBOLS + symbol(2)).alias("pair")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    table = sample.sparkSession.range(SYMBOLS**2).select(F.col("id").cast("int").alias("pair")).join(pairs, "pair", "left").na.fill(0)
    first = F.floor(F.col("pair") / SYMBOLS)
    of_first = table.groupBy(first.alias("first")).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    share = lambda n, t: F.log((F.col(n) + UNSEEN) / (F.col(t) + UNSEEN * SYMBOLS))
    rows = table.withColumn("first", first).join(of_first, "first").select("pair", F.round(1000 * (share("n1", "t1") - share("n0", "t0"))).cast("int").alias("ratio"))
    return [r.ratio for r in rows.orderBy("pair").collect()]  # SYMBOLS ** 2 rows


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = 16, least_score: float = 8.0, least_sample: int = 8, max_docs: int = 1000, drawn: int = 500
) -> DataFrame:
    """Credentials in every text, by rules and by the look of their characters.

    Returns (``id_col``, n_assign, n_access, n_hex, n_markov, base_sha256,
    spans), a row for each input row. A null text is empty: no spans, and the
    digest of the empty string. Spans of rules may overlap and all stay; a run
    of ``least_run`` characters or more that touches none of them is ``markov``
    if its log-likelihood ratio is ``least_score`` or more. Rows of equal or null
    id are judged by their own text; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ratios = log_ratios(labelled(base, least_sample, max_docs, drawn))
    kind = lambda k, rows: F.transform(rows, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    ruled = base.select("id", "text", *[rows.alias(name) for name, rows in rule_spans("text").items()])
    judged = ruled.select("id", "text", F.concat(*[kind(k, F.col(name)) for k, name in enumerate(KINDS[:3])]).alias("base"), *[F.size(name).cast("long").alias(f"n_{name}") for name in KINDS[:3]])
    judged = judged.withColumn("runs", places("text", run_pattern(least_run))).drop("text")
    untouched = "not exists(base, x -> x.start < r.end and r.start < x.end)"
    judged = judged.withColumn("markov", F.expr(f"filter(runs, r -> {untouched} and {run_score('r.match', ratios)} >= {round(1000 * least_score)})"))
    names = F.array(*[F.lit(x) for x in KINDS])
    told = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    return judged.select(
        F.col("id").alias(id_col),
        *[f"n_{name}" for name in KINDS[:3]],
        F.size("markov").cast("long").alias("n_markov"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(F.concat("base", kind(3, F.col("markov")))).alias("spans"),
    )


def oracle(least_run: int = 16, least_score: float = 8.0, least_sample: int = 8, max_docs: int = 1000, drawn: int = 500) -> str:
    """DuckDB SQL for ``secret_scan`` over documents; matches are rows, and places are running sums over them."""
    
    def matches(name: str, source: str, pattern: str, value: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""{name}_m AS (SELECT id, doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {value})) AS v,
  unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM {source}),
{name} AS (SELECT id, doc_id, m, e - length(m) AS s, e, e - length(v) AS vs FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY id ORDER BY i) AS e FROM {name}_m))"""

    chars = f"'{ALPHABET}'"
    code = lambda c: f"CASE WHEN {c} = '' THEN 0 ELSE instr({chars}, {c}) END"
    pairs = lambda run, i: f"({code(f'substr({run}, {i}::INT - 1, CASE WHEN {i} = 1 THEN 0 ELSE 1 END)')}) * {SYMBOLS} + {code(f'substr({run}, {i}::INT, 1)')}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
{matches("assign_all", "d", assign_pattern(), 2)},
{matches("access_all", "d", ACCESS)},
{matches("hex_all", "d", HEX)},
base AS (
  SELECT id, 0 AS kind, s, e, vs FROM assign_all WHERE e - vs >= {LEAST["assign"]}
  UNION ALL SELECT id, 1, s, e, vs FROM access_all WHERE e - s >= {LEAST["access"]}
  UNION ALL SELECT id, 2, s, e, vs FROM hex_all WHERE e - s >= {LEAST["hex"]}),
sampled AS (SELECT * FROM d WHERE md5(coalesce(doc_id::VARCHAR, '')) <= (SELECT max(h) FROM (SELECT md5(coalesce(doc_id::VARCHAR, '')) AS h FROM d ORDER BY h LIMIT {max_docs}))),
{matches("ident", "sampled", run_pattern(least_sample))},
marked AS (
  SELECT m AS run, random FROM (
    SELECT ident.id, ident.s, any_value(m) AS m, max(CASE WHEN base.vs < ident.e AND ident.s < base.e THEN 1 ELSE 0 END) AS random, max(CASE WHEN base.s < ident.e AND ident.s < base.e THEN 1 ELSE 0 END) AS touched
    FROM ident LEFT JOIN base USING (id) GROUP BY 1, 2) WHERE random = 1 OR touched = 0),
labelled AS (
  SELECT run, random FROM marked
  UNION SELECT lower(run) || '_' || lower(run) || upper(run[1]) || lower(run[2:]) || '-' || lower(run) || '/' || upper(run) || '_' || upper(run), 0 FROM marked WHERE random = 0 AND regexp_full_match(run, '[A-Za-z]+')
  UNION SELECT sha256(i::VARCHAR), 1 FROM range({drawn}) t(i)
  UNION SELECT to_base64(unhex(sha256(i::VARCHAR))), 1 FROM range({drawn}) t(i)),
learned AS (SELECT {pairs("run", "i")} AS pair, random FROM (SELECT run, random, unnest(range(1, length(run) + 1)) AS i FROM labelled)),
counts AS (SELECT p AS pair, p // {SYMBOLS} AS first, coalesce(sum(random), 0) AS n1, coalesce(sum(1 - random), 0) AS n0 FROM range({SYMBOLS**2}) t(p) LEFT JOIN learned ON p = pair GROUP BY 1, 2),
ratios AS (
  SELECT pair, round(1000 * (ln((n1 + {UNSEEN}) / (sum(n1) OVER w + {UNSEEN * SYMBOLS})) - ln((n0 + {UNSEEN}) / (sum(n0) OVER w + {UNSEEN * SYMBOLS}))))::BIGINT AS ratio
  FROM counts WINDOW w AS (PARTITION BY first)),
{matches("run", "d", run_pattern(least_run))},
free AS (SELECT * FROM run WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.id = run.id AND base.s < run.e AND run.s < base.e)),
scored AS (SELECT id, s, e FROM (SELECT id, s, e, {pairs("m", "i")} AS pair FROM (SELECT id, s, e, m, unnest(range(1, length(m) + 1)) AS i FROM free)) JOIN ratios USING (pair) GROUP BY 1, 2, 3 HAVING sum(ratio) >= {round(1000 * least_score)}),
every AS (SELECT id, kind, s, e FROM base UNION ALL SELECT id, 3, s, e FROM scored),
per AS (
  SELECT id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
    string_agg({list(KINDS)}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({list(KINDS)}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM every GROUP BY id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, coalesce(n3, 0)::BIGINT AS n_markov,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (id)"""
