"""Scans of source texts against the language's own parser, and odd texts; decision records line by line."""

import ast
import glob
import os

from tidemark.functions import core
from tidemark.operators import source
from tidemark.plans import catalog, estate


def texts(spark, pairs):
    return spark.createDataFrame([("p", path, text) for path, text in pairs], "project string, path string, content string")


def library():
    folder = os.path.dirname(ast.__file__)
    paths = sorted(glob.glob(f"{folder}/*.py") + glob.glob(f"{folder}/json/*.py") + glob.glob(f"{folder}/email/*.py"))[:140]
    return [(p, open(p, encoding="utf-8", errors="ignore").read()) for p in paths]


def parsed(text):
    nodes = list(ast.walk(ast.parse(text)))
    names, relative = set(), set()
    for n in nodes:
        if isinstance(n, ast.Import):
            names |= {a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            (relative if n.level else names).add(n.module.split(".")[0])
    kinds = lambda *k: sum(isinstance(n, k) for n in nodes)
    return kinds(ast.ClassDef), kinds(ast.FunctionDef, ast.AsyncFunctionDef), names, relative


def test_library_modules_equal_the_parser(spark):
    files = library()
    got = {r.path: r for r in source.code_inventory(texts(spark, files)).collect()}
    want = {p: parsed(t) for p, t in files}
    assert [p for p in want if got[p].failed] == []
    assert {p: (r.classes, r.functions, r.imports) for p, r in got.items()} == {p: (c, f, len(n | rel)) for p, (c, f, n, rel) in want.items()}
    none = spark.createDataFrame([], "name string")
    counted = {r.name: r.n for r in source.import_census(texts(spark, files), none, none, cap=1000).collect()}
    assert counted == {x: sum(x in n for _, _, n, _ in want.values()) for x in set().union(*[n for _, _, n, _ in want.values()])}


def test_broken_and_quoted(spark):
    cases = [
        ("a", "import os, requests\n", (0, 0, 2)), ("b", '"""\nimport os\nclass A:\n"""\n', (0, 0, 0)), ("c", "class of 99\n", None), ("d", None, None), ("e", "", (0, 0, 0)),
        ("f", "x = (1,\n", None), ("g", "x = ']'\n", (0, 0, 0)), ("h", "x = 'a\n", None), ("i", "def f(): import a; import b\n", (0, 1, 2)), ("j", "this was prose\n", None),
        ("k", "from . import a\n", (0, 0, 0)), ("l", "import a \\\n  , b\n", (0, 0, 2)), ("m", "x = '\\'import y'\n#'\nimport z", (0, 0, 1)), ("n", "def x\n", None), ("o", "match a:\n  case b: pass\n", (0, 0, 0)),
        ("p", "x = 1 if y else 2\nassert x is not None, 'a b'\n", (0, 0, 0)), ("q", "y = f'{a!r:>{w}} import b'\n", (0, 0, 0)), ("r", "x = \"\"\"a\\\"\"\"\"\nimport a", (0, 0, 1)),
    ]
    got = {r.path: None if r.failed else (r.classes, r.functions, r.imports) for r in source.code_inventory(texts(spark, [(p, t) for p, t, _ in cases])).collect()}
    assert got == {p: w for p, _, w in cases}
    assert source.code_inventory(texts(spark, []).limit(0)).count() == 0


def test_write_targets(spark):
    cases = [
        ("ok", "c = connect(p)\nc.execute(\n  'INSERT INTO widgets VALUES (?)', (1,))\n", ("ok", "widgets", "")),
        ("or", "c.execute('insert or replace into a select 1'); c.executescript(\"replace into b\")\n", ("ok", "a,b", "")),
        ("name", "x = 1\nc.execute(SQL)\n", ("ok", "", "2")),
        ("filled", "c.execute(f'update {t} set a')\nc.execute(f'update t set {a}')\n", ("ok", "t", "1")),
        ("joined", "c.execute('delete ' 'from q')\nc.execute('delete from ' + q)\n", ("ok", "q", "2")),
        ("prose", "'''update the docs'''\nx = 'insert into none'\n", None),
        ("read", "def execute(x): pass\ny = db.get_connection()\ny.execute('select updated from t')\n", ("ok", "", "")),
        ("broken", "c.execute('update a'\n", ("unparsed", None, None)),
        ("lines", "f(\n  1,\n  c.execute(a),\n  c.execute(b))\nc.execute()\n", ("ok", "", "3,4")),
    ]
    got = {r.path: (r.status, r.writes, r.unresolved) for r in source.write_targets(texts(spark, [(p, t) for p, t, _ in cases])).collect()}
    assert got == {p: w for p, _, w in cases if w}


def test_decisions(spark):
    log = "# Log\n## 1 - a\nStatus: pending\nstatus: accepted\n## 2\nno\n##3 none\n## 12a none\n## 0004 Status: assumed\nx **Status:** **Confirmed** y\n### 5\n## 6\nstatus unknown\nstatus = Superseded.\n"
    got = source.decision_entries(texts(spark, [("d", log), ("e", ""), ("f", None)])).orderBy("number").collect()
    assert [(r.number, r.tier) for r in got] == [(1, "PENDING"), (2, "other"), (4, "CONFIRMED"), (6, "superseded")]
    notes = "# Open Questions: now\n- a\n-\n  * b\n12. c\n1) d\n## Open decisions\n## open questionsfoo\n- x\n# End\n- y\n"
    got = source.open_questions(texts(spark, [("d", notes)])).collect()
    assert sorted(r["items"] for r in got) == [0, 3]
    docs = [("a", "x\n# Title  here\n**Status**: **Accepted** on\n"), ("b", "## no\nStatus\n"), ("c", None)]
    got = {r.path: (r.title, r.status) for r in source.decision_documents(texts(spark, docs)).collect()}
    assert got == {"a": ("Title  here", "Accepted"), "b": ("", "")} or got == {"a": ("Title  here", "Accepted"), "b": ("", ""), "c": ("", "")}


def test_small_tables_of_source_texts_are_dealt_to_all_cores(spark):
    few = spark.range(100).coalesce(1)
    assert core.spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in core.spread(few).collect()) == list(range(100))
    many = spark.range(0, 100, 1, 50)
    assert core.spread(many).rdd.getNumPartitions() == 50
    tables = catalog.Tables(spark, "/root/testdata/sf0.001")
    assert tables.part.rdd.getNumPartitions() == 1
    for job in (estate.ag_import_census, estate.ag_code_inventory, estate.ag_write_targets):
        assert "RoundRobinPartitioning" in job(tables)._jdf.queryExecution().executedPlan().toString()
