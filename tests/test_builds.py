"""Feeds, reference builders, call trees and URL search on small frames."""

import zipfile

from pyspark.sql import functions as F

from tessera.operators import derivation, evidence, graph, incremental, layers, qa, relations, search, urls as url_ops
from tessera.sources import feeds


def test_unpacked_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/a.ts", "let x = 'é'")
        z.writestr("src/empty.ts", "")
        z.writestr("bin/b", b"\xff\xfe")
        z.writestr("folder/", "")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = {(r["archive"].rsplit("/", 1)[1], r["path"]): (r["content"], r["length"]) for r in feeds.unpacked(spark, str(tmp_path)).collect()}
    assert got == {("a.zip", "src/a.ts"): ("let x = 'é'", 12), ("a.zip", "src/empty.ts"): ("", 0), ("a.zip", "bin/b"): (None, 2), ("broken.zip", None): (None, None)}


def test_change_feed(spark):
    lines = spark.createDataFrame([("R090\ta.ts\tb.ts",), ("C100\ta.ts\tc.md",), ("T\tx.vue",), ("Z\tq",), (None,)], "line string")
    got = {tuple(r) for r in feeds.name_status(lines).collect()}
    assert got == {("b.ts", "renamed", "a.ts", True), ("c.md", "added", None, False), ("x.vue", "modified", None, True)}
    assert incremental.change_summary(feeds.name_status(lines)).first().asDict() == {"total": 3, "added": 1, "modified": 1, "deleted": 0, "renamed": 1}


DEFINITIONS = [(1, "main", "a.ts", 1), (2, "load", "a.ts", 20), (3, "load", "b.ts", 5), (4, "save", "b.ts", 9), (5, "save", "c.ts", 2), (6, "other", "d.ts", 1)]
CALLS = [(1, 2, "load", 3), (1, None, "gone", 4), (1, 1, "main", 1), (1, None, "save", 6), (2, 1, "main", 22), (6, 3, "load", 7), (6, 3, "load", 8)]


def tree_rows(frame):
    return {(r["direction"], r["key"], r["node"], r["call_line"], r["ambiguous"], r["candidates"], r["cyclic"]) for r in frame.collect()}


def test_symbol_tree(spark):
    d = spark.createDataFrame(DEFINITIONS, "id int, symbol string, path string, line_start int")
    c = spark.createDataFrame(CALLS, "source int, target int, symbol string, call_line int")
    assert tree_rows(graph.symbol_tree(d, c, "main", depth=2)) == {
        ("root", "root", 1, None, False, 1, False), ("callers", "caller.load", 2, 22, False, 1, False), ("callers", "caller.load.main", 1, 3, False, 1, True), ("callers", "caller.load.other", 6, 7, False, 1, False),
        ("callees", "callee.load", 2, 3, False, 2, False), ("callees", "callee.gone", None, 4, False, 0, False), ("callees", "callee.save", 4, 6, True, 2, False), ("callees", "callee.load.main", 1, 22, False, 1, True),
    }
    assert graph.symbol_tree(d, c, "nothing").count() == 0
    assert tree_rows(graph.symbol_tree(d, c, "load", chunk=3, depth=1, direction="callees")) == {("root", "root", 3, None, True, 2, False)}
    assert [r["key"] for r in graph.symbol_tree(d, c, "main", depth=4, most=3).collect()] == ["root", "caller.load", "caller.load.main"]


def test_question_tree(spark):
    d = spark.createDataFrame([(1, "loadUser", "a.ts", 1), (2, "saveUser", "a.ts", 9)], "id int, symbol string, path string, line_start int")
    c = spark.createDataFrame([(2, 1, "loadUser", 10)], "source int, target int, symbol string, call_line int")
    about, tree = graph.question_tree(d, c, "who calls loadUser and saveUser")
    assert about["direction"] == "callers" and about["matched_by"] == "query-token" and about["root"]["id"] == 1 and [a["id"] for a in about["alternatives"]] == [2]
    assert [r["key"] for r in tree.collect()] == ["root", "caller.saveUser"]
    about, tree = graph.question_tree(d, c, "who calls it", evidence=("SAVEUSER",))
    assert about["matched_by"] == "evidence-top" and about["root"]["symbol"] == "saveUser" and tree.count() == 1
    assert graph.question_tree(d, c, "hello")[1] is None


def test_file_graph(spark):
    files = spark.createDataFrame([(1, "src/a.ts"), (2, "src/b.ts"), (3, "c.ts")], "id long, path string")
    imports = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, None)], "source long, target long")
    calls = spark.createDataFrame([(1, 3), (1, 1), (2, 1)], "source long, target long")
    nodes, edges = graph.file_graph(files, imports, calls, 1, 2)
    assert {tuple(r) for r in nodes.collect()} == {(1, "a.ts", "src/a.ts"), (2, "b.ts", "src/b.ts")}
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "imports", 1), (2, 3, "imports", 1), (1, 3, "calls", 1), (2, 1, "calls", 1)}
    assert graph.file_graph(files, imports, calls, 1, 1)[0].count() == 1
    assert graph.file_graph(files, imports, calls, 9, 2)[1].count() == 0


def test_constant_references(spark):
    constants = spark.createDataFrame([(1, 1, "API_BASE", True), (2, 1, "local", False), (3, 1, None, True)], "id int, file_id int, symbol string, exported boolean")
    imports = spark.createDataFrame([(2, 1, "API_BASE", "BASE", "named"), (3, 1, None, "consts", "namespace"), (4, 1, "other", None, "named")], "importer int, imported int, symbol string, alias string, import_type string")
    chunks = spark.createDataFrame([(10, 1, 1, "const local = 1\n  use(local)\nlocalize()"), (20, 2, 5, "x\nget(BASE)\nBASE_URL"), (30, 3, 1, "consts.API_BASE"), (40, 4, 1, "API_BASE"), (50, 1, 1, None)], "id int, file_id int, line_start int, code_text string")
    got = {tuple(r) for r in relations.constant_references(constants, imports, chunks).collect()}
    assert got == {(2, 1, 10, 2, "use(local)", "local_reference"), (1, 2, 20, 6, "get(BASE)", "direct_reference"), (1, 3, 30, 1, "consts.API_BASE", "namespace_access")}


def test_constant_references_once(spark, monkeypatch):
    monkeypatch.setattr(relations, "LIST", 2, raising=False)
    constants = spark.createDataFrame([(k, 1, "A", True) for k in range(5)] + [(9, 2, "loc", False), (8, 2, "own", None)], "id int, file_id int, symbol string, exported boolean")
    imports = spark.createDataFrame([(2, 1, "A", None, "named"), (2, 1, "A", "B", "named"), (2, 1, None, "A", "namespace"), (2, 1, "A", "", "named")], "importer int, imported int, symbol string, alias string, import_type string")
    chunks = spark.createDataFrame([(10, 2, 1, "A B A\nconst locals; const own = loc + A1"), (10, 2, 1, "B\nown"), (11, 3, 1, "A loc")], "id int, file_id int, line_start int, code_text string")
    frame = relations.constant_references(constants, imports, chunks).drop("context")
    bare = relations.constant_references(constants, imports, chunks, context=False)
    expected = sorted([(k, 2, 10, 1, kind) for k in range(5) for kind in ("direct_reference", "namespace_access")] + [(8, 2, 10, 2, "local_reference")])
    assert sorted(map(tuple, bare.collect())) == expected and sorted(map(tuple, frame.distinct().collect())) == expected
    top = frame._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top  # rows of the result are not compared with each other


def test_constant_references_by_kind(spark):
    constants = spark.range(1000).selectExpr("id", "1L AS file_id", "'A' AS symbol", "true AS exported")
    imports = spark.range(2, 62).selectExpr("id AS importer", "1L AS imported", "'A' AS symbol", "CASE WHEN id % 2 = 0 THEN 'B' END AS alias", "'named' AS import_type")
    chunks = spark.createDataFrame([(10, 2, 1, "B\nA"), (11, 3, 1, "x A"), (12, 2, 7, "B")], "id int, file_id long, line_start int, code_text string")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty()
        rows = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {rows.apply(k).stageId(): rows.apply(k).shuffleWriteRecords() for k in range(rows.size())}

    before = stages()
    got = [tuple(r) for r in relations.constant_references(constants, imports, chunks, context=False).collect()]
    after = stages()
    dealt = sum(n for k, n in after.items() if k not in before)
    assert sorted(got) == sorted((k, *at, "direct_reference") for k in range(1000) for at in ((2, 10, 1), (2, 12, 7), (3, 11, 1)))
    assert 0 < dealt < 1000 * 60  # constants are not dealt out once for each file that imports them


def test_constant_references_of_ids_with_two_declarations(spark):
    constants = spark.createDataFrame([(1, 1, "A", True), (1, 1, "A", True), (1, 2, "A", True), (1, 3, "A", None), (2, 1, "A", True), (None, 1, "A", True), (3, None, "A", True)], "id int, file_id int, symbol string, exported boolean")
    imports = spark.createDataFrame([(3, 1, "A", None, "named"), (3, 2, "A", "B", None), (3, None, "A", None, "named")], "importer int, imported int, symbol string, alias string, import_type string")
    chunks = spark.createDataFrame([(10, 3, 1, "A B\nlet A\nB")], "id int, file_id int, line_start int, code_text string")
    got = [tuple(r) for r in relations.constant_references(constants, imports, chunks, context=False).collect()]
    direct = [(k, 3, 10, line, "direct_reference") for k, line in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (None, 1), (None, 2))]
    assert sorted(got, key=repr) == sorted([*direct, (1, 3, 10, 1, "local_reference")], key=repr)


def test_url_usages(spark):
    patterns = spark.createDataFrame([(1, 7, 1, 3, "GET", "/a", "a", "axios.get('/a')"), (1, 8, 2, 4, "GET", "/a", "a", "axios.get('/a')"), (1, 9, 2, 4, None, "/a", "a", "x")], "repo_id int, id int, file_id int, line int, method string, pattern string, normalized_pattern string, code string")
    spans = spark.createDataFrame([(1, "f", 1, 10), (1, "g", 3, 4)], "file_id int, name string, line_start int, line_end int")
    got = {(r["pattern_id"], r["file_id"], r["line"], r["method"], r["chunk"]) for r in relations.url_usages(patterns, spans).collect()}
    assert got == {(7, 1, 3, "GET", "g"), (7, 2, 4, "GET", None), (9, 2, 4, None, None)}
    sites = spark.createDataFrame([(1, 5, "/A/", 1, "indirect_call"), (1, 6, "/b", 2, "template_helper"), (1, 4, "/b", 9, "template_helper")], "repo_id int, file_id int, url string, line int, kind string")
    usages, lacking = relations.indirect_usages(sites, patterns)
    assert {(r["file_id"], r["pattern_id"]) for r in usages.collect()} == {(5, 7), (6, None), (4, None)}
    assert [tuple(r) for r in lacking.collect()] == [(1, "/b", 4, 9)]


def test_enumeration(spark):
    patterns = spark.createDataFrame([(1, "GET", "/api/a"), (2, None, "/api/b"), (3, "POST", "/x"), (4, "GET", "http://e/x")], "id int, method string, path string")
    rows = url_ops.inventory(patterns)
    assert qa.enumeration("how are you", rows) is None
    got = qa.enumeration("列出所有 GET 接口", rows)
    assert got["method"] == "GET" and got["rows"].count() == 2 and got["by_method"].first()["n"] == 2
    assert [r["content"] for r in got["evidence"].collect()] == ["GET /api/a", "GET http://e/x"]
    lines = [r["line"] for r in qa.inventory_markdown(rows).collect()]
    assert lines[0] == "### /api (1)" and lines[-1] == "| (undecided) | `/api/b` | 0 |" and len(lines) == 16


def test_promotion_and_rebuild(spark):
    unresolved = spark.createDataFrame([("src/a.ts", "./b"), ("src/c.ts", "./d")], "importer string, target string")
    assert [r["file"] for r in incremental.promoted(unresolved, spark.createDataFrame([("src/b.ts",)], "path string")).collect()] == ["src/a.ts"]
    files = spark.createDataFrame([(1, "x"), (3, "z")], "id int, content string")
    derive = lambda f: {"t": f.select(F.col("id").alias("file_id"), F.upper("content").alias("v"))}
    old = spark.createDataFrame([(1, "old"), (2, "gone"), (3, "kept")], "file_id int, v string")
    got = incremental.rebuilt({"t": old, "u": old}, files, spark.createDataFrame([(1,), (2,)], "id int"), derive)
    assert sorted(map(tuple, got["t"].collect())) == [(1, "X"), (3, "kept")] and [tuple(r) for r in got["u"].collect()] == [(3, "kept")]
    assert incremental.reindexed(files, derive)["t"].count() == 2


def test_url_search(spark):
    constants = spark.createDataFrame([(1, "USERS", "/api/v1/users", "k.ts", 3)], "id int, name string, value string, file_path string, line int")
    patterns = spark.createDataFrame([(1, "/api/v1/users", "api/v1/users", "GET", "p.ts", 5, "get()"), (2, "/api/:ver/users", "api/:ver/users", None, "q.ts", 6, "loop()")], "id int, pattern string, normalized_pattern string, method string, file_path string, line int, code string")
    usages = spark.createDataFrame([(1, "u.ts", 7, "call('/api/v1/users')", "api_call", "/api/v1/users", "api/v1/users"), (2, "w.ts", 8, "wrap()", "indirect_call", "/api/users", "api/users")], "id int, file_path string, line int, code string, context string, pattern string, normalized_pattern string")
    chunks = spark.createDataFrame([(1, "z.ts", 1, "fetch(USERS)")], "id int, file_path string, line_start int, code_text string")
    rows = layers.search_url("where is /api/v1/users", constants, patterns, usages, chunks).collect()
    best = {r["file_path"]: (r["type"], r["score"]) for r in rows}
    assert best["k.ts"] == ("constant", 1.0) and best["p.ts"] == ("pattern", 1.0) and best["u.ts"] == ("usage", 0.98)
    assert [u["file"] for r in rows if r["file_path"] == "k.ts" for u in r["usage_chain"]] == ["z.ts"]
    shown = spark.createDataFrame([("p.ts", 5)], "file_path string, line_start int")
    near = {(r["kind"], r["file_path"], r["score"]) for r in layers.related_layer(usages, patterns, "/api/v1/users", shown).collect()}
    assert near == {("indirect_call", "w.ts", 0.35), ("version_family", "q.ts", 0.28)}
    assert layers.related_layer(usages, patterns, "/api/v1/users", near_places(spark)).count() == 0


def near_places(spark):
    return spark.createDataFrame([("w.ts", 8), ("q.ts", 6)], "file_path string, line_start int")


def test_symbols_and_evidence(spark):
    d = spark.createDataFrame([("Foo", "b", 1), ("foo", "a", 2), ("bar", "a", 3), (None, "a", 4)], "symbol string, path string, line_start int")
    assert [r["line_start"] for r in search.named_symbols(d, ["FOO"]).collect()] == [1, 2]
    assert [r["line_start"] for r in search.symbol_candidates(d, "foo").collect()] == [2]
    row = evidence.evidence(spark.createDataFrame([(1, None)], "id int, similarity double")).first()
    assert (row["file_path"], row["line_start"], row["symbol_type"], row["score"]) == ("", 0, "unknown", 0.0)


def test_entry_points(spark):
    values = spark.createDataFrame([(1, "const", "/api/users"), (2, "function", "/api/:id"), (3, "const", "/x"), (4, "function", "/API/users/list"), (5, "const", None)], "id int, kind string, value string")
    assert [(r["id"], r["score"]) for r in derivation.entry_points(values, "/api/users").collect()] == [(4, 1.1), (1, 1.0), (2, 0.55)]
    assert derivation.entry_points(values, "").count() == 0
