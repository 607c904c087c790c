"""The reference's cases on small frames."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, urls
from tessera.operators import extract, graph, incremental, qa, relations, search, urls as url_ops
from tessera.plans import planner
from tessera.sources import files
from tessera.streaming import refresh


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds or "x int").select(column).first()[0]


@pytest.mark.parametrize(("query", "expected"), [("https://api.example.com/users/42", True), ("/api/users", True), ("/users/42", True), ("GET /api/users", True), ("a/b/c", True), ("getUserById", False), ("x/y", False), ("/users", False), ("/", False), ("", False), ("api/users", False)])
def test_looks_like_url(spark, query, expected):
    assert one(spark, urls.looks_like_url(F.col("q")), q=query) is expected


def test_template_and_suffix_match(spark):
    assert one(spark, urls.template_match(F.col("u"), F.col("t")), u="/api/users/42", t="/api/users/:id").asDict() == {"score": 1.0, "params": {"id": "42"}}
    assert one(spark, urls.template_match(F.col("u"), F.col("t")), u="/api/users/42", t="/api/users/{id}/x") is None
    assert one(spark, urls.suffix_match_score(F.col("u"), F.col("t")), u="https://h/p/api/users/7", t="api/users/:id") == 4
    score = urls.segment_score(0.7, F.array(F.lit("api"), F.lit("users")), F.lit(1), F.lit("api/orders/list"))
    assert one(spark, score, x=1) == pytest.approx(0.7 * 0.5 * 2 / 3)


def test_matched_patterns(spark):
    patterns = spark.createDataFrame([(1, "/en/:id.html"), (2, "/en/:id"), (3, "/:id-b"), (4, "/en/{x}/:id"), (5, "/en/list"), (6, "/:"), (7, "/:a/:b")], "id int, pattern string")
    calls = spark.createDataFrame([("http://h/en/7",), ("http://h/en/7.html",), ("/x",), ("/en/list",), ("/en/{x}/8",), ("/en/9/8",), ("/:",), ("/",), (None,)], "url string")
    both = {"http://h/en/7": (2, "/en/:id.html"), "http://h/en/7.html": (2, "/en/:id.html"), "/x": (0, "/:id-b"), "/en/list": (5, "/en/list"), "/:": (3, "/:")}
    got = lambda *wild: {r["url"]: (r["score"], r["pattern"]) for r in url_ops.matched_patterns(calls, patterns, *wild).collect()}
    assert got() == both | {"/en/{x}/8": (2, "/en/{x}/:id"), "/en/9/8": (2, "/en/{x}/:id")}
    assert got(urls.is_wild) == both | {"/en/{x}/8": (4, "/en/{x}/:id"), "/en/9/8": (0, "/:id-b")}


def test_components_and_params(spark):
    got = one(spark, urls.template_components(F.col("t")), t="/a/${b}/c${d}")
    assert [(x["type"], x["value"]) for x in got] == [("literal", "/a/"), ("variable", "b"), ("literal", "/c"), ("variable", "d")]
    assert one(spark, urls.path_params(F.col("t")), t="/a/:b/{c}") == ["b", "c"]
    assert one(spark, urls.match_confidence(F.col("u"), F.col("p")), u="/a/1", p="/a/:id") == 75


HELPERS = [("src/service/Api/base.ts", "PTRFIX", "", False), ("src/service/Api/base.ts", "COOP_URL", "${PTRFIX}/rest", True), ("src/service/Api/base.ts", "QUALITY_URL", "${COOP_URL}/quality/a/${appId}", True), ("src/service/Api/base.ts", "TEST_URL_API", "/plugin/api", True), ("src/service/Api/TestScenario/index.ts", "scope", "${COOP_URL}/quality/a/${appId}", False), ("src/service/Api/TestScenarioReport/index.ts", "scope", "${COOP_URL}/quality/a/${appId}/api/report", False), ("src/service/Api/TestScenarioExecute/index.ts", "scope", "${TEST_URL_API}/log", False), ("src/service/Api/ApiCase/index.ts", "CASE_URL", "${QUALITY_URL(appId)}/api/case", False)]
EXPANDED = [("${scope(options.appId)}/api/scenario/get", "TestScenario/index.ts", "/rest/quality/a/:param/api/scenario/get"), ("${scope(options.appId)}/group", "TestScenarioReport/index.ts", "/rest/quality/a/:param/api/report/group"), ("${scope(appId)}/list", "TestScenarioExecute/index.ts", "/plugin/api/log/list"), ("${COOP_URL}/global", "base.ts", "/rest/global"), ("${QUALITY_URL(aid)}/api/service/list", "TestScenario/index.ts", "/rest/quality/a/:param/api/service/list"), ("${CASE_URL(aid)}/delete", "TestScenario/index.ts", None), ("${CASE_URL(aid)}/delete", "ApiCase/index.ts", "/rest/quality/a/:param/api/case/delete"), ("${url}", "x.ts", None), ("/rest/quality/a/${appId.value}/apiDefinition/mock/response", "x.ts", "/rest/quality/a/:param/apiDefinition/mock/response"), ("login", "routes.ts", None), ("${NO_SUCH_HELPER(a)}/x", "y.ts", None)]


def test_helper_expansion(spark):
    helpers = spark.createDataFrame(HELPERS, "file_path string, name string, template string, exported boolean")
    patterns = spark.createDataFrame([(i, p, f"src/service/Api/{f}") for i, (p, f, _) in enumerate(EXPANDED)], "id int, pattern string, file_path string")
    got = {r["id"]: r["path"] for r in url_ops.expand_patterns(patterns, helpers).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(EXPANDED)}


def test_fusion_and_duplicates(spark):
    rows = spark.createDataFrame([("f", 1, 1, 0.5), ("f", 1, 2, 0.5), ("f", 1, 3, 0.6)], "file_path string, line_start int, arrival int, weighted double")
    assert search.fuse(rows).first()["score"] == pytest.approx(0.7)
    found = spark.createDataFrame([("a", 0.9, "f.ts", 1, 10, "let x = 1 // one"), ("b", 0.8, "f.ts", 8, 20, "other"), ("c", 0.7, "g.ts", 1, 5, "let x = 1 /* two */"), ("d", 0.6, "h.ts", 1, 2, "quite different text")], "id string, score double, file_path string, line_start int, line_end int, content string")
    assert sorted(r["id"] for r in search.near_duplicates_removed(found).collect()) == ["a", "d"]
    assert {r["id"]: round(r["score"], 2) for r in search.clusters_merged(found).collect()} == {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.6}


def test_scores(spark):
    rows = [("s", 1, 0.95, "a.ts"), ("s", 2, 0.92, "b.ts"), ("s", 3, 0.90, "c.ts"), ("w", 1, 0.2, "a.ts")] + [("f", i, 1.0, "a") for i in range(5)]
    e = spark.createDataFrame(rows, "id string, ord int, score double, file_path string")
    assert {r["id"]: r["sufficiency"] for r in search.sufficiency(e, "id").collect()}["s"] == 0.98
    assert {r["id"]: r["confidence"] for r in search.confidence(e, "id").collect()}["f"] == 1.0
    bad = spark.createDataFrame([("n", 1, float("nan")), ("n", 2, float("inf"))], "id string, ord int, score double")
    assert search.confidence(bad, "id").count() == 0


EDGES = [(2, 1), (3, 2), (4, 3), (1, 4), (5, 1), (6, 6)]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES, "source long, target long")
    found, summary = graph.impact(edges, 1, 3)
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(2, 1), (5, 1), (3, 2), (4, 3)}
    assert summary.first().asDict() == {"total": 4, "truncated": False, "deepest": 3}
    assert graph.shortest_path(edges, 2, 4).first()["path"] == [2, 1, 4]
    assert graph.shortest_path(edges, 5, 6).count() == 0
    assert {(r["node"], r["cycle"]) for r in graph.cycle_members(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6)}
    tree = graph.call_tree(edges, spark.createDataFrame([(6,)], "node long"), 2)
    assert [(r["key"], r["cycle"]) for r in tree.collect()] == [("6", False), ("6/6", True)]
    assert graph.clamp_depth(None) == 3 and graph.clamp_depth(0) == 3 and graph.clamp_depth(99) == 10


def test_many_cycles(spark):
    """More components than a fixed number of rounds peels off: each cycle leads to all cycles with smaller ids, so they go one by one."""
    n = 32
    pairs = [(2 * i, 2 * i + 1) for i in range(n)] + [(2 * i + 1, 2 * i) for i in range(n)] + [(2 * i, 2 * j) for i in range(n) for j in range(i)]
    got = {r["node"]: r["cycle"] for r in graph.cycle_members(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got == {i: i - i % 2 for i in range(2 * n)}


def test_edge_statistics(spark):
    rows = [(11, 10, "f", 5, 10, 1), (12, 11, "g", 9, 11, 1), (10, 10, "f", 1, 10, 1), (13, None, "f", 7, 10, 1), (14, 20, "f", 3, 10, 1)]
    calls = spark.createDataFrame(rows, "caller long, callee long, symbol string, call_line int, root long, root_line int")
    got = {r["symbol"]: r for r in graph.edge_statistics(calls).collect()}["f"]
    assert (got["incoming"], got["unresolved"], got["artifact_self_loops"], got["resolved_elsewhere"]) == (4, 1, 1, 1)


def test_memory(spark):
    rows = [("s", i, "x" * n) for i, n in ((1, 900), (2, 2000), (3, 700), (4, 790), (5, 100))]
    turns = spark.createDataFrame(rows, "session_id string, id int, answer string")
    assert sorted(r["id"] for r in qa.context_budget(turns, 1600).collect()) == [3, 4, 5]
    assert sorted(r["id"] for r in qa.recent_turns(turns, 2).collect()) == [4, 5]
    assert one(spark, text.session_id(F.col("s")), s="   ") is None and one(spark, text.session_id(F.col("s")), s=" a ") == "a"


def test_consistency(spark):
    answers = spark.createDataFrame([(1, "see a.ts:2 and src/ghost.ts:999"), (2, "no place"), (3, "src/a.ts:3-4"), (4, "b.ts:90"), (5, "a.ts:1")], "id int, answer string")
    evidence = spark.createDataFrame([(1, "src/a.ts", 1, 5), (2, "src/a.ts", 1, 5), (3, "./src/a.ts", 1, 5), (4, "b.ts", 1, 5)], "id int, file_path string, line_start int, line_end int")
    got = {r["id"]: (r["verdict"], r["unsupported"]) for r in qa.consistency(answers, evidence).collect()}
    assert got == {1: ("unsupported_refs", ["src/ghost.ts:999"]), 2: ("no_refs", []), 3: ("ok", []), 4: ("line_mismatch", []), 5: ("empty_evidence", [])}


def test_answer_loop():
    strong = [{"score": s, "file_path": f} for s, f in ((0.95, "a"), (0.92, "b"), (0.9, "c"))]
    weak = [{"score": 0.2, "file_path": "a"}]
    calls = []
    generate = lambda q, rows: calls.append(1) or "answer"
    got = qa.answer_loop("q", lambda q, n, t, s: weak if n == 10 else strong, generate)
    assert (got["rounds"], got["evidence"], len(calls), got["degraded"]) == (2, 4, 1, False)
    assert qa.answer_loop("q", lambda *a: strong, generate)["rounds"] == 1
    always = qa.answer_loop("q", lambda *a: weak, generate)
    assert always["rounds"] == 3 and always["degraded"]
    empty = qa.answer_loop("q", lambda *a: [], lambda *a: pytest.fail("called"))
    assert empty["answer"] is None and empty["confidence"] == 0


def test_incremental(spark):
    kinds = "kind string, path string, symbol string, line int"
    a = spark.createDataFrame([("function", "f", "go", 3), ("function", "f", "onSizeChange", 8), ("function", "f", "reset", 12)], kinds)
    c = spark.createDataFrame([("function", "f", "go", 3), ("function", "f", "onSizeChange", 9), ("function", "f", "reset", 13)], kinds)
    d = spark.createDataFrame([("function", "f", "go", 3), ("function", "f", "onSizeUpdate", 8), ("function", "f", "reset", 12)], kinds)
    assert {(r["symbol"], r["change"]) for r in incremental.snapshot_diff(a, c).collect()} == {("onSizeChange", "moved"), ("reset", "moved")}
    assert {(r["symbol"], r["change"]) for r in incremental.snapshot_diff(a, d).collect()} == {("onSizeChange", "removed"), ("onSizeUpdate", "added")}
    assert incremental.snapshot_diff(a, a).count() == 0
    feed = spark.createDataFrame([("A", "x", None), ("R", "z", "y"), ("D", "x", None)], "status string, path string, from_path string")
    assert sorted(r["path"] for r in incremental.candidate_paths(feed).collect()) == ["x", "y", "z"]


def test_streaming_refresh(spark, tmp_path):
    batches = [[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("b", None, 2), ("c", "1", 2)]]
    feed = tmp_path / "feed"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, refresh.SCHEMA).coalesce(1).write.mode("append").parquet(str(feed / f"{i}"))
    for i in range(2):
        flat = tmp_path / "in"
        spark.read.schema(refresh.SCHEMA).parquet(str(feed / f"{i}")).coalesce(1).write.mode("append").parquet(str(flat))
        refresh.refresh(spark, str(flat), str(tmp_path / "table"), str(tmp_path / "check"), 1).awaitTermination(120)
    got = {(r["path"], r["content"]) for r in spark.read.parquet(str(tmp_path / "table" / "v1")).collect()}
    assert got == {("a", "2"), ("c", "1")}


CODE = """import def, { a as b, c } from './base'
import * as ns from '@/lib/x'
import './side.css'
const { q } = require('old')
export const API = '/api/users'
const ROUTES = { list: '/api/list', 'other': "/x/y" }
enum Kind { A = 'a-value' }
export async function load(id: string) {
  if (id && API) { return await fetch(`/api/users/${id}`) }
  // function hidden() {}
  return client.get('/api/all').then(done)
}
export class Store extends Base {
  private async read(k) { return load(k) }
}
"""


def test_extraction(spark):
    got = {(r["kind"], r["name"]): r for r in extract.entities("a.ts", CODE)}
    assert got["function", "load"]["is_async"] and got["function", "load"]["exported"] and (got["function", "load"]["line_start"], got["function", "load"]["line_end"]) == (8, 12)
    assert got["function", "load"]["complexity"] == 3 and ("function", "hidden") not in got
    assert got["method", "read"]["parent"] == "Store" and got["method", "read"]["visibility"] == "private" and ("enum", "Kind") in got
    assert [(r["symbol"], r["alias"], r["import_type"], r["target"]) for r in extract.imports("a.ts", CODE)] == [("default", "def", "default", "./base"), ("a", "b", "named", "./base"), ("c", None, "named", "./base"), ("*", "ns", "namespace", "@/lib/x"), (None, None, "side_effect", "./side.css"), ("q", None, "require", "old")]
    assert {(r["name"], r["value"], r["parent"]) for r in extract.constants("a.ts", CODE)} == {("API", "/api/users", None), ("list", "/api/list", "ROUTES"), ("other", "/x/y", "ROUTES"), ("A", "a-value", "Kind")}
    assert {(r["url"], r["method"]) for r in extract.url_calls("a.ts", CODE)} == {("/api/users/${id}", None), ("/api/all", "GET")}
    assert extract.chunks("i.ts", "export * from './a'\n")[0]["type"] == "module"
    vue = "<template/>\n<script>\nfunction go() {}\n</script>"
    assert extract.entities("x.vue", vue)[0]["line_start"] == 3
    frame = spark.createDataFrame([("a.ts", CODE), ("b.ts", None)], "path string, content string")
    assert extract.extract(frame, extract.imports).count() == 6


def test_relations(spark):
    f = spark.createDataFrame([(1, "p/src/a.ts"), (2, "p/src/lib/index.ts"), (3, "p/src/b.js")], "id int, path string")
    i = spark.createDataFrame([("p/src/x/y.ts", "../a"), ("p/src/a.ts", "@/lib"), ("p/src/a.ts", "./b"), ("p/src/a.ts", "react"), ("p/src/a.ts", "./gone")], "importer string, target string")
    got = relations.resolved_imports(i, f)
    assert {(r["target"], r["file_id"]) for r in got.collect()} == {("../a", 1), ("@/lib", 2), ("./b", 3), ("react", None), ("./gone", None)}
    assert [r["target"] for r in relations.unresolved_internal(got).collect()] == ["./gone"]
    c = spark.createDataFrame([(1, "f", 10, "function f() {\n  await g(1); if (x) h()\n  p().then(q)\n}")], "id int, symbol_name string, line_start int, code_text string")
    edges = {(r["to_symbol"], r["call_line"], r["call_type"]) for r in relations.call_edges(c).collect()}
    assert edges == {("g", 11, "direct"), ("h", 11, "direct"), ("p", 12, "direct"), ("then", 12, "direct")}
    imports = spark.createDataFrame([(2, 1, "s", "named"), (3, 2, "s", "named"), (4, 1, "x", "namespace")], "importer long, imported long, symbol string, import_type string")
    assert {(r["file"], r["depth"]) for r in relations.importers(imports, 1, "s").collect()} == {(2, 1), (4, 1), (3, 2)}


def test_guards(spark):
    rows = [("dist/a.js", "x"), ("a.min.js", "x"), ("a.ts", "x" * 1_000_001), ("b.ts", "y" * 6000), ("c.ts", "ok\n")]
    got = {r["reason"]: r["n"] for r in files.skip_summary(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"build-output": 2, "too-large": 1, "minified": 1, "accept": 1}


def test_planner(spark):
    assert planner.analyze("/api/users/1") == ("url", 0.9) and planner.analyze("go(") == ("function", 0.85) and planner.analyze("E123") == ("constant", 0.8)
    assert "exact" not in planner.strategies("constant", 0.8, ("vector", "exact")) and "graph" in planner.strategies("function", 0.85, ("graph",))
    rows = [("1", "a.ts", "orderTotal", 1, 5, "function orderTotal(items) { return sum(items) }"), ("2", "b.ts", "sendMail", 1, 5, "function sendMail(to) { return post(to) }")]
    t = spark.createDataFrame(rows, "id string, file_path string, name string, line_start int, line_end int, content string")
    got = planner.search(planner.Tables({"code_chunks": t, "functions": t}), "fucntion orderTotal", threshold=0.3, reranker=search.lexical_overlap).collect()
    assert got[0]["file_path"] == "a.ts"


def test_enclosing_names_of_any_type(spark):
    spans = spark.createDataFrame([(1, "outer", 1, 90), (1, "b", 5, 20), (1, "a", 5, 20), (1, "late", 8, 9), (2, "x", 1, 3)], "file_id long, name string, line_start long, line_end long")
    points = spark.createDataFrame([(1, 6, 7), (1, 8, 8), (1, 50, 80), (1, 95, 95), (2, 4, 4)], "file_id long, line_start long, line_end long")
    got = {(r["file_id"], r["line_start"]): r["name"] for r in relations.enclosing(points, spans).collect()}
    assert got == {(1, 6): "a", (1, 8): "late", (1, 50): "outer", (1, 95): None, (2, 4): None}


def test_report_begins_with_a_byte_order_mark(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, "a,b")], "id long, v string").coalesce(1), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,v\n") and b'1,"a,b"' in part.read_bytes()


def test_call_tree_levels_are_capped(spark):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b], "source long, target long")
    roots = spark.createDataFrame([(0,)], "node long")
    full = graph.call_tree(edges, roots, 3, 10_000).collect()
    assert [tuple(r) for r in graph.call_tree(edges, roots, 3, 40).collect()] == [tuple(r) for r in full[:40]]


def test_symbols_of_addresses(spark):
    from tessera.functions import questions

    frame = spark.createDataFrame([("see https://h.io/a/getOne.json and https://h.io/b/getTwo/ok_it?x=get%5FX plus GETONE myVar AB",)], "q string")
    assert frame.select(questions.symbol_tokens(F.col("q")).alias("s")).first()["s"] == ["ok_it", "getOne", "getTwo", "get_X", "myVar"]


def test_planner_runs_all_strategies(spark):
    schema = "id string, file_path string, name string, line_start int, line_end int, content string"
    functions = spark.createDataFrame([("1", "a.ts", "load", 1, 5, "function load() { read everything }"), ("2", "b.ts", "other", 1, 9, "something else entirely"), ("3", "c.ts", "third", 2, 3, "a third thing of its own")], schema)
    imports = spark.createDataFrame([("d.ts", "load", "a.ts", "named"), ("e.ts", "x", "d.ts", "namespace")], "file_path string, symbol string, target_path string, import_type string")
    calls = spark.createDataFrame([("2", "1"), ("1", "3")], "source string, target string")
    tables = planner.Tables({"functions": functions, "code_chunks": functions}, imports=imports, calls=calls)
    got = {r["file_path"]: r for r in planner.search(tables, "function load", threshold=0.2).collect()}
    assert set(got) == {"a.ts", "b.ts", "c.ts", "d.ts"} and got["d.ts"]["id"] == "dep:d.ts:load"  # e.ts has the text of d.ts
    assert got["a.ts"]["score"] > got["b.ts"]["score"] > got["d.ts"]["score"]
    assert got["d.ts"]["score"] == pytest.approx(0.35 * 0.8) and got["b.ts"]["score"] == pytest.approx(0.5 * 1.1)
