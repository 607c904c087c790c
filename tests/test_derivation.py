"""Evaluation of URL-building code."""

from tessera.operators import derivation

BASE = """
export const PREFIX = ''
export const API = `${PREFIX}/api`
export const ROUTES = { users: API + '/users', one: `${API}/users/${id}` }
export function buildPath(kind, id) { return API + '/' + kind + '/' + id; }
export const pick = (flag) => flag ? '/a/x' : '/b/y'
const joined = ['/v1', 'items', 'list'].join('/')
const replaced = '/old/path'.replace('old', 'new')
"""
USER = """
const mine = buildPath('orders', 7)
const other = unknown('/q')
const API_TWO = ROUTES.users
"""


def test_evaluator():
    table = {r["name"]: (r["params"], r["expression"]) for r in derivation.symbols("a.ts", BASE) + derivation.symbols("b.ts", USER)}
    e = derivation.Evaluator(table)
    assert e.strings("ROUTES.users") == ["/api/users"]
    assert e.strings("ROUTES.one") == ["/api/users/:param"]
    assert e.strings("mine") == ["/api/orders/:param"] or e.strings("mine") == ["/api/orders/7"]
    assert e.strings("pick(1)") == ["/a/x", "/b/y"]
    assert e.strings("joined") == ["/v1/items/list"] and e.strings("replaced") == ["/new/path"]
    assert e.strings("other") == [":param"] and e.strings("API_TWO") == ["/api/users"]
    loop = derivation.Evaluator({"a": (None, "b"), "b": (None, "a")})
    assert loop.strings("a") == [":param"]


def test_derived_urls(spark):
    f = spark.createDataFrame([(1, "a.ts", BASE), (1, "b.ts", USER), (2, "c.ts", "const x = API"), (2, "d.ts", None)], "repo_id long, path string, content string")
    got = {(r["repo_id"], r["path"], r["name"], r["url"]) for r in derivation.derived_urls(f).collect()}
    assert (1, "a.ts", "ROUTES.users", "/api/users") in got and (1, "b.ts", "API_TWO", "/api/users") in got
    assert not any(r[0] == 2 for r in got)
