"""Queries over rules: sample texts that reach every arm, dealt to the rows of a table by its key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.catalog import query
from tessera.functions import questions, text, urls
from tessera.sources import model

t = model.table


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def dealt(key: Column, values) -> Column:
    """The sample of a row: the values in turn."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def dealt_sql(key: str, values) -> str:
    return f"list_extract({sql_list(values)}, CAST({key} % {len(values)} AS BIGINT) + 1)"


def cases(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{name}'" for condition, name in rules) + f" ELSE '{otherwise}' END"


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '" + pattern.replace("'", "''") + "')"


URLS = ("/users/:id", "/a.b/c.d", "GET /api/users", "https://x.io/a", "getUserById", "/one", "see /v1/items/42 now", "a/b/c", "http:/x", "${base}/x/{id}", "//", "")


@query(f"""SELECT page_id, {matches("v", "^https?://")} OR {matches("v", r"/[A-Za-z0-9_\-.:{}$]+/[A-Za-z0-9_\-.:{}$]+")} AS is_url FROM (SELECT page_id, {dealt_sql("page_id", URLS)} AS v FROM pages)""")
def url_like_queries(spark, d):
    return t(spark, d, "pages").select("page_id", urls.looks_like_url(dealt(F.col("page_id"), URLS)).alias("is_url"))


INTENTS = ("/api/users/1", "/a/b", "x /get y", "by :id", "/x/{id}", "https://x.io", "foo (bar)", "function go", "x => {", "Class Foo", "INTERFACE Bar", "a type t", "MAX_SIZE", "E404", "E4x", "hello there")
INTENT_RULES = (
    (" OR ".join(matches("v", p) for p in (r"(?i)/(api|rest|v\d+|graphql|endpoint)/|:\w+|/\{|\bhttps?://", "(?i)^/[a-z0-9_-]+/[a-z0-9_-]+", r"(?i)/(get|post|put|delete|patch)\b")), "url"),
    (matches("v", r"\w+\s*\(|function\s+\w+|=>\s*\{"), "function"), (matches("v", r"(?i)class\s+\w+|interface\s+\w+|type\s+\w+"), "class"), (matches("v", r"^[A-Z_]+$|^E\d+$"), "constant"),
)


@query(f"""SELECT page_id, kind, CASE kind WHEN 'url' THEN 0.9 WHEN 'constant' THEN 0.8 WHEN 'general' THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence FROM (SELECT page_id, {cases(INTENT_RULES, "general")} AS kind FROM (SELECT page_id, {dealt_sql("page_id", INTENTS)} AS v FROM pages))""")
def query_intents(spark, d):
    return t(spark, d, "pages").select("page_id", text.intent(dealt(F.col("page_id"), INTENTS)).alias("i")).select("page_id", "i.kind", "i.confidence")


CONSTANTS = ("https://a.b/c", "HTTPS://a.b", "/abc", "/Abc", "/1/2-x", "E42", "Ex", "save:done", ".btn", "-x", "MAX_A", "plain text", "")
SQL_KINDS = ((matches("v", "^(https?://|/[a-z])"), "url_segment"), (matches("v", "^E[0-9]+$"), "error_code"), ("contains(v, ':')", "event_name"), (matches("v", r"^\."), "css_class"), (matches("v", "^[A-Z_]+$"), "env_var"))
INDEXED_KINDS = ((matches("v", "(?i)^(https?://|/[a-z])"), "url_segment"), (matches("v", "^E[0-9]+$"), "error_code"), ("contains(v, ':')", "event_name"), (matches("v", r"^[.\-]"), "css_class"), (matches("v", "^[A-Z_]+$"), "env_var"), (matches("v", r"(?i)^/[a-z0-9\-_/]+$"), "api_path"))


@query(f"""SELECT p_partkey, {cases(SQL_KINDS, "string")} AS kind FROM (SELECT p_partkey, {dealt_sql("p_partkey", CONSTANTS)} AS v FROM part)""")
def constant_types(spark, d):
    return t(spark, d, "part").select("p_partkey", urls.constant_type_sql(dealt(F.col("p_partkey"), CONSTANTS)).alias("kind"))


@query(f"""SELECT p_partkey, {cases(INDEXED_KINDS, "string")} AS kind FROM (SELECT p_partkey, {dealt_sql("p_partkey", CONSTANTS)} AS v FROM part)""")
def constant_types_indexed(spark, d):
    return t(spark, d, "part").select("p_partkey", urls.constant_type_indexed(dealt(F.col("p_partkey"), CONSTANTS)).alias("kind"))


CALLS = ("get users", "POST it", "xputx", "DELETEd", "patch me", "none here", "POST or GET", "")


@query("SELECT event_id, CASE " + " ".join(f"WHEN contains(upper(v), '{m}') THEN '{m}'" for m in urls.METHODS) + f" END AS method FROM (SELECT event_id, {dealt_sql('event_id', CALLS)} AS v FROM events)")
def http_methods(spark, d):
    return t(spark, d, "events").select("event_id", urls.http_method(dealt(F.col("event_id"), CALLS)).alias("method"))


CODES = ("app.get('/x', f)", "Router . POST(u)", "axios.post(u)", "fetch(u)", "this.http.put(u)", "ajax.head(u)", "useRouter()", "new router", "const x = 1", "myapp.gets(1)", "rpc.call(u)")
CONTEXTS = (
    (matches("v", r"(?i)\b(router|app|route|server|express)\s*\.\s*(get|post|put|patch|delete|all|use|head|options)\s*\("), "route_definition"),
    (matches("v", "(?i)(axios|fetch|got|superagent|request|ky|needle|urllib)"), "api_call"),
    (matches("v", r"(?i)\b(this\.)?(client|http|httpclient|apiclient|api|request|instance|agent|ajax|rpc)\s*\.\s*(get|post|put|patch|delete|head|options|request)\s*\("), "api_call"),
    ("contains(v, 'router')", "router"),
)


@query(f"""SELECT event_id, {cases(CONTEXTS, "unknown")} AS context FROM (SELECT event_id, {dealt_sql("event_id", CODES)} AS v FROM events)""")
def usage_contexts(spark, d):
    return t(spark, d, "events").select("event_id", urls.usage_context(dealt(F.col("event_id"), CODES)).alias("context"))


#: URL and pattern, in pairs.
PAIRS = (
    ("/api/Users/7", "/API/users/${id}"), ("/api/users/7", "/api/users/7"), ("https://h.io/v1/a/b", "/:version/a/:x"), ("/a/b/c", "/a/x/c"), ("/a/b", "/a/b/c"), ("/x/1", "/x/:1-y"), ("/x/1", "/x/{id}"), ("/v2/x", "/<v>/x"), ("/p/q", "/:a/:a"), ("", "/a"), ("/v1/x", "/v1/:y"),
)
PLACEHOLDER = r"^(\$\{[^}]+\}|:[a-zA-Z_][a-zA-Z0-9_]*|\{[^}]+\}|<[^>]+>)$"
PAIRED = f"""SELECT page_id, url, pattern, list_filter(string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda s: s <> '') AS u, list_filter(string_split(regexp_replace(pattern, '^https?://[^/]+', ''), '/'), lambda s: s <> '') AS p
FROM (SELECT page_id, {dealt_sql("page_id", [a for a, _ in PAIRS])} AS url, {dealt_sql("page_id", [b for _, b in PAIRS])} AS pattern FROM pages)"""
FITS = f"(len(u) = len(p) AND len(p) > 0 AND len(list_filter(list_zip(u, p), lambda x: NOT ({matches('x[2]', PLACEHOLDER)} OR lower(x[1]) = lower(x[2])))) = 0)"
SAME = "(CASE WHEN greatest(len(u), len(p)) = 0 THEN 0.0 ELSE len(list_filter(list_zip(u, p), lambda x: coalesce(lower(x[1]) = lower(x[2]), false))) / greatest(len(u), len(p)) END)"


def pairs(spark, d):
    key = F.col("page_id")
    return t(spark, d, "pages").select("page_id", dealt(key, [a for a, _ in PAIRS]).alias("url"), dealt(key, [b for _, b in PAIRS]).alias("pattern"))


@query(f"""WITH z AS ({PAIRED}), f AS (SELECT page_id, list_filter(list_zip(u, p), lambda x: {matches("x[2]", PLACEHOLDER)}) AS x FROM z WHERE {FITS}),
n AS (SELECT page_id, list_transform(x, lambda y: regexp_replace(y[2], '^(\\$\\{{|[:{{<])|[}}>]$', '', 'g')) AS names, list_transform(x, lambda y: y[1]) AS vals FROM f)
SELECT page_id, 1.0::DOUBLE AS score, array_to_string(list_sort(list_transform(list_filter(range(1, len(names) + 1), lambda i: NOT list_contains(names[i + 1:], names[i])), lambda i: names[i] || '=' || vals[i])), ',') AS params FROM n""")
def template_matches(spark, d):
    m = pairs(spark, d).withColumn("m", urls.template_match(F.col("url"), F.col("pattern"))).where("m IS NOT NULL")
    params = F.transform(F.map_entries("m.params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("page_id", "m.score", F.array_join(F.array_sort(params), ",").alias("params"))


@query(f"SELECT page_id, round({SAME}, 6) AS similarity FROM ({PAIRED})")
def url_pair_similarities(spark, d):
    return pairs(spark, d).select("page_id", F.round(urls.url_similarity(F.col("url"), F.col("pattern")), 6).alias("similarity"))


@query(f"""SELECT page_id, CASE WHEN url = pattern THEN 100 ELSE CAST(floor((CASE WHEN {FITS} THEN list_sum(list_transform(p, lambda s: CASE WHEN {matches("s", PLACEHOLDER)} THEN 0.5 ELSE 1.0 END)) / len(p) ELSE {SAME} END) * 100 + 0.5) AS INTEGER) END AS confidence FROM ({PAIRED})""")
def match_confidences(spark, d):
    return pairs(spark, d).select("page_id", urls.match_confidence(F.col("url"), F.col("pattern")).alias("confidence"))


@query(f"""SELECT page_id, len(list_filter(list_zip(u, p), lambda x: coalesce({matches("x[1]", "^v[0-9]+$")}, false) AND coalesce({matches("x[2]", PLACEHOLDER)}, false))) > 0 AS same_family FROM ({PAIRED})""")
def version_families(spark, d):
    return pairs(spark, d).select("page_id", F.coalesce(urls.version_family(F.col("url"), F.col("pattern")), F.lit(False)).alias("same_family"))


TEMPLATES = ("/a/${id}/b", "${x}", "plain", "/a/${b}${c}", "${p}/q", "")


@query(f"""SELECT page_id, array_to_string(list_transform(list_filter(regexp_extract_all(v, '\\$\\{{[^}}]*\\}}|[^$]+'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '${{') THEN 'variable:' || x[3:length(x) - 1] ELSE 'literal:' || x END), '|') AS parts FROM (SELECT page_id, {dealt_sql("page_id", TEMPLATES)} AS v FROM pages)""")
def template_components(spark, d):
    parts = urls.template_components(dealt(F.col("page_id"), TEMPLATES))
    return t(spark, d, "pages").select("page_id", F.array_join(F.transform(parts, lambda x: F.concat(x["type"], F.lit(":"), x["value"])), "|").alias("parts"))


#: Path and file of undecided inventory rows.
UNDECIDED = (
    ("HTTPS://cdn.io/x.js", "a.ts"), ("/assets/x", "vite.config.ts"), ("/home", "src/router/routes.ts"), ("/menu", "src/initializeRootMenu.ts"), ("/m", "src/AppCreated.vue"), ("/Read/Write", "a.vue"), ("/plugin/api/x", "a.ts"), ("/rest/x", "a.ts"), ("/api/x", "a.ts"), ("/x.js", None), (None, "b.ts"), ("/Users", "menu.ts"),
)
UNDECIDED_RULES = (
    (matches("p", "(?i)^https?://"), "not-interface"), ("contains(f, 'vite.config')", "not-interface"), ("contains(f, 'router/routes')", "not-interface"), ("contains(f, 'initializeRootMenu') OR contains(f, 'AppCreated')", "not-interface"),
    ("p = '/Read/Write'", "not-interface"), ("starts_with(p, '/plugin/api/') OR starts_with(p, '/rest/')", "interface"),
)


@query(f"""SELECT page_id, {cases(UNDECIDED_RULES, "unknown")} AS kind FROM (SELECT page_id, coalesce({dealt_sql("page_id", [a for a, _ in UNDECIDED])}, '') AS p, coalesce({dealt_sql("page_id", [b for _, b in UNDECIDED])}, '') AS f FROM pages)""")
def undecided_rows(spark, d):
    key = F.col("page_id")
    return t(spark, d, "pages").select("page_id", urls.classify_undecided(dealt(key, [a for a, _ in UNDECIDED]), dealt(key, [b for _, b in UNDECIDED])).alias("kind"))


MISSPELT = ("fucntion go", "Retrun the obejct", "pst to delet", "athentication valiation", "class of arry", "no typo", "")
TYPO_MAP = "map(" + sql_list(text.TYPOS) + ", " + sql_list(text.TYPOS.values()) + ")"


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split_regex(v, '\\s+'), lambda w: coalesce({TYPO_MAP}[lower(w)], w)), ' ') AS fixed FROM (SELECT p_partkey, {dealt_sql("p_partkey", MISSPELT)} || ' ' || p_name AS v FROM part)""")
def corrected_typos(spark, d):
    line = F.concat(dealt(F.col("p_partkey"), MISSPELT), F.lit(" "), F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", text.correct_typos(line).alias("fixed"))


ASKED = (
    "列出所有 POST 接口", "一共有多少个 api", "/api/users 在哪", "what is :id", "login 函数在哪", "如何实现用户认证", "系统架构设计", "为什么登录失败", "怎么用这个类", "a vs b", "where is x called", "usages of y", "definition of z", "implementation here", "who are the callers", "谁调用了它", "定义在哪里", "hello",
)
ACTION_RULES = [(f"contains(lower(v), '{word}')", name) for word, name in text.ACTIONS]
KIND_RULES = [(f"{matches('v', text.LISTING[0])} AND {matches('v', text.LISTING[1])}", "enumeration"), (matches("v", r"(?i)/(api|rest|v\d+|graphql)/|:\w+|/\{|\bhttps?://"), "url_lookup"), *((matches("v", pattern), name) for name, pattern in text.QUESTION_KINDS)]


@query(f"""SELECT conv_id, turn, {cases(ACTION_RULES, "general_search")} AS action, {cases(KIND_RULES, "general")} AS kind FROM (SELECT conv_id, turn, {dealt_sql("(conv_id + turn)", ASKED)} AS v FROM conversations)""")
def question_actions(spark, d):
    v = dealt(F.col("conv_id") + F.col("turn"), ASKED)
    return t(spark, d, "conversations").select("conv_id", "turn", text.action(v).alias("action"), text.question_kind(v).alias("kind"))


#: Questions about calls, and the symbols that they name.
CALL_QUESTIONS = (
    ("who calls loadUser and do_it", "loadUser,do_it"), ("getUser 被谁调用", "getUser"), ("getUser 调用了谁", "getUser"), ("what does saveAll depends on callees", "saveAll"), ("where is loadUser called", "loadUser"), ("fooBar 怎么实现", "fooBar"),
    ("https://h.io/rest/userInfo/getUserAuthority?a=callMe&b=1 callers", "getUserAuthority,userInfo,callMe"), ("谁调用了 aB 又调用了谁", ""), ("class Foo function API", ""), ("loadUser LOADUSER loaduser", "loadUser"), ("hello there", ""),
)


def _score_sql(patterns) -> str:
    return " + ".join(f"{weight} * len(regexp_extract_all(v, '" + pattern.replace("'", "''") + "'))" for pattern, weight in patterns)


@query(f"""SELECT conv_id, turn, CASE WHEN up > down THEN 'callers' WHEN down > up THEN 'callees' ELSE 'both' END AS direction, symbols FROM (SELECT conv_id, turn, symbols, {_score_sql(questions.CALLERS)} AS up, {_score_sql(questions.CALLEES)} AS down
FROM (SELECT conv_id, turn, {dealt_sql("(conv_id + turn)", [q for q, _ in CALL_QUESTIONS])} AS v, {dealt_sql("(conv_id + turn)", [s for _, s in CALL_QUESTIONS])} AS symbols FROM conversations))""")
def call_questions(spark, d):
    q = dealt(F.col("conv_id") + F.col("turn"), [q for q, _ in CALL_QUESTIONS])
    return t(spark, d, "conversations").select("conv_id", "turn", questions.call_direction(q).alias("direction"), F.array_join(questions.symbol_tokens(q), ",").alias("symbols"))


#: Texts with every kind of separator.
WORDY = ("getUserName of HTTPServer", "handle_click-Event (the) 'big' one", "snake_case, kebab-case; v2.0!", "这 获取用户 a b", "user user User", "")
STOP = sql_list(text.STOP_WORDS)
TOKENS = "list_transform(list_filter(string_split_regex(regexp_replace(v, '(\\p{Lu})', ' \\1', 'g'), '[\\s,;.!?()\\[\\]{}<>''\"_-]+'), lambda w: w <> ''), lambda w: lower(w))"


@query(f"SELECT item_id, array_to_string({TOKENS}, ' ') AS tokens, array_to_string(list_sort(list_distinct(list_filter({TOKENS}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)))), ' ') AS terms FROM (SELECT item_id, {dealt_sql('item_id', WORDY)} || ' ' || text AS v FROM benchmark)")
def search_terms(spark, d):
    v = F.concat(dealt(F.col("item_id"), WORDY), F.lit(" "), F.col("text"))
    return t(spark, d, "benchmark").select("item_id", F.array_join(text.tokens(v), " ").alias("tokens"), F.array_join(F.array_sort(text.search_terms(v)), " ").alias("terms"))


LITERALS = ("/api/x", "https://a.io", "application/json", "a/b", "plain", "${base}", "ftp://x/y", "text/html", "")


@query(f"""SELECT event_id, ({matches("v", "^[a-zA-Z]+://")} OR (contains(v, '/') AND NOT {matches("v", "^(application|text|image|audio|video|multipart|font)/[a-z0-9.+*-]+$")})) OR (event_id % 2 = 0 AND {matches("v", "^[$][{][^}]+[}]$")}) AS accepted FROM (SELECT event_id, {dealt_sql("event_id", LITERALS)} AS v FROM events)""")
def accepted_urls(spark, d):
    return t(spark, d, "events").select("event_id", urls.accepts_url(dealt(F.col("event_id"), LITERALS), F.col("event_id") % 2 == 0).alias("accepted"))
