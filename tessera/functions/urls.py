"""URL and path expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Fixed patterns: identifiers in paths.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def normalize_url_pattern(url: Column) -> Column:
    """UUIDs become :id; then path parts of 20 or more hex digits (of any case), or of digits, become /:id."""
    out = F.regexp_replace(url, f"(?i){UUID}", ":id")
    out = F.regexp_replace(out, "(?i)/[0-9a-f]{20,}", "/:id")
    return F.regexp_replace(out, "/[0-9]+", "/:id")


def strip_origin(url: Column) -> Column:
    """Without scheme and host."""
    return F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_replace(strip_origin(url), "[?#].*$", "")


def normalize_target(text: Column) -> Column:
    """Lower-case path without query, fragment and outer slashes."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, "[?#].*$", ""))), "^/+|/+$", "")


def segments(path: Column) -> Column:
    """Non-empty path parts."""
    return F.filter(F.split(path_of(path), "/"), lambda s: s != "")


def usable_segments(path: Column) -> Column:
    """Trimmed lower-case parts of two characters or more."""
    return F.filter(F.transform(segments(path), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) >= 2)


def path_segments(url: Column) -> Column:
    """Parts with identifiers named: digits :id, 20 or more hex digits :token, UUIDs :uuid; other parts of up to two signs go, v1 and the like stay."""
    named = F.transform(
        segments(url),
        lambda s: F.when(s.rlike("^[0-9]+$"), ":id").when(F.lower(s).rlike(f"^{UUID}$"), ":uuid").when(F.lower(s).rlike("^[0-9a-f]{20,}$"), ":token").otherwise(s),
    )
    return F.filter(named, lambda s: s.rlike("^v[0-9]+$") | ~s.rlike("^[A-Za-z0-9]{1,2}$"))


def normalize_indexed_url(url: Column) -> Column:
    """Index form: no origin, no placeholder in front, ids as :id, ${xId} as :xId, single slashes, none outside."""
    out = F.regexp_replace(strip_origin(url), r"^\$\{[^}]*\}", "")
    out = F.regexp_replace(F.regexp_replace(out, UUID, ":id"), "/[0-9]+(/|$)", "/:id$1")
    out = F.regexp_replace(out, r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", ":$1")
    return F.regexp_replace(F.regexp_replace(out, "/+", "/"), "^/|/$", "")


def accepts_url(value: Column, trusted: Column) -> Column:
    """Whether a string is taken for a URL: a scheme or a slash, no MIME type; a placeholder alone only from a trusted call."""
    mime = value.rlike("^(application|text|image|audio|video|multipart|font)/[a-z0-9.+*-]+$")
    return (value.rlike("^[a-zA-Z]+://") | (value.contains("/") & ~mime)) | (trusted & value.rlike(r"^\$\{[^}]+\}$"))


def http_method(text: Column) -> Column:
    """The first of the known methods that the text contains, by their order; null without any."""
    out = F.lit(None).cast("string")
    for method in reversed(METHODS):
        out = F.when(F.upper(text).contains(method), method).otherwise(out)
    return out


def path_params(pattern: Column) -> Column:
    """Names of :name and {name} parts, in order."""
    found = F.regexp_extract_all(pattern, F.lit(r"[:{]([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(found)


def template_components(template: Column) -> Column:
    """Array of (type, value): literals and ${…} variables in turn, empty literals left out."""
    literals = F.split(template, r"\$\{[^}]*\}", -1)
    names = F.regexp_extract_all(template, F.lit(r"\$\{([^}]*)\}"), F.lit(1))
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    both = F.transform(literals, lambda x, i: F.array(part("literal", x), part("variable", F.get(names, i))))
    return F.filter(F.flatten(both), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def is_placeholder(segment: Column) -> Column:
    """${x}, :x, {x} and <x> stand for any value; a name after a colon is an identifier."""
    return segment.rlike(r"^(\$\{[^}]+\}|:[a-zA-Z_][a-zA-Z0-9_]*|\{[^}]+\}|<[^>]+>)$")


def is_wild(segment: Column) -> Column:
    """A part with anything after a leading colon stands for any value: :id, and :id.html of a normalised /7.html."""
    return segment.rlike(r"^:[^\n]+\z")


def matched_parts(url: Column) -> Column:
    """Non-empty parts after an http origin; a query stays with its part."""
    return F.filter(F.split(F.regexp_replace(url, "^https?://[^/]+", ""), "/"), lambda s: s != "")


def template_match(url: Column, template: Column) -> Column:
    """Struct (score, params): parts must agree one to one without case, placeholders take any part; null if they don't.

    The score is the share of literal parts that agree, so it is 1 for every
    match; of a name that occurs twice the last value stays.
    """
    u, t = matched_parts(url), matched_parts(template)
    pairs = F.zip_with(u, t, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fits = (F.size(u) == F.size(t)) & (F.size(t) > 0) & F.forall(pairs, lambda p: is_placeholder(p["b"]) | (F.lower(p["a"]) == F.lower(p["b"])))
    named = F.transform(F.filter(pairs, lambda p: is_placeholder(p["b"])), lambda p: F.struct(F.regexp_replace(p["b"], r"^(\$\{|[:{<])|[}>]$", "").alias("name"), p["a"].alias("value")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda y: y["name"] == x["name"]))
    params = F.map_from_arrays(F.transform(last, lambda x: x["name"]), F.transform(last, lambda x: x["value"]))
    return F.when(fits, F.struct(F.lit(1.0).alias("score"), params.alias("params")))


def url_similarity(a: Column, b: Column) -> Column:
    """Aligned parts that are equal without case over the longer number of parts; 0 if both are empty."""
    x, y = matched_parts(a), matched_parts(b)
    most = F.greatest(F.size(x), F.size(y))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.lower(p).eqNullSafe(F.lower(q)) & p.isNotNull()), lambda s: s))
    return F.when(most == 0, 0.0).otherwise(same / most)


def segment_score(base: float, query: Column, matched: Column, candidate: Column) -> Column:
    """base x share of query parts matched x query parts over the longer number of parts."""
    n, m = F.size(query), F.size(segments(candidate))
    return F.when(n == 0, 0.0).otherwise(F.lit(base) * (matched / n) * (n / F.greatest(n, m)))


def suffix_match_score(url: Column, pattern: Column, wild: Callable[[Column], Column] = lambda s: is_placeholder(s) | is_wild(s)) -> Column:
    """A pattern's parts against the last parts of a URL: 2 for each literal, 1 more if all are literal and the lengths agree; null if one differs.

    wild tells the parts that are no literals.
    """
    u, p = segments(url), segments(pattern)
    tail = F.slice(u, F.greatest(F.size(u) - F.size(p) + 1, F.lit(1)), F.greatest(F.size(p), F.lit(1)))
    pairs = F.zip_with(tail, p, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fits = (F.size(p) > 0) & (F.size(u) >= F.size(p)) & F.forall(pairs, lambda x: wild(x["b"]) | (x["a"] == x["b"]))
    literal = F.size(F.filter(p, lambda x: ~wild(x)))
    return F.when(fits, literal * 2 + ((literal == F.size(p)) & (F.size(u) == F.size(p))).cast("int"))


def version_family(query: Column, candidate: Column) -> Column:
    """Whether the query has v1 or the like where the candidate has a placeholder."""
    pairs = F.zip_with(matched_parts(query), matched_parts(candidate), lambda a, b: F.coalesce(a.rlike("^v[0-9]+$"), F.lit(False)) & F.coalesce(is_placeholder(b), F.lit(False)))
    return F.exists(pairs, lambda x: x)


def match_confidence(url: Column, pattern: Column) -> Column:
    """0 to 100: exact 100; a template part by part, literal 1 and placeholder a half; else equal aligned parts over the longer."""
    t = template_match(url, pattern)
    p = matched_parts(pattern)
    weight = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(is_placeholder(x), 0.5).otherwise(1.0)) / F.size(p)
    return F.when(url == pattern, 100).otherwise(F.floor(F.when(t.isNotNull(), weight).otherwise(url_similarity(url, pattern)) * 100 + 0.5)).cast("int")


def normalize_tail(path: Column) -> Column:
    """${…} as :param, no query, no trailing slash, one leading slash."""
    out = F.regexp_replace(F.regexp_replace(path, r"\$\{[^}]*\}", ":param"), "[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(out, "^/+|/+$", ""))


def looks_like_url(text: Column) -> Column:
    """An http address, or anywhere two path parts in a row."""
    # fixed values: the characters of a path part
    return text.rlike(r"^https?://") | text.rlike(r"/[A-Za-z0-9_\-.:{}$]+/[A-Za-z0-9_\-.:{}$]+")


def interface_group(path: Column) -> Column:
    """External URLs together, two parts under rest and plugin, else the first part."""
    p = segments(path)
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return (
        F.when(path.rlike("^https?://"), "external")
        .when(first.isin("rest", "plugin") & second.isNotNull(), F.concat(F.lit("/"), first, F.lit("/"), second))
        .when(first.isNotNull(), F.concat(F.lit("/"), first))
        .otherwise("/")
    )


#: Patterns of route definitions, and of calls by a client.
ROUTE = r"(?i)\b(router|app|route|server|express)\s*\.\s*(get|post|put|patch|delete|all|use|head|options)\s*\("
CLIENT = r"(?i)(axios|fetch|got|superagent|request|ky|needle|urllib)"
CLIENT_METHOD = r"(?i)\b(this\.)?(client|http|httpclient|apiclient|api|request|instance|agent|ajax|rpc)\s*\.\s*(get|post|put|patch|delete|head|options|request)\s*\("


def usage_context(code: Column) -> Column:
    """route_definition, api_call, router (in lower case) or unknown, by the first that fits."""
    return F.when(code.rlike(ROUTE), "route_definition").when(code.rlike(CLIENT) | code.rlike(CLIENT_METHOD), "api_call").when(code.contains("router"), "router").otherwise("unknown")


def classify_undecided(path: Column, definition_file: Column) -> Column:
    """interface, not-interface or unknown for an inventory row without a method, by the first rule that fits."""
    real, file = F.coalesce(path, F.lit("")), F.coalesce(definition_file, F.lit(""))
    return (
        F.when(real.rlike("(?i)^https?://"), "not-interface")
        .when(file.contains("vite.config") | file.contains("router/routes"), "not-interface")
        .when(file.contains("initializeRootMenu") | file.contains("AppCreated"), "not-interface")
        .when(real == "/Read/Write", "not-interface")
        .when(real.startswith("/plugin/api/") | real.startswith("/rest/"), "interface")
        .otherwise("unknown")
    )


def constant_type_sql(value: Column) -> Column:
    """Constant kinds as the database function tells them (fixed values: its patterns)."""
    return (
        F.when(value.rlike("^(https?://|/[a-z])"), "url_segment").when(value.rlike("^E[0-9]+$"), "error_code").when(value.contains(":"), "event_name")
        .when(value.rlike(r"^\."), "css_class").when(value.rlike("^[A-Z_]+$"), "env_var").otherwise("string")
    )


def constant_type_indexed(value: Column) -> Column:
    """Constant kinds as the indexer tells them (fixed values: its patterns): URL test without case, css also with a dash, paths of any case."""
    return (
        F.when(value.rlike("(?i)^(https?://|/[a-z])"), "url_segment").when(value.rlike("^E[0-9]+$"), "error_code").when(value.contains(":"), "event_name")
        .when(value.rlike(r"^[.\-]"), "css_class").when(value.rlike("^[A-Z_]+$"), "env_var").when(value.rlike(r"(?i)^/[a-z0-9\-_/]+$"), "api_path").otherwise("string")
    )


def redact_credentials(url: Column) -> Column:
    """User and token of a URL masked."""
    return F.regexp_replace(url, "://[^/@]+@", "://***@")


def repository_name(source: Column) -> Column:
    """Last part, lower case, without .git or .zip."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(source, "/+$", ""), r"\.(git|zip)$", ""), "^.*[/:]", ""))
