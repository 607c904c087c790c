"""Expressions over questions, embeddings' texts and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns that speak for callers or callees of a symbol, with their weights.
CALLERS = (
    (r"在哪(里|些)?(地方|文件|模块)?(被)?调用", 3),
    (r"被谁(调用|引用|使用|用到)", 3),
    (r"谁(在)?(调用|引用|使用|用到)了?", 3),
    (r"(哪些|什么)(地方|文件|模块|位置)(调用|引用|使用)", 2),
    (r"被(引用|调用|使用)", 2),
    (r"调用(方|点|处)", 2),
    (r"(?i)(who calls|called by|callers|usages|references)", 3),
    (r"(?i)\b(is|are|was|were)\s+[A-Za-z_$][\w$.]*\s+called\b", 3),
    (r"(?i)\bcalled\b", 1),
)
CALLEES = (
    (r"调用了?(谁|哪(些|个)|什么|哪些方法|哪些接口|哪些函数)", 3),
    (r"(依赖|依赖了|依赖于)(谁|哪(些|个)|什么)?", 3),
    (r"内部(调用|依赖)(了)?(谁|哪(些|个)|什么)?", 2),
    (r"会调用(哪些|什么|谁)", 2),
    (r"(?i)(calls into|depends on|callees|dependency)", 3),
    (r"(?i)\b(what|which)\s+(does|do|did)?\s*[A-Za-z_$][\w$.]*\s+calls?\b", 3),
)
#: Words that name no symbol.
NO_SYMBOLS = (
    "http", "https", "www", "com", "cn", "net", "org", "api", "rest", "the", "and", "for", "how", "what", "where", "which", "does", "is", "are", "this", "that", "code", "file",
    "function", "method", "class", "get", "post", "put", "delete", "v1", "v2", "v3",
)
#: Fixed value: addresses in a question.
ADDRESS = """(?i)https?://[^\\s"'<>）)】\\],，。；;]+"""


def _score(text: Column, patterns: tuple) -> Column:
    out = F.lit(0)
    for pattern, weight in patterns:
        out = out + F.regexp_count(text, F.lit(pattern)) * weight
    return out


def call_direction(question: Column) -> Column:
    """callers or callees, whichever the patterns found speak for with more weight; both if neither."""
    up, down = _score(question, CALLERS), _score(question, CALLEES)
    return F.when(up > down, "callers").when(down > up, "callees").otherwise("both")


def is_symbol(name: Column) -> Column:
    """3 to 80 signs with a capital inside or an underscore, and no common word; not three capitals or digits alone."""
    common = F.lower(name).isin(*NO_SYMBOLS) | (name.rlike("^[A-Z0-9_]+$") & (F.length(name) <= 3))
    return F.length(name).between(3, 80) & ~common & (name.rlike("^.+[A-Z]") | name.contains("_"))


def symbol_tokens(question: Column, most: int = 12) -> Column:
    """Names that a question may ask for, distinct without case, up to so many.

    First the last parts of addresses (those of later ones first), then their
    other parts from the end on and the values of their queries, then the
    identifiers in the rest of the text.
    """
    found = F.regexp_extract_all(question, F.lit(ADDRESS), F.lit(0))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    path = lambda url: F.filter(F.split(F.regexp_replace(F.regexp_replace(url, "(?i)^https?://[^/?#]*", ""), "[?#].*$", ""), "/"), lambda s: s != "")
    name = lambda part: F.regexp_replace(decoded(F.replace(part, F.lit("+"), F.lit("%2B"))), r"\.[A-Za-z0-9]+$", "")
    symbols = lambda names: F.filter(names, lambda x: x.rlike("^[A-Za-z_$][A-Za-z0-9_$-]*$") & is_symbol(x))
    last = F.flatten(F.transform(F.reverse(found), lambda u: symbols(F.transform(F.slice(F.reverse(path(u)), 1, 1), name))))
    values = lambda url: F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: decoded(F.regexp_extract(x, "=(.*)$", 1)))
    others = F.flatten(F.transform(found, lambda u: F.concat(symbols(F.transform(F.slice(F.reverse(path(u)), 2, 1 << 20), name)), F.filter(values(u), is_symbol))))
    rest = F.filter(F.regexp_extract_all(F.regexp_replace(question, ADDRESS, " "), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]{2,}"), F.lit(0)), is_symbol)
    every = F.concat(last, others, rest)
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def asked_method(question: Column) -> Column:
    """An HTTP method that stands as a word in a question, upper case; null without one."""
    return F.upper(F.nullif(F.regexp_extract(question, r"(?i)\b(get|post|put|delete|patch)\b", 1), F.lit("")))


def asked_path(question: Column) -> Column:
    """The first path in a question; null without one."""
    return F.nullif(F.regexp_extract(question, r"(/[A-Za-z0-9_:{}/.-]+)", 1), F.lit(""))


def embedding_text(kind: str, **columns: Column) -> Column:
    """What is embedded of an entity of a kind; missing parts are left out."""
    order = {"function": ("name", "signature", "code"), "class": ("name", "kind", "code"), "constant": ("name", "value"), "url": ("method", "pattern"), "chunk": ("name", "code")}[kind]
    return F.substring(F.concat_ws("\n", *(columns[c] for c in order if c in columns)), 1, 8000)


def project_path(url: Column) -> Column:
    """group/project of a repository address."""
    plain = F.regexp_replace(F.regexp_replace(url, "^(https?://[^/]+/|git@[^:]+:)", ""), r"(/-/.*|\.git|/)$", "")
    return plain


def project_host(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:https?://|git@)(?:[^@/]*@)?([^/:]+)", 1)


def decoded_segments(url: Column) -> Column:
    """Path parts, %xx decoded; a part that is not decodable stays as it is."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", ""), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))


def prompt_block(number: Column, path: Column, first: Column, last: Column, content: Column) -> Column:
    """One numbered evidence block of a prompt."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"), F.substring(content, 1, 2000))
