"""URLs that code builds: symbols of a repository, evaluated as strings.

Files are scanned one by one for symbols (constants, object properties,
functions with a returned expression); per repository only these rows come
together.  An expression is evaluated by its form: literals, templates, sums,
names, properties, calls with bound arguments, join, replace and trim,
conditionals (both ways).  What is only known at run time becomes ``:param``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions import urls
from tessera.operators import extract

#: Fixed limits: nesting, steps of one evaluation, ways that are followed.
MAX_DEPTH, MAX_HOPS, MAX_WAYS = 64, 200, 16
_CONST = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*")
_FUNCTION = re.compile(r"(?:function\s+([A-Za-z_$][\w$]*)\s*|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?)\(([^()]*)\)\s*(?::\s*[\w<>\[\]| ]+)?\s*(=>)?\s*(\{)?")
_PAIR = re.compile(r"\s*(?:([A-Za-z_$][\w$]*)|['\"]([^'\"]+)['\"])\s*:\s*")


def split_top(text: str, mask: str, by: str) -> list[str]:
    """Parts between separators outside of brackets and strings."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(mask):
        c = mask[i]
        depth += (c in "([{") - (c in ")]}")
        if not depth and c == by and not _in_string(mask, i):
            out.append(text[last:i])
            last = i + 1
        i += 1
    return [*out, text[last:]]


def _in_string(mask: str, at: int) -> bool:
    return any(mask.count(q, 0, at) % 2 for q in "'\"`")


def symbols(path: str, code: str) -> list[dict]:
    """name, params (null: no function), expression, line of a file's symbols; object properties as object.key."""
    rows = []
    for before, text in extract.script_blocks(path, code):
        mask = extract.masked(text)
        line = lambda at: text.count("\n", 0, at) + 1 + before  # noqa: B023, E731
        functions = set()
        for m in _FUNCTION.finditer(mask):
            name = m.group(1) or m.group(2)
            if m.group(2) and not m.group(4):
                continue
            if m.group(5):
                end = extract.block_end(mask, m.start(5))
                found = re.search(r"\breturn\b", mask[m.end() : end])
                if not found:
                    continue
                start = m.end() + found.end()
                stop = mask.find(";", start, end)
                expression = text[start : stop if stop >= 0 else end - 1]
            elif m.group(4):
                expression = text[m.end() : _expression_end(mask, m.end())]
            else:
                continue
            functions.add(name)
            rows.append({"name": name, "params": text[m.start(3) : m.end(3)], "expression": expression.strip(), "line": line(m.start())})
        for m in _CONST.finditer(mask):
            if m.group(1) in functions:
                continue
            if m.end() < len(mask) and mask[m.end()] == "{":
                end = extract.block_end(mask, m.end())
                inner, inner_mask = text[m.end() + 1 : end - 1], mask[m.end() + 1 : end - 1]
                at = 0
                for part in split_top(inner, inner_mask, ","):
                    p = _PAIR.match(part)
                    if p:
                        rows.append({"name": f"{m.group(1)}.{p.group(1) or p.group(2)}", "params": None, "expression": part[p.end() :].strip(), "line": line(m.end() + 1 + at)})
                    at += len(part) + 1
            else:
                rows.append({"name": m.group(1), "params": None, "expression": text[m.end() : _expression_end(mask, m.end())].strip(), "line": line(m.start())})
    return rows


def _expression_end(mask: str, start: int) -> int:
    depth = 0
    for k in range(start, len(mask)):
        depth += (mask[k] in "([{") - (mask[k] in ")]}")
        if depth < 0 or (depth == 0 and mask[k] == ";") or (depth == 0 and mask[k] == "\n" and mask[start:k].strip() and not mask[start:k].rstrip().endswith(("+", "?", ":", "=>", "("))):
            return k
    return len(mask)


class Evaluator:
    """Strings that an expression may give, from a table of name to (params, expression)."""

    def __init__(self, table: dict[str, tuple[str | None, str]]):
        self.table, self.hops = table, 0

    def strings(self, expression: str) -> list[str]:
        self.hops = 0
        return self._value(expression, {}, 0)

    def _value(self, text: str, bound: dict[str, list[str]], depth: int) -> list[str]:
        text = text.strip()
        self.hops += 1
        if depth > MAX_DEPTH or self.hops > MAX_HOPS or not text:
            return [":param"]
        mask = extract.masked(text)
        ask = split_top(text, mask, "?")
        if len(ask) == 2:
            ways = split_top(ask[1], extract.masked(ask[1]), ":")
            if len(ways) == 2:
                return [x for w in ways for x in self._value(w, bound, depth + 1)][:MAX_WAYS]
        parts = split_top(text, mask, "+")
        if len(parts) > 1:
            return self._joined([self._value(p, bound, depth + 1) for p in parts])
        if text[0] == "(" and extract.block_end(mask, 0) == len(text):
            return self._value(text[1:-1], bound, depth + 1)
        m = re.match(r"^(.*)\.(join|replace|trim|toString)\((.*)\)$", text, re.DOTALL)
        if m and extract.block_end(mask, m.start(3) - 1) == len(text):
            return self._method(m.group(1), m.group(2), m.group(3), bound, depth)
        if text[0] in "'\"" and text[-1] == text[0] and len(text) > 1:
            return [text[1:-1]]
        if text[0] == "`" and text[-1] == "`" and len(text) > 1:
            return self._template(text[1:-1], bound, depth)
        if text in bound:
            return bound[text]
        m = re.match(r"^([\w$.]+)\((.*)\)$", text, re.DOTALL)
        if m and m.group(1) in self.table and self.table[m.group(1)][0] is not None:
            params, body = self.table[m.group(1)]
            given = split_top(m.group(2), extract.masked(m.group(2)), ",") if m.group(2).strip() else []
            names = [re.split(r"[:=?]", p)[0].strip() for p in params.split(",") if p.strip()]
            return self._value(body, {n: self._value(given[i], bound, depth + 1) if i < len(given) else [":param"] for i, n in enumerate(names)}, depth + 1)
        if re.fullmatch(r"[\w$.]+", text) and text in self.table and self.table[text][0] is None:
            return self._value(self.table[text][1], {}, depth + 1)
        return [":param"]

    def _joined(self, ways: list[list[str]], by: str = "") -> list[str]:
        out = [""]
        for i, w in enumerate(ways):
            out = [a + (by if i else "") + b for a in out for b in w][:MAX_WAYS]
        return out

    def _method(self, owner: str, name: str, args: str, bound: dict, depth: int) -> list[str]:
        given = split_top(args, extract.masked(args), ",") if args.strip() else []
        if name == "join" and owner.strip().startswith("["):
            inner = owner.strip()[1:-1]
            by = self._value(given[0], bound, depth + 1)[0] if given else ","
            return self._joined([self._value(p, bound, depth + 1) for p in split_top(inner, extract.masked(inner), ",")], by)
        values = self._value(owner, bound, depth + 1)
        if name == "replace" and len(given) == 2:
            old, new = (self._value(g, bound, depth + 1)[0] for g in given)
            return [v.replace(old, new, 1) for v in values]
        return [v.strip() if name == "trim" else v for v in values]

    def _template(self, text: str, bound: dict, depth: int) -> list[str]:
        ways, at = [], 0
        for m in re.finditer(r"\$\{", text):
            if m.start() < at:
                continue
            end = extract.block_end(text, m.start() + 1)
            ways += [[text[at : m.start()]], self._value(text[m.end() : end - 1], bound, depth + 1)]
            at = end
        return self._joined([*ways, [text[at:]]])


def derived_urls(files: DataFrame) -> DataFrame:
    """repo_id, path, line, name, url of every symbol that evaluates to a path.

    files: repo_id, path, content.  A name defined in one file of the
    repository only, or in the same file, is known; other names are not.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"repo_id": i, "path": p, **r} for i, p, c in zip(pdf["repo_id"], pdf["path"], pdf["content"], strict=True) for r in symbols(p or "", c or "")]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "name", "params", "expression", "line"]).astype(object)

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        owners: dict[str, set] = {}
        for r in pdf.itertuples():
            owners.setdefault(r.name, set()).add(r.path)
        everywhere = {r.name: (r.params if isinstance(r.params, str) else None, r.expression) for r in pdf.itertuples() if len(owners[r.name]) == 1}
        out = []
        for path, own in pdf.groupby("path", sort=True):
            table = everywhere | {r.name: (r.params if isinstance(r.params, str) else None, r.expression) for r in own.itertuples()}
            evaluator = Evaluator(table)
            for r in own.itertuples():
                for value in evaluator.strings(r.expression):
                    if re.match(r"^(https?://[^/]+)?/[\w:$.-]", value):
                        out.append({"repo_id": r.repo_id, "path": path, "line": r.line, "name": r.name, "url": value})
        return pd.DataFrame(out, columns=["repo_id", "path", "line", "name", "url"])

    found = files.select("repo_id", "path", "content").mapInPandas(scan, "repo_id long, path string, name string, params string, expression string, line int")
    return found.groupBy("repo_id").applyInPandas(evaluate, "repo_id long, path string, line int, name string, url string").distinct()


def entry_points(values: DataFrame, target: str) -> DataFrame:
    """Symbols (id, kind, value: what it evaluates to) that hold parts of a target, with score: the share of its parts, a tenth more for functions; best first, of equal ones the smaller id.

    A target without parts has no entry points.
    """
    parts = [x.lower() for x in values.sparkSession.createDataFrame([(target,)], "u string").select(urls.path_segments(F.col("u"))).first()[0] or []]
    if not parts:
        return values.withColumn("score", F.lit(0.0)).limit(0)
    value = F.lower(F.coalesce("value", F.lit("")))
    hits = sum((F.contains(value, F.lit(x)).cast("int") for x in parts), F.lit(0))
    score = hits / len(parts) * F.when(F.col("kind") == "function", 1.1).otherwise(1.0)
    return values.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), "id")
