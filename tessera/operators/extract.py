"""Code entities from source text: chunks, functions, classes, constants, imports, URLs.

A scanner masks strings and comments and matches brackets; declarations are
found by patterns on the masked text.  It knows TypeScript, JavaScript and the
script blocks of Vue files.  Each function takes one file and gives rows; the
DataFrame operators run them over files (path, content) in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed limit: bytes of a fallback chunk and of a constant's value.
MODULE_BYTES, CONSTANT_BYTES = 8000, 2000
_BLOCK = re.compile(r"<script\b[^>]*>(.*?)</script>", re.DOTALL | re.IGNORECASE)
_OPEN, _CLOSE = "([{", ")]}"


def masked(code: str) -> str:
    """The code with comments and the insides of strings blanked, at the same offsets."""
    out, i, n = list(code), 0, len(code)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = code[i : i + 2]
        if two == "//":
            j = code.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
        elif two == "/*":
            j = code.find("*/", i + 2)
            j = n if j < 0 else j + 2
            blank(i, j)
        elif code[i] in "'\"`":
            j = i + 1
            while j < n and code[j] != code[i]:
                j += 2 if code[j] == "\\" else 1
            blank(i + 1, j)
            j += 1
        else:
            j = i + 1
        i = j
    return "".join(out)


def block_end(mask: str, start: int) -> int:
    """Offset after the bracket that closes the one at start."""
    depth = 0
    for k in range(start, len(mask)):
        if mask[k] in _OPEN:
            depth += 1
        elif mask[k] in _CLOSE:
            depth -= 1
            if not depth:
                return k + 1
    return len(mask)


def script_blocks(path: str, code: str) -> list[tuple[int, str]]:
    """(lines before, code) of a file's scripts: the whole file, or a Vue file's script blocks."""
    if not path.endswith(".vue"):
        return [(0, code)]
    return [(code.count("\n", 0, m.start(1)), m.group(1)) for m in _BLOCK.finditer(code)]


def _line(code: str, offset: int) -> int:
    return code.count("\n", 0, offset) + 1


_DECLARATIONS = (
    ("function", re.compile(r"(export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*(\()")),
    ("function", re.compile(r"(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(async\s*)?(?:(\()[^()]*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^=]+)?=>")),
    ("class", re.compile(r"(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?(?:\s+implements\s+([\w$.,\s]+?))?\s*(\{)")),
    ("interface", re.compile(r"(export\s+)?interface\s+([A-Za-z_$][\w$]*)[^{]*(\{)")),
    ("enum", re.compile(r"(export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)\s*(\{)")),
    ("type", re.compile(r"(export\s+)?type\s+([A-Za-z_$][\w$]*)(?:<[^>]*>)?\s*=")),
)
_METHOD = re.compile(r"(?m)^\s*(?:(public|private|protected)\s+)?(?:static\s+)?(async\s+)?(?:get\s+|set\s+)?([A-Za-z_$][\w$]*)\s*(\()[^()]*\)\s*(?::\s*[^{;]+)?\{")
_VARIABLE = re.compile(r"(?m)^(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)")
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor"}


def _statement_end(mask: str, start: int) -> int:
    depth = 0
    for k in range(start, len(mask)):
        if mask[k] in _OPEN:
            depth += 1
        elif mask[k] in _CLOSE:
            depth -= 1
        if depth < 0 or (depth == 0 and (mask[k] == ";" or (mask[k] == "\n" and mask[k - 1] in "}'\"`);"))):
            return k
    return len(mask)


def entities(path: str, code: str) -> list[dict]:
    """kind, name, parent, line_start, line_end, exported, is_async, visibility, complexity, code of each declaration; unparsable code gives none."""
    found: dict[tuple, dict] = {}
    for before, text in script_blocks(path, code):
        mask = masked(text)

        def add(kind: str, name: str, a: int, b: int, **more) -> None:
            first, last = _line(text, a) + before, _line(text, max(a, b - 1)) + before
            row = {"kind": kind, "name": name, "parent": None, "line_start": first, "line_end": last, "exported": False, "is_async": False, "visibility": None, "complexity": complexity(mask[a:b]), "code": text[a:b]}
            found.setdefault((name, first, last), row | more)

        for kind, pattern in _DECLARATIONS:
            for m in pattern.finditer(mask):
                exported = m.group(1) is not None
                if pattern is _DECLARATIONS[0][1]:
                    body = mask.find("{", block_end(mask, m.start(4)))
                    add(kind, m.group(3), m.start(), block_end(mask, body) if body >= 0 else m.end(), exported=exported, is_async=m.group(2) is not None)
                elif pattern is _DECLARATIONS[1][1]:
                    rest = mask[m.end() :]
                    body = m.end() + len(rest) - len(rest.lstrip())
                    end = block_end(mask, body) if body < len(mask) and mask[body] == "{" else _statement_end(mask, body)
                    add(kind, m.group(2), m.start(), end, exported=exported, is_async=m.group(3) is not None)
                elif kind == "type":
                    add(kind, m.group(2), m.start(), _statement_end(mask, m.end()), exported=exported)
                else:
                    end = block_end(mask, m.end() - 1)
                    add(kind, m.group(2), m.start(), end, exported=exported)
                    if kind == "class":
                        for x in _METHOD.finditer(mask, m.end(), end):
                            if x.group(3) not in _WORDS - {"constructor"}:
                                add("method", x.group(3), x.start(3), block_end(mask, x.end() - 1), parent=m.group(2), is_async=x.group(2) is not None, visibility=x.group(1) or "public")
        for m in _VARIABLE.finditer(mask):
            end = _statement_end(mask, m.end())
            first = _line(text, m.start()) + before
            if not any(r["name"] == m.group(2) and r["line_start"] == first for r in found.values()):
                add("variable", m.group(2), m.start(), end, exported=m.group(1) is not None)
    return sorted(found.values(), key=lambda r: (r["line_start"], r["line_end"], r["name"]))


def complexity(mask: str) -> int:
    """One and the branches, loops, cases and logical operators."""
    return 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", mask))


def chunks(path: str, code: str) -> list[dict]:
    """name, type, line_start, line_end, code: the file's entities, or one module chunk without any."""
    rows = [{"name": r["name"], "type": r["kind"], "line_start": r["line_start"], "line_end": r["line_end"], "code": r["code"]} for r in entities(path, code)]
    if rows or not code.strip():
        return rows
    cut = code.encode()[:MODULE_BYTES].decode(errors="ignore")
    if len(cut) < len(code) and "\n" in cut:
        cut = cut[: cut.rindex("\n")]
    return [{"name": path.rsplit("/", 1)[-1], "type": "module", "line_start": 1, "line_end": cut.count("\n") + 1, "code": cut}]


_CONSTANT = re.compile(r"(?m)(export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(['\"`])((?:\\.|(?!\3).)*)\3")
_PROPERTY = re.compile(r"([A-Za-z_$][\w$]*|['\"][^'\"]+['\"])\s*[:=]\s*(['\"`])((?:\\.|(?!\2).)*)\2")
_CONTAINER = re.compile(r"(export\s+)?(?:const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=|(?:const\s+)?enum\s+([A-Za-z_$][\w$]*))\s*(\{)")


def constants(path: str, code: str) -> list[dict]:
    """name, value, parent, line, exported of string constants: variables, object properties, enum members."""
    rows = []
    for before, text in script_blocks(path, code):
        mask = masked(text)
        for m in _CONSTANT.finditer(text):
            if mask[m.start(2)] != " " and len(m.group(4).encode()) <= CONSTANT_BYTES:
                rows.append({"name": m.group(2), "value": m.group(4), "parent": None, "line": _line(text, m.start()) + before, "exported": m.group(1) is not None})
        for m in _CONTAINER.finditer(mask):
            end = block_end(mask, m.start(4))
            for x in _PROPERTY.finditer(text, m.end(), end):
                if mask[x.start(1)] != " " and len(x.group(3).encode()) <= CONSTANT_BYTES:
                    rows.append({"name": x.group(1).strip("'\""), "value": x.group(3), "parent": m.group(2) or m.group(3), "line": _line(text, x.start()) + before, "exported": m.group(1) is not None})
    return rows


_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(.+?)\s+from\s+)?['\"]([^'\"]+)['\"]", re.DOTALL)
_REQUIRE = re.compile(r"(?:const|let|var)\s+(\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")


def imports(path: str, code: str) -> list[dict]:
    """symbol, alias, import_type (default, namespace, named, side_effect, require), target, line."""
    rows = []
    for before, text in script_blocks(path, code):
        mask = masked(text)
        for m in _IMPORT.finditer(text):
            if mask[m.start()] != "i":
                continue
            base = {"target": m.group(2), "line": _line(text, m.start()) + before}
            what = m.group(1)
            if not what:
                rows.append(base | {"symbol": None, "alias": None, "import_type": "side_effect"})
                continue
            for part in re.findall(r"\{[^}]*\}|[^,{}]+", what):
                part = part.strip()
                if part.startswith("{"):
                    for name in filter(None, (x.strip() for x in part[1:-1].split(","))):
                        symbol, _, alias = re.sub(r"^type\s+", "", name).partition(" as ")
                        rows.append(base | {"symbol": symbol.strip(), "alias": alias.strip() or None, "import_type": "named"})
                elif part.startswith("*"):
                    rows.append(base | {"symbol": "*", "alias": part.split(" as ")[-1].strip(), "import_type": "namespace"})
                elif part:
                    rows.append(base | {"symbol": "default", "alias": part, "import_type": "default"})
        for m in _REQUIRE.finditer(text):
            if mask[m.start()] == " ":
                continue
            names = [x.strip() for x in m.group(1).strip("{}").split(",")] if m.group(1).startswith("{") else [m.group(1)]
            for name in filter(None, names):
                symbol, _, alias = name.partition(":")
                rows.append({"symbol": symbol.strip(), "alias": alias.strip() or None, "import_type": "require", "target": m.group(2), "line": _line(text, m.start()) + before})
    return rows


_CALL = re.compile(r"\b([\w$.]+)\s*\.\s*(get|post|put|delete|patch|request)\s*(?:<[^>]*>)?\s*\(\s*(['\"`])((?:\\.|(?!\3).)*)\3|\b(fetch|request|axios|got)\s*\(\s*(['\"`])((?:\\.|(?!\6).)*)\6", re.IGNORECASE)


def url_calls(path: str, code: str) -> list[dict]:
    """url, method, line, is_route of calls and route definitions with a literal URL."""
    rows = []
    for before, text in script_blocks(path, code):
        mask = masked(text)
        for m in _CALL.finditer(text):
            if mask[m.start()] == " ":
                continue
            owner, verb, url = m.group(1), m.group(2), m.group(4) or m.group(7) or ""
            trusted = owner is None
            if "/" in url and not re.match(r"^(application|text|image|audio|video|multipart|font)/[\w.+*-]+$", url) or trusted and re.fullmatch(r"\$\{[^}]+\}", url):
                route = bool(owner) and re.search(r"\b(router|app|route|server|express)$", owner, re.IGNORECASE) is not None
                method = verb.upper() if verb and verb.lower() != "request" else None
                rows.append({"url": url, "method": method, "line": _line(text, m.start()) + before, "is_route": route})
    return rows


SCHEMAS = {
    entities: "kind string, name string, parent string, line_start int, line_end int, exported boolean, is_async boolean, visibility string, complexity int, code string",
    chunks: "name string, type string, line_start int, line_end int, code string",
    constants: "name string, value string, parent string, line int, exported boolean",
    imports: "symbol string, alias string, import_type string, target string, line int",
    url_calls: "url string, method string, line int, is_route boolean",
}


def extract(files: DataFrame, of: Callable[[str, str], list[dict]]) -> DataFrame:
    """path and the rows of ``of`` for each file (path, content); a file that fails to parse gives none."""
    names = [x.split()[0] for x in SCHEMAS[of].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, **r} for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in of(p or "", c or "")]
            yield pd.DataFrame(rows, columns=["path", *names]).astype(object)

    return files.select("path", "content").mapInPandas(run, f"path string, {SCHEMAS[of]}")
