"""Text, vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no meaning in a search; English, Chinese, Japanese.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "should", "could", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "那", "里", "什么", "如何", "怎么", "为什么",
    "の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ",
    "ある", "いる", "も", "する", "から", "な", "こと", "として", "い", "や",
)
#: Frequent misspellings.
TYPOS = {
    "fucntion": "function", "funciton": "function", "retrun": "return", "reutrn": "return", "cosnt": "const", "conts": "const", "improt": "import", "imoprt": "import", "exoprt": "export", "exprot": "export",
    "calss": "class", "clsas": "class", "interfce": "interface", "interafce": "interface", "asynch": "async", "awiat": "await", "promies": "promise", "promse": "promise", "obejct": "object", "ojbect": "object",
    "arary": "array", "arry": "array", "lenght": "length", "heigth": "height", "widht": "width", "gt": "get", "pst": "post", "delte": "delete", "delet": "delete",
    "athentication": "authentication", "authetication": "authentication", "autorization": "authorization", "authroization": "authorization", "valiation": "validation", "validtion": "validation",
}


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def normalize_code(code: Column) -> Column:
    """Without // and /* */ comments, blanks squeezed."""
    out = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"//[^\n]*", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct 3-character pieces of the lower-case words, each with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all of both; arguments are trigram arrays."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def correct_typos(text: Column) -> Column:
    """Known misspellings replaced word by word."""
    table = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.coalesce(table[F.lower(w)], w)), " ")


def keywords(text: Column) -> Column:
    """Distinct lower-case parts of camelCase, snake_case and dashed words."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(split), r"[_\-\s]+"), lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Lower-case tokens: cut at blanks, punctuation, _ and -, and before every capital letter.

    Scripts without blanks are not segmented: that takes a dictionary, which is
    up to the caller.
    """
    parts = F.split(F.regexp_replace(text, r"(\p{Lu})", " $1"), r"""[\s,;.!?()\[\]{}<>'"_-]+""")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.lower(w))


def search_terms(text: Column) -> Column:
    """Distinct tokens of more than one sign that are no stop words."""
    return F.array_except(F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) > 1)), F.array(*(F.lit(x) for x in STOP_WORDS)))


def context_lines(content: Column, first: Column, last: Column, around: int = 5) -> Column:
    """Lines first-around to last+around of a text, cut at its ends."""
    lines = F.split(content, "\n")
    low = F.greatest(first - around, F.lit(1))
    high = F.least(last + around, F.size(lines))
    return F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round2(x: Column) -> Column:
    """Half up, as whole hundredths."""
    return F.floor(x * 100 + 0.5) / 100


def intent(query: Column) -> Column:
    """Struct (kind, confidence), by fixed patterns: url, function, class, constant or general, by the first pattern that fits."""
    of = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    url = query.rlike(r"(?i)/(api|rest|v\d+|graphql|endpoint)/|:\w+|/\{|\bhttps?://") | query.rlike("(?i)^/[a-z0-9_-]+/[a-z0-9_-]+") | query.rlike(r"(?i)/(get|post|put|delete|patch)\b")
    return (
        F.when(url, of("url", 0.9)).when(query.rlike(r"\w+\s*\(|function\s+\w+|=>\s*\{"), of("function", 0.85)).when(query.rlike(r"(?i)class\s+\w+|interface\s+\w+|type\s+\w+"), of("class", 0.85))
        .when(query.rlike(r"^[A-Z_]+$|^E\d+$"), of("constant", 0.8)).otherwise(of("general", 0.5))
    )


#: Fixed order: the first contained word decides.
ACTIONS = (
    ("位置", "find_usages"), ("在哪", "find_usages"), ("哪里调用", "find_usages"), ("调用", "find_usages"), ("使用", "find_usages"), ("引用", "find_usages"), ("定义", "find_definition"), ("实现", "find_implementations"), ("谁调用", "find_callers"),
    ("usage", "find_usages"), ("usages", "find_usages"), ("where", "find_usages"), ("called", "find_usages"), ("references", "find_usages"), ("definition", "find_definition"), ("implementation", "find_implementations"), ("callers", "find_callers"),
)
#: Fixed order: the first matching pattern decides.
QUESTION_KINDS = (
    ("code_location", "在哪|位置|文件|哪个文件|定义在"), ("implementation", "如何实现|怎么实现|怎样实现|实现方式|实现逻辑|怎么做|如何处理"), ("architecture", "架构|设计|模式|结构|组织方式|整体.*流程|系统.*设计"),
    ("bug_analysis", "为什么|原因|bug|问题|错误|异常|失败|不work|不生效|没有.*效果"), ("usage_example", "如何使用|怎么用|用法|示例|例子|调用方式"), ("comparison", "区别|差异|对比|比较|和.*有什么不同|vs"),
)
LISTING = ("列出|列举|罗列|枚举|清单|有哪些|都有什么|一共有|总共有|总共|多少个|有几个|几个接口", r"(?i)(接口|端点|api\b|api列表|url|路由|endpoint)")


def action(query: Column) -> Column:
    """What a question asks for."""
    out = F.lit("general_search")
    for word, name in reversed(ACTIONS):
        out = F.when(F.lower(query).contains(word), name).otherwise(out)
    return out


#: Fixed value: what makes a question one about a URL.
URL_QUESTION = r"(?i)/(api|rest|v\d+|graphql)/|:\w+|/\{|\bhttps?://"


def question_kind(query: Column) -> Column:
    """Kind of a question: listings first, then URLs, then the patterns in order."""
    out = F.lit("general")
    for name, pattern in reversed(QUESTION_KINDS):
        out = F.when(query.rlike(pattern), name).otherwise(out)
    return F.when(query.rlike(LISTING[0]) & query.rlike(LISTING[1]), "enumeration").when(query.rlike(URL_QUESTION), "url_lookup").otherwise(out)


#: Fixed order: the first matching pattern decides what a question is treated as.
TASK_TYPES = (("root_cause_analysis", "为什么|原因|bug|问题|错误|异常|失败"), ("impact_analysis", "影响|修改.*会|如果.*改"), ("architecture_analysis", "架构|设计|模式|结构|整体"))


def task_type(query: Column) -> Column:
    """root_cause_analysis, impact_analysis, architecture_analysis or general_query, by the first pattern that fits."""
    out = F.lit("general_query")
    for name, pattern in reversed(TASK_TYPES):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def session_id(value: Column) -> Column:
    """Trimmed, up to 128 signs; null for a blank one."""
    return F.nullif(F.substring(F.trim(value), 1, 128), F.lit(""))


def citations(answer: Column) -> Column:
    """Array of (path, first, last) of path.ext:line or path.ext:line-line, not after a colon."""
    found = F.regexp_extract_all(answer, F.lit(r"(?:^|[^:\w./-])([\w./-]+\.[A-Za-z]+:[0-9]+(?:-[0-9]+)?)"), F.lit(1))
    first = lambda x: F.regexp_extract(x, ":([0-9]+)", 1).cast("int")
    last = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "-([0-9]+)$", 1), F.lit("")).cast("int"), first(x))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^(.*):[0-9]", 1).alias("path"), first(x).alias("first"), last(x).alias("last")))


def same_file(evidence: Column, cited: Column) -> Column:
    """Equal after dropping ./ and a leading slash, or the evidence's path ends with the cited one."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+", "")
    return (plain(evidence) == plain(cited)) | F.endswith(plain(evidence), F.concat(F.lit("/"), plain(cited)))
