"""Text kernels as Catalyst expressions: cleaning, hashing, dates, anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchor terms (group, term, rule) in rule order, and which groups the three anchor versions take.
ANCHORS = [
    ("AI", "人工智能", "substring"), ("AI", "artificial intelligence", "phrase"), ("AI", "ai", "phrase"),
    ("ML", "机器学习", "substring"), ("ML", "machine learning", "phrase"), ("ML", "ml", "phrase"),
    ("NLP", "自然语言处理", "substring"), ("NLP", "natural language processing", "phrase"), ("NLP", "nlp", "phrase"),
    ("CVISION", "计算机视觉", "substring"), ("CVISION", "computer vision", "phrase"),
    ("CIMAGE", "图像识别", "substring"), ("CIMAGE", "image recognition", "phrase"),
    ("LLM", "大语言模型", "substring"), ("LLM", "大型语言模型", "substring"), ("LLM", "large language model", "plural"), ("LLM", "llm", "plural"),
    ("TRANS", "模型", "after transformer"), ("TRANS", "架构", "after transformer"),
    ("TRANS", "transformer model", "plural"), ("TRANS", "transformer architecture", "plural"),
]
# The groups of each anchor version.
_GROUPS = {"main": ["AI", "ML", "NLP", "CVISION", "CIMAGE", "LLM", "TRANS"], "cn_paper": ["AI", "ML", "NLP", "CIMAGE"], "babina": ["AI", "ML", "NLP", "CVISION"]}
VERSIONS = {name: [a for a in ANCHORS if a[0] in groups] for name, groups in _GROUPS.items()}
# Bits of the anchor groups.
GROUP_BITS = {"AI": 1, "ML": 2, "NLP": 4, "CVISION": 8, "CIMAGE": 16, "LLM": 32, "TRANS": 64}


def pattern(term: str, rule: str) -> str:
    """A Java regex over lower-cased text; phrases may be joined by blanks or hyphens and stand between non-alphanumerics."""
    gaps = "[\\s\\-]+".join(term.split())
    match rule:
        case "substring":
            return term
        case "phrase":
            return f"(?<![a-z0-9]){gaps}(?![a-z0-9])"
        case "plural":
            return f"(?<![a-z0-9]){gaps}s?(?![a-z0-9])"
        case "after transformer":
            return f"(?<![a-z0-9])transformer[\\s\\-]*{term}"
    raise ValueError(rule)


def anchor_groups(text: Column, anchors: list[tuple[str, str, str]] = ANCHORS) -> Column:
    """Distinct groups of the anchors in text, in rule order."""
    low = F.lower(text)
    return F.array_distinct(F.filter(F.array(*[F.when(low.rlike(pattern(t, r)), g) for g, t, r in anchors]), lambda x: x.isNotNull()))


def anchor_hits(text: Column, anchors: list[tuple[str, str, str]] = ANCHORS) -> Column:
    """(flag, groups, surfaces): the distinct groups and the distinct spellings that occur, both in rule order."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(pattern(t, r)), F.lit(0)) for _, t, r in anchors]
    hit = [F.when(F.size(x) > 0, g) for x, (g, _, _) in zip(found, anchors, strict=True)]
    groups = F.array_distinct(F.filter(F.array(*hit), lambda g: g.isNotNull()))
    return F.struct((F.size(groups) > 0).cast("int").alias("flag"), groups.alias("groups"), F.array_distinct(F.flatten(F.array(*found))).alias("surfaces"))


def group_bits(groups: Column) -> Column:
    bits = F.create_map(*[F.lit(x) for kv in GROUP_BITS.items() for x in kv])
    return F.aggregate(groups, F.lit(0), lambda a, g: a.bitwiseOR(F.coalesce(bits[g], F.lit(0))))


def hash63(key: Column) -> Column:
    """The first eight bytes of SHA-256 as a non-negative bigint."""
    h = F.sha2(key, 256)
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("int").bitwiseAND(7).cast("string")
    return F.conv(F.concat(top, F.substring(h, 2, 15)), 16, 10).cast("bigint")


def squeezed(text: Column) -> Column:
    """text without white space: what identity of text means."""
    return F.regexp_replace(text, "\\s+", "")


def match_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def position_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[\\s()\\[\\]{}<>0-9#_\\-]+", "")


# Lines that are rules or nothing but a heading word, and the marks of which a run, mixed or with blanks between, becomes its first.
TEMPLATE_LINE = "(?mdU)^(?:[-—=＝*_#\\s　·．.。]{4,}|(?:职位介绍|岗位职责|任职要求|工作内容|岗位要求)\\s*[:：]?\\s*)$"
_MARKS = "，。、；：．.！!？?；;"


def cleaned(text: Column, template_lines: tuple[str, ...] = ()) -> Column:
    """Control characters to blanks, tags away, rule lines, heading-word lines and the given template lines away, runs of marks and
    blanks collapsed, at most one empty line."""
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " ")
    t = F.when(t.contains("<") & t.contains(">"), F.regexp_replace(t, "<[^>]*>", " ")).otherwise(t)
    t = F.regexp_replace(t, TEMPLATE_LINE, "\n")
    for line in template_lines:
        t = F.replace(t, F.lit(line), F.lit("\n"))
    t = F.regexp_replace(t, f"(?U)([{_MARKS}])\\s*+[{_MARKS}][{_MARKS}\\s]*+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t　]{2,}", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(t, "(?U)\\A\\s+|\\s+\\z", "")


def year_of(time: Column) -> Column:
    """The four digits that text starts with, else null."""
    y = F.regexp_extract(time, "^\\s*(\\d{4})", 1)
    return F.when(y != "", y.cast("int"))


def period_of(time: Column) -> Column:
    """(year, half, quarter): months outside 1..12 keep the year only, no date gives zeros."""
    y, m = (F.regexp_extract(time, "^\\s*(\\d{4})-(\\d{1,2})", k) for k in (1, 2))
    year, month = F.coalesce(year_of(time), F.lit(0)), F.when((y != "") & (m != ""), m.cast("int")).otherwise(0)
    good = month.between(1, 12)
    return F.struct(year.alias("year"), F.when(good, F.when(month <= 6, 1).otherwise(2)).otherwise(0).alias("half"), F.when(good, F.floor((month + 2) / 3).cast("int")).otherwise(0).alias("quarter"))


def binned(n: Column, edges: list[int], names: list[str]) -> Column:
    """The name of the half-open bin of n; edges are the lower ends, and n under the first is an error."""
    out = F.when(n < edges[0], F.raise_error(F.lit("below the first bin")))
    for low, high, name in zip(edges, [*edges[1:], None], names, strict=True):
        out = out.when((n >= low) & (n < high) if high is not None else n >= low, name)
    return out


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of name: SHA-1 over the namespace's bytes and the name, version and variant bits set."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.element_at(F.split(F.lit("8 9 a b"), " "), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def concept_id(namespace: str, term: Column, year: Column) -> Column:
    """A stable id of a concept by its normal term and the year of its first finding; an empty term or a year outside 1900 to 2100 is an error."""
    key = F.lower(F.trim(term))
    good = (key != "") & year.between(1900, 2100)
    return F.when(good, uuid5(namespace, F.concat_ws("|", key, year.cast("string")))).otherwise(F.raise_error(F.lit("a concept needs a term and a year")))
