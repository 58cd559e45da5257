"""Skills in texts by small dictionaries, and the dictionaries themselves: aliases, unions, grades, crosswalks, checks.

Small dictionaries (up to a few hundred terms) are expressions over the text; larger ones go through `matching`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score from which a job counts, weight of a term without one, words that mark a company in brackets, contexts that
# exclude a term, least frequency of an activated alias, prefix of ids of own terms, what stands for an unknown source version.
THRESHOLD, DEFAULT_WEIGHT = 3.0, 3.0
COMPANY = "公司 集团 有限 股份 实业 科技 贸易 电子 制造 精密 信息 网络 软件 控股 能源 生物 医药 材料 文化 商贸 咨询 地产".split()
EXCLUDED = {"AI设计": "AI设计(?=软件)"}
LEAST_FREQUENCY = 100
OWN_PREFIX = "legacy:"
UNKNOWN_VERSION = "UNKNOWN_LOCAL_SNAPSHOT"

_BRACKETS = f"[（(][^）)]*?(?:{'|'.join(COMPANY)})[^）)]*[）)]"


def quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def needs_boundary(term: str) -> bool:
    """Short terms without Chinese letters must not touch ASCII letters."""
    return bool(term) and not re.search("[一-鿿]", term) and len(term) <= 4


def bounded(text: Column, term: str) -> Column:
    return text.rlike(f"(?<![A-Za-z]){quoted(term)}(?![A-Za-z])")


def occurs(text: Column, term: str) -> Column:
    return bounded(text, term) if needs_boundary(term) else text.contains(term)


def listed(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in the dictionary's order; null text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(occurs(t, term), term) for term in terms if term]), lambda x: x.isNotNull())


def scored(text: Column, weights: dict[str, float], excluded: dict[str, str], required: dict[str, str]) -> Column:
    """Sum of the weights of terms that occur, without those whose excluding context occurs or whose required context doesn't."""
    t = F.coalesce(text, F.lit(""))
    total = F.lit(0.0)
    for term, weight in weights.items():
        hit = occurs(t, term)
        if term in excluded:
            hit &= ~t.rlike(excluded[term])
        if term in required:
            hit &= t.rlike(required[term])
        total += F.when(hit, float(weight)).otherwise(0.0)
    return total


def in_title(title: Column, keywords: list[str]) -> Column:
    """Whether a title has a keyword, company names in brackets left out: Chinese ones anywhere, others between non-letters, in upper case."""
    t = F.upper(F.regexp_replace(F.coalesce(title, F.lit("")), _BRACKETS, ""))
    return reduce(lambda a, b: a | b, [t.contains(k) if re.search("[一-鿿]", k) else bounded(t, k) for k in keywords], F.lit(False))


def prefilter(text: Column, terms: list[str]) -> Column:
    """One pattern, whatever the case, that holds wherever a term can score."""
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + "|".join(map(quoted, terms)))


def longest_first(text: Column, terms: list[str], most: int = 4000, contexts: dict[str, str] | None = None) -> Column:
    """Distinct terms that one pattern finds from the left, the longest first, in the first `most` characters (the rule's own limit); a term with a
    context only counts where that occurs."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, most)
    pattern = "|".join(map(quoted, sorted({x for x in terms if x}, key=lambda x: (-len(x), x))))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    for term, context in (contexts or {}).items():
        found = F.when(t.rlike(context), found).otherwise(F.array_remove(found, term))
    return found


def concepts(text: Column, aliases: list[tuple[str, int]], contexts: dict[int, str] | None = None) -> Column:
    """Distinct ids of all aliases that occur, overlapping or not: ASCII aliases between characters that are no ASCII letters or digits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda a: low.rlike(f"(?<![a-zA-Z0-9]){quoted(a)}(?![a-zA-Z0-9])") if a.isascii() else low.contains(a)
    found = F.array(*[F.when(hit(a.lower()) & (low.rlike((contexts or {})[k]) if k in (contexts or {}) else F.lit(True)), k) for a, k in aliases])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def weighted_terms(lines: DataFrame) -> DataFrame:
    """(value) lines `term|weight` -> (term, weight): blank lines and those that begin with # are no terms, no weight is the default one."""
    t = F.trim("value")
    part = F.split(t, "\\|")
    weight = F.coalesce(F.nullif(F.trim(F.get(part, 1)), F.lit("")).cast("double"), F.lit(DEFAULT_WEIGHT))
    return lines.where((t != "") & ~t.startswith("#")).select(F.trim(F.get(part, 0)).alias("term"), weight.alias("weight"))


def active_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that are on and of two characters or more, or the one-letter language."""
    name = F.trim("alias")
    return aliases.where((F.col("is_active") == 1) & F.col("alias").isNotNull() & ((F.length(name) >= 2) | (F.lower(name) == "r")))


def resolved(aliases: DataFrame) -> DataFrame:
    """(alias, skill_id, primary_id, ambiguous) -> (key, alias, skill_id, ambiguous), a row for each alias in lower case: its only skill, else the only
    primary one among its skills, else an error."""
    known = F.nullif("primary_id", F.lit(""))
    groups = aliases.groupBy(F.lower("alias").alias("key")).agg(
        F.min("skill_id").alias("lo"), F.max("skill_id").alias("hi"), F.min(known).alias("p_lo"), F.max(known).alias("p_hi"),
        F.max("ambiguous").alias("ambiguous"), F.min_by("alias", F.struct("alias", "skill_id")).alias("one"),
        F.sort_array(F.collect_set(F.struct("skill_id", "alias"))).alias("all"),
    )
    target = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when((F.col("p_lo") == F.col("p_hi")) & F.exists("all", lambda x: x["skill_id"] == F.col("p_lo")), F.col("p_lo"))
    safe = F.coalesce(target, F.raise_error(F.concat(F.lit("no only primary skill: "), F.col("key"))).cast("string"))
    own = F.array_min(F.transform(F.filter("all", lambda x: x["skill_id"] == F.col("skill_id")), lambda x: x["alias"]))
    return groups.withColumn("skill_id", safe).select("key", own.alias("alias"), "skill_id", "ambiguous")


def union_lexicon(aliases: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """aliases (key, skill_id), terms (term) -> (key, skill_id): aliases come before own terms of the same key; own terms of under `least` characters go."""
    own = terms.select(F.lower("term").alias("key")).where(F.length("key") >= least).distinct()
    more = own.join(aliases.select("key"), "key", "left_anti").select("key", F.concat(F.lit(OWN_PREFIX), "key").alias("skill_id"))
    return aliases.select("key", "skill_id").unionByName(more)


def dispositions(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """terms (place, term), aliases (key, skill_id) -> (place, term, key, skill_id, disposition): what became of each own term in the union."""
    keyed = terms.select("place", "term", F.lower("term").alias("key")).join(aliases.select("key", F.col("skill_id").alias("alias_id")), "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy("place")) == 1
    kind = F.when(F.length("key") < 2, "skipped_short").when(F.col("alias_id").isNotNull(), "covered_by_atier").when(first, "legacy_concept").otherwise("duplicate_term")
    out = keyed.withColumn("disposition", kind)
    sid = F.when(F.col("disposition") == "skipped_short", "").otherwise(F.coalesce("alias_id", F.concat(F.lit(OWN_PREFIX), "key")))
    return out.select("place", "term", "key", sid.alias("skill_id"), "disposition")


def registry_hash(rows: DataFrame, *cols: str) -> DataFrame:
    """A hash of all rows, whatever their order: sums of the rows' hashes in two halves, which combine before the shuffle, hashed."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    half = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    own = rows.agg(F.count("*").alias("n"), half(1).alias("a"), half(13).alias("b"))
    return own.select("n", F.sha2(F.concat_ws("|", "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), 256).alias("registry_hash"))


def activated(candidates: DataFrame, ambiguous: DataFrame, least: int = LEAST_FREQUENCY) -> DataFrame:
    """candidates (alias, freq), ambiguous (alias) -> with is_active and the reason."""
    marked = candidates.join(ambiguous.select("alias", F.lit(True).alias("__several")).distinct(), "alias", "left")
    reason = F.when(F.col("__several"), "ambiguous").when(F.col("freq") < least, "below_frequency").otherwise("activated")
    return marked.select("alias", "freq", (reason == "activated").alias("is_active"), reason.alias("reason"))


def governed(grades: DataFrame) -> DataFrame:
    """(term, grade, skill_id) -> (key, skill_id) of grades A to C: an empty id or two ids of a key are errors."""
    formal = grades.where(F.col("grade").isin("A", "B", "C"))
    own = formal.groupBy(F.lower(F.trim("term")).alias("key")).agg(F.min(F.coalesce("skill_id", F.lit(""))).alias("lo"), F.max(F.coalesce("skill_id", F.lit(""))).alias("hi"))
    bad = F.raise_error(F.concat(F.lit("no id or several: "), F.col("key"))).cast("string")
    return own.select("key", F.when((F.col("lo") != "") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(bad).alias("skill_id"))


def formal_dictionary(base: DataFrame, grades: DataFrame) -> DataFrame:
    """base (skill_id, name) concepts, grades (term, grade, skill_id) -> (skill_id, name, language, boundary, origin): base concepts and those of grades
    B and C that base lacks."""
    new = grades.where(F.col("grade").isin("B", "C")).groupBy("skill_id").agg(F.min("term").alias("name")).join(base.select("skill_id"), "skill_id", "left_anti")
    both = base.select("skill_id", "name", F.lit("base").alias("origin")).unionByName(new.select("skill_id", "name", F.lit("appended").alias("origin")))
    language = F.when(F.col("name").rlike("[一-鿿]"), F.when(F.col("name").rlike("[A-Za-z]"), "mixed").otherwise("zh")).otherwise("en")
    boundary = F.when(F.col("name").rlike("^[\\x00-\\x7F]*$"), "ascii_boundary").otherwise("substring")
    return both.select("skill_id", "name", language.alias("language"), boundary.alias("boundary"), "origin")


def crosswalk(concepts: DataFrame) -> DataFrame:
    """(skill_id, source, version, source_id, esco, onet) -> up to three source records a concept, none twice."""
    name = F.upper("source")
    version = F.coalesce(F.nullif("version", F.lit("")), F.lit(UNKNOWN_VERSION))

    def record(source: Column, v: Column, key: Column, kind: str, rank: int) -> Column:
        return F.struct(source.alias("source_name"), v.alias("source_version"), key.alias("source_skill_id"), F.lit(kind).alias("mapping_type"), F.lit(rank).alias("rank"))

    crossed = lambda names: F.when(name.isin(*names), version).otherwise(UNKNOWN_VERSION)
    found = F.array(
        record(F.col("source"), version, F.col("source_id"), "primary_source_record", 0),
        record(F.lit("ESCO"), crossed(["ESCO"]), F.col("esco"), "source_crosswalk", 1),
        record(F.lit("O*NET"), crossed(["O*NET", "ONET"]), F.col("onet"), "source_crosswalk", 2),
    )
    rows = concepts.select("skill_id", F.explode(found).alias("x")).select("skill_id", "x.*").where("source_name <> '' and source_skill_id <> ''")
    least = F.min_by(F.struct("source_version", "mapping_type"), "rank")
    return rows.groupBy("skill_id", "source_name", "source_skill_id").agg(least.alias("y")).select("skill_id", "source_name", "source_skill_id", "y.*")


def checked(rules: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(rule, broken): one row for each rule (name, table, aggregate of broken rows)."""
    return reduce(DataFrame.unionByName, [df.agg(F.coalesce(c, F.lit(0)).cast("bigint").alias("broken")).select(F.lit(n).alias("rule"), "broken") for n, df, c in rules])


def dedup_invariants(stage: DataFrame, first: DataFrame, groups: DataFrame, most_share: float = 0.02, span: int = 30) -> DataFrame:
    """stage (rid, day) rows, first (rule one: a row for each rid), groups (buckets: records, earliest_day, latest_day, canonical) -> (rule, broken)."""
    sizes = [df.agg(F.count("*").alias(n)) for n, df in (("stage", stage), ("kept", first))]
    counted = sizes[0].join(F.broadcast(sizes[1])).join(F.broadcast(groups.agg(F.sum("records").alias("grouped"))))  # one row each
    return checked([
        ("buckets_hold_all_rows", counted, F.max(F.abs(F.col("stage") - F.coalesce("grouped", F.lit(0))))),
        ("rule_one_within_share", counted, F.max((F.col("stage") - F.col("kept") > most_share * F.col("stage")).cast("int"))),
        ("spans_within_days", groups.where((F.col("latest_day") - F.col("earliest_day") > span) & (F.col("records") > 1)), F.count("*")),
        ("canonical_rows_unique", groups, F.count("canonical") - F.countDistinct("canonical")),
    ])
