"""Longest dictionary matches with evidence, character-bigram retrieval, and the beta-binomial prior."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: most terms that are broadcast to the executors as one automaton
DICTIONARY_ROWS = 2_000_000


# Terms whose concept is matched only in texts where the pattern occurs.
GUARDS = {"深度学习": "深度学习(?!能力|精神|意识|态度|习惯|思考|领悟|钻研|学习|力)", "强化学习": "强化学习(?!能力|学习)"}


def matches_with_evidence(posts: DataFrame, terms: DataFrame, guards: dict[str, str] = GUARDS) -> DataFrame:
    """posts (id, text), terms (term, skill_id, and ambiguous where there is such a column) -> (id, skill_id, surface, start, mention_count,
    ambiguous, covered: what the skill's mentions lie over).

    All occurrences are taken longest first (then leftmost, then by skill_id), each only where nothing taken before overlaps it; one that
    is not taken is covered by the first taken that it overlaps. Occurrences of ASCII terms must not touch another ASCII letter or digit, but
    digits may follow c++ and c#. A skill with a term in `guards` is matched only in texts where the pattern occurs. One row for each skill:
    its first place and how often.
    """
    unsure = F.coalesce(F.col("ambiguous").cast("boolean"), F.lit(False)) if "ambiguous" in terms.columns else F.lit(False)
    rows = terms.groupBy(F.lower("term").alias("term"), "skill_id").agg(F.max(unsure).alias("ambiguous")).limit(DICTIONARY_ROWS + 1).collect()
    if len(rows) > DICTIONARY_ROWS:
        raise ValueError(f"over {DICTIONARY_ROWS} terms: split the dictionary")
    owners: dict[str, list] = {}
    for r in rows:
        owners.setdefault(r.term, []).append(r.skill_id)
    flagged = {r.term for r in rows if r.ambiguous}
    needs = {r.skill_id: guards[r.term] for r in sorted(rows, key=lambda r: str(r.term)) if r.term in guards}
    shared = posts.sparkSession.sparkContext.broadcast(({t: min(s) for t, s in owners.items() if t}, flagged, needs))

    def touches(text: str, at: int, digits: bool) -> bool:
        c = text[at] if 0 <= at < len(text) else ""
        return c.isascii() and (c.isalpha() or (digits and c.isdigit()))

    def free(text: str, start: int, end: int) -> bool:
        term = text[start:end]
        return not term.isascii() or not (touches(text, start - 1, True) or touches(text, end, term not in ("c++", "c#")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned, unsure, needed = shared.value
        patterns = {skill: re.compile(p) for skill, p in needed.items()}
        machine = ahocorasick.Automaton()
        for term, skill in owned.items():
            machine.add_word(term, (len(term), skill))
        machine.make_automaton()
        for batch in batches:
            out = []
            for post, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                found = [(-n, end - n + 1, skill) for end, (n, skill) in machine.iter(low)] if len(machine) else []
                absent = {skill for skill in {x[2] for x in found} & patterns.keys() if not patterns[skill].search(low)}
                found = sorted(x for x in found if x[2] not in absent and free(low, x[1], x[1] - x[0]))
                used, taken = array("i", bytes(4 * len(low))), []
                for n, start, skill in found:
                    over = min((k for k in used[start : start - n] if k), default=0)
                    if over:
                        taken[over - 1][3].append((skill, low[start : start - n], start, start - n))
                    else:
                        taken.append((start, -n, skill, []))
                        used[start : start - n] = array("i", [len(taken)]) * -n
                mentions: dict[int, list] = {}
                for x in sorted(taken, key=lambda x: x[:2]):
                    mentions.setdefault(x[2], []).append(x)
                for skill, own in mentions.items():
                    at, n = own[0][:2]
                    under = [dict(zip(("skill_id", "surface", "start", "end"), c, strict=True)) for m in own for c in m[3]]
                    out.append((post, skill, low[at : at + n], at, len(own), low[at : at + n] in unsure, under))
            cols = zip(*out, strict=True) if out else [[]] * 7
            covered = pa.list_(pa.struct([("skill_id", pa.int64()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), covered)
            names = ["id", "skill_id", "surface", "start", "mention_count", "ambiguous", "covered"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    own = posts.select(F.col("id").cast("bigint"), "text")
    covered = "array<struct<skill_id: bigint, surface: string, start: int, end: int>>"
    return own.mapInArrow(run, f"id bigint, skill_id bigint, surface string, start int, mention_count int, ambiguous boolean, covered {covered}")


def longest_matches(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, skill_id, surface, start, mention_count) of `matches_with_evidence`."""
    return matches_with_evidence(posts, terms).drop("ambiguous", "covered")


def bigram_retrieval(queries: DataFrame, terms: DataFrame, top: int = 10) -> DataFrame:
    """queries (query), terms (concept, alias) -> the `top` concepts by Jaccard of character bigrams: an inverted-index equi-join."""

    def grams(df: DataFrame, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substr(F.lower(name), i, F.lit(2)))
        return df.withColumn("grams", F.array_distinct(cut)).select("*", F.size("grams").alias("n"))

    left = grams(queries, "query").select("query", F.col("n").alias("nq"), F.explode("grams").alias("g"))
    right = grams(terms, "alias").select("concept", "alias", F.col("n").alias("na"), F.explode("grams").alias("g"))
    both = left.join(right, "g").groupBy("query", "concept", "alias", "nq", "na").agg(F.count("*").alias("k"))
    rated = both.select("query", "concept", (F.col("k") / (F.col("nq") + F.col("na") - F.col("k"))).alias("jaccard"))
    best = rated.groupBy("query", "concept").agg(F.max("jaccard").alias("jaccard"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("jaccard"), "concept"))
    return best.withColumn("place", place).where(F.col("place") <= top)


def overlap_retrieval(queries: DataFrame, terms: DataFrame, top: int = 10) -> DataFrame:
    """queries (query), terms (alias) -> the `top` aliases by the number of character bigrams that both have, then by name."""

    def grams(df: DataFrame, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substr(F.lower(name), i, F.lit(2)))
        return df.select(name, F.explode(F.array_distinct(cut)).alias("g"))

    both = grams(queries, "query").join(grams(terms, "alias"), "g").groupBy("query", "alias").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("overlap"), "alias"))
    return both.withColumn("place", place).where(F.col("place") <= top)


def beta_prior(cells: list[tuple[int, int, int]], least_cells: int = 50) -> tuple[float, float, str]:
    """(n, c, how many such cells) -> (alpha, beta, status): maximum likelihood by a simplex search on logarithms."""
    if sum(k for _, _, k in cells) < least_cells:
        return 0.5, 0.5, "jeffreys:few_skills"
    lg = math.lgamma

    def loss(p: tuple[float, float]) -> float:
        if max(abs(x) for x in p) > 12:
            return math.inf
        a, b = math.exp(p[0]), math.exp(p[1])
        one = lg(a) + lg(b) - lg(a + b)
        return -sum(k * (lg(c + a) + lg(n - c + b) - lg(n + a + b) - one) for n, c, k in cells)

    # fixed values: where the search begins, and the range in which a fit counts as stable
    start, low, high = (math.log(0.3), math.log(8.0)), 1e-4, 1e4
    points = sorted(((loss(p), p) for p in (start, (start[0] + 0.3, start[1]), (start[0], start[1] + 0.3))))
    for _ in range(400):
        (f0, best), (f1, mid), (f2, worst) = points
        if abs(f2 - f0) < 1e-10 * (1 + abs(f0)):
            break
        centre = tuple((x + y) / 2 for x, y in zip(best, mid, strict=True))
        step = lambda t: tuple(c + t * (c - w) for c, w in zip(centre, worst, strict=True))  # noqa: B023, E731
        tries = [(loss(p), p) for p in ([step(1.0), step(2.0)] if loss(step(1.0)) < f0 else [step(1.0), step(0.5), step(-0.5)])]
        new = min(tries)
        if new[0] < f2:
            points = sorted([points[0], points[1], new])
        else:
            shrink = [tuple((x + y) / 2 for x, y in zip(best, p, strict=True)) for p in (mid, worst)]
            points = sorted([points[0], *((loss(p), p) for p in shrink)])
    else:
        return 0.5, 0.5, "jeffreys:not_converged"
    a, b = (math.exp(x) for x in points[0][1])
    if not (low <= a <= high and low <= b <= high):
        return 0.5, 0.5, "jeffreys:unstable"
    return a, b, "fitted"


def fitted_priors(counts: DataFrame, least_n: int = 5) -> DataFrame:
    """counts (unit columns span, anchor, year; n_skill, n_anchor) -> (span, anchor, year, alpha, beta, status).

    Cells are compressed to a histogram of (n, c) in Spark first, so that a unit's fit reads few rows.
    """
    histogram = counts.where(F.col("n_skill") >= least_n).groupBy("span", "anchor", "year", "n_skill", "n_anchor").agg(F.count("*").alias("k"))

    def fit(key, frame):
        import pandas as pd

        a, b, status = beta_prior(list(zip(frame.n_skill, frame.n_anchor, frame.k, strict=True)))
        return pd.DataFrame([(*key, a, b, status)], columns=["span", "anchor", "year", "alpha", "beta", "status"])

    return histogram.groupBy("span", "anchor", "year").applyInPandas(fit, "span string, anchor string, year int, alpha double, beta double, status string")
