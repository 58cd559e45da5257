"""Model replies and long texts: unwrapping, JSON recovery, spans of quoted skills, chunks, batches by characters."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What ends a sentence, and what a batch item costs beside its text.
SENTENCE_ENDS = "\n。！？；;!?"
ITEM_COST = 40

_THINK = "(?s)\\A<think(?:ing)?>.*?</think(?:ing)?>\\s*"
_ENDS = "\\A\\s+|\\s+\\z"


def unwrapped(reply: Column) -> Column:
    """reply without the reasoning block that it starts with (or a lone closing tag at either end) and without a pair of code
    fences around all of it. What stands inside stays; null gives an empty text."""
    t = F.regexp_replace(F.coalesce(reply, F.lit("")), _ENDS, "")
    t = F.when(t.rlike(_THINK), F.regexp_replace(t, _THINK, "")).otherwise(F.regexp_replace(t, "\\A</think(?:ing)?>\\s*", ""))
    t = F.regexp_replace(t, "\\s*</think(?:ing)?>\\s*\\z", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\\A```(?:json)?\\s*", ""), "```\\z", ""), _ENDS, "")
    return F.when(t.startswith("```") & t.endswith("```"), bare).otherwise(t)


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The JSON object that starts at the first brace, else the array at the first bracket, in compact form; else null."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        for opener in "{[":
            at = (t or "").find(opener)
            if at < 0:
                continue
            try:
                return json.dumps(decoder.raw_decode(t, at)[0], ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                continue
        return None

    return texts.map(one)


def json_objects(text: Column) -> Column:
    """All objects of at most one level of nesting that parse, in order, as strings."""
    found = F.regexp_extract_all(text, F.lit("\\{(?:[^{}]++|\\{[^{}]*+\\})*+\\}"), F.lit(0))
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def located(text: Column, surface: Column, evidence: Column) -> Column:
    """(start, end, multiple) of surface in text, from 0: its only place; of several the first inside evidence, else the first.
    Null if it is empty or does not occur."""
    n = F.length(surface)
    first = F.position(surface, text)
    ev = F.when(F.length(evidence) > 0, F.position(evidence, text)).otherwise(0)
    inside = F.when(ev > 0, F.position(surface, text, ev)).otherwise(0)
    start = F.when((inside > 0) & (inside + n <= ev + F.length(evidence)), inside).otherwise(first) - 1
    many = F.position(surface, text, first + 1) > 0
    return F.when((n > 0) & (first > 0), F.struct(start.alias("start"), (start + n).alias("end"), many.cast("int").alias("multiple")))


def spans(text: str, tokens: Callable[[str], int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `most` tokens; a chunk ends after a sentence in its last 35 % if one ends there.
    `tokens` must not shrink when text is added."""
    if tokens(text) <= most:
        return [(0, len(text))]
    out, start = [], 0
    while not out or out[-1][1] < len(text):
        fits = bisect_right(range(start + 1, len(text) + 1), most, key=lambda e: tokens(text[start:e]))
        end = start + max(1, fits)
        if end < len(text):
            low = start + max(1, int((end - start) * 0.65))
            end = 1 + max((text.rfind(c, low, end) for c in SENTENCE_ENDS), default=-1) or end
        out.append((start, end))
        start = max(start + 1, end - overlap)
    return out


def chunked(rows: DataFrame, key: str, tokens: Callable[[str], int], most: int = 5000, overlap: int = 200) -> DataFrame:
    """(key, text) -> (key, chunk, start, end, text); null texts give one empty chunk. Each text is cut by itself, in Arrow batches."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, s, e, t[s:e]) for k, t in zip(b[key], b["text"].fillna("")) for i, (s, e) in enumerate(spans(t, tokens, most, overlap))]
            yield pd.DataFrame(out, columns=[key, "chunk", "start", "end", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(cut, f"{key} {kind}, chunk int, start int, end int, text string")


def batched(rows: DataFrame, key: str, order: str, budget: int, most: int | None = None) -> DataFrame:
    """(key, order, text) -> (key, order, batch): within a key, items in order fill a batch until the next would exceed its
    characters or its number of items. Greedy filling is sequential in a key, so a key's (order, length) rows pass through one
    task as a sorted stream; texts stay behind and nothing is collected."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used, n = object(), 0, 0, 0
        for b in batches:
            places = []
            for k, cost in zip(b[key], b["cost"]):
                if k != now:
                    now, batch, used, n = k, 0, 0, 0
                elif used + cost > budget or (most and n >= most):
                    batch, used, n = batch + 1, 0, 0
                used, n = used + cost, n + 1
                places.append(batch)
            yield b[[key, order]].assign(batch=places)

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order)]
    cost = (F.coalesce(F.length("text"), F.lit(0)) + ITEM_COST).alias("cost")
    return rows.select(key, order, cost).repartition(key).sortWithinPartitions(key, order).mapInPandas(pack, ", ".join([*kinds, "batch int"]))
