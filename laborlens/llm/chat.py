"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn; neighbours of one role are merged into one block, an array of
their texts, and blocks are concatenated:

    <s>[:system]...[/][:user]...[+user]...[/][:assistant]...[/]</s>

`[:role]` opens a block, `[+role]` starts the next turn of the same block, `[/]` ends it, `</s>` follows an assistant's
block. Inside roles and texts the characters that marks are made of are escaped (`\\` as `\\b`, `[` as `\\l`, `]` as `\\r`,
`<` as `\\a`), so no text can make a mark and every text can be read back. The loss mask names the segments (the formatted
text cut at `[`) that training learns from: those of assistants, from behind the `]` on.

Defined cases: null text or role counts as empty; turns with one number are ordered by role and text (null numbers
first); repeated rows are turns of their own; a null conv_id is a conversation; extra columns are not read; texts are read whole; an empty
table gives an empty result.
One conversation is one output string, so its turns meet in one task; all steps on them are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = (("\\", "\\b"), ("[", "\\l"), ("]", "\\r"), ("<", "\\a"))


def escape(c: Column) -> Column:
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_segments array<int>)."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    # where a role's block begins, and the blocks: slices of the turns from one beginning to the next
    opens = F.filter(F.transform("ts", lambda t, i: F.when((i == 0) | (F.get("ts", i - 1).role != t.role), i)), lambda i: i.isNotNull())
    opened = sorted_.select("conv_id", "ts", opens.alias("opens"))
    block = lambda i, k: F.slice("ts", i + 1, F.coalesce(F.get("opens", k + 1), F.size("ts")) - i)
    merged = opened.select("conv_id", F.transform("opens", lambda i, k: F.struct(F.get("ts", i).role.alias("role"), F.transform(block(i, k), lambda t: t.text).alias("texts"))).alias("blocks"))

    def written(b: Column) -> Column:
        role = escape(b.role)
        joined = F.call_function("array_join", F.transform(b.texts, escape), F.concat(F.lit("[+"), role, F.lit("]")))
        return F.concat(F.lit("[:"), role, F.lit("]"), joined, F.when(b.role == learn, "[/]</s>").otherwise("[/]"))

    whole = merged.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("blocks", written), "")).alias("formatted"))
    segments = whole.withColumn("segs", F.split("formatted", "\\["))
    tag = escape(F.lit(learn))
    learned = F.filter(F.transform("segs", lambda s, i: F.when(s.startswith(F.concat(F.lit(":"), tag, F.lit("]"))) | s.startswith(F.concat(F.lit("+"), tag, F.lit("]"))), i)), lambda i: i.isNotNull())
    return segments.select("conv_id", "formatted", learned.alias("loss_segments"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_segments) -> (conv_id, turns array of (role, text), loss array<string>), unescaped."""
    cut = chats.select("*", F.split("formatted", "\\[").alias("segs"))
    body = lambda s: F.substr(s, F.position(F.lit("]"), s) + 1)
    opened = F.filter("segs", lambda s: s.startswith(":") | s.startswith("+"))
    turn = lambda s: F.struct(unescape(F.substring_index(F.substr(s, F.lit(2)), "]", 1)).alias("role"), unescape(body(s)).alias("text"))
    loss = F.transform("loss_segments", lambda i: F.get("segs", i))
    both = cut.select("conv_id", "formatted", F.transform(opened, turn).alias("turns"), loss.alias("learned"))
    return both.select("conv_id", "formatted", "turns", F.transform("learned", lambda s: unescape(body(s))).alias("loss"))


def digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("loss", "").alias("loss"), "formatted")
    return learned.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
