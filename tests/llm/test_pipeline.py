"""The pipeline against plain Python versions of its five stages, and the native operators' edge cases."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from laborlens.llm import chat, decontaminate, rules

from .test_simhash import AZ, plain_components
from .test_substrings import plain as plain_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in rules.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered)


def plain_rules(rows):
    """(doc_id, text, source) -> (doc_id, measures but lines, base_failed, kept)"""
    ms = [(d, s, *measures(t)) for d, t, s in rows]
    flag = [(n < 50 or 100 * rep > 50 * n, 100 * sym > 10 * n, 100 * dup > 30 * lines) for _, _, n, _, sym, lines, dup, rep in ms]
    hosts = {}
    for m, f in zip(ms, flag, strict=True):
        h = hosts.setdefault(m[1], [0, 0])
        h[0] += any(f)
        h[1] += 1
    rate = [b / n for b, n in hosts.values()]
    mean = sum(rate) / len(rate)
    var = max(sum((r - mean) ** 2 for r in rate) / len(rate), 1e-6)
    weight = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6)
    out = []
    for (d, s, n, wc, sym, _, dup, rep), (base, fs, fl) in zip(ms, flag, strict=True):
        r = (hosts[s][0] + mean * weight) / (hosts[s][1] + weight)
        out.append((d, n, wc, sym, dup, rep, base, not base and not (fs and r > 0.01) and not (fl and r > 0.5)))
    return out


def plain_hits(text, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = cut.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for item, t in items:
        b = cut.findall((t or "").translate(AZ))
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_whole_pipeline(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r[0] for r in plain_rules(docs) if r[-1]}
    docs = [(d, t) for d, t, _ in docs if d in kept]
    one = {d for d, _, c in plain_components(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in one]
    cut = {d: (gone, text) for d, _, gone, text in plain_windows(docs, 50)}
    docs = [(d, cut[d][1] if cut[d][0] else t) for d, t in docs]
    docs = [(d, t) for d, t in docs if not plain_hits(t, items)[-1]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got.keys() == want.keys() and 20 < len(got) < 200
    for d, ids in want.items():
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_rules_edges(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", None), (3, w, "a"), (3, w, "a"), (4, w + " # # # # # # # # # $$$", "a"), (5, "a b a b a b\n\x0b\na b", "b"), (None, w, None), (6, "x " * 9000, "b"), (7, "é é " * 3, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as kept", "2 as host", "3 as rate")
    got = [tuple(r) for r in rules.judged(df).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(plain_rules(rows), key=key)
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in plain_rules(rows) if r[-1])
    assert rules.judged(df.limit(0)).count() == 0 and rules.keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 300_000])
def test_decontamination_edges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, long), (2, "Short one"), (3, None), (4, "..."), (5, "é"), (6, long), (10, "a a a a a a a a a a a")]
    rows = [(1, "x " + long.upper() + " y"), (2, "a short, ONE short one"), (3, None), (3, "short one"), (None, long), (4, ""), (5, "É é"), (6, "a " * 500), (7, long[6:]), (8, long), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 as n_hit", "1 as version")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted(((d, *plain_hits(t, items)) for d, t in rows), key=str)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in rows if not plain_hits(t, items)[-1])
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert {r.contaminated for r in decontaminate.contaminated(docs, bench.limit(0)).collect()} == {False}


def test_chat_edges(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b\\l[x]<"), (1, 1, "assistant", None), (1, 0, None, "\\"), (2, None, "we]ird[", "[/]"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, 0, "assistant", "é🙂")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as formatted", "2 as ts")
    out = chat.formatted(df)
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert "".join(back[conv].loss) == "".join(x for _, r, x in own if r == "assistant")
    assert out.where("conv_id = 1").first().formatted == "<s>[:]\\b[/][:assistant][+assistant]b\\bl\\lx\\r\\a[/]</s>"
    assert chat.digests(out).count() == 4 and chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_pipeline_edges(spark, tmp_path, tiny):
    """run() over a table with nulls, repeated rows and clashing extra columns, and over an empty one."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1, 60), "en", "a", 5), (1, words(1, 60), "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, words(2, 70), None, None, 9), (4, words(3, 400), "en", "b", 9), (5, words(1, 60), "en", "b", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as kept", "'x' as host", "2 as fp", "3 as marks", "4 as version")
    for name, table in (("some", df), ("none", df.limit(0))):
        folder = tmp_path / name
        table.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tiny}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = sorted((str(r.doc_id), r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(folder)).collect())
        assert got == ([("1", True), ("4", True), ("None", True)] if name == "some" else [])
