"""The trained operators: held-out accuracy, exact parts against plain counts, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laborlens.llm import extract, hashing, labelled, lm, quality, toxicity
from laborlens.llm.html_blocks import blocks

from .test_simhash import AZ

EDGES = [(1, None), (1, ""), (None, "a b"), (2, "x " * 5000), (3, "é\x0bÉ A a")]


def held_out(spark, folder, module, column):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = module.graded(docs, labels.select("doc_id", F.col(column).alias("label")))
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    both = out.join(labels, "doc_id").where("held_out")
    return both.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_quality(spark, small):
    assert held_out(spark, small, quality, "quality") > 0.93
    df = spark.createDataFrame(EDGES, "doc_id bigint, text string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(2, 1), (3, None), (9, 0)], "doc_id bigint, label int")
    assert quality.graded(df, labels).count() == 5
    assert {r.held_out for r in quality.graded(df, labels).where("doc_id is null").collect()} == {False}
    assert {r.score for r in quality.graded(df, labels.limit(0)).collect()} == {0.5} and quality.graded(df.limit(0), labels).count() == 0


def test_toxicity(spark, small):
    assert held_out(spark, small, toxicity, "toxic") > 0.85
    df = spark.createDataFrame(EDGES, "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as n")
    labels = spark.createDataFrame([(2, 1), (3, None)], "doc_id bigint, label int")
    assert toxicity.graded(df, labels).count() == 5 and toxicity.graded(df, labels.limit(0)).count() == 5 and toxicity.graded(df.limit(0), labels).count() == 0
    assert {r.held_out for r in toxicity.graded(df, labels).where("doc_id is null").collect()} == {False}


def test_risk_and_its_gradient():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 6, int(rng.integers(0, 5)))) for _ in range(9)]
    times, theta = rng.integers(1, 5, 9), rng.standard_normal(7)
    for sign in (1, -1):
        plain = lambda t: sum(n * math.log1p(math.exp(-sign * (sum(t[w] for w in r) + t[-1]))) for r, n in zip(rows, times, strict=True))  # noqa: B023, E731
        loss, *slope = toxicity.risk(theta, rows, times, sign)
        assert abs(loss - plain(theta)) < 1e-9
        for k in range(7):
            step = np.eye(7)[k] * 1e-5
            assert abs((plain(theta + step) - plain(theta - step)) / 2e-5 - slope[k]) < 1e-6


def test_unlabelled_risk_is_over_all_rows(spark, monkeypatch):
    """Fewer steps and made texts: the model equals one that plain lists of all documents give, on the driver and by executors."""
    monkeypatch.setattr(toxicity, "_STEPS", 5)
    rows = [(d, f"good words here w{d % 7}" + (" bad worse" if d % 5 == 0 else "")) for d in range(60)] + [(60, None), (None, "bad"), (0, "bad again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(d % 5 == 0)) for d in range(0, 40)], "doc_id bigint, label int")
    here, there = toxicity.trained(docs, labels), toxicity.trained(docs, labels, patterns=0)
    assert np.allclose(here[0], there[0], atol=1e-6) and abs(here[1] - there[1]) < 1e-9 and (here[0] != 0).any()
    sets = [toxicity.words_of((t or "").encode()) for _, t in rows]
    active = np.flatnonzero(here[0])
    place = {w: k for k, w in enumerate(active)}
    own = [np.array([place[w] for w in x if w in place], dtype=np.int64) for x in sets]
    texts = {}
    for d, t in rows:
        if d is not None and d % 5 == 0 and d < 40:
            texts.setdefault(d, []).append(t)
    hashed = {r.doc_id: r.text for r in labelled.one_text(docs).collect()}
    positive = [np.array([place[w] for w in toxicity.words_of(hashed[d].encode()) if w in place], dtype=np.int64) for d in sorted(texts)]
    theta = toxicity.fit(positive, lambda t: toxicity.risk(t, own, np.ones(len(own)), -1), len(own), len(active), 8 / 40)
    assert np.allclose(theta[:-1], here[0][active], atol=1e-5) and abs(theta[-1] - here[1]) < 1e-6


def test_follow_the_regularised_leader():
    """The sparse fit against plain per-coordinate updates."""
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 8, 4)), None, int(rng.integers(0, 2))) for _ in range(20)]
    rows = [(at, rng.random(len(at)), y) for at, _, y in rows]
    z, n = [0.0] * 8, [0.0] * 8

    def weight(k):
        if abs(z[k]) <= quality._L1:
            return 0.0
        return -(z[k] - math.copysign(quality._L1, z[k])) / ((quality._BETA + math.sqrt(n[k])) / quality._ALPHA + quality._L2)

    for _ in range(quality._EPOCHS):
        for at, x, y in rows:
            w = [weight(k) for k in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for k, a, b in zip(at, w, x, strict=True):
                g = (p - y) * b
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality._ALPHA * a
                n[k] += g * g
    assert np.allclose(quality.fit(rows)[:8], [weight(k) for k in range(8)], atol=1e-6)


def split(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)), ""]


def hashes(words):
    """The hashes of single words; an empty one is the end token."""
    return np.array([int(next(hashing.hashed(pa.array([w])))[1][0]) for w in words], dtype=np.uint64)


def test_hashes_of_words(monkeypatch):
    texts = ["a bb\x0bccc É", None, "", "  x ", "A BB", "y" * 700 + " z " * 300, "\t"]
    want = [h for t in texts for h in hashes(split(t))]
    for piece in (3, 1 << 19):
        monkeypatch.setattr(hashing, "PIECE", piece)
        got = [(low + r, h) for low, words, rows in hashing.hashed(pa.array(texts)) for h, r in zip(words, rows, strict=True)]
        assert [h for _, h in got] == want
        assert [r for r, _ in got] == [k for k, t in enumerate(texts) for _ in split(t)]
    assert len(set(want)) == len({w for t in texts for w in split(t)})
    one, two = hashing.before(np.arange(6, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 1]))
    assert list(two) == [hashing.END, hashing.END, 0, hashing.END, 2, 3] and list(one) == [hashing.END, 0, 1, 2, 3, 4]


def plain_scores(model, rows, c, out, contexts):
    """Scores token by token from counted words and pairs; class probabilities from the model's weights, one context at a time."""
    key = {w: int(h) for w, h in zip(c, hashes(c), strict=True)}
    head = {w for w in c if key[w] in set(map(int, model.head))}
    place = {int(h): k for k, h in enumerate(model.head)}

    def context(w):
        h = key.get(w) or int(hashes([w])[0])
        return w if w in head else (h >> 3) % contexts

    def cls(w):
        return int(model.classes[place[key[w]]]) if w in head else lm.HEAD_CLASSES + (key[w] & 7)

    pairs, follows, mass = Counter(), Counter(), Counter()
    for d, t in rows:
        if not out(d):
            for a, b in zip(["", *split(t)], split(t)):
                pairs[context(a), b] += 1
                follows[context(a)] += 1
    for w, n in c.items():
        mass[cls(w)] += n
    scores = []
    for _, t in rows:
        words, total = split(t), 0.0
        for k, w in enumerate(words):
            a, b = words[k - 1] if k else "", words[k - 2] if k > 1 else ""
            if not c[w]:
                total += math.log10(model.unknown)
                continue
            f = model.features(hashes([a]), hashes([b]))
            z = model.bias.astype(float) + sum(model.weights[x[0]].astype(float) for x in f)
            p0 = math.exp(z[cls(w)]) / np.exp(z).sum() * c[w] / mass[cls(w)]
            total += math.log10((1 - model.unknown) * (pairs[context(a), w] + lm.MU * p0) / (follows[context(a)] + lm.MU))
        scores.append(total)
    return scores


@pytest.mark.parametrize(("head", "hot", "bucket"), [(4, 4, 50), (1 << 16, 1 << 16, 1 << 21), (40, 8, 1)])
def test_language_model(spark, monkeypatch, head, hot, bucket):
    rng = np.random.default_rng(3)
    rows = [(d, " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", f"w{d}", f"v{d % 9}"], 30))) for d in range(80)] + EDGES
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as block")
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not out(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    models, train = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda *a: models.append(train(*a)) or models[-1])
    rows_of = lm.scored(df, head=head, hot=hot, bucket_tokens=bucket).collect()
    want = plain_scores(models[0], rows, c, out, lm.CONTEXTS)
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score] for r in rows_of), key=str)
    plain = sorted(([d, out(d), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6), s] for (d, t), s in zip(rows, want, strict=True)), key=str)
    assert [g[:-1] for g in got] == [p[:-1] for p in plain]
    assert all(abs(g[-1] - p[-1]) < 1e-3 * p[2] for g, p in zip(got, plain, strict=True))
    assert lm.scored(df.limit(0)).count() == 0


def test_model_is_a_distribution(spark):
    texts = spark.createDataFrame([("a b c a b d e",), ("b a zz q",), ("a b c",)], "text string")
    counts = lm.counted(texts)
    m = lm.trained(texts, counts, head=3)
    c = Counter(w for (t,) in texts.collect() for w in split(t))
    feats = m.features(hashes(["b"]), hashes(["a"]))
    shares = np.exp(m.log_classes(feats))[0]
    words = list(c)
    at, there = m.places(hashes(words))
    cls = m.classes_of(hashes(words), at, there)
    assert abs(sum(shares[k] * c[w] / m.mass[k] for w, k in zip(words, cls, strict=True)) - 1) < 1e-4


def test_model_beats_its_base(spark, tiny, small):
    for folder in (tiny, small):
        out = lm.scored(spark.read.parquet(f"{folder}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        assert out[0] > 0.8 * out[1]


def test_gradient_of_labeller():
    pages = [extract.encode(blocks(p)) for p, _ in extract.drafts(3, 5)]
    labels = [np.arange(len(p[0])) % 2 for p in pages]
    model = extract.Labeller()
    rng = np.random.default_rng(0)
    model.p = {k: rng.standard_normal(v.shape) * 0.3 for k, v in model.p.items()}

    def loss():
        x, mask, _ = model.vectors(pages)
        s = model.scores(x, mask)[0]
        y = np.zeros_like(s)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        return float(((np.logaddexp(0, s) - y * s) * mask).sum() / mask.sum())

    g = model.gradients(pages, labels)
    for k in ("Wf", "Ub", "Bf", "V"):
        at = tuple(n // 2 for n in model.p[k].shape)
        keep = model.p[k][at]
        model.p[k][at] = keep + 1e-3
        up = loss()
        model.p[k][at] = keep - 1e-3
        slope = (up - loss()) / 2e-3
        model.p[k][at] = keep
        assert abs(slope - g[k][at]) < 1e-3 + 0.05 * abs(slope)


def test_blocks():
    page = "<p>a<b>b</b> &amp;&#233;<br>c<p title='>'>d</p><script>x<p></script><!-- <p>no --><ul><li>e<li>f</ul>g<p cla"
    assert [t for _, t, _ in blocks(page)] == ["ab &é", "c", "d", "e", "f", "g"]
    assert blocks(None) == [] and blocks("1 < 2")[0][1] == "1 < 2"


def test_stray_quotes():
    says = lambda page: [t for _, t, _ in blocks(page)]
    assert says('<article><p><a href="x"">link</a> one.</p><p>two.</p><p class="k">three.</p></article>') == ["link one.", "two.", "three."]
    assert says("<p>a</p><p title=Bob's>b</p><p>it's c</p>") == ["a", "b", "it's c"]
    assert says("<p>a</p><p title=Bob's>b</p><p>c</p>") == ["a", "b", "c"]
    assert says("<p>a</p><p \">b</p><p 'x>c</p></p'>d") == ["a", "b", "c", "d"]
    assert says("<p title = 'x>y' lang=\"a>b\"alt=>a</p><p x= 'u>v>b</p>' y>c") == ["a", "c"]
    assert ("div", ".a", ".b", ".c") in blocks("<div id='a'class=\"b c\" title=' role=n'><p>a")[0][0]


def test_whole_paths_and_texts_are_read():
    model = extract.Labeller()
    model.p["E"] = np.random.default_rng(1).standard_normal(model.p["E"].shape).astype(np.float32)
    rows = lambda page: model.vectors([extract.encode(blocks(page))])[0][0, 0, : extract.WIDTH]
    far, near = "<div>" * 70, "<div class='a b c d e f g h {}'>x"
    for one, two in (("w " * 12 + "advert", "w " * 12 + "story"), ("<nav>" + far + "x", "<main>" + far + "x"), (near.format("ad"), near.format("post"))):
        assert np.abs(rows(one) - rows(two)).max() > 1e-3
    own = blocks("<article>" + "<div>" * 90 + "<p>a" + "</div>" * 90 + "<p>b</article>c")
    assert [("article" in [m[0] for m in path], sum(m[0] == "div" for m in path)) for path, _, _ in own] == [(True, 90), (True, 0), (False, 0)]
    ids, _, paths = extract.encode(blocks("<font>a<br>" * 20_000))
    assert len(ids) == len(paths) == 20_000 and model.path_sums(paths)[1][-1] == 20_000


def test_marks_far_up_count():
    story = "<article><h1>Ka tise</h1>" + "<p>Dase mito pana fe kelu nora ti samo vidu keba.</p>" * 5 + "</article>"
    for depth in (0, 15, 30):
        o, c = "<div>" * depth, "</div>" * depth
        page = f"<body>{o}{story}{c}<div class='comments'>{o}<p>Some text here that tells.</p>{c}</div><div class='sidebar'>{o}<p>Other words stand here.</p>{c}</div></body>"
        text = extract.main_text([page], extract.trained())[0]
        assert "Dase" in text and "Some" not in text and "Other" not in text


def test_extraction(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in extract.extracted(pages).collect()}
    rows = pages.collect()
    want = {r.page_id: " ".join(t for path, t, _ in blocks(r.html) if any(m[0] == "article" for m in path)) for r in rows}
    assert len(got) == len(rows) and sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<script>x</script>")], "page_id bigint, url string, html string").selectExpr("*", "1 as text")
    assert [(r.text, r.n_chars) for r in extract.extracted(odd).collect()] == [("", 0)] * 3 and extract.extracted(odd.limit(0)).count() == 0
