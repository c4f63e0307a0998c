"""The other training-data operators: brute force, round trips, held-out accuracy, odd rows."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, html_extract, language, mixing, mtree, queries, rare_digest, toxicity, url_filter, warc
from ledgerloom.llm.oracles import ORACLES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = "word " * 20_000
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, " \n ", "en", "s", 3), (None, "no id", "en", "s", 5), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (5, "12 !!", "de", "t", 5), (6, "\U0001f600é", None, "t", 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001" if name == "op2_hyperminhash" else SF
    same(queries.QUERIES[name](spark, sf), connect(sf), ORACLES[name])


# --- toxicity ---


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, int(rng.integers(0, 6)), replace=False)} for _ in range(700)]
    idf = rng.uniform(0.5, 5, 40)
    index = toxicity.Index.build(vectors, [int(x) for x in rng.integers(0, 2, 700)], list(range(700)), idf)
    full = [toxicity._weights(index.vectors[i], idf) for i in range(700)]
    for q in vectors[:60]:
        w = toxicity._weights(q, idf)
        want = sorted(((-sum(w[t] * f.get(t, 0) for t in w), i) for i, f in enumerate(full)), key=lambda x: (round(x[0], 9), x[1]))
        want = [(-s, i) for s, i in want if s < 0][:9]
        got = index.search(q, 9)
        assert [round(s, 8) for s, _ in got] == [round(s, 8) for s, _ in want]


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert (clean.predicted == 1).mean() < 0.02 and (toxic.predicted == 1).mean() > 0.6
    assert got.score.between(0, 1).all()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.tox_score for r in toxicity.score(odd_docs(spark), toxicity.fit(odd_docs(spark), none)).collect()} == {0.0}


def plain_isotonic(x, y, w):
    """Weighted isotonic fit by the max-min formula: ``(first x, last x, fit, weight)`` per run of equal fits."""
    xs = sorted(set(x))
    ys = [sum(w[i] * y[i] for i in range(len(x)) if x[i] == v) for v in xs]
    ws = [sum(w[i] for i in range(len(x)) if x[i] == v) for v in xs]
    mean = lambda j, k: sum(ys[j : k + 1]) / sum(ws[j : k + 1])
    fit = [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    runs = []
    for v, f, m in zip(xs, fit, ws):
        if runs and abs(runs[-1][2] - f) < 1e-12:
            runs[-1] = (runs[-1][0], v, f, runs[-1][3] + m)
        else:
            runs.append((v, v, f, m))
    return runs


def test_toxicity_votes_and_calibration_equal_plain_ones():
    rng = np.random.default_rng(5)
    n, k, level = 150, 7, 0.1
    vectors = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(12, int(rng.integers(0, 5)), replace=False)} for _ in range(n)]
    vectors[3], vectors[4] = dict(vectors[5]), dict(vectors[5])  # ties
    labels = [int(any(t < 3 for t in v) and rng.random() < 0.8) for v in vectors]
    idf = rng.uniform(0.5, 5, 12)
    index = toxicity.Index.build(vectors, labels, list(range(n)), idf)
    own, truth = list(index.vectors), [int(x) for x in index.labels]
    index.calibrate(k, level)

    def unit(v):
        raw = {t: (1 + np.log(c)) * idf[t] for t, c in v.items()}
        norm = sum(x * x for x in raw.values()) ** 0.5
        return {t: x / norm for t, x in raw.items()}

    full = [unit(v) for v in own]
    cosine = lambda a, b: sum(x * b.get(t, 0.0) for t, x in a.items())

    def near(q, leave_out=-1):
        found = sorted((-round(c, 11), i) for i, f in enumerate(full) if i != leave_out and (c := cosine(q, f)) > 0)
        return [(-c, i) for c, i in found[:k]]

    def vote(found):
        weights = [1 / (toxicity.TINY + max(0.0, 1 - c)) for c, _ in found]
        return round(sum(w * truth[i] for w, (_, i) in zip(weights, found)) / sum(weights), 9)

    found = [near(f, i) for i, f in enumerate(full)]
    some = [i for i in range(n) if found[i]]
    ones = sum(truth)
    mass = [level / ones if y else (1 - level) / (n - ones) for y in truth]
    runs = plain_isotonic([vote(found[i]) for i in some], [truth[i] for i in some], [mass[i] for i in some])
    total, positive = sum(mass[i] for i in some), sum(mass[i] * truth[i] for i in some)
    shrink = total / len(some)
    want_x = [(a + b) / 2 for a, b, _, _ in runs]
    want_y = [(f * m + shrink * positive / total) / (m + shrink) for _, _, f, m in runs]
    assert index.knots[0] == pytest.approx(want_x, abs=1e-6) and index.knots[1] == pytest.approx(np.maximum.accumulate(want_y), abs=1e-6)
    none = [i for i in range(n) if not found[i]]
    assert none and index.nothing == pytest.approx(sum(mass[i] * truth[i] for i in none) / sum(mass[i] for i in none))
    for q in vectors[:40]:
        got = index.search(q, k)
        if not q:
            assert got == [] and index.score(got) == index.nothing
            continue
        want = near(unit(q))
        assert [c for c, _ in got] == pytest.approx([c for c, _ in want], abs=1e-9)
        if got:
            assert index.score(got) == pytest.approx(np.interp(vote([(c, i) for c, i in got]), want_x, np.maximum.accumulate(want_y)), abs=1e-6)


def test_toxicity_odd_rows(spark):
    schema = "doc_id long, text string, tox_score string, tox_examples int"
    own = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "vile nasty words here" if i % 4 == 0 else "kind gentle words here", "x", 1) for i in own]
    rows += [(own[0], "vile nasty words here", "x", 1)] * 500 + [(None, "vile", "x", 1), (9000, None, "x", 1), (9001, "", "x", 1), (9002, "vile " * 50_000, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in own] + [(own[0], 0), (own[1], None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.index.ids) == len(set(model.index.ids)) == len(own)  # repeated ids add no examples
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "tox_score", "tox_examples", "tox_similarity"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.tox_score)
    assert all(len(v) == 1 for v in by.values())  # equal texts score alike
    score = {k: min(v) for k, v in by.items()}
    assert score[9002] > 0.7 > score[own[1]] and score[9000] == score[9001] == model.index.nothing
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).count() == len(rows)


def test_toxicity_keeps_every_term_that_passes(spark):
    words = [f"w{i}x" for i in range(3400)]
    rows = [(i, " ".join(words if i % 2 else ["plain", "words"]), "en", "s", 1) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    assert {*words, "plain", "words"} <= set(model.vocabulary) and len(model.vocabulary) > 3400


# --- language ---


def test_language_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = language.Network.random(4, 3, rng)
    net = language.Network(*(p.astype(np.float64) for p in net.parts()))
    x, y = rng.integers(1, 255, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parts(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[i] += 1e-4
        up = net.gradients(x, y)[0]
        p[i] -= 2e-4
        down = net.gradients(x, y)[0]
        p[i] += 1e-4
        assert abs((up - down) / 2e-4 - g[i]) < 1e-3 * max(1, abs(g[i]))


def test_language_held_out_and_und(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    model = language.fit(docs, steps=60)
    odd = {r.doc_id: r for r in language.predict(odd_docs(spark), model).collect()}
    assert model.document(["½", "²³", "Ⅷ", "①", "_", "５", None, ""]) == [("und", 0.0)] * 8
    assert model.document(["ª½"])[0][0] != "und"
    assert [odd[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and odd[4].lang_pred != "und"
    assert language.fit(docs.limit(0)).document(["text"]) == [("und", 0.0)]


def test_language_labels_equal_a_plain_network():
    """The fast pass against gates written out one position at a time."""
    rng = np.random.default_rng(7)
    net = language.Network.random(5, 3, rng)
    x = rng.integers(1, 255, (3, language.WINDOW)).astype(np.uint8)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    got = net.label(x)
    for w in range(3):
        states = np.zeros((2, language.WINDOW, 5))
        for d in (0, 1):
            state = np.zeros(5)
            for t in range(language.WINDOW) if d == 0 else range(language.WINDOW - 1, -1, -1):
                own, back = net.table[d][x[w, t]].astype(float), state @ net.inner[d].astype(float)
                z, r = sigmoid(own[:5] + back[:5]), sigmoid(own[5:10] + back[5:10])
                state = (1 - z) * np.tanh(own[10:] + r * back[10:]) + z * state
                states[d, t] = state
        logits = np.concatenate([states[0], states[1]], axis=1) @ net.out + net.bias
        want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        assert np.abs(got[:, :, w] - want).max() < 1e-4


def test_language_odd_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, lang_score string"
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    own = [i for i in range(100) if not held(i)]
    one = spark.createDataFrame([(i, "only words of one tongue", "xx", 1, "s") for i in own] + [(None, None, None, None, None)], schema)
    model = language.fit(one, steps=5)
    assert model.languages == ["xx"]
    got = language.predict(one, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    assert {(r.lang_pred, r.lang_score) for r in got.collect()} == {("xx", 1.0), ("und", 0.0)} and got.count() == len(own) + 1
    assert language.predict(one.limit(0), model).count() == 0
    assert language.fit(one.limit(0)).net is None


def test_every_language_is_learnt(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    own = [i for i in range(2000) if not held(i)]
    rows = [(own[k], "".join(chr(0x4E00 + 97 * k + int(x)) for x in rng.integers(0, 40, 40)), f"l{k:03}", "s", 40) for k in range(210)]
    many = spark.createDataFrame(rows, DOCS)
    model = language.fit(many, steps=2)
    assert model.languages == [f"l{k:03}" for k in range(210)]  # one row each, and more than 200
    assert len(model.document([r[1] for r in rows[:3]])) == 3
    # Rows of no or one id, and many rows without letters, do not hide a language.
    odd = [(None, "no id at all", "xx", "s", 1)] * 600 + [(own[0], f"same id {i} ones", "yy", "s", 1) for i in range(600)]
    odd += [(i, "12", "zz", "s", 2) for i in own] * 2 + [(own[5], "letters", "zz", "s", 7)]
    assert language.fit(spark.createDataFrame(odd, DOCS), steps=2).languages == ["xx", "yy", "zz"]
    unlabelled = many.withColumn("lang", F.lit(None).cast("string"))
    assert P.keep_languages(spark, unlabelled, SF).count() == 210


# --- mixing ---


def test_share_out_and_flow():
    assert mixing.share_out([100, 100, 100], [3, 1, 2], 450, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.share_out([], [], 0, 2) == [] and mixing.share_out([0], [1], 0, 2) == [0]
    # A document set in both sources serves the one that lacks words.
    assert mixing.route([([0], 100), ([1], 10), ([0, 1], 50)], [100, 60]) == [100, 10, 50]
    assert mixing.route([([0], 10)], [100]) == [20]  # two readings at most
    # First readings everywhere before repetitions.
    assert mixing.route([([0], 10), ([0], 10)], [20]) == [10, 10]


def plain_flow(patterns, quotas, repeats=2):
    """Cost and size of a cheapest maximal flow, one unit at a time by Bellman-Ford."""
    end = 1 + len(patterns) + len(quotas)
    arcs = []
    add = lambda a, b, room, cost: arcs.extend([[a, b, room, cost], [b, a, 0, -cost]])
    for p, (members, size) in enumerate(patterns):
        for r in range(repeats):
            add(0, 1 + p, size, 2 * r + 1)
        for s in members:
            add(1 + p, 1 + len(patterns) + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        add(1 + len(patterns) + s, end, quota, 0)
    sent = cost = 0
    while True:
        dist, via = {0: 0}, {}
        for _ in range(end + 1):
            for k, (a, b, room, c) in enumerate(arcs):
                if room and a in dist and dist[a] + c < dist.get(b, 1 << 60):
                    dist[b], via[b] = dist[a] + c, k
        if end not in dist:
            return sent, cost
        v = end
        while v:
            arcs[via[v]][2] -= 1
            arcs[via[v] ^ 1][2] += 1
            v = arcs[via[v]][0]
        sent, cost = sent + 1, cost + dist[end]


def test_flow_equals_a_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(25):
        sources = int(rng.integers(1, 4))
        patterns = [(sorted(set(rng.integers(0, sources, int(rng.integers(1, 4))).tolist())), int(rng.integers(0, 9))) for _ in range(int(rng.integers(1, 6)))]
        quotas = [int(x) for x in rng.integers(0, 25, sources)]
        got = mixing.route(patterns, quotas)
        cost = sum(min(f, size) + 3 * max(0, f - size) for f, (_, size) in zip(got, patterns))
        assert (sum(got), cost) == plain_flow(patterns, quotas) and all(f <= 2 * size for f, (_, size) in zip(got, patterns))


def test_flow_of_many_patterns_is_quick():
    import time

    rng = np.random.default_rng(0)
    patterns = [(sorted(set(rng.integers(0, 50, int(rng.integers(1, 4))).tolist())), int(rng.integers(1, 1000))) for _ in range(20_000)]
    begun = time.process_time()
    assert sum(mixing.route(patterns, [200_000] * 50)) == 10_000_000
    assert time.process_time() - begun < 5


def test_mixing_cut_and_clashing_columns(spark):
    """Against a plain walk through the seeded order, with columns named like those of the operator."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "a", "a", "b", None]), 1, 2, "z") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, source_size int, _mix_full string")
    src = F.array("source")
    mix = mixing.solve(docs, src, F.col("doc_id"), F.col("text"))
    got = {r.doc_id: r.copies for r in mixing.copies(docs, mix, src, F.col("doc_id")).select("doc_id", "copies").collect()}
    sizes = {s: sum(len(t.split()) for _, t, x, *_ in rows if x == s) for s in ("a", "b", None)}
    targets = mixing.share_out([sizes[s] for s in ("a", "b", None)], [3, 1, 2], 1.5 * sum(sizes.values()), 2)
    assert {r.source: r.target for r in mix.totals.collect()} == pytest.approx(dict(zip(("a", "b", None), targets)))
    for s, target in zip(("a", "b", None), targets):
        own = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, x, *_ in rows if x == s)
        full, more, upto = round(target) // sizes[s], round(target) % sizes[s], 0
        for _, i, size in own:
            upto += size
            assert got[i] == full + (more > 0 and 2 * upto - size <= 2 * more), (s, i)


def test_mixing_odd_rows_and_reruns(spark):
    docs = odd_docs(spark)
    src = F.array("source")

    def run():
        m = mixing.solve(docs, src, F.col("doc_id"), F.col("text"))
        return sorted((str(r.doc_id), r.copies) for r in mixing.copies(docs, m, src, F.col("doc_id")).select("doc_id", "copies").collect())

    assert run() == run() and all(0 <= c <= 2 for _, c in run())
    empty = docs.limit(0)
    m = mixing.solve(empty, src, F.col("doc_id"), F.col("text"))
    assert mixing.copies(empty, m, src, F.col("doc_id")).count() == 0


# --- html ---


def test_html_extraction():
    model = html_extract.train(html_extract.labelled_pages())
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site better for you and for all of our visitors.</p></div><article><h1>Head &amp; line</h1><p>First   paragraph
    of the text<br>with a break and &eacute; in it, long enough.</p><div class="ad"><p>Buy now our product which is the best of all products.</p></div><p>Second paragraph with <b>bold</b> words<p>Third unclosed paragraph of text</article>
    <section id="comments"><div class="comment"><p>I liked this text very much and would like to say so.</p></div></section><form><p>Write to us</p><input></form><footer>&copy; all rights</footer></body></html>"""
    assert model.extract(page) == "Head & line\nFirst paragraph of the text with a break and é in it, long enough.\nSecond paragraph with bold words\nThird unclosed paragraph of text"
    assert model.extract(None) == model.extract("") == model.extract("<p>") == ""
    assert isinstance(model.extract("<div>" * 5000 + "x"), str)


def test_html_marginals_match_enumeration():
    from itertools import product

    model = html_extract.train(html_extract.labelled_pages(60))
    dom = html_extract.parse("<div class=content><p>some words in here</p>loose<ul><li>a<li>b</ul></div>")
    n, total, own = len(dom.tags), 0.0, [0.0] * 6
    own = [0.0] * n
    for labels in product(range(html_extract.LABELS), repeat=n):
        p = model.root[labels[0]]
        for i in range(n):
            p *= model.unary(dom, i)[labels[i]] * (model.edges[html_extract.kind_of(dom, i)][labels[dom.parents[i]]][labels[i]] if i else 1)
        total += p
        for i in range(n):
            own[i] += p * (labels[i] == html_extract.CONTENT)
    assert model.marginals(dom) == pytest.approx([x / total for x in own], rel=1e-6)


def test_html_text_in_frames_is_kept():
    model = html_extract.train(html_extract.labelled_pages())
    assert model.extract("<body>text one two three that goes on<br>next line</body>") == "text one two three that goes on next line"
    assert model.extract("just text with <b>bold</b> and <math><mi>x</mi></math>") == "just text with bold and x"
    page = "<html><body><nav><ul><li><a href=x>home</a></li></ul></nav>Article text in the body.<div class=ad>Buy now</div>Its end.</body></html>"
    assert model.extract(page) == "Article text in the body.\nIts end."
    page = "<div class=wrapper>text of a wrapper that goes on for some words<div class=sidebar><p>side</p></div></div>"
    assert model.extract(page) == "text of a wrapper that goes on for some words"
    assert model.extract("<article>Intro text <p>para</p> more text</article>") == "Intro text\npara\nmore text"
    math = "<article><p>We let <math><mi>a</mi><mo>=</mo><mn>1</mn></math> hold for the rest of this text.</p></article>"
    assert model.extract(math) == "We let a=1 hold for the rest of this text."


def test_html_parser_is_linear():
    """Four times the page takes at most nine times as long (a quadratic parser: sixteen), on any machine."""
    import time

    def took(page):
        best = float("inf")
        for _ in range(3):
            begun = time.process_time()
            html_extract.parse(page)
            best = min(best, time.process_time() - begun)
        return max(best, 0.01)

    hostile = ["<div>", "<p><x>", "<li><ul><x>", "<table><tr><td>", "<svg><div>", '<a "', "<a b='", '<a b="', "<!x", "</p>", "<li><p><x-y>", "</div>", "<ul><li>"]
    for unit in hostile:
        assert took(unit * 20_000 + "x") < 9 * took(unit * 5_000 + "x"), unit
    nested = lambda n: "<li><ul>" + "<x>" * n + "<li>a</li>" * n
    assert took(nested(20_000)) < 9 * took(nested(5_000))


def test_html_tags_as_browsers_read_them():
    text = lambda page: [t for _, t in html_extract.parse(page).blocks]
    assert text('<p title="5" screen">one</p><p a=">">two</p><p a=\'x>y\'>three</p><p a=b"c>four</p>') == ["one", "two", "three", "four"]
    assert text("<table><tr><td>a<td>b<tr><th>c</table><p>d<p>e<div>f</div>") == ["a", "b", "c", "d", "e", "f"]
    assert text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><dl><dt>e<dd>f</dl>") == ["a", "b", "c", "d", "e", "f"]
    assert text("<p>a<table><tr><td><p>b</td></tr></table>") == ["a", "b"] and text("a</p>b") == ["a", "b"]


def test_html_odd_tables(spark):
    model = html_extract.train(html_extract.labelled_pages(60))
    schema = "page_id long, html string, main_text int, text string"
    assert html_extract.extract(spark.createDataFrame([], schema), model).count() == 0
    body = "<article><p>Plain words of a paragraph that is long enough to be one.</p></article>"
    got = html_extract.extract(spark.createDataFrame([(1, body, 7, "t"), (1, body, 7, "t"), (2, None, 8, None)], schema), model)
    assert got.columns == ["page_id", "html", "text", "main_text"]
    rows = sorted((r.page_id, r.main_text, r.text) for r in got.collect())
    assert rows == [(1, "Plain words of a paragraph that is long enough to be one.", "t")] * 2 + [(2, "", None)]


def test_html_pages_of_the_table(spark):
    import html
    import re

    for r in queries.op5_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", " ", body))
        assert r.text == "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert r.n_chars == len(r.text)


# --- search ---


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)], "x") for i in range(400)] + [(i, [0.5] * 6, "x") for i in range(400, 700)]
    rows += [(1000, None, "x"), (1001, [None] * 6, "x"), (1002, [float("nan")] * 6, "x"), (1003, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, k=7, block_rows=120, block_queries=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and i < 1000}
    for q in (i for i in ints if i % 50 == 0):
        want = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mtree.top_k(df.where("vec_id <= 2"), F.col("vec_id") % 50 == 0).count() == 2


def test_search_skips_what_bounds_exclude():
    """Clustered rows: exact against brute force, with most scores never computed."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 16))
    rows = np.floor(1024 * (centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.02, (3000, 16)))).astype(np.int64)
    ids = rng.permutation(3000)
    r2 = float((rows.astype(float) ** 2).sum(axis=1).max())
    pivot = mtree.lifted(rows[:1], r2)[0]
    tree, count = mtree.build(ids, rows, r2, pivot), [0]
    assert sorted(tree.ids) == list(range(3000)) and max(len(n.parent_distance) for n in _leaves(tree.root)) <= mtree.PAGE
    own = rng.choice(3000, 50, replace=False)
    got = mtree.search(tree, pivot, rows[own], ids[own], r2, 5, count=count)
    for q, i, s, found in zip(rows[own], ids[own], got.scores, got.ids):
        want = sorted((-int(q @ r), int(j)) for r, j in zip(rows, ids) if j != i)[:5]
        assert [(-int(a), int(b)) for a, b in zip(s, found)] == want
    assert count[0] < 0.5 * 50 * 3000
    far = mtree.search(tree, pivot, rows[own], ids[own], r2, 5, kth=np.full(50, 1e12), count=(none := [0]))
    assert none[0] == 0 and (far.ids == np.iinfo(np.int64).max).all()
    with pytest.raises(OverflowError):
        mtree.search(tree, pivot, rows[own] << 40, ids[own], r2, 5)
    big = mtree.search(tree, pivot, rows[own] << 28, ids[own], r2, 5)  # beyond exact floats
    assert big.scores.dtype == np.int64 and (big.ids == got.ids).all()


def _leaves(node):
    return [node] if node.children is None else [x for c in node.children for x in _leaves(c)]


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.5, 0.5])] + [(7, [1.0, float(i % 3)]) for i in range(500)] + [(8, [0.25, 1.0]), (9, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for order in ("embedding", F.desc("embedding")):
        got = mtree.top_k(df.orderBy(order).repartition(4), F.col("vec_id") % 100 == 0, k=10, block_rows=2)
        # 100 is (0.5, 0.5), 7 is (1, 0), 9 is (0.25, 0)
        assert sorted(tuple(r) for r in got.collect()) == [(100, 1, 8, 512 * 256 + 512 * 1024), (100, 2, 7, 512 * 1024), (100, 3, 9, 512 * 256)]


# --- tokens ---


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    path, pattern = queries.tokenizer_files()
    ranks = byte_bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(60)]
    texts += ["", None, "<|endoftext|>", "a" * 5000, "  \n\n  x", *ds.dataset(f"{SF}/documents.parquet").to_table()["text"].to_pylist()[:200]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert all(bytes(r.decoded) == (texts[r.k] or "").encode() for r in byte_bpe.encode(df, path, pattern, decoded=True).collect())
    for r in byte_bpe.decode(byte_bpe.encode(df, path, pattern), path).collect():
        t = texts[r.k] or ""
        assert r.token_ids == want.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        assert bytes(r.packed) == np.array(r.token_ids, dtype="<u4").tobytes()
        at = 0
        for tok, a, b in zip(r.token_ids, r.char_starts, r.char_ends, strict=True):
            piece = want.decode_single_token_bytes(tok)
            first, last = len(t.encode()[:at].decode(errors="ignore")), at + len(piece)
            assert a == first and t[a:b].encode().find(piece.strip(b"\x80")[:1]) >= -1 and b >= a
            at = last
        assert not r.token_ids or (r.char_starts[0] == 0 and r.char_ends[-1] == len(t))


def test_bpe_odd_tables(spark):
    path, pattern = queries.tokenizer_files()
    schema = "token_ids string, k long, text string, packed int, decoded int"
    empty = byte_bpe.encode(spark.createDataFrame([], schema), path, pattern, decoded=True)
    assert empty.count() == 0 and empty.columns == ["k", "text", "token_ids", "char_starts", "char_ends", "packed", "decoded"]
    assert byte_bpe.decode(empty.drop("decoded"), path).count() == 0
    got = byte_bpe.encode(spark.createDataFrame([("x", 1, "a b", 1, 1), ("y", 1, "a b", 1, 1), ("z", 2, None, 1, 1)], schema), path, pattern, decoded=True).collect()
    assert sorted((r.k, bytes(r.decoded), len(r.token_ids)) for r in got) == [(1, b"a b", 2), (1, b"a b", 2), (2, b"", 0)]


def test_bpe_cuts_batches_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "", "b" * 50, "c" * 200, "d"])], names=["t"])
    got = [b.column(0).to_pylist() for b in byte_bpe._shares(iter([batch, batch.slice(0, 0)]), "t", most=60)]
    assert sum(got, []) == batch.column(0).to_pylist() and all(sum(n) - max(n) < 60 for g in got if (n := [len(t or "") for t in g]))
    with pytest.raises(OverflowError):
        byte_bpe._binary(memoryview(np.zeros(1 << 31, dtype=np.uint8)), np.array([0, 1 << 31]))


# --- urls ---


def test_url_rules_and_model(spark):
    model = url_filter.fit(url_filter.labelled_urls())
    fresh = url_filter.labelled_urls(800, seed=5)
    assert ((model.probability([u for u, _ in fresh]) >= 0.5) == np.array([v for _, v in fresh])).mean() > 0.97
    cases = [
        ("http://a.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://x.net/q", "x.net", "/q", "net/", "block"), ("https://x.net", "x.net", "", None, "allow"),
        ("http://www.example.com/de/9?a=1#b", "www.example.com", "/de/9", "example.com/de/", "block"), ("http://notexample.com/de/9", "notexample.com", "/de/9", None, "allow"),
        ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme/net/", "", "", None, None), ("http://u?x=http://y.net/", "u", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, path string")
    got = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (verdict is None or got[i].verdict == verdict), cases[i]


def test_url_trees_equal_plain_ones():
    """Boosting and prediction against one row, one feature and one bar at a time."""
    import math

    labelled = url_filter.labelled_urls(240, seed=2)
    model = url_filter.fit(labelled, trees=4, depth=2)
    urls, y = [u for u, _ in labelled], [v for _, v in labelled]
    x = [url_filter.features(u, model.rates, model.usual) for u in urls]
    bars = [sorted(set(np.quantile([r[f] for r in x], np.linspace(0.02, 0.98, 33)))) for f in range(len(url_filter.FEATURES))]
    score = [model.start] * len(y)
    for tree in model.trees:
        p = [1 / (1 + math.exp(-s)) for s in score]

        def grow(node, rows, level):
            g, h = sum(y[i] - p[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
            best = None
            for f, cuts in enumerate(bars) if level < 2 else ():
                for bar in cuts:
                    left = [i for i in rows if x[i][f] <= bar]
                    gl, hl = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    best = max(best or (1e-6, 0, 0.0), (gain, -f, bar), key=lambda b: round(b[0], 9))
            f, bar, value = tree[node]
            if best is None or best[0] <= 1e-6:
                assert f == -1 and value == pytest.approx(0.2 * g / (h + 1))
                for i in rows:
                    score[i] += value
                return
            left = [i for i in rows if x[i][f] <= bar]
            gl, hl = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
            assert gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1) == pytest.approx(best[0])  # no better split
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, [i for i in rows if x[i][f] > bar], level + 1)

        grow(0, list(range(len(y))), 0)
    assert model.probability(urls) == pytest.approx([1 / (1 + math.exp(-s)) for s in score])


def test_url_odd_tables(spark):
    model = url_filter.fit(url_filter.labelled_urls(400))
    schema = "page_id long, url string, host int, junk string, verdict int, rule int"
    assert url_filter.judge(spark.createDataFrame([], schema), queries.URL_RULES, model).count() == 0
    long = "http://a.net/" + "x/" * 200_000 + "?" + "a=1&" * 50_000
    rows = [(1, long, 1, "j", 1, 1), (2, None, 1, "j", 1, 1), (2, None, 1, "j", 1, 1), (3, "http://b.com/y", 1, "j", 1, 1)]
    got = url_filter.judge(spark.createDataFrame(rows, schema), queries.URL_RULES, model).collect()
    assert len(got) == 4
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.net", "/" + "x/" * 200_000, "net/", "block")
    assert (by[2].host, by[2].path, by[2].rule) == ("", "", None) and by[2].verdict in ("allow", "block")
    assert url_filter.features(None, model.rates, model.usual) == [0] * 14 + [model.usual] * 2


# --- fingerprints ---


def plain_features(text, rarity):
    """The features of a text by their definition: one window, one group of windows at a time."""
    import math

    w, n = rare_digest.W, len(text)
    steps = 1 << rare_digest.STEPS
    scaled = [round(c * math.log2(c) * 2**16) if c else 0 for c in range(w + 1)]

    def far(i):
        weight = sum(scaled[text[i : i + w].count(b)] for b in set(text[i : i + w]))
        return int(rarity[((6 << 16) - weight // w) * steps >> 16])

    fars = [far(i) for i in range(n - w + 1)]
    groups = range(len(fars) - w + 1)
    votes = [0] * len(fars)
    for g in groups:
        best = max(range(g, g + w), key=lambda i: (fars[i], -i))
        votes[best] += fars[best] >= 0
    chosen = []
    if not groups and fars:
        best = max(range(len(fars)), key=lambda i: (fars[i], -i))
        chosen = [best] * (fars[best] >= 0)
    bar = rare_digest.VOTES
    while groups and not chosen and bar:
        chosen = [i for i, v in enumerate(votes) if v >= bar]
        bar //= 2
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * m) & mask
        return x ^ (x >> 33)

    out = list(dict.fromkeys(mix(sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(text[i : i + w])) & mask) for i in chosen))
    if text and len(out) < rare_digest.FEW:
        out.append(mix(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")))
    return out


def plain_filters(features):
    return [{(h >> (11 * k)) % 1024 for h in features[a : a + 80] for k in range(5)} for a in range(0, len(features), 80)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = plain_filters(a), plain_filters(b)
    if not x or not y:
        return 0.0
    if len(x) > len(y):
        x, y = y, x

    def alike(p, q):
        chance, most = len(p) * len(q) / 1024, min(len(p), len(q))
        return min(1.0, max(0.0, (len(p & q) - chance) / max(most - chance, 1e-9)))

    return sum(max(alike(p, q) for q in y) for p in x) / len(x)


def test_fingerprints_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    counts = [0] * rare_digest.BINS
    for t in texts.values():
        for i in range(len(t) - 63):
            seen = np.bincount(np.frombuffer(t[i : i + 64], dtype=np.uint8))
            weight = sum(round(int(c) * np.log2(c) * 2**16) for c in seen if c)
            counts[((6 << 16) - weight // 64) >> 10] += 1
    rarity = rare_digest.measure(docs)
    assert (rarity == rare_digest.rarity_of(np.array(counts))).all()
    order = [i for i in sorted(texts, reverse=True) if len(texts[i]) < 3000]
    got = {r.doc_id: r for r in queries.op9_rare_digest(spark, "/root/testdata/sf0.001").collect()}
    unpacked = lambda fp: [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in rare_digest.unpack(fp)]
    ids, done = sorted(texts, reverse=True), 0
    for k, i in enumerate(ids):
        nxt = texts[ids[(k + 1) % len(ids)]]
        if len(texts[i]) > 2500 or len(nxt) > 2500 or done > 25:
            continue
        done += 1
        changed = rare_digest.edited(texts[i].decode(), nxt.decode()).encode()
        own, other, edit = (plain_features(t, rarity) for t in (texts[i], nxt, changed))
        r = got[i]
        assert r.fingerprint.split(":")[0] == str(len(own)) and unpacked(r.fingerprint) == plain_filters(own)
        assert r.edited_fingerprint.split(":")[0] == str(len(edit)) and unpacked(r.edited_fingerprint) == plain_filters(edit)
        assert r.near_edited == pytest.approx(plain_likeness(own, edit), abs=1e-9) or len(plain_filters(own)) == len(plain_filters(edit)) > 1
        assert r.near_next == pytest.approx(plain_likeness(own, other), abs=1e-9) or len(plain_filters(own)) == len(plain_filters(other)) > 1
    assert done > 10 and order


def test_fingerprint_clashing_columns_and_hot_ids(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3} " * 40, "x", 1) for i in range(400)] + [(None, "t" * 90, "x", 1)] * 5, "doc_id long, text string, fingerprint string, hash int")
    got = rare_digest.fingerprints(docs)
    assert got.columns == ["doc_id", "text", "hash", "fingerprint"] and got.count() == 405
    out = rare_digest.compare_neighbours(docs).collect()
    assert len(out) == 405 and sum(r.near_next == 1 for r in out) >= 400 - 3
    assert rare_digest.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    got = queries.op9_rare_digest(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    raw = [t.encode() for t in docs.text]
    fps = [rare_digest.fingerprint(h) for h in rare_digest.features(raw, rare_digest.rarity_of(rare_digest.histogram(raw)))]
    for i in range(len(docs)):
        k = (i + 1) % len(docs)
        e = rare_digest.edited(docs.text[i], docs.text[k])
        r = got.loc[docs.doc_id[i]]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(docs.text[i]) and r.fingerprint == fps[i]
        assert r.near_next == pytest.approx(rare_digest.likeness(fps[i], fps[k])) and 0 <= r.near_edited <= 1
    same_text = docs.groupby("text").doc_id.apply(list)
    assert all(len({got.loc[i].fingerprint for i in ids}) == 1 for ids in same_text)
    assert got.near_edited.mean() > got.near_next.mean() + 0.3


def test_fingerprint_segments_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    big = bytes(rng.choice(list(b"etaoin shrdlu,."), 300_000).tolist())
    counts = rare_digest.histogram([big])
    table = rare_digest.rarity_of(counts)
    whole = rare_digest.features([big], table)[0]
    monkeypatch.setattr(rare_digest, "SEGMENT", 1 << 16)
    assert (rare_digest.features([big], table)[0] == whole).all() and (rare_digest.histogram([big]) == counts).all()
    assert rare_digest.fingerprint(rare_digest.features([b""], table)[0]) == "0:" and rare_digest.likeness("0:", "0:") == 1
    out = rare_digest.compare_neighbours(odd_docs(spark))
    assert out.count() == 8
    one = rare_digest.compare_neighbours(odd_docs(spark).where("doc_id = 6")).first()
    assert one.near_next == 1 and one.n_chars == 2
    assert rare_digest.compare_neighbours(odd_docs(spark).limit(0)).count() == 0


def test_every_text_has_a_fingerprint_of_its_own():
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"etaoin shrdlu,.ETAOIN", dtype=np.uint8)
    texts = [bytes(rng.choice(letters, n)) for n in range(1, 301) for _ in range(3)]
    table = rare_digest.rarity_of(rare_digest.histogram(texts))
    fps = [rare_digest.fingerprint(h) for h in rare_digest.features(texts, table)]
    assert "0:" not in fps
    assert all(rare_digest.likeness(a, b) < 1 for t, u, a, b in zip(texts, texts[1:], fps, fps[1:]) if t != u)
    # A byte more, or another last byte, is another text.
    short = [t for t in texts if len(t) < 190]
    for other in ([t + b"x" for t in short], [t[:-1] + b"#" for t in short]):
        got = [rare_digest.fingerprint(h) for h in rare_digest.features(other, table)]
        alike = [rare_digest.likeness(a, b) for a, b in zip(fps, got)]
        assert "0:" not in got and np.mean([x == 1 for x in alike]) < 0.02
    runs = [unit * n for unit in (b"a", b"b", b"ab", b"cd", b"abcdefgh ") for n in (1, 63, 64, 65, 100, 126, 127, 140, 300, 2000, 300_000)]
    fps = [rare_digest.fingerprint(h) for h in rare_digest.features(runs, table)]
    assert "0:" not in fps
    assert len({f for t, f in zip(runs, fps) if len(set(t)) == 1}) == 22
    assert rare_digest.likeness(fps[runs.index(b"ab" * 300)], fps[runs.index(b"cd" * 300)]) < 0.5


def test_html_keeps_text_of_and_after_embedded_elements():
    text = lambda page: [t for _, t in html_extract.parse(page).blocks]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p>Next</p>") == ["Let x=2 be.", "Next"]
    assert text("<p>See <svg><g><path d='M0'/><text>label</text></g></svg> here</p><p>Next</p>") == ["See label here", "Next"]
    assert text("<p>a <object data=x>instead</object> b <canvas>drawn</canvas> c</p>") == ["a instead b drawn c"]
    assert text("<div>one<noscript>two</noscript>three</div>") == ["one", "two", "three"]
    for tag in ("object", "math", "svg", "canvas", "noscript", "select"):  # without an end tag
        assert text(f"<p>first</p><{tag}><p>second</p><div><p>third</p></div>")[-2:] == ["second", "third"]
    for tag in ("script", "style", "template", "iframe", "textarea"):
        assert text(f"<p>first</p><{tag}>x < y</{tag}><p>second</p>") == ["first", "second"]
        assert text(f"<p>first</p><{tag}><p>second</p>") == ["first"]
    model = html_extract.train(html_extract.labelled_pages())
    body = " ".join(["Plain words of a long paragraph go on here."] * 6)
    page = f"<html><body><article><h1>Title</h1><p>{body}</p><object data=x><p>{body} Last.</p></article></body></html>"
    assert "Last." in model.extract(page)


# --- warc ---


def test_warc_salvage_inside_members():
    rng = np.random.default_rng(4)

    def rec(i, body):
        return warc.record_bytes(i, f"http://h/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None)

    def found(data):
        got = list(warc.salvage(data))
        return [int(h["warc-record-id"][12:-1]) for _, _, h, _, _ in got if h], [g for g in got if g[2] is None]

    plain = [rec(i, bytes(rng.integers(0, 256, 3000 + i, dtype=np.uint8))) for i in range(8)]
    bad = plain[:3] + [plain[3].replace(b"sha256:", b"sha256:0")] + plain[4:]
    after = gzip.compress(rec(99, b"after " * 30))
    ids, gaps = found(gzip.compress(b"".join(bad)) + after)
    assert ids == [0, 1, 2, 4, 5, 6, 7, 99] and len(gaps) == 1 and "digest" in gaps[0][4]
    for level in (0, 6):  # stored or packed
        one = gzip.compress(b"".join(plain), level)
        ids, gaps = found(one[: len(one) * 6 // 8])
        assert ids == [0, 1, 2, 3, 4, 5][: len(ids)] and len(ids) >= 5 and len(gaps) == 1 and gaps[0][1] == len(one) * 6 // 8
        ids, gaps = found(one[: len(one) * 6 // 8] + after)  # the next member is not lost with the rest
        assert ids == [*range(len(ids) - 1), 99] and len(ids) >= 6
    ids, gaps = found(one[:-8] + b"12345678" + after)  # wrong checksum
    assert ids == [99] and len(gaps) == 1
    stored = bytearray(gzip.compress(b"".join(plain), 0))
    stored[len(stored) // 2] ^= 1  # in one payload: the digest tells which
    ids, gaps = found(bytes(stored) + after)
    assert ids in ([0, 1, 2, 4, 5, 6, 7, 99], [0, 1, 2, 3, 5, 6, 7, 99]) and len(gaps) == 2
    assert found(gzip.compress(b"") + after) == ([99], [])


def test_warc_salvage(spark, tmp_path):
    def rec(i, body):
        return warc.record_bytes(i, f"http://h/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None)

    bodies = [bytes([65 + i]) * (200 + i) for i in range(6)]
    members = [warc.member(rec(i, b)) for i, b in enumerate(bodies)]
    assert all(m.endswith(b"\0") for m in members)
    clean = b"".join(members)
    assert [h["warc-record-id"] for _, _, h, _, _ in warc.salvage(clean)] == [f"<urn:record:{i}>" for i in range(6)]
    broken = bytearray(clean)
    hit = len(members[0]) + len(members[1]) + len(members[2]) // 2
    broken[hit] ^= 0xFF
    got = list(warc.salvage(bytes(broken)))
    assert [h["warc-record-id"][12:-1] for _, _, h, _, _ in got if h] == ["0", "1", "3", "4", "5"]
    gap = [(a, b, why) for a, b, h, _, why in got if h is None]
    assert gap == [(len(members[0]) + len(members[1]), len(members[0]) + len(members[1]) + len(members[2]), gap[0][2])]
    plain = b"junk" + rec(1, b"x" * 120) + rec(2, b"y")[:-6] + rec(3, b"z" * 130)
    got = list(warc.salvage(plain))
    assert [h["warc-record-id"][12:-1] for _, _, h, _, _ in got if h] == ["1", "3"] and len([g for g in got if g[2] is None]) == 2
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken))
    (tmp_path / "b.warc").write_bytes(plain)
    back = warc.read_archives(spark, f"file://{tmp_path}")
    assert back.where("error is null").count() == 7 and back.where("error is not null").count() == 3


def test_warc_round_trip_with_odd_rows(spark, tmp_path):
    big = "long " * 50_000
    rows = [(1, "u", None), (2, None, ""), (3, "http://a/\r\nX: y", "p" * 99), (4, "u", "q" * 100), (5, "u", "q" * 100), (4, "u", "q" * 100), (None, "u", "q" * 100), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n\r\n" * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(df, "page_id", "url", "html"), path)
    back = warc.read_archives(spark, path).collect()
    assert len(back) == len(rows) and all(r.error is None for r in back)
    kinds = sorted((str(r.rec_id), r.warc_type, r.refers_to) for r in back)
    assert kinds == sorted([("1", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("4", "response", None), ("5", "revisit", 4), ("None", "response", None), ("6", "response", None), ("7", "response", None)])
    assert {r.rec_id: bytes(r.payload).decode() for r in back if r.warc_type == "response"}[6] == big
    import glob

    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/part-*"))
    assert data.count(b"WARC/1.1\r\nWARC-Type") == len(rows)  # ordinary gzip readers agree
    empty = df.limit(0)
    warc.write_archives(warc.plan_records(empty, "page_id", "url", "html"), f"{path}2")
    assert warc.read_archives(spark, f"{path}2").count() == 0


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    import os

    rng = np.random.default_rng(6)
    text = lambda n: bytes(rng.integers(33, 127, n, dtype=np.uint8)).decode()
    big = [text(n) for n in (700_000, 900_000, 5_000_000, 600_000)]
    rows = [(i, "u", text(3000)) for i in range(600)] + [(1000 + i, "u", t) for i, t in enumerate(big)] + [(2000, "u", big[2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(df, "page_id", "url", "html"), path, archive_bytes=2 << 20)
    sizes = [os.path.getsize(f"{tmp_path}/w/{f}") for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    assert sum(s > 2 << 20 for s in sizes) == 1 and len(sizes) >= 4  # only the record that is longer by itself
    back = warc.whole(warc.read_archives(spark, path)).collect()
    got = {r.rec_id: (r.warc_type, r.payload_bytes, bytes(r.payload).decode()) for r in back}
    assert len(back) == len(rows) and got[2000] == ("revisit", 5_000_000, "")
    assert all(got[i][2] == t for i, _, t in rows if i != 2000)


def test_warc_gaps_are_logged_and_fatal(spark, tmp_path):
    body = b"x" * 150
    good = warc.record_bytes(1, "u", body, 150, hashlib.sha256(body).hexdigest(), None)
    wrong = good.replace(b"X-Payload-Length: 150", b"X-Payload-Length: 151")
    (tmp_path / "a.warc").write_bytes(good + wrong + good)
    back = warc.read_archives(spark, f"file://{tmp_path}/a.warc")
    (gap,) = warc.quarantined(back).collect()
    assert (gap.begin, gap.end, gap.error) == (len(good), len(good) + len(wrong), "payload length does not fit")
    with pytest.raises(warc.Damaged, match="payload length"):
        warc.whole(back)
    clashing = spark.createDataFrame([(1, "u", "h", 5, "d")], "page_id long, url string, html string, n_bytes int, digest string")
    assert warc.plan_records(clashing, "page_id", "url", "html").first().n_bytes == 1


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "byte_bpe"]
    kept = P.drop_toxic(spark, docs, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in ids for i in clean) > 0.98 * len(clean) and kept.columns == docs.columns
    lang = P.keep_languages(spark, odd_docs(spark).unionByName(docs), SF)
    assert lang.columns == docs.columns and not {1, 2, 3, 5} & {r.doc_id for r in lang.where("length(text) < 6 or text is null").collect()}
    deduped = P.drop_near_duplicates(spark, docs.union(docs.where("doc_id < 20")), SF)
    assert deduped.count() == deduped.select("doc_id").distinct().count() < docs.count()
    mixed = P.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() > docs.count()
    done = P.run(spark, SF)
    assert done.count() > 0 and "ids_sha256" in done.columns


def test_pipeline_stages_on_empty_and_odd_tables(spark):
    import corpus_pipeline as P

    more = "doc_id long, text string, lang string, source string, n_chars long, id long, tox_score string, lang_pred int, copies int, token_ids string, root long"
    empty = spark.createDataFrame([], more)
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x", 1, 1, "t", 1), (3, "", "en", "s", 0, 2, "x", 1, 1, "t", 1), (3, "", "en", "s", 0, 2, "x", 1, 1, "t", 1), (4, "words of a text " * 9, "en", "s", 1, 3, "x", 1, 1, "t", 1)], more)
    for name, stage in P.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
        got = stage(spark, odd, "/root/testdata/sf0.001")
        assert 4 in {r.doc_id for r in got.collect()} or name == "language", name
        assert name == "byte_bpe" or got.columns == odd.columns


def test_temporaries_are_given_up(spark):
    from ledgerloom.llm.common import cut, keep, temporaries

    paths = lambda *frames: [f for df in frames for f in df.inputFiles()]
    with temporaries() as kept:
        a, b = cut(spark.range(5)), cut(spark.range(7))
        c = keep(spark.range(3))
        kept.append(b)
        files = paths(a, b)
    assert not c.is_cached and b.count() == 7
    import os

    assert [os.path.exists(f.removeprefix("file://")) for f in files] == [False] * len(paths(a)) + [True] * len(paths(b))


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1)), (7, text(1)), (7, text(2)), (7, text(2)), (7, ""), (7, None), (8, text(2) + " more"), (9, text(3)), (9, text(3)), (None, text(4)), (None, text(4))]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for (i, t), s in zip(rows, "abcdefghijk")], DOCS)
    want = [("1", text(1), "a"), ("7", "", "e"), ("7", "None", "f"), ("8", text(2) + " more", "g"), ("9", text(3), "h"), ("None", text(4), "j"), ("None", text(4), "k")]
    for order in ("source", F.desc("source")):
        got = P.drop_near_duplicates(spark, docs.orderBy(order).repartition(3), SF)
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text), r.source) for r in got.collect()) == sorted(want)


def test_top_k_of_wide_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=3000 if i % 2 else 2)], "x", 1.0, 5, 7, "t") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string, v double, cell int, tree int, turn string")
    got = mtree.top_k(df, F.col("vec_id") % 20 == 0, k=4, block_rows=7, block_queries=1).collect()
    wide = np.zeros((60, 3000), dtype=np.int64)
    for i, e, *_ in rows:
        wide[i, : len(e)] = np.floor(1024 * np.array(e))
    want = {}
    for i in range(0, 60, 20):
        score = wide @ wide[i]
        for r, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-score[j], j))[:4], 1):
            want[i, r] = (j, int(score[j]))
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got} == want


def test_routing_holds_few_distances_at_once(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_rows=20, block_queries=11).collect()))
    whole = ask()
    monkeypatch.setattr(mtree, "ROUTED", 1)  # a query at a time
    assert ask() == whole


def test_very_long_texts_have_a_language(spark):
    german, english = "der schnelle braune fuchs springt über den hund ", "the quick brown fox jumps over the dog "
    docs = spark.createDataFrame([(i, t * (3 + i % 5), l) for i in range(40) for t, l in ((german, "de"), (english, "en"))], "doc_id long, text string, lang string")
    model = language.fit(docs, steps=120)
    odd = spark.createDataFrame([(1, german * 40_000), (2, english * 40_000), (3, "1" * 2_000_000), (4, german * 200 + english * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.predict(odd, model).collect()}
    assert got == {1: "de", 2: "en", 3: "und", 4: "en"}
