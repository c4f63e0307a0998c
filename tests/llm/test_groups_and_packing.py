"""Centroids, packing and spelling variants, against plain versions and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, packing, queries, variants

# ---- centroid clustering


def plain_k_means(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        now = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(now)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, j, d in found)


def run_centroids(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, norms int")  # clashing names
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_centroids(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def test_centroids_equal_plain_k_means(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)], "x", 1) for i in range(300)]
    rows += [(1000 + i, rows[5][1], "x", 1) for i in range(100)]  # a third are equal: ties
    rows += [(7, rows[3][1], "x", 1), (7, rows[3][1], "x", 1), (None, rows[4][1], "x", 1)]
    rows += [(2000, None, "x", 1), (2001, [1.0] * 63, "x", 1), (2002, [None] * 64, "x", 1), (2003, [float("nan")] * 64, "x", 1), (2004, [float("inf")] * 64, "x", 1), (2005, [], "x", 1)]
    assert run_centroids(spark, rows, tmp_path) == plain_k_means([r[:2] for r in rows], 40, 5)


def test_centroids_few_and_none(spark, tmp_path):
    rows = [(i, [float(i)] * 64, None, None) for i in range(3)]
    got = run_centroids(spark, rows, tmp_path / "few")
    assert got == plain_k_means([r[:2] for r in rows], 40, 5) and {r[4] for r in got} == {0}
    assert run_centroids(spark, [], tmp_path / "none") == []


def test_centroids_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceed 63 bits"):
        centroids.k_means(df)


def test_block_norms_screen_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, size=(40, 64)) * np.repeat(rng.integers(0, 2, size=(40, 8)), 8, axis=1)
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-9, 9, size=(5000, 64))
    count = [0]
    got, far = centroids.nearest(x, centroids.segment_norms(x), centres, count=count)
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert (centroids.lower_bounds(centroids.segment_norms(x), centroids.segment_norms(centres)) <= d).all()
    assert count[0] < 5000 * 10  # of 40 distances a row


# ---- packing


def pieces_of(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [(p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]


def whole_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_files("word_bpe_49k.json")[0])
    t.encode_special_tokens = True
    return t


def check_gapless(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_texts(spark, tmp_path):
    long = "Whole texts, don't cut! Ünïcødé 中文 x² " * 4000
    texts = [None, "", " \t\n", "a", long, "é́ \x1c \x85 <|endoftext|> 'S'll", "y" * 5000, long + "z", "word " * 1_300_000] + ["same text of many rows"] * 200
    rows = [(i if i % 7 else None, t, -1, -1) for i, t in enumerate(texts)] + [(3, "a", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, offset int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_packing(spark, str(tmp_path)).collect()
    t = whole_tokenizer()
    want = sorted((str(i), *p) for i, x, _, _ in rows for p in pieces_of(x, t))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_gapless(got) <= -(-sum(r.length for r in got) // 4096) + 1


def test_packing_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_packing(spark, str(tmp_path)).count() == 0


def test_packing_whole_tables_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_packing(spark, sf).collect()
    t = whole_tokenizer()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((d.doc_id, *p) for d in docs for p in pieces_of(d.text, t))
    assert check_gapless(got) <= -(-sum(r.length for r in got) // 4096) + 1


def test_special_tokens_on_request():
    path = queries.tokenizer_files("word_bpe_49k.json")[0]
    assert packing.Encoder(path, special=True).ids("a<|endoftext|>b").tolist() == [320, 49407, 321]
    assert 49407 not in packing.Encoder(path).ids("a<|endoftext|>b").tolist()


def test_encoder_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 20)
    monkeypatch.setattr(packing, "STEP", 30)
    e, t = packing.Encoder(queries.tokenizer_files("word_bpe_49k.json")[0]), whole_tokenizer()
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("abXÉ's 0!\n\té中͏"), size=200))
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_with_their_mark_are_asked_for_once(monkeypatch):
    asked, own = [], packing.Encoder._run
    monkeypatch.setattr(packing.Encoder, "_run", lambda self, run: asked.append(run) or own(self, run))
    e, t = packing.Encoder(queries.tokenizer_files("word_bpe_49k.json")[0]), whole_tokenizer()
    for _ in range(3):
        assert e.ids("Words words, words,").tolist() == t.encode("Words words, words,", add_special_tokens=False).ids
    assert asked == ["words", "words,"]


def test_configurations_hold_every_piece_once():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64):
        for _ in range(20):
            counts = np.zeros(capacity + 1, dtype=np.int64)
            for l in rng.integers(1, capacity + 1, size=5):
                counts[l] = rng.integers(0, 1000)
            held = np.zeros_like(counts)
            for config, copies in packing.configurations(counts, capacity, steps=30):
                assert copies > 0 and sum(l * a for l, a in config.items()) <= capacity
                for l, a in config.items():
                    held[l] += a * copies
            assert (held == counts).all()


def test_the_program_beats_best_fit_where_it_fails():
    # Best fit puts three of 34 with nothing; the optimum is 51 + 27 + 22 and the like.
    counts = np.zeros(101, dtype=np.int64)
    for l, n in ((51, 6000), (27, 6000), (26, 6000), (23, 6000), (24, 0)):
        counts[l] = n
    n_lp = sum(n for _, n in packing.configurations(counts, 100))
    n_fit = sum(n for _, n in packing.best_fit(counts.copy(), [], 100))
    least = -(-int((counts * np.arange(101)).sum()) // 100)
    assert least <= n_lp < n_fit


def test_the_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        weight = np.full(31, -np.inf)
        own = rng.choice(np.arange(1, 31), size=4, replace=False)
        weight[own] = rng.random(4)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - l] + weight[l] for l in own if l <= c])
        got = packing.heaviest(weight, 30)
        assert sum(l * a for l, a in got.items()) <= 30
        assert sum(weight[l] * a for l, a in got.items()) == pytest.approx(best[30])


def test_a_hot_length_is_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    df = spark.range(1000).select(F.col("id").alias("_row"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).alias("_length"))
    got = packing.numbered(df, "_length", "_row", 1000).collect()
    by = defaultdict(list)
    for r in got:
        by[r._length].append(r.number)
    assert len(got) == 1000 and all(sorted(own) == list(range(len(own))) for own in by.values())


def test_packing_refuses_lengths_that_do_not_fit(spark):
    for bad in (0, 11, None):
        with pytest.raises(ValueError, match="does not fit"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"), capacity=10)


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(60)], "doc_id long, text string")
    pieces = packing.token_pieces(df, queries.tokenizer_files("word_bpe_49k.json")[0], capacity=64)
    packed = packing.pack(pieces, capacity=64)
    rows, made = packed.collect(), {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert {r.sequence_id for r in rows} == set(made) and max(map(len, made.values())) <= 4 * 64
    assert all(made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)


# ---- spelling variants


def plain_words(rows):
    import re

    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 97 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n, out = plain_words(rows), {}
    for w in n:
        near = [v for v in n if is_near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, str(f), root(w), n[w], k, n[f] if f else -1) for w, (f, k) in out.items())


def run_variants(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, n int, word int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_variants(spark, str(tmp_path)).collect()
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got)


def test_variants_equal_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = ["colour", "aaaaa", "straße", "Übermut", "naïve", "école", "x×÷yzz", "letters"]
    texts = []
    for i in range(400):
        own = []
        for _ in range(30):
            w = base[int(rng.integers(len(base)))]
            at, kind = int(rng.integers(len(w))), int(rng.integers(9))
            c = "abeéÜrs"[int(rng.integers(7))]
            own.append({0: w[:at] + w[at + 1 :], 1: w[:at] + c + w[at:], 2: w[:at] + c + w[at + 1 :]}.get(kind, w))
        texts.append((i, " ".join(own).swapcase() if i % 5 == 0 else "-".join(own)))
    texts += [(None, "colour color color color"), (5, None), (6, ""), (7, "1 中文 é"), (8, "colouur " * 9), (8, "colouur " * 9)]
    got = run_variants(spark, texts, tmp_path)
    assert got == plain_variants(texts)
    assert sum(g[1] != "None" for g in got) > 50 and sum(g[2] not in (g[0], g[1]) and g[1] != "None" for g in got) > 0


def test_variants_of_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = plain_words(rows)
    got = {r.word: r for r in queries.op13_variants(spark, sf).collect()}
    assert {w: r.n for w, r in got.items()} == n
    by = defaultdict(set)  # deletion neighbourhoods as strings, then every candidate is compared
    for w in n:
        for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by[s].add(w)
    near = defaultdict(set)
    for own in by.values():
        for a in own:
            near[a] |= {b for b in own if is_near(a, b)}
    assert {w: r.n_near for w, r in got.items()} == {w: len(near[w]) for w in n}
    for w, r in got.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        assert r.form == (best if best and n[best] >= 2 * n[w] else None)


def test_variants_of_very_long_runs(spark, tmp_path):
    rng = np.random.default_rng(9)
    a = "".join(rng.choice(list("abcdefgé"), size=200_000))
    b, c = a[:150_000] + "z" + a[150_001:], a[:70_000] + a[70_001:]
    rows = [(None, f"{a} {a} {a} {a} {a} {a} {b} {b} {b} {c}"), (None, f"{c} {c} {'a' * 100_000} " * 3)]
    got = {w: (f, n, k) for w, f, _, n, k, _ in run_variants(spark, rows, tmp_path)}
    assert got == {a: ("None", 6, 2), b: (a, 3, 1), c: ("None", 7, 1), "a" * 100_000: ("None", 3, 0)}


def test_variants_empty_table(spark, tmp_path):
    assert run_variants(spark, [], tmp_path) == []


def test_colliding_hashes_pair_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(0, "abcde", 9), (1, "abcdf", 3), (2, "vwxyz", 5), (3, "vwxyzz", 8), (4, "qqqqq", 3)], "id long, word string, n long")
    right = sorted((r.id, r.n_near) for r in variants.near_words(words).collect())
    assert right == [(0, 1), (1, 1), (2, 1), (3, 1)]

    def same(words):
        key, who, place, kind = variants.deletion_keys(words)
        return np.zeros_like(key), who, place, kind

    keys = spark.createDataFrame([(0, int(i), int(p), int(k)) for i, p, k in zip(*same(["abcde", "abcdf", "vwxyz", "vwxyzz", "qqqqq"])[1:], strict=True)], "key long, id long, place int, kind byte")
    monkeypatch.setattr(variants, "keyed", lambda words: keys)
    assert sorted((r.id, r.n_near) for r in variants.near_words(words).collect()) == right


def test_deletion_keys_equal_where_remainders_do():
    words = ["hello", "hallo", "hell", "hello", "llama", "ÿÿÿÿÿÿ", "ÿÿÿÿÿ"]
    key, who, place, kind = variants.deletion_keys(words)
    meaning = {}
    for k, w, p, t in zip(key.tolist(), who.tolist(), place.tolist(), kind.tolist(), strict=True):
        rest = words[w] if t == 0 else words[w][:p] + words[w][p + 1 :]
        assert meaning.setdefault(k, rest) == rest and (t == 2) == (t > 0 and p > 0 and words[w][p] == words[w][p - 1])
    assert len(set(meaning.values())) == len(meaning)
