"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows: at most ``examples_per_class`` of each label,
those with the smallest md5 of their id, so reruns agree.  Terms are words and their first four
and five letters (inflected forms share those); of all terms of the sample those are kept that
go with a label more than chance allows, all of them.  Document frequencies of the kept terms are counted over
all documents, labelled or not.

Search.  An inverted index holds, per term, the examples in blocks of ``BLOCK`` and the greatest
weight in each block.  A query adds up these maxima to an upper bound per block, visits blocks in
falling order of their bounds and stops when no later block can reach the k-th best similarity:
the neighbours are exactly those of a full scan, ties going to the earlier example.

Votes weigh by ``1 / (TINY + distance)``.  Scores are calibrated on the examples themselves,
each voted on by all others, by pooling adjacent violators with the labels' true frequencies;
a document that shares no term with any example gets the frequency found for such examples.

Defined results: null and empty texts score like texts without a known term; without labels
of both kinds every score is the frequency of label 1 (0 if there are no labels at all);
several labels of one document count as toxic if one of them does; null labels count for nothing;
of several texts of one labelled id the least is the example; every row is scored, repeated ones
alike; an empty table gives an empty result; columns that carry the names of the new ones are
replaced.

Bounds: ``examples_per_class`` rows of each label and terms that ``min_docs`` of them hold; the driver
and the broadcast model get no more.  Everything else covers all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep, release, small_batches

BLOCK = 64
TINY = 0.05
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """Words of the whole text and, marked by ``^``, their first four and five letters."""
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        if len(w) > 4:
            out["^" + w[:4]] += n
            if len(w) > 5:
                out["^" + w[:5]] += n
    return out


def known_terms(text: str | None, number: dict[str, int]) -> dict[int, int]:
    """Counts of the kept terms of a text, by term number."""
    out: dict[int, int] = {}
    if not text:
        return out
    for w in _WORD.findall(text.lower()):
        for t in (w, "^" + w[:4], "^" + w[:5])[: 1 if len(w) < 5 else 2 if len(w) < 6 else 3]:
            if t in number:
                k = number[t]
                out[k] = out.get(k, 0) + 1
    return out


class TermFinder:
    """Like :func:`known_terms`, but looks at each distinct word of a text once."""

    def __init__(self, vocabulary: list[str]):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.words = {t for t in vocabulary if t[0] != "^"}
        self.stems = {t[1:] for t in vocabulary if t[0] == "^"}
        self.heads4 = {s for s in self.stems if len(s) == 4}
        self.heads5 = {s for s in self.stems if len(s) == 5}

    def __call__(self, text: str | None) -> dict[int, int]:
        if not text:
            return {}
        found = _WORD.findall(text.lower())
        own = set(found)
        hit = {w for w in own if w in self.words or w[:4] in self.heads4 or w[:5] in self.heads5}
        return known_terms(" ".join(w for w in found if w in hit), self.number) if hit else {}


@dataclass
class Index:
    """Weighted examples by term, in blocks, with block maxima."""

    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    post: list[tuple[np.ndarray, np.ndarray]]  # per term: example numbers in order, weights
    at: np.ndarray  # terms x (blocks + 1): where each block's postings begin
    top: np.ndarray  # terms x blocks: greatest weight
    level: float = 0.0  # frequency of label 1
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    nothing: float = 0.0  # frequency of label 1 among examples without neighbours
    vectors: list[dict[int, int]] = field(default_factory=list)  # counts, for calibration only

    @classmethod
    def build(cls, vectors: list[dict[int, int]], labels: list[int], ids: list[int], idf: np.ndarray) -> Index:
        weighed = [_weights(v, idf) for v in vectors]
        # Examples that share their heaviest term stand together, which sharpens the block maxima.
        order = sorted(range(len(ids)), key=lambda i: (max(weighed[i], key=lambda t: (weighed[i][t], t)) if weighed[i] else -1, ids[i]))
        blocks = -(-len(ids) // BLOCK)
        rows: list[list[tuple[int, float]]] = [[] for _ in idf]
        for place, i in enumerate(order):
            for t, w in weighed[i].items():
                rows[t].append((place, w))
        post = [(np.array([p for p, _ in r], dtype=np.int64), np.array([w for _, w in r])) for r in rows]
        at = np.array([np.searchsorted(p, np.arange(blocks + 1) * BLOCK) for p, _ in post]).reshape(len(post), blocks + 1)
        top = np.zeros((len(post), blocks))
        for t, (p, w) in enumerate(post):
            np.maximum.at(top[t], p // BLOCK, w)
        return cls(idf, np.array([labels[i] for i in order]), np.array([ids[i] for i in order]), post, at, top, vectors=[vectors[i] for i in order])

    def search(self, vector: dict[int, int], k: int, leave_out: int = -1) -> list[tuple[float, int]]:
        """The ``k`` most similar examples with a shared term: (cosine, example number), best first."""
        q = _weights(vector, self.idf)
        if not q:
            return []
        ts = sorted(q)
        bound = np.array([q[t] for t in ts]) @ self.top[ts]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-9:
                break
            got = np.zeros(BLOCK)
            for t in ts:
                lo, hi = self.at[t, b], self.at[t, b + 1]
                if lo < hi:
                    got[self.post[t][0][lo:hi] - b * BLOCK] += q[t] * self.post[t][1][lo:hi]
            near = np.flatnonzero(got > 0)
            best = sorted(best + [(-got[i], int(b * BLOCK + i)) for i in near if b * BLOCK + i != leave_out])[:k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([1 / (TINY + max(0.0, 1 - s)) for s, _ in near])
        return float(w @ self.labels[[i for _, i in near]] / w.sum())

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.nothing
        return float(np.clip(np.interp(self.vote(near), *self.knots), 0, 1))

    def calibrate(self, k: int, level: float) -> None:
        """Fits the map from votes to frequencies of label 1, ``level`` being its overall frequency."""
        ones = max(1, int(self.labels.sum()))
        weight = np.where(self.labels == 1, level / ones, (1 - level) / max(1, len(self.labels) - ones))
        votes, truth, mass, none = [], [], [], [0.0, 0.0]
        for i, v in enumerate(self.vectors):
            near = self.search(v, k, leave_out=i)
            if near:
                votes.append(self.vote(near))
                truth.append(self.labels[i])
                mass.append(weight[i])
            else:
                none[self.labels[i]] += weight[i]
        self.level, self.nothing = level, none[1] / sum(none) if sum(none) else level
        self.vectors = []
        if votes:
            self.knots = pooled(np.array(votes), np.array(truth, float), np.array(mass))


def _weights(vector: dict[int, float], idf: np.ndarray) -> dict[int, float]:
    """Unit-length TF-IDF weights, term frequencies taken as 1 + log."""
    raw = {t: (1 + np.log(c)) * idf[t] for t, c in vector.items()}
    norm = np.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()} if norm > 0 else {}


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of ``y`` on ``x`` (pool adjacent violators, slightly shrunk)."""
    order = np.argsort(x, kind="stable")
    parts: list[list[float]] = []
    for i in order:
        parts.append([x[i], x[i], w[i], w[i] * y[i]])
        while len(parts) > 1 and (parts[-2][3] / parts[-2][2] >= parts[-1][3] / parts[-1][2] or parts[-2][1] == parts[-1][0]):
            last = parts.pop()
            parts[-1] = [parts[-1][0], last[1], parts[-1][2] + last[2], parts[-1][3] + last[3]]
    shrink = w.sum() / len(w)
    mean = float((w * y).sum() / w.sum())
    knots = [(0.5 * (a + b), (s + shrink * mean) / (m + shrink)) for a, b, m, s in parts]
    kx, ky = np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
    return kx, np.maximum.accumulate(ky)


@dataclass
class Model:
    vocabulary: list[str]
    index: Index
    k: int


def fit(docs: DataFrame, labels: DataFrame, examples_per_class: int = 4000, min_docs: int = 3, k: int = 15) -> Model:
    """Learns from ``labels`` (doc_id, toxic) of rows that are not held out."""
    small_batches(docs.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    usable = usable.withColumn("h", F.md5(F.col("doc_id").cast("string")))
    seen = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        level = float(seen.get(1, 0) > 0)
        return Model([], Index(np.zeros(0), np.zeros(0), np.zeros(0), [], np.zeros((0, 1), int), np.zeros((0, 0)), level, nothing=level), k)
    picked = usable.where("toxic = 0").orderBy("h").limit(examples_per_class).union(usable.where("toxic = 1").orderBy("h").limit(examples_per_class))
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # One text for each id, so the sample has no more rows than there are picked ids, however often an id repeats.
    sample = keep(text.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[y].update(terms(t).keys())
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([sums[y][t] for t in names], pa.int64()) for y in (1, 0))], names=["term", "pos", "neg"])

    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    share = p / max(1, p + n)
    with_label = sample.select("toxic", "text").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_docs)
    with_label = keep(with_label)
    # Likelihood ratio of "the label matters" to chance; the bar lets 0.1 chance terms through on average.
    bar = 2 * math.log(max(1, with_label.count()) / 0.1)
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((F.col("pos") + F.col("neg")) * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("pos"), share) + part(F.col("neg"), 1 - share))
    kept = with_label.withColumn("ratio", ratio).where(F.col("ratio") >= bar).select("term").collect()
    release(with_label)
    vocabulary = sorted(r.term for r in kept)
    if not vocabulary:
        level = seen[1] / (seen[0] + seen[1])
        return Model([], Index(np.zeros(0), np.zeros(0), np.zeros(0), [], np.zeros((0, 1), int), np.zeros((0, 0)), level, nothing=level), k)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total, sums = TermFinder(vocabulary), 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += 1
                sums[list(find(t))] += 1
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *own.tolist()], pa.int64()), pa.array([total, *sums[own].tolist()], pa.int64())], names=["t", "n"])

    counted = {r.t: r.n for r in text.select("text").mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0)
    idf = np.array([np.log((total + 1) / (counted.get(t, 0) + 1)) + 0.1 for t in range(len(vocabulary))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = TermFinder(vocabulary)
        for batch in batches:
            found = [find(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(v) for v in found], pa.list_(pa.int32())), pa.array([list(v.values()) for v in found], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "t", "n"],
            )

    rows = sorted(sample.mapInArrow(vectors, "doc_id long, toxic int, t array<int>, n array<int>").collect(), key=lambda r: r.doc_id)
    release(sample)
    index = Index.build([dict(zip(r.t, r.n, strict=True)) for r in rows], [r.toxic for r in rows], [r.doc_id for r in rows], idf)
    index.calibrate(k, seen[1] / (seen[0] + seen[1]))
    return Model(vocabulary, index, k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``tox_score`` and the evidence ``tox_examples``, ``tox_similarity`` to every row.

    The broadcast model holds at most twice ``examples_per_class`` short vectors.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("tox_score", "tox_examples", "tox_similarity")
    kept = [c for c in docs.columns if c not in new]
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find = TermFinder(m.vocabulary)
        for batch in batches:
            near = [m.index.search(v, m.k) if (v := find(t)) else [] for t in batch.column(where).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            cols += [
                pa.array([m.index.score(x) for x in near], pa.float64()),
                pa.array([[int(m.index.ids[i]) for _, i in x] for x in near], pa.list_(pa.int64())),
                pa.array([[s for s, _ in x] for x in near], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *new])

    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.ArrayType(T.LongType())), T.StructField(new[2], T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)
