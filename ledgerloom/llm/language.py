"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` UTF-8 bytes in both directions and gives every byte
position a distribution over the learned languages; a document's distribution is the mean over
all positions of its whole text.  It is trained in numpy by backpropagation through time.

Training is bounded and deterministic: at most ``docs_per_language`` documents per language
(those with the smallest md5 of their id among rows that are not held out), cut into windows on
the executors, at most ``windows_per_doc`` spread evenly over the whole text.  The driver gets
only these windows and takes a number of steps that depends on the number of languages only,
whatever the size of the corpus.  Every non-null language with a usable row is learnt, however
rare it is and however many there are.

Defined results: ``und`` with score 0 for null texts and texts without a letter (a character of
general category L, in training as well); without any learnable language every document is
``und``; with a single one it is the answer for every text with a letter; repeated rows are
judged each; an empty table gives an empty result; columns that carry the names of the new ones
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, keep, release, small_batches

WINDOW = 64
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter (general category L; digits, fractions and letter-like numbers are none)."""
    return bool(text) and any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text (rows of bytes, the last padded with zeros)."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """Parameters; index 0 of ``table`` and ``inner`` reads forwards, 1 backwards.

    ``table[d, byte]`` is a byte's input to the update, reset and candidate gates, ``inner[d]``
    what the state adds, ``out`` and ``bias`` the labelling of a position by both states.
    """

    table: np.ndarray  # 2 x 256 x 3h
    inner: np.ndarray  # 2 x h x 3h
    out: np.ndarray  # 2h x labels
    bias: np.ndarray  # labels

    @classmethod
    def random(cls, hidden: int, labels: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        return cls(draw(2, 256, 3 * hidden, s=0.3), draw(2, hidden, 3 * hidden, s=hidden**-0.5), draw(2 * hidden, labels, s=0.2), np.zeros(labels, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias]

    def label(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (positions x windows x labels) for every byte position."""
        count, steps = windows.shape
        h = self.inner.shape[1]
        # sigmoid(x) = (1 + tanh(x / 2)) / 2: the halves go into the weights, so one tanh serves all gates.
        scale = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        half = np.concatenate([np.full(2 * h, 0.5), np.full(h, 0.5)]).astype(np.float32)
        states = np.empty((2, steps, h, count), dtype=np.float32)
        bytes_in = np.ascontiguousarray(windows.T)
        for d in (0, 1):
            table = np.ascontiguousarray((self.table[d] * scale).T)
            inner = np.ascontiguousarray((self.inner[d] * half).T)
            state = np.zeros((h, count), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = np.take(table, bytes_in[t], axis=1)
                a = inner @ state
                gates = g[: 2 * h]
                gates += a[: 2 * h]
                np.tanh(gates, out=gates)
                reset = gates[h:]
                reset += 1
                cand = a[2 * h :]
                cand *= reset
                cand += g[2 * h :]
                np.tanh(cand, out=cand)
                keep = gates[:h]
                keep += 1
                keep *= 0.5
                new = states[d, t]
                np.subtract(state, cand, out=new)
                new *= keep
                new += cand
                state = new
        x = self.out[:h].T @ states[0] + self.out[h:].T @ states[1] + self.bias[:, None]
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x  # steps x labels x windows

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        count, steps = windows.shape
        h = self.inner.shape[1]
        order = np.stack([windows, windows[:, ::-1]])  # direction x window x time
        state = np.zeros((2, count, h), np.float32)
        kept = []
        for t in range(steps):
            x = order[:, :, t]
            g = np.stack([self.table[0][x[0]], self.table[1][x[1]]])
            a = state @ self.inner
            zr = 1 / (1 + np.exp(-(g[..., : 2 * h] + a[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(g[..., 2 * h :] + r * a[..., 2 * h :])
            new = n + z * (state - n)
            kept.append((x, state, z, r, n, a[..., 2 * h :]))
            state = new
            kept[-1] += (new,)
        both = np.empty((steps, count, 2 * h), np.float32)
        for t in range(steps):
            both[t, :, :h] = kept[t][6][0]
            both[steps - 1 - t, :, h:] = kept[t][6][1]
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        real = (windows.T != 0).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(p[:, np.arange(count), y] + 1e-9) * real).sum()) / total
        d = p
        d[:, np.arange(count), y] -= 1
        d *= real[..., None] / total
        d_out = np.tensordot(both, d, axes=([0, 1], [0, 1]))
        d_bias = d.sum(axis=(0, 1))
        d_both = d @ self.out.T
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        dh = np.zeros((2, count, h), np.float32)
        for t in range(steps - 1, -1, -1):
            x, prev, z, r, n, an, _ = kept[t]
            dh = dh + np.stack([d_both[t, :, :h], d_both[steps - 1 - t, :, h:]])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (prev - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=-1)
            dg = np.concatenate([dz, dr, dn], axis=-1)
            d_inner += prev.transpose(0, 2, 1) @ da
            for k in (0, 1):
                np.add.at(d_table[k], x[k], dg[k])
            dh = dh * z + da @ self.inner.transpose(0, 2, 1)
        return loss, [d_table, d_inner, d_out, d_bias]


def train(windows: np.ndarray, y: np.ndarray, labels: int, hidden: int = 12, steps: int = 320, batch: int = 96, seed: int = 5) -> Network:
    """Adam on batches balanced over the labels; more labels than a batch holds take turns in as many more steps."""
    rng = np.random.default_rng(seed)
    steps = -(-steps * labels // batch) if labels > batch else steps
    turns = np.zeros(0, dtype=np.int64)
    net = Network.random(hidden, labels, rng)
    by = [np.flatnonzero(y == k) for k in range(labels)]
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        if labels > batch:
            turns = turns if len(turns) >= batch else np.concatenate([turns, rng.permutation(labels)])
            now, turns = turns[:batch], turns[batch:]
        else:
            now = np.arange(labels)
        pick = np.concatenate([rng.choice(by[k], -(-batch // len(now))) for k in now])
        _, grads = net.gradients(windows[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


@dataclass
class Model:
    languages: list[str]
    net: Network | None

    def document(self, texts: list[str | None], at_once: int = 1024) -> list[tuple[str, float]]:
        """Language and pooled probability of whole texts."""
        at_once = max(16, min(at_once, (at_once << 6) // max(1, len(self.languages))))  # bounds memory if there are many
        out = [(UNKNOWN, 0.0)] * len(texts)
        which = [i for i, t in enumerate(texts) if has_letter(t)] if self.net else []
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            nonlocal held, owner, waiting
            if not held:
                return
            w, o = np.concatenate(held), np.concatenate(owner)
            held, owner, waiting = [], [], 0
            for k in range(0, len(w), at_once):
                part = w[k : k + at_once]
                p = self.net.label(part)
                p *= (part.T != 0)[:, None, :]
                pooled = p.sum(axis=0)
                for c in range(pooled.shape[0]):
                    sums[:, c] += np.bincount(o[k : k + at_once], weights=pooled[c], minlength=len(texts))

        for i in which:
            w = windows_of(texts[i].encode("utf-8", "replace"))
            held.append(w)
            owner.append(np.full(len(w), i))
            waiting += len(w)
            if waiting >= 16 * at_once:
                flush()
        flush()
        for i in which:
            if total := sums[i].sum():
                best = int(sums[i].argmax())
                out[i] = (self.languages[best], float(sums[i, best] / total))
        return out


def fit(docs: DataFrame, docs_per_language: int = 150, windows_per_doc: int = 6, **training) -> Model:
    """Learns every non-null lang that has a row with text, with a letter, that is not held out."""
    small_batches(docs.sparkSession)
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = usable.select("lang", "text", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], None)
    # A hash bar per language keeps about three times the bound, so no window sorts a whole language.
    bars = [(k, f"{min(0xFFFFFFFF, int(3 * docs_per_language / n * 2**32)):08x}") for k, n in sorted(counts.items())]
    bar = F.broadcast(docs.sparkSession.createDataFrame(bars, "lang string, bar string"))
    few = keep(keyed.join(bar, "lang").where(F.substring("h", 1, 8) <= F.col("bar")).drop("bar"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = few.withColumn("k", place).where(F.col("k") <= docs_per_language).select("lang", "text")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = windows_of(text.encode("utf-8", "replace"))
                for i in sorted({int(x) for x in np.linspace(0, len(w) - 1, min(windows_per_doc, len(w)))}):
                    tags.append(lang)
                    rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])

    cut_up = lambda df: [(r.lang, bytes(r.window)) for r in df.mapInArrow(slices, "lang string, window binary").collect()]
    rows = cut_up(picked)
    release(few)
    # Many rows of one id share one hash, which may lie above the bar.
    if missed := [(k,) for k in sorted(set(counts) - {r[0] for r in rows})]:
        left = F.broadcast(docs.sparkSession.createDataFrame(missed, "lang string"))
        rows += cut_up(keyed.join(left, "lang").groupBy("lang").agg(F.min(F.struct("h", "text")).alias("least")).select("lang", "least.text"))
    rows.sort()
    langs = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(langs)}
    y = np.array([number[r[0]] for r in rows])
    return Model(langs, train(x, y, len(langs), **training))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` to every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "lang_score")
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.document(batch.column(batch.schema.get_field_index("text")).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *new])

    fields = [f for f in docs.schema.fields if f.name not in new]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())]))
