"""Document fingerprints from improbable features in chained Bloom filters.

Every window of ``W`` bytes gets its entropy, in fixed-point integers so that equal bytes give
equal results anywhere.  How often each entropy occurs, in steps of 1/64 bit, is counted over all
windows of all texts (:func:`measure`); a window is the rarer, the seldomer its entropy.  Nearly
constant windows are worth nothing.  Fingerprints are comparable if they were made with the same
table; it is small and can be stored.  Of every ``W`` neighbouring windows the rarest (the first, if several) gets a vote; windows with at least ``VOTES`` votes are
the features.  A text without any (short ones, or endless repetition) has half that bar, and half
again, until a window reaches it.  A text of less than ``FEW`` features also has its whole bytes
as one, so different short texts differ.  The hashes go, in order, into Bloom filters of ``BITS`` bits; a full filter
(``FULL`` features) is followed by the next.  The fingerprint is the number of features and the
chained filters in base64.

Two fingerprints are compared filter by filter: the bits that a filter shares with the best
matching one, less what chance explains, as a share of what could be shared; averaged over the
filters of the shorter fingerprint.

Texts of any length are read in segments that overlap as far as votes reach, with the same
features as in one piece.

Defined results: null counts as empty; only an empty text has the fingerprint ``0:``, which is
alike (1) only to itself; texts shorter than a window, and those of nearly constant windows only,
are one feature; repeated rows and ids are documents of their own; an empty table gives an empty
result; a column of the fingerprint's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches

W = 64
VOTES = 16
FEW = 4
BITS, HASHES, FULL = 1024, 5, 80
STEPS = 6  # binary places of the entropies that are counted
LEAST = 1 << (STEPS - 1)  # half a bit: below, a window is nearly constant
BINS = (W.bit_length() - 1 << STEPS) + 1
SEGMENT = 1 << 17
TOGETHER = 1 << 16  # bytes of short texts that are worked on at once, to stay in the cache
_U = np.uint64
_FIX = 16  # binary places of entropies

_F = np.array([round(c * np.log2(c) * 2**_FIX) if c else 0 for c in range(W + 2)], dtype=np.int64)
_G = np.diff(_F, prepend=0)  # what the c-th equal byte adds
_B = _U(0x9E3779B97F4A7C15)
_B_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT * 2)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (_B, _B_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how many equal ones the W bytes that end and that begin with it hold."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = (data[order].astype(np.int64) << 40) | order if n > (1 << 20) - W else ((data[order].astype(np.int32) << 20) | order.astype(np.int32))
    first = np.searchsorted(key, key - key.dtype.type(W - 1))  # the earliest equal byte that is near enough
    here = np.arange(n)
    out_ends, out_begins = np.empty(n, dtype=np.uint8), np.empty(n, dtype=np.uint8)
    out_ends[order] = here - first + 1
    # ``first`` never falls, so the last one that reaches back to a byte follows from counts.
    out_begins[order] = np.cumsum(np.bincount(first, minlength=n)) - here
    return out_ends, out_begins


def _entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every place, in steps of 1 / 2**STEPS bit."""
    ends, begins = _counts(data)
    s = np.cumsum(_G[ends])
    s[W:] -= np.cumsum(_G[begins])[:-W]
    weight = s[W - 1 :]  # per window start: sum of c log c
    return np.clip(((W.bit_length() - 1 << _FIX) - weight // W) >> (_FIX - STEPS), 0, BINS - 1)


def _inside(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def _features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bar: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the windows of ``bar`` votes in texts laid end to end, each of W bytes or more."""
    n = len(data)
    far = rarity[_entropies(data)]
    windows = lengths - W + 1
    inside = _inside(n - W + 1, starts, windows)
    at = np.arange(n - W + 1, dtype=np.int64)
    key = np.where(inside & (far >= 0), (far << 32) | (0xFFFFFFFF - at), -1)
    # The rarest of W neighbouring windows, by doubling.
    best, span = key, 1
    while span < W:
        best = np.maximum(best[:-span], best[span:]) if len(best) > span else best
        span *= 2
    groups = windows - W + 1
    ok = groups > 0
    whole = _inside(len(best), starts[ok], groups[ok])
    winners = best[whole & (best >= 0)] if len(windows) and ok.any() else best[:0]
    votes = np.bincount(0xFFFFFFFF - (winners & 0xFFFFFFFF), minlength=n)
    chosen = votes >= bar
    for a, m in zip(starts[~ok], windows[~ok], strict=True):  # too short for a full group
        rarest = a + int(key[a : a + m].argmax())
        chosen[rarest] = key[rarest] >= 0
    pos = np.flatnonzero(chosen)
    up, down = _powers(n + 1)
    c = np.concatenate([[_U(0)], np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n])])
    return pos, _mix((c[pos + W] - c[pos]) * down[pos])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _whole(text: bytes) -> np.ndarray:
    """The hash of a text as one feature."""
    return _mix(np.array([int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")], dtype=np.uint64))


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of W bytes or more, laid end to end in shares that fit the cache, long ones cut to overlapping segments.

    Gives per share the pieces (text, and between which of its places they count), bytes, starts and lengths.
    """
    pieces: list[tuple[int, bytes, int, int]] = []
    for i, t in enumerate(texts):
        if len(t) <= SEGMENT:
            if len(t) >= W:
                pieces.append((i, t, 0, len(t)))
        else:
            for a in range(0, len(t), SEGMENT):
                lo = max(0, a - 2 * W)
                part = t[lo : a + SEGMENT + 3 * W]
                if len(part) >= W:
                    pieces.append((i, part, a - lo, min(a - lo + SEGMENT, len(part))))
    k = 0
    while k < len(pieces):
        m, total = k, 0
        while m < len(pieces) and (m == k or total + len(pieces[m][1]) <= TOGETHER):
            total += len(pieces[m][1])
            m += 1
        own = pieces[k:m]
        lengths = np.array([len(p[1]) for p in own])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        yield [(i, lo, hi) for i, _, lo, hi in own], np.frombuffer(b"".join(p[1] for p in own), dtype=np.uint8), starts, lengths
        k = m


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    out = np.zeros(BINS, dtype=np.int64)
    for own, data, starts, lengths in _pieces(texts):
        lo, hi = (np.array([p[k] for p in own]) for k in (1, 2))
        counted = _inside(len(data) - W + 1, starts + lo, np.maximum(0, np.minimum(hi, lengths - W + 1) - lo))
        out += np.bincount(_entropies(data)[counted], minlength=BINS)
    return out


def rarity_of(counts: np.ndarray) -> np.ndarray:
    """Rarity of each entropy: its surprisal in fixed point; -1 for nearly constant windows."""
    out = np.round(np.log2((counts.sum() + 1) / (counts + 1)) * (1 << 16)).astype(np.int64)
    out[:LEAST] = -1
    return out


def measure(df: DataFrame, text: str = "text") -> np.ndarray:
    """The rarity table of all texts of a table, from counts summed on the executors (``BINS`` numbers)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            total += histogram([(t or "").encode() for t in batch.column(0).to_pylist()])
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bin", "n"])

    counts = np.zeros(BINS, dtype=np.int64)
    for r in df.select(F.col(text).cast("string")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    return rarity_of(counts)


def _chosen(texts: list[bytes], bar: int, rarity: np.ndarray) -> list[np.ndarray]:
    """Hashes of the windows of at least ``bar`` votes of each text, in order of place, each once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for own, data, starts, lengths in _pieces(texts):
        pos, h = _features(data, starts, lengths, bar, rarity)
        for (i, lo, hi), start in zip(own, starts, strict=True):
            a, b = np.searchsorted(pos, [start + lo, start + hi])
            out[i].append(h[a:b])
    done = []
    for parts in out:
        h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        done.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return done


def features(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text, in order of place, each once."""
    out = _chosen(texts, VOTES, rarity)
    bar = VOTES // 2
    while bar and (without := [i for i, h in enumerate(out) if not len(h) and len(texts[i]) >= W]):
        for i, h in zip(without, _chosen([texts[i] for i in without], bar, rarity), strict=True):
            out[i] = h
        bar //= 2
    return [np.concatenate([h, _whole(t)]) if t and len(h) < FEW else h for t, h in zip(texts, out, strict=True)]


def filters(h: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (rows of packed bits)."""
    n = -(-len(h) // FULL)
    bits = np.zeros((n, BITS), dtype=np.uint8)
    row = np.arange(len(h)) // FULL
    for k in range(HASHES):
        bits[row, (h >> _U(11 * k)).astype(np.int64) % BITS] = 1
    return np.packbits(bits, axis=1)


def fingerprint(h: np.ndarray) -> str:
    return f"{len(h)}:" + base64.b64encode(filters(h).tobytes()).decode()


def unpack(fp: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fp.partition(":")[2]), dtype=np.uint8).reshape(-1, BITS // 8)


def likeness(a: str, b: str) -> float:
    """Normalised bit overlap of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = unpack(a), unpack(b)
    if len(x) > len(y) or (len(x) == len(y) and a > b):
        x, y = y, x
    if not len(x) or not len(y):
        return 0.0
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        chance, most = nx[i] * ny / BITS, np.minimum(nx[i], ny)
        total += float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(x)


def edited(text: str, after: str) -> str:
    """``text`` with its second half replaced by as many characters from the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", rarity: np.ndarray | None = None) -> DataFrame:
    """Adds ``name`` to every row; the general form of the operator.  The table is measured on ``df`` if none is given."""
    small_batches(df.sparkSession)
    rarity = measure(df, text) if rarity is None else rarity
    kept = [c for c in df.columns if c != name]
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(h) for h in features([(t or "").encode() for t in batch.column(where).to_pylist()], rarity)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(fps, pa.string())], names=[*kept, name])

    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.StringType())]))


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _ROW.split(", ")]


def _compare(ids: list, texts: list[str], nexts: list[str], own: list[str], after: list[str], rarity: np.ndarray) -> list[tuple]:
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    raw = [c.encode() for c in changed]
    fps = [fingerprint(h) for h in features(raw, rarity)]
    return [
        (i, len(t), hashlib.sha256(r).hexdigest(), f, e, likeness(f, e), likeness(f, x))
        for i, t, r, f, e, x in zip(ids, texts, raw, own, fps, after, strict=True)
    ]


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited form, and likenesses to it and to the next document.

    Documents are ordered by falling id (null last, equal ids by a hash of the text); after the last
    comes the first.  One range shuffle deals the texts out in order; ranges also split one id, and
    equal texts of one id by the partition they were read in.  Only the last text of each partition
    must still meet the first of the next one, which a small join does.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    rarity = measure(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "read_in": F.spark_partition_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("read_in")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def pack(done: list[tuple], part: int, ends: list[tuple[str, int | None, str]]) -> pa.RecordBatch:
        """Finished rows, and the first and last text of the partition as rows of their own."""
        full = [*(r + (None, part, None) for r in done), *((i, *[None] * 6, kind, part, t) for kind, i, t in ends)]
        types = [*_TYPES, pa.string(), pa.int64(), pa.string()]
        cols = list(zip(*full, strict=True)) if full else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*_NAMES, "end", "part", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        fps: list[str] = []
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(1).to_pylist()
            ids += batch.column(0).to_pylist()
            texts += new
            fps += [fingerprint(h) for h in features([t.encode() for t in new], rarity)]
            heads = [] if begun else [("head", ids[0], texts[0])]
            begun = True
            yield pack(_compare(ids[:-1], texts[:-1], texts[1:], fps[:-1], fps[1:], rarity), part, heads)
            ids, texts, fps = ids[-1:], texts[-1:], fps[-1:]
        if begun:
            yield pack([], part, [("tail", ids[0], texts[0])])

    made = cut(dealt.mapInArrow(run, f"{_ROW}, end string, part long, text string"), "neighbours")
    parts = sorted(r.part for r in made.where("end = 'head'").select("part").collect())  # one number per partition
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part long, following long")
    tails = made.where("end = 'tail'").select("doc_id", "text", "part").join(F.broadcast(follows), "part")
    heads = made.where("end = 'head'").select(F.col("part").alias("following"), F.col("text").alias("after"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
            own, nxt = ([fingerprint(h) for h in features([t.encode() for t in x], rarity)] for x in (texts, after))
            done = _compare(ids, texts, after, own, nxt, rarity)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [()] * len(_TYPES), _TYPES, strict=True)], names=_NAMES)

    joined = tails.join(heads, "following").select("doc_id", "text", "after").mapInArrow(last, _ROW)
    return made.where("end is null").select(*_NAMES).union(joined)
