"""Near-duplicate detection with HyperMinHash registers, banding and exact confirmation.

A document's set is its distinct word shingles, each a 64-bit hash (words are maximal runs of
bytes other than ASCII white space, A-Z lower-cased).  Documents of equal sets form one class,
found by a 128-bit digest; classes take the place of their copies from there on.

Registers.  Each of ``bands * rows`` hash functions keeps the least hash of the set, compressed
to the number of leading zeros (6 bits) and the ``MANTISSA`` bits after the leading one.  Every
register looks at the whole set, so short documents have no empty registers.

Candidates.  A band is ``rows`` neighbouring registers; classes that agree on one share a
bucket.  A pair at similarity 0.8 shares none of 54 bands of 7 with probability 3e-6.  Within a
bucket no pairs are enumerated: all members are held against its hub, the member with the most
company over all its buckets, and the links found are closed to components.

Completion.  Two members of one hub may be linked though the hub is linked to at most one of
them.  Such a pair must differ from the hub in the same way: with ``D(y)`` the shingles in which
``y`` and hub differ (those that ``y`` lacks and those that it adds), ``w(y)`` = lacked + t *
added and t the threshold, a link between ``x`` and ``y`` needs
``(1 + t) * |D(x) & D(y)| >= w(x) + w(y) - (1 - t) * |hub|``, and ``w > (1 - t) * |hub|`` for
whoever is not linked to the hub; also ``|D(y) - D(x)|`` cannot exceed ``(1 / t - 1) * |y|``.
Both bound the overlap from below, so the rarest few elements of both sides must meet, early
enough to leave room for the rest (the prefix and position filters of set-similarity joins).
Links within a component change nothing, so elements that only one component has count as the
rarest and meet no one; members of a component that share all other elements differ in ``w`` only,
and the lightest of them is linked if any is, so it stands for all; and members meet those of other
components only.  Pairs that meet are tested, which is exact: no cap, and a bucket of a third of
all rows costs a few rows per member.

Confirmation.  Sizes must allow the threshold; the collision-corrected estimate from the
registers must not fall more than ``SIGMAS`` standard deviations below it; then the full sets
decide, in integers: ``100 * intersection >= percent * union``.

Defined results: null or wordless text has an empty set and links to nothing; rows with a null
id link to nothing; rows with one id are one node; an empty table gives an empty result.  Other
columns of the table play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, keep, release, small_batches
from .components import components

BANDS, ROWS = 54, 7
MANTISSA = 10
SIGMAS = 6.0
#: Up to so many ids are broadcast to their texts (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hashes of the words met so far; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 60_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_hashes(text: str | None, words_per_shingle: int, known: _Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    w = min(words_per_shingle, len(h))
    s = np.full(len(h) - w + 1, w, dtype=np.uint64)
    for i in range(w):
        s = _mix(s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - w + 1 + i])
    return np.unique(s)


def multipliers(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


def registers(sets: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Compressed registers (sets x count, uint16) of concatenated non-empty sets."""
    least = np.empty((len(starts), count), dtype=np.uint64)
    product = np.empty_like(sets)
    for j, a in enumerate(multipliers(count)):
        np.multiply(sets, a, out=product)
        least[:, j] = np.minimum.reduceat(product, starts)
    zeros = np.zeros(least.shape, dtype=np.uint16)
    x = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        empty = x < (_U(1) << _U(64 - step))
        zeros[empty] += step
        x = np.where(empty, x << _U(step), x)
    zeros = np.minimum(zeros, 63)
    mantissa = ((x << _U(1)) >> _U(64 - MANTISSA)).astype(np.uint16)
    return (zeros << MANTISSA) | mantissa


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of sizes ``n`` and ``m`` agree.

    Sums the probabilities of every register value over dyadic intervals, the leading-zero
    part exactly and the mantissa part by the interval's width.
    """
    n, m = np.asarray(n, float)[:, None], np.asarray(m, float)[:, None]
    parts = 16  # mantissa cells are joined 2**MANTISSA / parts at a time; within one the density is flat
    z = np.arange(0, 40)[None, :, None]
    cell = np.arange(parts)[None, None, :]
    low = 2.0 ** -(z + 1) * (1 + cell / parts)
    width = 2.0 ** -(z + 1) / parts
    pn = (1 - low) ** n[:, :, None] - (1 - low - width) ** n[:, :, None]
    pm = (1 - low) ** m[:, :, None] - (1 - low - width) ** m[:, :, None]
    return (pn * pm).sum(axis=(1, 2)) * parts / 2.0**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (pairs x count), corrected for chance agreement."""
    c = chance_agreement(n, m)
    return np.clip(((a == b).mean(axis=1) - c) / (1 - c), 0, 1)


def sketch(docs: DataFrame, doc_id: str, text: str, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, n, set_key, registers`` per document; the last two are null for empty sets and null ids."""
    small_batches(docs.sparkSession, 256)
    count = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sets = [shingle_hashes(t, words, known) for t in texts]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            usable = (n > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            keys: list = [None] * len(sets)
            regs: list = [None] * len(sets)
            which = np.flatnonzero(usable)
            place = np.cumsum(n[which]) // 24_000  # shares that stay in the cache of a core
            for part in np.split(which, np.flatnonzero(np.diff(place)) + 1):
                if len(part):
                    got = registers(np.concatenate([sets[i] for i in part]), np.concatenate([[0], np.cumsum(n[part])[:-1]]), count).astype(">u2")
                    for i, r in zip(part, got, strict=True):
                        keys[i], regs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "set_key", "registers"])

    rows_in = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows_in.mapInArrow(run, "id long, n long, set_key binary, registers binary")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, count: int) -> DataFrame:
    """Keeps the pairs ``(a, b)`` whose estimate may still reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u2").reshape(-1, count) for i in (2, 4)]
            j = estimate(*side, batch.column(3).to_numpy(), batch.column(5).to_numpy())
            level = percent / 100
            yield batch.select([0, 1]).filter(pa.array(j >= level - SIGMAS * np.sqrt(level * (1 - level) / count)))

    side = lambda c: classes.select(F.col("id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ra", "na", "rb", "nb").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``id, shingles`` (packed hashes) of the documents in ``ids``, one column ``id`` of distinct values."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingle_hashes(t, words, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    ids = keep(ids)
    # At most a few MB are broadcast; more ids meet their texts in a shuffle.
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = keep(texts.join(near, "id", "left_semi").mapInArrow(make, "id long, shingles binary"))
    release(ids)
    return out


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sets.  ``a``, the hub, comes last, so its set is not shuffled once for every member."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Keeps the pairs ``(a, b)`` whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(asked, docs, doc_id, text, words)
    out = cut(_with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "links")
    release(sets)
    return out


def _differences(pairs: DataFrame, percent: int) -> DataFrame:
    """``hub, id, e`` per shingle in which a member differs from its hub, and what bounds overlaps.

    ``e`` is the shingle's hash, with the lowest bit telling lacked from added ones; ``size`` the
    number of differences, ``w`` their weight, ``n`` and ``hub_n`` the set sizes.  ``as_any`` and
    ``as_outside`` say how many of the rarest elements must be kept if the member is any, or one
    that is not linked to the hub.
    """
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hub, own = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                lacked, added = np.setdiff1d(hub, own, assume_unique=True), np.setdiff1d(own, hub, assume_unique=True)
                size = len(lacked) + len(added)
                if not size:
                    continue
                w = len(lacked) + t * len(added)
                least = size - int((1 / t - 1) * len(own) + 1e-9)
                any_k = max(1, math.floor(w / (1 + t) - 1e-9) + 1, least)
                out_k = max(1, math.ceil((w - (1 - t) * len(hub)) / (1 + t) - 1e-9), least)
                e = np.concatenate([lacked & ~_U(1), added | _U(1)]).view(np.int64)
                numbers = [batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), size, len(own), len(hub), size - any_k + 1, size - out_k + 1]
                cols = [pa.array(np.full(size, v, dtype=np.int64)) for v in numbers]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(e), pa.array(np.full(size, w))], names=["hub", "id", "size", "n", "hub_n", "as_any", "as_outside", "e", "w"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "hub long, id long, size long, n long, hub_n long, as_any long, as_outside long, e long, w double")


def _completion(members: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of members of one hub that may be linked though one of them is not linked to the hub.

    ``members``: ``hub, id, root, outside`` (whether the id's component is not the hub's).
    """
    t = percent / 100
    asked = members.select("id").union(members.select(F.col("hub").alias("id"))).distinct()
    sets = _sets(asked, docs, doc_id, text, words)
    found = keep(_differences(_with_sets(members.select(F.col("hub").alias("a"), F.col("id").alias("b")), sets), percent))
    release(sets)
    rooted = found.join(members, ["hub", "id"])
    shared = rooted.groupBy("hub", "e").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("hub", "e", "often")
    place = F.row_number().over(Window.partitionBy("hub", "id").orderBy(F.coalesce("often", F.lit(0)), "e"))
    # Tables, not kept frames: the plans that follow use them several times and would hold all of this each time.
    met_by = cut(rooted.join(shared, ["hub", "e"], "left").withColumn("place", place).where("often IS NOT NULL").drop("often"), "met")
    release(found)
    # Of members of one component with the same shared elements the lightest.
    same = [F.count("*").alias("k"), F.bit_xor(F.xxhash64("e")).alias("x"), F.sum(F.xxhash64("e", F.lit(1)).cast("decimal(38,0)")).alias("s")]
    marks = met_by.groupBy("hub", "root", "id").agg(*same, F.first("w").alias("w"))
    lightest = marks.groupBy("hub", "root", "k", "x", "s").agg(F.min(F.struct("w", "id")).alias("least")).select("hub", F.col("least.id").alias("id"))
    short = cut(met_by.where(F.col("place") <= F.greatest("as_any", "as_outside")).join(lightest, ["hub", "id"]), "short")
    # An element met at these places leaves at most so many more to share; the pair needs as many as its weights ask.
    side = lambda df, c, *more: df.select("hub", "e", *more, *(F.col(x).alias(x + c) for x in ("id", "root", "n", "w")), (F.col("size") - F.col("place")).alias("rest" + c))
    y = side(short.where("place <= as_any"), "_b")
    others = y.select("hub", "e", "root_b").distinct()
    x = side(short.where("outside and place <= as_outside"), "_a", "hub_n").join(others, ["hub", "e"]).where("root_a != root_b")
    reach = (1 + t) * (1 + F.least("rest_a", "rest_b")) >= F.col("w_a") + F.col("w_b") - (1 - t) * F.col("hub_n") - 1e-6
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    met = x.join(y, ["hub", "e", "root_b"]).where(size & reach)
    out = cut(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "completion")
    drop_cut(met_by, short)
    return out


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``id, n, root`` per row of ``docs``: its set's size and the smallest id its links reach."""
    sketched = keep(sketch(docs, doc_id, text, words, bands, rows))
    base = cut(sketched.select("id", "n", "set_key"), "sizes")
    classes = cut(
        sketched.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes"
    )
    release(sketched)
    width = 2 * rows
    piece = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("registers", i * width + 1, F.lit(width)))
    banded = classes.select("id", F.posexplode(piece).alias("band", "piece")).select("id", F.xxhash64("band", "piece").alias("bucket"))
    busy = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = keep(banded.join(busy, "bucket"))
    company = shared.groupBy("id").agg(F.sum("members").alias("company"))
    hubs = shared.join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("i"))).alias("h")).select("bucket", (-F.col("h.i")).alias("hub"))
    sizes = classes.select("id", "n")
    members = cut(shared.join(hubs, "bucket").where("id != hub").select("hub", "id").distinct(), "members")
    release(shared)

    def test(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs ``(a, b)`` with sizes that allow one."""
        near = keep(_estimated(pairs, classes, percent, bands * rows))
        out = _confirmed(near, docs, doc_id, text, words, percent)
        release(near)
        return out

    side = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    to_hub = members.join(side("hub"), "hub").join(side("id"), "id").where(100 * F.least("n_hub", "n_id") >= percent * F.greatest("n_hub", "n_id"))
    links = test(to_hub.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    # An id that repeats with another text joins the classes of its texts.
    repeated = base.where("set_key is not null").groupBy("id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x != y").select("id")
    own = base.join(repeated, "id", "left_semi").join(classes.select("set_key", F.col("id").alias("a")), "set_key").where("id != a").select("a", F.col("id").alias("b"))
    links = cut(links.union(own).distinct(), "links")
    roots = components(links)

    rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = roots.select(F.col("id").alias("hub"), F.col("root").alias("hub_root"))
    rooted = rooted.join(heads, "hub", "left").withColumn("outside", F.col("root") != F.coalesce("hub_root", "hub")).drop("hub_root")
    open_hubs = rooted.groupBy("hub").agg(F.count("*").alias("k"), F.max("outside").alias("any")).where("k > 1 and any").select("hub")
    unsettled = cut(rooted.join(open_hubs, "hub", "left_semi").select("hub", "id", "root", "outside"), "unsettled")
    if not unsettled.isEmpty():
        more = test(_completion(unsettled, docs, doc_id, text, words, percent))
        if not more.isEmpty():
            roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))

    named = cut(classes.join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("root")), "named")
    drop_cut(classes, members, links, unsettled)
    return base.join(named, "set_key", "left").select("id", "n", F.coalesce("root", "id").alias("root"))
