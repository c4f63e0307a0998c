"""Packing token sequences: a configuration linear program over the length histogram, then rounding.

Pieces of a document's tokens go into sequences of at most ``capacity`` tokens.  Which piece goes
where depends on lengths alone, so the problem is that of the histogram: at most ``capacity``
lengths with counts, however many documents there are.  A configuration is a multiset of lengths
that fits into a sequence; the linear program asks for multiplicities of configurations that cover
all counts with the fewest sequences.  It is solved by multiplicative weights: a length's weight
starts at its share of a sequence and falls with what is covered of its count; the pricing step, a
knapsack by dynamic programming over the capacity, finds the heaviest configuration.

Rounding keeps the whole part of every multiplicity, never more than the counts allow.  What remains
goes into the gaps of these sequences and into new ones by best fit, longest first, over classes of
sequences of equal content instead of single ones.  The plan is a list of configurations with
their numbers of copies, at most some ten thousand whatever the number of pieces.

Pieces are numbered within their length by two-level prefix sums over buckets of bounded size, so
a length that a third of all pieces share is not one task; a piece's number selects configuration,
copy and place, by a search in the broadcast plan.  Every planned place is used, so places have no gaps.

Tokens come from the ``tokenizers`` library.  The vocabulary's splitting never crosses ASCII white
space, so runs between it are encoded by themselves, and those of Latin-1 in the pieces that the vocabulary
splits them into; the ids of frequent runs and pieces are kept.  Strings of special tokens in a text are ordinary text unless asked
otherwise.

Defined results: a null text counts as empty and has the end token only; rows with the same id are
documents of their own; a length that is null, below 1 or beyond the capacity raises; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_table
from .common import cut, small_batches

RUN = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SEPARATORS = re.compile(r"[\x1C-\x1F]")  # white space to Python, not to the vocabulary

#: The vocabulary's own splitting, for lower-case text in Latin-1.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾\x20\x09-\x0D\x85\xa0]+")

#: Runs and pieces whose ids a worker keeps twice over, the longest of them, and the code points that are split in one go.
CACHED, CACHED_LENGTH, STEP = 400_000, 48, 1 << 20

#: Bytes of ids that go to Spark in one batch, about.
TOGETHER = 4 << 20

#: Steps of one linear program, and how often what is left may have another.
STEPS, PROGRAMS = 400, 3

#: Pieces of one length that are numbered together, about.
BUCKET = 100_000


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def in_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str, special: bool) -> Encoder:
    """One for all tasks of a worker, with what it knows."""
    return Encoder(path, special)


class Known(dict):
    """Packed ids of runs and pieces; those that are not there are asked of the encoder."""

    def __init__(self, run: Callable[[str], bytes]):
        self.run = run

    def __missing__(self, key: str) -> bytes:
        return self.run(key)


class Encoder:
    """Ids of whole texts by a vocabulary file, piece by piece."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        self.special, self.model = special, self.tokenizer.model
        bytes_shown = byte_table()
        self.shown = {c: "".join(bytes_shown[b] for b in chr(c).encode()) for c in range(256)}
        self.young = Known(self._run)  # pieces seen since the last change of generations
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit integers."""
        return np.frombuffer(self.packed_ids(text), dtype="<u4")

    def packed_ids(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if len(text) <= STEP:
            return self._part(text)
        out, at = [], 0
        while at < len(text):
            upto = at + STEP
            if upto < len(text):  # up to the next white space, so that no run is cut
                space = SPACE.search(text, upto)
                upto = space.start() if space else len(text)
            out.append(self._part(text[at:upto]))
            at = upto
        return b"".join(out)

    def _part(self, text: str) -> bytes:
        if self.special:
            runs = RUN.findall(text)
        elif in_latin(text) and not SEPARATORS.search(text):
            runs = text.lower().split()
        else:
            runs = [r.lower() if in_latin(r) else r for r in RUN.findall(text)]
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, Known(self._run)
        return b"".join(map(self.young.__getitem__, runs))

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= CACHED_LENGTH:
            self.young[key] = ids
        return ids

    def _run(self, run: str) -> bytes:
        """Packed ids of a run between white space that is not among the young ones."""
        if run.isalpha() and not self.special and in_latin(run):
            return self._known(run)
        if (ids := self.old.get(run)) is not None:
            return self._keep(run, ids)
        if self.special or not in_latin(run):
            return self._keep(run, packed(self.tokenizer.encode(run, add_special_tokens=False).ids))
        if run[-1] in ".,;:!?" and (word := run[:-1]).isalpha():
            seen = word in self.young
            ids = self._known(word) + self._known(run[-1])
            return self._keep(run, ids) if seen else ids  # only those of words that come again are kept; most come once
        return self._keep(run, b"".join(map(self._known, PIECE.findall(run))))

    def _known(self, piece: str) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            ids = self._keep(piece, self._piece(piece) if ids is None else ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        """What the model makes of a piece, which the vocabulary splits no further."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.translate(self.shown)
        return packed([t.id for t in self.model.tokenize(piece)])


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, special: bool = False, keep_ids: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``: documents with their end token, cut after ``capacity`` tokens.

    ``ids`` are packed little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own_encoder, last, step = encoder(path, special), packed([end]), 4 * capacity
        for batch in batches:

            def rows(found: list[tuple], kept: list[bytes], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                i, *numbers = np.array(found, dtype=np.int64).reshape(-1, 5).T
                columns = [batch.column(0).take(pa.array(i)), *(pa.array(c.astype(t)) for c, t in zip(numbers, (np.int32, np.int64, np.int64, np.int64), strict=True))]
                return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names=names)

            found, kept, size = [], [], 0
            for i, own in enumerate(batch.column(1)):
                ids = memoryview(own_encoder.packed_ids(own.as_py() or "") + last)
                for n, start in enumerate(range(0, len(ids), step)):
                    own_piece = ids[start : start + step]
                    found.append((i, n, start // 4, len(own_piece) // 4, zlib.crc32(own_piece)))
                    if keep_ids:
                        kept.append(bytes(own_piece))
                        size += len(own_piece)
                    if size >= TOGETHER or len(found) >= 10_000:
                        yield rows(found, kept)
                        found, kept, size = [], [], 0
            if found:
                yield rows(found, kept)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(id_col, text).mapInArrow(run, schema)


def heaviest(weight: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the greatest total weight: a knapsack, each length any number of times.

    ``weight[l]`` is that of length ``l`` (minus infinity: not there).
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    there = np.flatnonzero(np.isfinite(weight))
    low, high = int(there[0]), int(there[-1])
    own = weight[low : high + 1]
    for c in range(low, capacity + 1):
        top = min(high, c)
        before = best[c - top : c - low + 1][::-1]  # room left after the lengths low ... top
        total = before + own[: top - low + 1]
        j = int(total.argmax())
        if total[j] > best[c - 1]:
            best[c], last[c] = total[j], low + j
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if last[c] == 0:
            c -= 1
        else:
            out[int(last[c])] = out.get(int(last[c]), 0) + 1
            c -= int(last[c])
    return out


def configuration_lp(counts: np.ndarray, capacity: int, steps: int = STEPS, pace: float = 0.5) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional multiplicities that cover ``counts[l]`` pieces of each length ``l`` nearly.

    In a step the heaviest configuration is used so often that it covers ``pace`` of the count of its
    scarcest length.  At the end multiplicities are scaled to the volume of all pieces.
    """
    there = counts > 0
    sizes = np.arange(len(counts))
    covered, uses = np.zeros(len(counts)), {}
    share = np.where(there, sizes / capacity, -np.inf)
    for _ in range(steps):
        part = np.where(there, covered / np.maximum(counts, 1), 0.0)
        fall = np.exp(-(part - part[there].min()))
        found = heaviest(np.where(there, share * fall, -np.inf), capacity)
        found = {l: min(a, int(counts[l])) for l, a in found.items()}
        step = pace * min(counts[l] / a for l, a in found.items())
        key = tuple(sorted(found.items()))
        uses[key] = uses.get(key, 0.0) + step
        for l, a in key:
            covered[l] += a * step
    scale = (counts * sizes).sum() / max(1.0, (covered * sizes).sum())
    return [(dict(k), x * scale) for k, x in uses.items()]


Configs = list[tuple[dict[int, int], int]]


def whole_part(left: np.ndarray, fractional: list[tuple[dict[int, int], float]]) -> Configs:
    """Whole copies of configurations, as far as ``left`` allows, which is lowered by what they hold."""
    out = []
    for config, x in sorted(fractional, key=lambda c: -c[1]):
        copies = min(int(x), *(int(left[l] // a) for l, a in config.items()))
        for l, a in config.items():
            left[l] -= a * copies
        if copies:
            out.append((config, copies))
    return out


def best_fit(left: np.ndarray, given: Configs, capacity: int) -> Configs:
    """``given`` and what is left, longest first, each piece in the smallest gap that takes it.

    Sequences of equal content are one entry with their number, so the work depends on the lengths only.
    """
    gaps: dict[int, Configs] = {}

    def keep(config: dict[int, int], copies: int) -> None:
        if copies:
            gaps.setdefault(capacity - sum(l * a for l, a in config.items()), []).append((config, copies))

    for config, copies in given:
        keep(config, copies)
    for l in map(int, np.flatnonzero(left)[::-1]):
        n = int(left[l])
        while n:
            fitting = [g for g in gaps if g >= l]
            gap = min(fitting) if fitting else capacity
            if not fitting:
                keep({}, -(-n // (capacity // l)))
            config, copies = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = gap // l
            full = min(copies, n // each)
            keep(config | {l: config.get(l, 0) + each}, full)
            n -= full * each
            if full < copies and n:  # fewer than fill one
                keep(config | {l: config.get(l, 0) + n}, 1)
                full, n = full + 1, 0
            keep(config, copies - full)
    return [c for own in gaps.values() for c in own if c[0]]


def configurations(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Configs:
    """Configurations with copies that hold exactly ``counts[l]`` pieces of each length ``l``.

    As long as a program's whole part holds half of the volume that was left, the rest has another.
    """
    left, chosen, sizes = counts.copy(), [], np.arange(len(counts))
    for _ in range(PROGRAMS):
        before = int((left * sizes).sum())
        if not before:
            break
        chosen += whole_part(left, configuration_lp(left, capacity, steps))
        if 2 * int((left * sizes).sum()) > before:
            break
    return best_fit(left, chosen, capacity)


@dataclass(frozen=True)
class Plan:
    """Per run of pieces of one length: where it begins, and where its pieces go."""

    key: np.ndarray  # length and first number of the run
    each: np.ndarray  # pieces of the length in one sequence
    sequence: np.ndarray  # number of the first sequence
    offset: np.ndarray  # of the first piece in a sequence
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers within their length."""
        key = (length << 48) + number
        at = np.searchsorted(self.key, key, side="right") - 1
        k = key - self.key[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def solve(histogram: dict[int, int], capacity: int = 4096, steps: int = STEPS) -> Plan:
    """The plan for ``histogram`` (length to number of pieces)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for l, n in histogram.items():
        counts[l] = n
    runs, used, first = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for config, copies in configurations(counts, capacity, steps):
        offset = 0
        for l, a in sorted(config.items(), reverse=True):
            runs.append(((l << 48) + int(used[l]), a, first, offset))
            used[l] += a * copies
            offset += l * a
        first += copies
    key, each, sequence, offset = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4).T
    return Plan(key, each, sequence, offset, first)


def numbered(rows: DataFrame, group: str, order: str, total: int) -> DataFrame:
    """Adds ``number``, 0, 1, ... within each group, in the order of buckets of the unique number ``order``."""
    bucket = F.pmod(F.xxhash64(order), F.lit(max(1, -(-total // BUCKET)))).cast("int")
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "_bucket", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(starts, [group, "_bucket"]).withColumn("number", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def pack(pieces: DataFrame, length: str = "length", capacity: int = 4096, steps: int = STEPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; columns of these names are replaced."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut(pieces.select(*own, F.monotonically_increasing_id().alias("_row")), "pieces")  # numbered once: the table keeps them
    size = F.col(length)
    histogram = {r.l: r.n for r in rows.groupBy(size.alias("l")).agg(F.count("*").alias("n")).collect() if _fits(r.l, capacity)}  # one row a length
    plan = solve(histogram, capacity, steps)
    narrow = numbered(rows.select("_row", size.cast("long").alias("_length")), "_length", "_row", sum(histogram.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], names=["_row", "sequence_id", "offset"])

    placed = narrow.select("_row", "_length", "number").mapInArrow(place, "_row long, sequence_id long, offset long")
    return rows.join(placed, "_row").drop("_row")


def _fits(length: int | None, capacity: int) -> bool:
    if length is None or not 1 <= length <= capacity:
        raise ValueError(f"a piece of length {length} does not fit into {capacity}")
    return True


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id, n_pieces, ids``: the packed sequences themselves, each of at most the capacity."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.hex(ids).alias("h"))))
    joined = F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), ""))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("ids"))
