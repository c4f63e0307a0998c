"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (one base64 token and its rank a line).  The merges are derived
from the ranks on the driver, the resulting tokenizer is broadcast as JSON (its size is that
of the vocabulary file, whatever the data), and each Python worker rebuilds it once.

Every match of the split pattern is a piece that is merged on its own, so pieces repeat
massively: a worker keeps the ids of pieces it has met (a bounded cache that is emptied when
full), maps the bytes of new ones to characters and hands these to the library, a whole batch at
a time.

Defined results: a null text encodes like an empty one (no ids) and decodes to empty bytes;
special-token strings are ordinary text; any text round-trips byte for byte; repeated rows are
encoded each; an empty table gives an empty result; columns that carry the names of the new ones
are replaced; a text whose ids take 2 GiB (more than half a billion) raises.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches


def byte_table() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each longer token, in rank order: what its bytes merge to by lower ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def build_tokenizer(ranks: dict[bytes, int]) -> str:
    """A tokenizers-library BPE over pieces that are split and mapped to byte characters, as JSON."""
    from tokenizers import Tokenizer, models

    shown = byte_table()
    text = lambda token: "".join(shown[b] for b in token)
    model = models.BPE(
        vocab={text(k): v for k, v in ranks.items()},
        merges=[(text(a), text(b)) for a, b in merges_of(ranks)],
        ignore_merges=True,
    )
    return Tokenizer(model).to_str()


class Codec:
    """Encodes and decodes batches of texts; one per Python worker."""

    def __init__(self, tokenizer_json: str, pattern: str, cache_pieces: int = 50_000):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.split = regex.compile(pattern).findall
        self.limit = cache_pieces
        self.shown = dict(enumerate(byte_table()))
        back = {c: b for b, c in self.shown.items()}
        vocab = json.loads(tokenizer_json)["model"]["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            tokens[i] = bytes(back[c] for c in shown)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.limit and self.known:
            self._empty()
            new = list(dict.fromkeys(pieces))
        mapped = [p.encode().decode("latin-1").translate(self.shown) for p in new]
        ids = np.array(self.tok.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int32)
        # Every byte is one character, so the ids of a piece end where its length is used up.
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(m) for m in mapped])) + 1
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + ends])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and where each text's ids begin (one more entry than texts)."""
        split = [self.split(t) if t else [] for t in texts]
        n_pieces = np.cumsum([0] + [len(p) for p in split])
        pieces = list(chain.from_iterable(split))
        self._learn(pieces)
        k = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        begin, length = self.at[k], self.at[k + 1] - self.at[k]
        ends = np.concatenate([[0], np.cumsum(length)])
        index = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
        return self.ids[index], ends[n_pieces]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (one more entry than ids)."""
        length = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        index = np.repeat(self.starts[ids] - ends[:-1], length) + np.arange(ends[-1])
        return self.blob[index], ends


def char_offsets(data: np.ndarray, token_at: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token within its text.

    ``data`` is UTF-8; a token that holds only part of a character spans that whole character,
    so both halves of a split character report it.
    """
    number = np.cumsum((data & 0xC0) != 0x80) - 1
    if not len(number):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    base = np.zeros(len(token_at) - 1, dtype=np.int64)
    own = token_at[text_at[:-1]]
    size = np.diff(text_at)
    full = size > 0
    base[:] = np.repeat(number[own[full]], size[full])
    start = number[token_at[:-1]] - base
    end = number[token_at[1:] - 1] + 1 - base
    return start.astype(np.int32), end.astype(np.int32)


_CODECS: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    key = hash((shared.id if hasattr(shared, "id") else id(shared), pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _extended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    taken = {n for n, _ in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in taken] + [T.StructField(n, t) for n, t in fields])


def _binary(data: bytes, at: np.ndarray) -> pa.Array:
    if len(data) >= 1 << 31:  # batches are cut well below that, unless one text alone exceeds it
        raise OverflowError(f"{len(data)} bytes in a batch of {len(at) - 1} rows; a cell of Spark holds less than 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _shares(batches: Iterator[pa.RecordBatch], text_col: str, most: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed ``most`` bytes together."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        share = np.cumsum(size, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _kept(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``token_ids``, ``char_starts``, ``char_ends`` (arrays of int) and ``packed`` to every row.

    ``packed`` holds the ids as little-endian unsigned 32-bit integers, as training files do.  With ``decoded`` the ids are decoded again in the same pass, which spares
    the second Python worker of a :func:`decode` that follows.  Columns of ``df`` that already
    carry these names are replaced.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(build_tokenizer(read_ranks(vocabulary)))
    new = ("token_ids", "char_starts", "char_ends", "packed", *["decoded"] * decoded)
    kept = [c for c in df.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in _shares(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids, at = codec.encode(texts)
            data, token_at = codec.decode(ids)
            starts, ends = char_offsets(data, token_at, at)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids, starts, ends)]
            bytes_ = [_binary(ids.astype("<u4").tobytes(), 4 * at), *[_binary(data.tobytes(), token_at[at])] * decoded]
            yield pa.RecordBatch.from_arrays([*_kept(batch, kept), *lists, *bytes_], names=[*kept, *new])

    ints = T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, _extended(df, *((n, ints) for n in new[:3]), *((n, T.BinaryType()) for n in new[3:])))


def decode(df: DataFrame, vocabulary: str, pattern: str = "", ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary: the bytes of the ids) to every row; null ids decode to no bytes."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(build_tokenizer(read_ranks(vocabulary)))
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            size = np.nan_to_num(np.asarray(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data, token_at = codec.decode(ids)
            at = token_at[np.concatenate([[0], np.cumsum(size)])]
            yield pa.RecordBatch.from_arrays([*_kept(batch, kept), _binary(data.tobytes(), at)], names=[*kept, "decoded"])

    return df.mapInArrow(run, _extended(df, ("decoded", T.BinaryType())))
