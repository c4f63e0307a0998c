"""Spelling variants: words one edit apart, found by keys of their deletions.

Two words of equal length that differ in one place agree once that place is deleted, and a word
equals a longer one with one code point deleted.  So every word gives

* for each place, a key of what remains without it: equal keys of equal places are replacements;
* a key of itself: if it equals a key of what remains of a longer word, that is an insertion.

The remainder is never written out.  With ``P`` the hash of the prefix before a place and ``S`` of
the suffix behind it, both sums of ``code * base^position`` modulo two primes, the hash without the
place is ``P + S / base``: NumPy computes all keys of a batch of words as 64-bit integers in a few
vector operations, in time that grows with the length of the words.  Keys travel with a number of
the word instead of the word; they are radix-partitioned by their upper bits, sorted, and only runs
that hold a possible pair go on.  There the words come back, and remainders are compared as
strings, so a collision of hashes pairs nothing.

All words of one place and remainder are near to one another: the group's size gives each member its
number of near words there, and the best word of the group is the best for all others.  Pairs are
never written.  A group of replacements holds at most one word per letter of the alphabet, a group
of insertions one word and the longer ones.

Defined results: null and empty texts have no words; rows with the same id and text count twice; a
null id deletes nothing, as its hash is null; a run is never cut, however long; of near words with equal counts the
first in code-point order is the form; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches

#: A byte of Latin-1 to the lower-case letter it counts as, or to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

#: Words that a task counts before it passes the counts on.
HELD = 200_000

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
RADIX_BITS = 12


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters of a text, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def without(word: bytes, at: int) -> bytes:
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, delete_every: int | None = None) -> DataFrame:
    """``word, n``: words of enough code points that occur often enough in all texts.

    With ``delete_every``, runs lose one code point where that number divides the checksum of id and run.
    """
    small_batches(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        known = held.get

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                every = None if doc_id is None else delete_every
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(runs(own.as_py() or "")).items():
                    if len(word) < least_length:  # deletions only shorten
                        continue
                    if every is not None:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % every == 0:
                            word = without(word, h % len(word))
                            if len(word) < least_length:
                                continue
                    held[word] = known(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = docs.select(F.col(id_col).cast("string"), text).mapInArrow(tally, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def powers(base: int, p: int, n: int) -> np.ndarray:
    """``base^0 ... base^(n-1)`` modulo ``p``, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit keys of hashes, of which all bits are used."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of words: ``key, word (its place in the list), place, kind``.

    Kind 0 is a word itself (place -1), 1 a deletion, 2 one that leaves the same as the deletion before it.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - starts[owner]
    whole, without = np.zeros(len(words), dtype=np.uint64), np.zeros(len(code), dtype=np.uint64)
    for p, base, shift in zip(PRIMES, BASES, (0, 32), strict=True):
        power, modulus, back = powers(base, p, int(sizes.max(initial=1))), np.uint64(p), np.uint64(pow(base, -1, p))
        # Terms are below 2^31, so plain sums of a batch of up to 2^33 code points fit.
        upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((code + np.uint64(1)) * power[place] % modulus)])
        first, last = upto[starts[:-1]], upto[starts[1:]]
        prefix = (upto[:-1] - first[owner]) % modulus
        suffix = (last[owner] - upto[1:]) % modulus
        whole |= ((last - first) % modulus) << np.uint64(shift)
        without |= ((prefix + suffix * back) % modulus) << np.uint64(shift)
    again = np.zeros(len(code), dtype=bool)  # of a run of one letter all deletions leave the same
    again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    kind = np.concatenate([np.zeros(len(words), dtype=np.int8), 1 + again.astype(np.int8)])
    return mixed(np.concatenate([whole, without])), np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), place]), kind


def keyed(words: DataFrame) -> DataFrame:
    """``key, id, place, kind`` of all words (``id, word``)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at, ends = 0, np.cumsum([len(w) for w in own])
            while at < len(own):  # so many words that their keys stay small; at least one
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, side="right")))
                key, who, place, kind = deletion_keys(own[at:upto])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:upto][who]), pa.array(place.astype(np.int32)), pa.array(kind)], names=["key", "id", "place", "kind"])
                at = upto

    return words.select("id", "word").mapInArrow(make, "key long, id long, place int, kind byte")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows whose key may pair them: deletions of one place, or a word with a deletion.

    Keys are dealt by their upper bits and sorted; a task looks at runs of equal keys as they stream by.
    """
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    dealt = keys.repartition(radix).sortWithinPartitions("key", "place")

    def pairs(t: pa.Table) -> pa.Table:
        key, place, kind = (t[c].to_numpy() for c in ("key", "place", "kind"))
        new = np.append(True, key[1:] != key[:-1])
        run, inner = np.cumsum(new) - 1, np.cumsum(new | np.append(True, place[1:] != place[:-1])) - 1
        own, cut_ = (np.bincount(run, kind == k, minlength=run[-1] + 1) > 0 for k in (0, 1))
        alike = np.bincount(inner)[inner] > 1
        return t.filter(pa.array(((kind > 0) & alike) | ((kind < 2) & (own & cut_)[run])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def whole_runs(last: bool) -> pa.Table:
            nonlocal held, n
            now = pa.Table.from_batches(held).combine_chunks()
            key = now["key"].to_numpy()
            open_ = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last run may go on
            held = now.slice(open_).to_batches()
            n = len(key) - open_
            return pairs(now.slice(0, open_)) if open_ else now.slice(0, 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 50_000:
                yield from whole_runs(False).to_batches()
        if n:
            yield from whole_runs(True).to_batches()

    return dealt.select("key", "id", "place", "kind").mapInArrow(scan, "key long, id long, place int, kind byte")


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: per word with near words their number, and the best of them as ``(-n, word)``.

    ``words``: ``id, word, n``, each word once.  ``best`` is the most frequent near word if that is more
    frequent than the word itself; else it may be the word itself.
    """
    found = cut(shared_keys(keyed(words)), "shared")
    named = found.join(words, "id")
    rest = F.concat(F.expr("left(word, place)"), F.expr("substr(word, place + 2)"))
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    swap = cut(named.where("kind > 0").select("id", "key", "place", rest.alias("rest"), me.alias("me")), "swap")
    group = swap.groupBy("key", "place", "rest").agg(F.count("*").alias("size"), F.min("me").alias("best")).where("size > 1")
    replaced = swap.join(group, ["key", "place", "rest"]).select("id", (F.col("size") - 1).alias("n_near"), "best")
    longer = named.where("kind = 1").select("key", rest.alias("rest"), F.col("id").alias("long"), me.alias("long_me"))
    shorter = named.where("kind = 0").select("key", F.col("word").alias("rest"), F.col("id").alias("short"), me.alias("short_me"))
    added = cut(longer.join(shorter, ["key", "rest"]), "added")
    one = F.lit(1).cast("long").alias("n_near")
    every = replaced.unionByName(added.select(F.col("long").alias("id"), one, F.col("short_me").alias("best"))).unionByName(added.select(F.col("short").alias("id"), one, F.col("long_me").alias("best")))
    out = cut(every.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near")
    drop_cut(found, swap, added)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms (``word, form``) of every word ends, by pointer jumping.

    Counts double with every form, so a chain is no longer than their logarithm.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = cut(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        drop_cut(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, delete_every: int | None = None
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    ``form`` is the most frequent near word if it is at least ``ratio`` times (2 is the least) as
    frequent as the word, ``root`` the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent as their words")
    counted = cut(count_words(docs, id_col, text, least_length, least_count, delete_every), "words")
    words = cut(counted.withColumn("id", F.monotonically_increasing_id()), "words")  # numbered once: the table keeps them
    drop_cut(counted)
    near = near_words(words)
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = cut(formed, "formed")
    drop_cut(near, words)
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
