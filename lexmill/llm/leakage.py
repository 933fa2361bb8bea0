"""Evaluation texts inside training texts (problem 8).

Method: winnowing. A text is its sequence of words; every run of ``GRAM`` words has a hash,
and of every ``WINDOW`` consecutive hashes the least is kept as a fingerprint. Any shared
span of ``GRAM + WINDOW - 1`` words therefore has a fingerprint that both texts keep.
Fingerprints are joined, and each hit is extended word by word to the full shared span, which
makes the result exact.

The items are broadcast only while their checked size is within ``BROADCAST_FINGERPRINTS``;
the hits are then extended in the scan of the documents. Beyond that a bitmap of the items'
hashes, of a size fixed by ``FILTER_BITS`` whatever the items, is broadcast instead. It drops
nearly all of the documents' fingerprints in the scan; those left are extended there to the
spans of ``SPAN`` words that hold them, and only the 128-bit hashes of these spans are
shuffled and joined to those of the items, so that nothing but true pairs comes out of the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexmill.llm.bpe import steps

SPAN = 12
GRAM = 6
WINDOW = SPAN - GRAM + 1
BROADCAST_FINGERPRINTS = 2_000_000

#: Bits of a fingerprint that the filter of the items tells apart: 2 ** 27 bits are 16 MB.
FILTER_BITS = 27
#: Parts of a span's group in the join; the items' side, the small one, is repeated for each.
SALTS = 8

_MEMORY = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tools() -> tuple:
    import regex
    import xxhash

    return regex.compile(r"\p{L}+").findall, xxhash.xxh64_intdigest


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and the number of words of each text."""
        letters, digest = _tools()
        words = [letters(t.lower()) if t else [] for t in texts]
        new: set[str] = set()
        for ws in words:
            new.update(ws)
        if len(self.known) > _MEMORY:
            self.known.clear()
        for w in new:
            if w not in self.known:
                self.known[w] = digest(w.encode("utf-8", "surrogatepass"))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One a Python worker."""
    return WordHashes()


def _hash_runs(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``length`` words, across the ends of texts too."""
    runs = len(words) - length + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(runs, 0), np.uint64)
        for k in range(length):
            h = h * base + words[k : k + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def fingerprints(words: np.ndarray, counts: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept grams of many texts: hash, text number, and position of the first word within all words.

    Of equal least hashes in a window the last is kept. Texts of fewer than ``gram`` words
    have none; those of fewer grams than ``window`` have the least of what they have.
    """
    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    if n < gram:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = n - gram + 1
    h = _hash_runs(words, gram, _BASE)
    inside = text[:grams] == text[gram - 1 :]
    at = np.flatnonzero(inside)
    h, text = h[at], text[at]
    m = len(h)
    if not m:
        return h, text, at
    # least[i]: position of the least hash of the window that starts at i, cut at the end of the text.
    last = np.searchsorted(text, text, side="right") - 1
    least = np.arange(m)
    for k in range(1, window):
        other = np.minimum(np.arange(m) + k, last)
        least = np.where(h[other] <= h[least], other, least)
    full = np.arange(m) + window - 1 <= last
    first = np.searchsorted(text, text, side="left") == np.arange(m)  # short texts have one, cut window
    keep = np.unique(least[full | first])
    return h[keep], text[keep], at[keep]


def spans_meet(a: np.ndarray, i: int, b: np.ndarray, j: int, span: int = SPAN, gram: int = GRAM) -> bool:
    """Whether the words shared around the gram at ``a[i]`` and ``b[j]`` run for at least ``span``."""
    if not np.array_equal(a[i : i + gram], b[j : j + gram]):
        return False
    length = gram
    while length < span and i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
        length += 1
    while length < span and i and j and a[i - 1] == b[j - 1]:
        i, j, length = i - 1, j - 1, length + 1
    return length >= span


class Items:
    """The items' words, and their fingerprints sorted by hash."""

    def __init__(self, texts: list[str]):
        words, counts = WordHashes()(texts)
        ends = np.cumsum(counts)
        self.words = [words[e - c : e] for e, c in zip(ends, counts)]
        h, text, at = fingerprints(words, counts)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.at = h[order], text[order], (at - (ends - counts)[text])[order]

    def leaks(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(text number, item number) of each text that shares a span with an item, each once."""
        words, counts = word_hashes()(texts)
        h, text, at = fingerprints(words, counts)
        low = np.searchsorted(self.hashes, h, side="left")
        high = np.searchsorted(self.hashes, h, side="right")
        starts = np.cumsum(counts) - counts
        found: set[tuple[int, int]] = set()
        for k in np.flatnonzero(high > low):
            t = int(text[k])
            own = words[starts[t] : starts[t] + counts[t]]
            for f in range(low[k], high[k]):
                pair = (t, int(self.item[f]))
                if pair not in found and spans_meet(own, int(at[k] - starts[t]), self.words[pair[1]], int(self.at[f])):
                    found.add(pair)
        pairs = sorted(found)
        return [a for a, _ in pairs], [b for _, b in pairs]


@lru_cache(maxsize=1)
def _items(texts: tuple[str, ...]) -> Items:
    return Items(list(texts))


def _span_rows(df: DataFrame, key: str, text: str, bitmap: Broadcast | None = None) -> DataFrame:
    """``_key``, ``_gram``, ``_h1``, ``_h2``: of each fingerprint the spans of ``SPAN`` words that hold its gram; with a bitmap of the grams in it only, and each span once."""
    schema = StructType([StructField("_key", df.schema[key].dataType), StructField("_gram", LongType()), StructField("_h1", LongType()), StructField("_h2", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                words, counts = word_hashes()(texts[lo:hi])
                h, t, at = fingerprints(words, counts)
                if bits is not None:
                    place = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    kept = (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    h, t, at = h[kept], t[kept], at[kept]
                ends = np.cumsum(counts)
                start = (at[:, None] - np.arange(SPAN - GRAM + 1)[None, :]).ravel()
                owner, gram = np.repeat(t, SPAN - GRAM + 1), np.repeat(h, SPAN - GRAM + 1)
                inside = (start >= (ends - counts)[owner]) & (start + SPAN <= ends[owner])
                start, owner, gram = start[inside], owner[inside], gram[inside]
                if bits is not None:  # one row a span is enough where the gram has done its work
                    start, first = np.unique(start, return_index=True)
                    owner, gram = owner[first], gram[first]
                pair = [_hash_runs(words, SPAN, base)[start].view(np.int64) if len(start) else np.empty(0, np.int64) for base in (_BASE, _SECOND_BASE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + owner, pa.int64())), pa.array(gram.view(np.int64)), *map(pa.array, pair)], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull()).mapInArrow(run, schema)


def _bitmap(grams: DataFrame) -> bytes:
    """The leading bits of all fingerprints as a bitmap; put together in parts of 4 KB, ``2 ** FILTER_BITS`` bits in all."""
    place = F.shiftrightunsigned("_gram", 64 - FILTER_BITS) + 1  # the functions count from 1
    parts = grams.groupBy(F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for row in parts.collect():
        start = (row["_part"] - 1) * 4096
        out[start : start + 4096] = row["_bits"]
    return bytes(out)


def _leaks_by_shuffle(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, doc_text: str, item_text: str) -> DataFrame:
    spans = _span_rows(items, item_key, item_text)
    bitmap = documents.sparkSession.sparkContext.broadcast(_bitmap(spans.select("_gram")))
    mine = _span_rows(documents, doc_key, doc_text, bitmap).select(F.col("_key").alias(doc_key), "_h1", "_h2", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).alias("_salt"))
    theirs = spans.select(F.col("_key").alias("_item"), "_h1", "_h2").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return mine.join(theirs, ["_h1", "_h2", "_salt"]).select(F.col(doc_key), F.col("_item").alias(item_key)).distinct()


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", doc_text: str = "text", item_text: str = "text", broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """``doc_key``, ``item_key`` of each document and item that share at least ``SPAN`` consecutive words.

    A word is a longest run of letters, compared in lower case; nothing between words counts.

    Defined cases: null, empty and wordless texts share nothing; texts of fewer than ``SPAN``
    words share nothing; a pair comes once however often it shares; repeated documents or
    items are reported under each of their ids, ids that are repeated with one text once;
    a null id is reported as null; empty tables give none; whole texts of any length count;
    columns of the two tables may clash, as only the named ones are taken.
    """
    size = items.agg(F.coalesce(F.sum(F.length(F.col(item_text).cast("string"))), F.lit(0)).alias("chars")).first()["chars"]
    if size // 2 > broadcast_limit:  # every word takes two characters at least, and no word gives two fingerprints
        return _leaks_by_shuffle(documents, items, doc_key, item_key, doc_text, item_text)
    long_enough = F.length(F.col(item_text).cast("string")) >= 2 * SPAN - 1
    rows = items.where(long_enough).select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t")).collect()
    item_type = items.schema[item_key].dataType
    shared = documents.sparkSession.sparkContext.broadcast(tuple(r["t"] for r in rows))
    numbered = documents.sparkSession.createDataFrame([(i, r["k"]) for i, r in enumerate(rows)], StructType([StructField("_no", IntegerType()), StructField(item_key, item_type)]))
    schema = StructType([StructField(doc_key, documents.schema[doc_key].dataType), StructField("_no", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _items(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                which, item = own.leaks(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + w for w in which], pa.int64())), pa.array(item, pa.int32())], names=schema.names)

    hits = documents.select(F.col(doc_key), F.col(doc_text).cast("string").alias("_text")).mapInArrow(run, schema)
    return hits.join(F.broadcast(numbered), "_no").select(doc_key, item_key).distinct()
