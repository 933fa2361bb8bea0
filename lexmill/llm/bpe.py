"""Byte-level BPE over whole corpora (problem 7).

Method: batched numpy merge rounds. Texts are cut into words by the tokenizer's pattern, the
distinct new words of a batch are encoded together: their symbols lie in one flat array, the
rank of every adjacent pair is found by binary search over the sorted pair keys, each word's
lowest-rank pair is merged, and rounds repeat until no pair has a rank. Words seen before
come from a bounded cache; the ids of a batch are gathered with array operations only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where the vocabulary files lie, unless told otherwise.
DEFAULT_FOLDER = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Pattern of the byte-level tokenizer: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, extra = [], 0x100
    for b in range(256):
        if b in own:
            letters.append(chr(b))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class Encoder:
    """Ids of texts, without special tokens."""

    def __init__(self, vocabulary: bytes):
        """``vocabulary`` is the content of the vocabulary file."""
        import regex

        model = json.loads(vocabulary)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        keys = a << 32 | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        of_letter = {c: i for i, c in enumerate(letters)}
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int32)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token) if all(c in of_letter for c in token) else 0
        self.words = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str | tuple[str], int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        # rank[i], at[i]: of the pair of symbols i and i + 1; none at the end of a word.
        rank, at = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols):
            rank[:-1], at[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[:-1] != word[1:]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(best != _NONE, counts)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
            hit = live & (rank == np.repeat(best, counts))
            where = np.flatnonzero(hit)
            if not len(where):
                break
            # A run of equal symbols offers overlapping pairs: of each run of hits every second one merges.
            fresh = np.append(True, np.diff(where) != 1)
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols[where] = self.made[at[where]]
            rank[where] = rank[where + 1]  # only to know whether the word goes on
            live[where + 1] = False
            last = word[where] != np.append(word, -1)[where + 2]
            kept = np.cumsum(live) - 1
            symbols, word, rank, at = symbols[live], word[live], rank[live], at[live]
            where = kept[where]
            rank[where[last]] = _NONE
            before = where[where > 0] - 1
            stale = np.concatenate([where[~last], before[word[before] == word[before + 1]]])
            rank[stale], at[stale] = self._rank(symbols[stale], symbols[stale + 1])
        ids, owner = np.concatenate(done_symbols or [np.empty(0, np.int64)]), np.concatenate(done_words or [np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _learn(self, chunks: list[str | tuple[str]]) -> None:
        """Add chunks to the cache; their distinct words are merged together."""
        cut = [self.words(" " + c if isinstance(c, str) else c[0]) for c in chunks]
        number: dict[str, int] = {}
        for ws in cut:
            for w in ws:
                number.setdefault(w, len(number))
        ids, lengths = self.merge_words([w.encode("utf-8", "surrogatepass") for w in number])
        starts = np.cumsum(lengths) - lengths
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        flat = ids[_ranges(starts[which], lengths[which])]
        chunk_of_word = np.repeat(np.arange(len(chunks)), list(map(len, cut)))
        of_chunk = np.bincount(chunk_of_word, weights=lengths[which], minlength=len(chunks)).astype(np.int64)
        for c in chunks:
            self.index[c] = len(self.index)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(of_chunk) - of_chunk])
        self.lengths = np.concatenate([self.lengths, of_chunk])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts together: the ids, the number of ids of each text, the number of bytes of each id."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        cut = [self.chunks(t) if t else [] for t in texts]
        new: set[str | tuple[str]] = set()
        for chunks in cut:
            new.update(chunks)
        unknown = [c for c in new if c not in self.index]
        if unknown:
            self._learn(unknown)
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        lengths = self.lengths[which]
        ids = self.flat[_ranges(self.starts[which], lengths)]
        text_of_chunk = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        per_text = np.bincount(text_of_chunk, weights=lengths, minlength=len(texts)).astype(np.int64)
        return ids, per_text, self.token_bytes[ids]

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """Pieces of a text that are encoded apart: strings follow a blank, one-tuples do not.

        A blank followed by something else opens a word, whatever stands before it, unless
        white space stands on both sides of it. So a text is cut at each single blank, which
        costs far less than the pattern; a text with wider white space around a blank is cut
        into words by the pattern.
        """
        if wide(text):
            return [(w,) for w in self.words(text)]
        out: list[str | tuple[str]] = text.split(" ")
        out[0] = (out[0],)
        return out


_WIDE = re.compile(r"\s |^ | $").search


def wide(text: str) -> bool:
    """Whether white space stands left of some blank, or a blank at either end."""
    if text.isascii():
        return any(p in text for p in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f ")) or text.startswith(" ") or text.endswith(" ")
    return _WIDE(text) is not None


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: tuple[str, Broadcast]) -> Encoder:
    """The encoder of a shared vocabulary; a Python worker keeps one."""
    name, content = vocabulary
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(content.value)
    return _ENCODERS[name]


def shared_vocabulary(spark: SparkSession, folder: str | None = None) -> tuple[str, Broadcast]:
    """Digest and content of the vocabulary file, a few MB, broadcast; executors need no copy of the folder.

    The session setting ``spark.lexmill.tokenizers`` may name another folder.
    """
    path = os.path.join(folder or spark.conf.get("spark.lexmill.tokenizers", DEFAULT_FOLDER), VOCABULARY)
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}; name its folder by spark.lexmill.tokenizers or LEXMILL_TOKENIZERS")
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)


#: Characters that are encoded together; bounds the memory of a step, longer texts go alone.
STEP_CHARS = 4_000_000


def steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of at most ``limit`` characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode_texts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (token ids without special tokens) of every document, once per row.

    Defined cases: null and empty texts have the empty list; blank texts have the ids of
    their blanks; strings that look like special tokens are ordinary text; repeated rows and
    null keys are carried through; an empty table gives none; other columns are ignored
    whatever their names; whole texts of any length are encoded. The job has no shuffle.
    """
    vocabulary = shared_vocabulary(documents.sparkSession, folder)
    schema = StructType([StructField(key, documents.schema[key].dataType), StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps(texts):
                ids, counts, _ = own.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
