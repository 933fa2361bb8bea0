"""Splitting of oversized texts at natural boundaries (problem 9).

Method: agglomerative merging. A text over the limit starts as atomic segments; adjacent
pairs wait in a heap, weakest boundary first (then smallest sum, then place), and merge while
their combined size plus the overlap fits. What remains are the pieces; each but the first is
then extended to the left by the overlap.

Words of a sentence would all merge before any two sentences do, as their boundaries are the
weaker ones. So the atoms are sentences where a sentence fits by itself, words where it does
not, and token-sized parts where a single word does not.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lexmill.llm.bpe import Encoder, encoder, shared_vocabulary, steps

LIMIT = 2048
OVERLAP = 128

TOKEN, WORD, SENTENCE, PARAGRAPH = range(4)

# A boundary lies after what matches, but before a last blank, which belongs to the next word.
# Paragraphs end at a line break, sentences at an end mark with closing marks after it and
# white space, or at an ideographic end mark.
_PARAGRAPH = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…।]+[\"'”’)\]]*\s+|[。！？]+[」』”’]*\s*")
_WORD = re.compile(r"\s+")


def boundaries(text: str) -> dict[int, int]:
    """Position -> strength of the boundary before that character; positions inside the text only."""
    out: dict[int, int] = {}
    for strength, pattern in ((WORD, _WORD), (SENTENCE, _SENTENCE), (PARAGRAPH, _PARAGRAPH)):
        for m in pattern.finditer(text):
            at = m.end() - (text[m.end() - 1] == " ")
            if 0 < at < len(text):
                out[at] = strength
    return out


def merge(sizes: list[int], strengths: list[int], room: int) -> list[int]:
    """Numbers of the first atoms of the groups that agglomerative merging leaves.

    ``strengths[i]`` is the boundary between atoms i and i + 1; groups hold at most ``room``.
    """
    n = len(sizes)
    size, left, right = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, version = [True] * n, [0] * n
    heap = [(strengths[i], sizes[i] + sizes[i + 1], i, 0, 0) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= room]
    heapq.heapify(heap)
    bound = list(strengths) + [PARAGRAPH]
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        size[i] += size[j]
        alive[j] = False
        version[i] += 1
        bound[i] = bound[j]
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            if size[i] + size[right[i]] <= room:
                heapq.heappush(heap, (bound[i], size[i] + size[right[i]], i, version[i], version[right[i]]))
        if left[i] >= 0 and size[left[i]] + size[i] <= room:
            k = left[i]
            heapq.heappush(heap, (bound[k], size[k] + size[i], k, version[k], version[i]))
    return [i for i in range(n) if alive[i]]


def _token_ends(text: str, token_bytes: np.ndarray) -> np.ndarray:
    """Character position at the end of each token; of a character cut by tokens, the position before it."""
    ends = np.cumsum(token_bytes)
    if text.isascii():
        return ends
    first = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    return np.append(np.cumsum(first) - 1, len(text))[ends]


def cut(text: str, token_bytes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of a text as (start, end) characters, each but the first with its overlap."""
    ends = _token_ends(text, token_bytes)
    n = len(ends)
    room = limit - overlap
    marks = boundaries(text)
    places = np.array(sorted(marks), np.int64)
    strength = np.array([marks[p] for p in places], np.int64)
    # Tokens before each boundary; one that straddles it (the blank before a word) counts for the earlier atom.
    token = np.minimum(np.searchsorted(ends, places, side="left") + 1, n)
    chosen = strength >= SENTENCE
    atoms = [(0, 0, PARAGRAPH), *zip(places[chosen].tolist(), token[chosen].tolist(), strength[chosen].tolist())]
    fine: list[tuple[int, int, int]] = []
    for k, (p, t, s) in enumerate(atoms):
        nxt_p, nxt_t = (atoms[k + 1][0], atoms[k + 1][1]) if k + 1 < len(atoms) else (len(text), n)
        fine.append((p, t, s))
        if nxt_t - t <= room:
            continue
        a, b = np.searchsorted(places, [p, nxt_p])
        words = [(int(places[x]), int(token[x]), WORD) for x in range(a, b) if places[x] > p]
        inner = [(p, t, s), *words]
        fine.pop()
        for m, (wp, wt, ws) in enumerate(inner):
            end_p, end_t = (inner[m + 1][0], inner[m + 1][1]) if m + 1 < len(inner) else (nxt_p, nxt_t)
            fine.append((wp, wt, ws))
            if end_t - wt > room:  # one word beyond the room: parts of whole tokens
                at = wt + room
                while at < end_t:
                    place = int(ends[at - 1])
                    if fine[-1][0] < place < end_p:
                        fine.append((place, at, TOKEN))
                    at += room
    sizes = [(fine[k + 1][1] if k + 1 < len(fine) else n) - fine[k][1] for k in range(len(fine))]
    groups = merge(sizes, [x[2] for x in fine[1:]], room)
    starts = [fine[g][0] for g in groups] + [len(text)]
    out = []
    for k, g in enumerate(groups):
        start = starts[k]
        if k:
            back = fine[g][1] - overlap
            start = min(start, int(ends[back - 1])) if back > 0 else 0
        out.append((start, starts[k + 1]))
    return out


def _bounds(limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ever smaller (limit, overlap) to cut by: less room first, down to one token, then less overlap."""
    spare = 0
    while limit - spare > overlap:
        yield limit - spare, overlap
        spare = spare * 2 or 2
    while overlap:
        overlap //= 2
        yield overlap + 1, overlap


def _by_bytes(text: str, limit: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` bytes, which cannot have more tokens; no overlap."""
    out, start, size = [], 0, 0
    for i, ch in enumerate(text):
        n = len(ch.encode("utf-8", "surrogatepass"))
        if size + n > limit:
            out.append((start, i))
            start, size = i, 0
        size += n
    return [*out, (start, len(text))]


def split_text(text: str, own: Encoder, limit: int = LIMIT, overlap: int = OVERLAP, token_bytes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text; every piece encoded by itself is within the limit.

    ``token_bytes`` are the sizes of the text's tokens, if they are known already.

    A piece may take a few tokens more by itself than as part of the text, as its first word
    may be cut. Where one is over the limit, the text is cut again with less room, and at
    the very last by bytes, so that no piece is ever over the limit.
    """
    token_bytes = own.encode([text])[2] if token_bytes is None else token_bytes
    if len(token_bytes) <= limit:
        return [(0, len(text), len(token_bytes))]
    ways = chain((cut(text, token_bytes, *bounds) for bounds in _bounds(limit, overlap)), (_by_bytes(text, limit) for _ in range(1)))
    for pieces in ways:
        counts = own.encode([text[a:b] for a, b in pieces])[1]
        if counts.max() <= limit:
            break
    return [(a, b, int(c)) for (a, b), c in zip(pieces, counts)]


def split_documents(documents: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, folder: str | None = None) -> DataFrame:
    """Pieces of every document: ``key``, ``piece_no`` (from 0), ``start``, ``end`` (characters), ``n_tokens``, ``piece``.

    Neighbours share the last ``overlap`` tokens of the earlier one, a few more where a token
    boundary lies inside a character. Texts within the limit come out as one piece.

    Defined cases: null and empty texts are one piece of no tokens (the piece null or empty);
    blank texts are cut like others; a word beyond the limit is cut between tokens; repeated
    rows and null keys are carried through; an empty table gives none; other columns are
    ignored whatever their names; whole texts of any length are cut. The job has no shuffle.
    """
    if not 0 <= overlap < limit // 2 or limit < 4:
        raise ValueError("the limit must hold a character of four bytes, and the overlap be less than half of it")
    vocabulary = shared_vocabulary(documents.sparkSession, folder)
    schema = StructType([StructField(key, documents.schema[key].dataType), *[StructField(c, IntegerType()) for c in ("piece_no", "start", "end", "n_tokens")], StructField("piece", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps(texts):
                _, counts, sizes = own.encode(texts[a:b])
                ends = np.cumsum(counts)
                rows: list[tuple] = []
                for i in range(a, b):
                    t = texts[i]
                    if not t or counts[i - a] <= limit:
                        rows.append((i, 0, 0, len(t or ""), int(counts[i - a]), t))
                    else:
                        rows += [(i, no, s, e, c, t[s:e]) for no, (s, e, c) in enumerate(split_text(t, own, limit, overlap, sizes[ends[i - a] - counts[i - a] : ends[i - a]]))]
                at, *rest = zip(*rows)
                kinds = [pa.int32()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(rest, kinds)]], names=schema.names)

    return documents.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
