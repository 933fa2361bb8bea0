"""Several values packed in one field (problem 2).

Method: dictionary-guided segmentation. The dictionary holds all known whole values of a field
(cells that consist of one value, and values that closed marks protect somewhere, which may
hold delimiters and marks that never close). A multi-pattern automaton finds them in every
packed text; dynamic programming picks the cover of the text by known values and unknown
pieces with the fewest unknown pieces, then the fewest pieces. The rows are read off that cover.

A rule gives the places where the cover may and must part: letters, marks, digits, spaces and
the signs ``. - + _ ' : ( )`` never part, nor do delimiters inside closed parentheses or closed
double quotes; every other delimiter does. Only where the rule leaves a delimiter open, that
is behind a parenthesis or quote which never closes, may a known value bridge it; with
``dictionary_protects=True`` known values may bridge any delimiter.

The dictionary is never cut short. Up to ``DICTIONARY_CHARS`` characters, which are counted,
it is broadcast; beyond that the pieces a text could hold are looked up by a join and each
batch builds its automaton from what was found, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from lexmill.session import collect_bounded

# Letters, marks, numbers, spaces and the signs . - + _ ' : ( ) never part values.
QUOTES = {'"': '"', "“": "”"}

#: Java pattern of a field that holds one value by its characters alone.
SINGLE_VALUE = r"^[\p{L}\p{M}\p{Nd}\p{Zs}.\-+_':]+\z"

#: Characters of all dictionary values together up to which the dictionary is broadcast.
DICTIONARY_CHARS = 4_000_000


_DELIMITER = regex.compile(r"[^\p{L}\p{M}\p{N}\p{Zs}.\-+_':()]")
_MARK = regex.compile(r'["“()]')
_OPENING = regex.compile(r'["“(]')


def scan(text: str) -> tuple[list[int], int]:
    """Positions of the delimiters that part values, and where an unclosed mark opens (len(text) if none does).

    Straight quotes double to stand for themselves; parentheses nest. A mark that never
    closes protects nothing: an unclosed quote is itself a delimiter, an unclosed parenthesis
    an ordinary sign.
    """
    cuts = [m.start() for m in _DELIMITER.finditer(text)]
    if not _OPENING.search(text):
        return cuts, len(text)
    closed = _closing(text)
    ends = sorted(closed.items())

    def outside(places: Iterable[int]) -> Iterator[int]:
        k = 0
        for p in places:
            while k < len(ends) and ends[k][1] < p:
                k += 1
            if k == len(ends) or p < ends[k][0]:
                yield p

    return list(outside(cuts)), next(outside(m.start() for m in _OPENING.finditer(text)), len(text))


def _closing(text: str) -> dict[int, int]:
    """Outermost protected spans: opening position -> closing position."""
    out: dict[int, int] = {}
    last_quote = {closer: text.rfind(closer) for closer in QUOTES.values()}
    close_parens = _paren_ends(text) if "(" in text else {}
    done = -1
    for m in _OPENING.finditer(text):
        i = m.start()
        if i <= done:
            continue
        if text[i] == "(":
            end = close_parens.get(i, -1)
        else:
            end = _quote_end(text, i) if last_quote[QUOTES[text[i]]] > i else -1
        if end > i:
            out[i] = done = end
    return out


def _quote_end(text: str, at: int) -> int:
    closer = QUOTES[text[at]]
    j = text.find(closer, at + 1)
    while closer == '"' and j >= 0 and text[j + 1 : j + 2] == '"':
        j = text.find(closer, j + 2)
    return j


def _paren_ends(text: str) -> dict[int, int]:
    """Closing position of every closed parenthesis; closed quotes inside are skipped. One pass over the marks."""
    out, stack, done = {}, [], -1
    for m in _MARK.finditer(text):
        i, ch = m.start(), text[m.start()]
        if i <= done:
            continue
        if ch in QUOTES:
            done = max(done, _quote_end(text, i))
        elif ch == "(":
            stack.append(i)
        elif stack:
            out[stack.pop()] = i
    return out


def clean(piece: str) -> str:
    """A value without the blanks and the quotes around it."""
    piece = piece.strip()
    if len(piece) >= 2 and piece[0] in QUOTES and piece[-1] == QUOTES[piece[0]] and _quote_end(piece, 0) == len(piece) - 1:
        inner = piece[1:-1]
        piece = (inner.replace('""', '"') if piece[0] == '"' else inner).strip()
    return piece


class Segmenter:
    """Cover of packed texts by known values and unknown pieces."""

    def __init__(self, known: Iterable[str] = (), dictionary_protects: bool = False):
        import ahocorasick

        self.known = {k for k in known if k}
        self.protects = dictionary_protects
        self.automaton = ahocorasick.Automaton()
        for k in self.known:
            self.automaton.add_word(k, len(k))
        if self.known:
            self.automaton.make_automaton()

    def cover(self, text: str) -> list[tuple[str, bool]]:
        """The values of a text in order, each with whether the dictionary holds it."""
        segments, unclosed = _segments(text)
        n = len(segments)
        values = [clean(text[a:b]) for a, b in segments]
        known = [False] * n
        bridges: dict[int, list[int]] = {}
        if self.known:
            starts = {a: k for k, (a, b) in enumerate(segments) if a < b}
            ends = {b: k for k, (a, b) in enumerate(segments) if a < b}
            inner = {_inside(text, a, b): k for k, (a, b) in enumerate(segments) if values[k] != text[a:b]}
            for last, length in self.automaton.iter(text):
                a, b = starts.get(last + 1 - length), ends.get(last + 1)
                if a is not None and a == b:
                    known[a] = True
                elif a is not None and b is not None and b > a and (self.protects or segments[b][0] > unclosed):
                    bridges.setdefault(a, []).append(b)
                elif (k := inner.get((last + 1 - length, last + 1))) is not None:
                    known[k] = True
            for k in inner.values():  # a doubled quote is written otherwise than in the dictionary
                known[k] = known[k] or values[k] in self.known
        # best[k]: (unknown pieces, pieces) of the best cover from segment k on, step[k]: segments its first piece takes.
        best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        step = [1] * n
        for k in range(n - 1, -1, -1):
            unknown, pieces = best[k + 1]
            best[k] = (unknown + (values[k] != "" and not known[k]), pieces + (values[k] != ""))
            for b in bridges.get(k, ()):
                unknown, pieces = best[b + 1]
                if (unknown, pieces + 1) < best[k]:
                    best[k], step[k] = (unknown, pieces + 1), b + 1 - k
        out, k = [], 0
        while k < n:
            if step[k] > 1:
                out.append((clean(text[segments[k][0] : segments[k + step[k] - 1][1]]), True))
            elif values[k]:
                out.append((values[k], known[k]))
            k += step[k]
        return [x for x in out if x[0]]

    def split(self, text: str) -> list[str]:
        return [v for v, _ in self.cover(text)]


def _segments(text: str) -> tuple[list[tuple[int, int]], int]:
    """What the rule's delimiters leave, without the blanks around, and where an unclosed mark opens."""
    cuts, unclosed = scan(text)
    out, at = [], 0
    for c in [*cuts, len(text)]:
        piece = text[at:c]
        a = at + len(piece) - len(piece.lstrip())
        out.append((a, max(a, c - (len(piece) - len(piece.rstrip())))))
        at = c + 1
    return out, unclosed


def _inside(text: str, a: int, b: int) -> tuple[int, int]:
    """Span inside the quotes of a quoted segment."""
    piece = text[a + 1 : b - 1]
    return a + 1 + len(piece) - len(piece.lstrip()), b - 1 - (len(piece) - len(piece.rstrip()))


def candidates(text: str, longest: int, dictionary_protects: bool = False) -> set[str]:
    """All pieces of a text that a dictionary value of at most ``longest`` delimiters could be in a cover."""
    segments, unclosed = _segments(text)
    out = set()
    for k, (a, b) in enumerate(segments):
        out.add(text[a:b])
        out.add(clean(text[a:b]))
        for to in range(k + 1, min(k + longest, len(segments) - 1) + 1):
            if a < b and (dictionary_protects or segments[to][0] > unclosed):
                out.add(text[a : segments[to][1]])
    return out - {""}


def _protected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of (field, text) rows that hold a parting delimiter, found by the rule alone."""
    cutter = Segmenter()
    for batch in batches:
        at, item = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            values = [v for v in cutter.split(text) if _DELIMITER.search(v)]
            at.extend([i] * len(values))
            item.extend(values)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.string())], names=["field", "item"])


def _cells(df: DataFrame, fields: Sequence[str], *keep: Column) -> DataFrame:
    """One row per non-empty cell: what is kept, ``field`` and ``text``."""
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_cell")
    return df.select(*keep, cell).where("_cell.text <> ''").select(*[c for c in df.select(*keep).columns], "_cell.field", "_cell.text")


def known_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, item): every whole value of the fields, once; taken from all rows.

    Whole values are cells that are one value by their characters, and values with a
    delimiter that closed marks protect. A cell that merely recurs is not one: rows are
    delivered twice, and lists with them.
    """
    cells = _cells(df, fields).select("field", F.trim("text").alias("item")).where("item <> ''")
    single = cells.where(F.col("item").rlike(SINGLE_VALUE))
    held = cells.where(F.col("item").rlike(r'["“(]')).mapInArrow(_protected, "field string, item string")
    return single.unionByName(held).distinct()


_CUTTERS: dict[str, dict[str, Segmenter]] = {}


def _cutters(key: str, known: Mapping[str, Sequence[str]], protects: bool) -> dict[str, Segmenter]:
    """The automata of a dictionary; a Python worker keeps the last one."""
    if key not in _CUTTERS:
        _CUTTERS.clear()
        _CUTTERS[key] = {f: Segmenter(items, protects) for f, items in known.items()}
    return _CUTTERS[key]


def _looked_up(cells: DataFrame, dictionary: DataFrame, longest: int, protects: bool) -> DataFrame:
    """``cells`` with ``_held``: the dictionary values that the text could hold, found by a join on the pieces of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, item = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = candidates(text, longest, protects)
                at.extend([i] * len(found))
                item.extend(found)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(item, pa.string())], names=["field", "text", "item"])

    texts = cells.select("field", "text").distinct()
    hits = texts.mapInArrow(run, "field string, text string, item string").join(dictionary, ["field", "item"])
    held = hits.groupBy("field", "text").agg(F.collect_set("item").alias("_held"))  # at most the pieces of one text
    return cells.join(held, ["field", "text"], "left")


def unpack_fields(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    *,
    dictionary: Mapping[str, Sequence[str]] | DataFrame | None = None,
    dictionary_protects: bool = False,
    carry: Sequence[str] = (),
    once: bool = False,
    dictionary_chars: int = DICTIONARY_CHARS,
) -> DataFrame:
    """One row per value: ``key``, the columns of ``carry``, ``field``, ``pos_no`` (from 1), ``item``, ``known`` (whether the dictionary holds it).

    ``dictionary`` is field -> values, or rows (field, item); without one it is learned from
    ``df``. With ``once`` an item that a cell repeats comes once, at its first position.

    Defined cases: null, empty and blank fields give no rows; empty values are dropped and
    not counted; values repeated in a field keep their positions; repeated or null keys are
    carried through; an empty table gives none; other columns are ignored whatever their
    names; the length of a text is not limited (one pass over it).
    """
    kept = [key, *carry]
    if len({*kept, "field", "pos_no", "item", "known"}) < len(kept) + 4:
        raise ValueError("the columns kept must have names of their own")
    spark = df.sparkSession
    if isinstance(dictionary, Mapping):
        dictionary = spark.createDataFrame([(f, v) for f, values in dictionary.items() for v in values], "field string, item string").distinct()
    dictionary = known_values(df, fields) if dictionary is None else dictionary
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)]
    cells = _cells(df, fields, *own)
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in kept], StructField("field", StringType()), StructField("pos_no", IntegerType()), StructField("item", StringType()), StructField("known", BooleanType())])
    found, shared = collect_bounded(dictionary, "item", dictionary_chars), None
    if found is not None:
        values: dict[str, list[str]] = {f: [] for f in fields}
        for row in found:
            values.setdefault(row["field"], []).append(row["item"])
        shared = spark.sparkContext.broadcast(values)
    else:
        delimiters = F.length(F.regexp_replace("item", r"[\p{L}\p{M}\p{N}\p{Zs}.\-+_':()]", ""))
        cells = _looked_up(cells, dictionary, dictionary.agg(F.max(delimiters)).first()[0], dictionary_protects)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            field_of, texts = columns["field"].to_pylist(), columns["text"].to_pylist()
            if shared is not None:
                cutters = _cutters(name, shared.value, dictionary_protects)
            else:
                held: dict[str, set[str]] = {f: set() for f in fields}
                for f, items in zip(field_of, columns["_held"].to_pylist()):
                    held[f].update(items or ())
                cutters = {f: Segmenter(items, dictionary_protects) for f, items in held.items()}
            covers: dict[tuple[str, str], tuple[list[int], list[str], list[bool]]] = {}
            at, pos, item, known_ = [], [], [], []
            for i, cell in enumerate(zip(field_of, texts)):
                found = covers.get(cell)
                if found is None:
                    values = [(p, v, k) for p, (v, k) in enumerate(cutters[cell[0]].cover(cell[1]), 1)]
                    if once:
                        first: dict[str, tuple] = {}
                        for x in values:
                            first.setdefault(x[1], x)
                        values = list(first.values())
                    found = covers[cell] = tuple(map(list, zip(*values))) if values else ([], [], [])
                at.extend([i] * len(found[0]))
                pos.extend(found[0])
                item.extend(found[1])
                known_.extend(found[2])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[columns[f"_c{i}"].take(take) for i in range(len(kept))], columns["field"].take(take), pa.array(pos, pa.int32()), pa.array(item, pa.string()), pa.array(known_, pa.bool_())], names=schema.names
            )

    return cells.mapInArrow(run, schema)
