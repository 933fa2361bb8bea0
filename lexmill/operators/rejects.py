"""Loading of ragged tab-separated lines with the rejects set apart (problem 1).

Method: the structural work is done by the Arrow CSV reader over whole batches. Every line
gets its batch index as an extra first column; the reader runs with the widest permitted
width and its invalid-row callback receives every line of another width. Lines of a
permitted smaller width are read again, one pass a width; all others are rejected. All
fields stay strings; whole column vectors are then tested, and failing cells are labelled.

The Arrow reader is lenient about text after a closing quote and about quotes that never
close, so a vectorised regular expression (linear-time engine) tests the quoting first.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FIELDS = [f"c{i}" for i in range(11)]
NARROWEST = 7

_FIELD = r'(?:[^"\t][^\t]*|"(?:[^"]|"")*")?'
QUOTING_OK = rf"\A{_FIELD}(?:\t{_FIELD})*\z"

# Fixed values of the dump format.
KIND = "tr"
EXTRA_OK = r"\A(?:|[mfncp]|(?:tr|alt|lit)=(?s:.+)|sc=[A-Z][a-z]{3})\z"
TEXT_HAS = r"[\p{L}\p{Nd}]"
TEXT_HAS_NOT = r"[\p{Cc}\x{FFFD}]"


def _spare(text: str, how_many: int) -> list[str]:
    """Private-use characters that do not occur in ``text``."""
    found, code = [], 0xF0000
    while len(found) < how_many:
        if chr(code) not in text:
            found.append(chr(code))
        code += 1
    return found


def _read(lines: list[str], width: int, refused: list[tuple[int, str]]) -> pa.Table:
    """Rows of exactly ``width`` columns; lines of another width go to ``refused``."""
    names = ["_i", *FIELDS[: width - 1]]
    data = ("\n".join(lines) + "\n").encode()

    def on_invalid(row: pacsv.InvalidRow) -> str:
        refused.append((row.actual_columns, row.text))
        return "skip"

    return pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=max(len(data) + 1, 1 << 16)),
        parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=on_invalid),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
    )


def parse_lines(lines: pa.Array) -> tuple[list[str | None], dict[str, pa.Array]]:
    """Structural parse of a batch: a reason (or None) for each line, and the fields c0..c10 in order."""
    n = len(lines)
    whole = pc.replace_substring_regex(lines.cast(pa.string()), r"\r\z", "")
    quoting = pc.fill_null(pc.match_substring_regex(whole, QUOTING_OK), True).to_pylist()
    reasons: list[str | None] = [None if ok else "quoting" for ok in quoting]
    texts = whole.to_pylist()
    todo = []
    for i, text in enumerate(texts):
        if text is None:
            reasons[i] = "columns"
        elif reasons[i] is None:
            todo.append(f"{i}\t{text}")
    joined = "".join(todo)
    spare = _spare(joined, 2) if "\n" in joined or "\r" in joined else None
    if spare:
        todo = [x.replace("\r", spare[0]).replace("\n", spare[1]) for x in todo]
    refused: list[tuple[int, str]] = []
    parts = []
    if todo:
        parts.append(_read(todo, len(FIELDS) + 1, refused))
    by_width: dict[int, list[str]] = {}
    for width, text in refused:
        text = text.rstrip("\n")
        if NARROWEST <= width - 1 < len(FIELDS):
            by_width.setdefault(width, []).append(text)
        else:
            reasons[int(text.split("\t", 1)[0])] = "columns"
    for width, again in by_width.items():
        parts.append(_read(again, width, []))
    columns: dict[str, list[str | None]] = {f: [None] * n for f in FIELDS}
    for part in parts:
        at = [int(x) for x in part.column("_i").to_pylist()]
        for f in part.column_names[1:]:
            own, values = columns[f], part.column(f).to_pylist()
            for i, value in zip(at, values):
                own[i] = value
    fields = {f: pa.array(v, pa.string()) for f, v in columns.items()}
    if spare:
        fields = {f: pc.replace_substring(pc.replace_substring(v, spare[0], "\r"), spare[1], "\n") for f, v in fields.items()}
    return reasons, fields


def failing_cells(fields: dict[str, pa.Array]) -> pa.Array:
    """Names of the cells of each row whose value is invalid, joined by commas, with empty strings for the others; c5 is tested elsewhere."""
    tests = {
        "c3": pc.not_equal(fields["c3"], KIND),
        "c6": pc.or_(pc.invert(pc.match_substring_regex(fields["c6"], TEXT_HAS)), pc.match_substring_regex(fields["c6"], TEXT_HAS_NOT)),
    }
    for f in FIELDS[NARROWEST:]:
        tests[f] = pc.invert(pc.match_substring_regex(fields[f], EXTRA_OK))
    labels = [pc.if_else(pc.fill_null(bad, False), f, "") for f, bad in tests.items()]
    return pc.binary_join_element_wise(*labels, ",")


def load_lines(lines: DataFrame, languages: DataFrame, *, id_col: str = "line_id", line_col: str = "raw_line", language_id: str = "id") -> DataFrame:
    """One row per input line: ``id_col``, ``reason`` (null where the line loads), ``bad_cells``, c0..c10.

    ``reason`` is the first that holds of ``quoting``, ``columns`` and ``value``; ``bad_cells``
    names the cells behind ``value``. c5 must be an id of ``languages``; that test is a left
    join in Spark, so the dimension may be of any size.

    Defined cases: a null line has no columns (``columns``); an empty line has one
    (``columns``); c7..c10 that are absent are null; repeated lines are kept, each under its
    own id; null or repeated ids are carried through; an empty table gives an empty table;
    other columns of ``lines``, whatever their names, are not carried over; the length of a
    line is not limited. Null ids of ``languages`` match nothing.
    """
    id_type = lines.schema[id_col].dataType
    source = lines.select(F.col(id_col).alias("_id"), F.col(line_col).cast("string").alias("_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons, fields = parse_lines(batch.column(1))
            bad = failing_cells(fields)
            loaded = pa.array([r is None for r in reasons])
            out: dict[str, pa.Array] = {"_id": batch.column(0), "_structure": pa.array(reasons, pa.string()), "_cells": pc.if_else(loaded, bad, "")}
            yield pa.RecordBatch.from_pydict(out | fields)

    schema = StructType([StructField("_id", id_type), StructField("_structure", StringType()), StructField("_cells", StringType()), *[StructField(f, StringType()) for f in FIELDS]])
    parsed = source.mapInArrow(run, schema)
    known = languages.select(F.col(language_id).alias("_lang")).where(F.col("_lang").isNotNull()).distinct()
    joined = parsed.join(known, parsed["c5"] == known["_lang"], "left")
    no_language: Column = F.col("_structure").isNull() & F.col("_lang").isNull()
    cells = F.concat_ws(",", F.when(no_language, F.lit("c5")), F.when(F.col("_cells") != "", F.col("_cells")))
    return joined.withColumn("bad_cells", F.array_sort(F.filter(F.split(cells, ","), lambda x: x != ""))).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_structure").isNotNull(), F.col("_structure")).when(F.size("bad_cells") > 0, F.lit("value")).alias("reason"),
        "bad_cells",
        *FIELDS,
    )


def rejected(loaded: DataFrame) -> DataFrame:
    """The lines set apart."""
    return loaded.where(F.col("reason").isNotNull())


def accepted(loaded: DataFrame) -> DataFrame:
    """The lines that loaded, without the columns about rejection."""
    return loaded.where(F.col("reason").isNull()).drop("reason", "bad_cells")
