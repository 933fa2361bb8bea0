"""Sinks: partitioned tables, delimited text, text lines, n-gram and card files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import prefix_key


def prefix_partitioned(df: DataFrame, path: str, word: str = "word") -> None:
    """One directory for each two-letter prefix; rows of a prefix are first brought together, so that a prefix has few files."""
    df.withColumn("pfx", prefix_key(word)).repartition("pfx").write.mode("overwrite").partitionBy("pfx").parquet(path)


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables, one directory each; readers look up by key through row-group statistics, for which rows are sorted by the first column."""
    for name, df in tables.items():
        df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{path}/{name}")


def word_store(words: DataFrame, by_word: dict[str, DataFrame], others: dict[str, DataFrame], path: str, key: str = "word") -> None:
    """A store driven by the word list: rows of ``by_word`` tables for unknown words are dropped, ``others`` are kept whole."""
    known = words.select(key).distinct()
    store({"words": words} | {n: d.join(known, key, "left_semi") for n, d in by_word.items()} | others, path)


def delimited(df: DataFrame, path: str, *, sep: str = "\t", header: bool = True, order: Sequence[str] = ()) -> None:
    """Delimited text; with ``order`` globally sorted, in as many files as the data needs (names sort like rows)."""
    flat = [F.col(c) if t in ("string", "int", "bigint", "double", "boolean", "date") or t.startswith(("decimal", "timestamp")) else F.to_json(c).alias(c) for c, t in df.dtypes]
    out = df.orderBy(*order) if order else df
    out.select(*flat).write.mode("overwrite").option("sep", sep).option("header", header).option("escape", '"').csv(path)


def lines(df: DataFrame, path: str, line: str = "line", by: Sequence[str] = ()) -> None:
    """Text lines, in one directory for each value of ``by``."""
    writer = df.select(*by, line).repartition(*by).write.mode("overwrite") if by else df.select(line).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def ngrams(df: DataFrame, path: str) -> None:
    """n-gram counts, one directory an n, most frequent first."""
    df.repartition("n").sortWithinPartitions("n", F.desc("cnt"), F.desc("gram")).write.mode("overwrite").partitionBy("n").option("sep", "\t").csv(path)
