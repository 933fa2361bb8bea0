"""Order-aware row operators: first and last wins, resume point, runs, sections, zipped groups, prioritised sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut_lineage


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``. Aggregates with map-side combine, so a hot key is no hot task."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def resume_from(df: DataFrame, word: str, prefix: str, order: str) -> DataFrame:
    """All rows from the first one on whose word has the prefix; none if no word has it.

    The starting point is a scalar subquery that aggregates, so that nothing is sorted.
    """
    start = df.where(F.col(word).startswith(prefix)).agg(F.min(order).alias("at"))
    return df.where(F.col(order) >= start.scalar())


def skip_lines(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows up to line ``n``, the first line (a header) left out; -1 keeps all."""
    return df if n < 0 else df.where(F.col(order) < n)


def runs(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Sequence[str]) -> DataFrame:
    """``df`` with ``run_no``: consecutive rows with equal ``value`` have one number within their partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(F.struct(*value)).over(w)
    change = F.when(before.eqNullSafe(F.struct(*value)) & before.isNotNull(), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run_no", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def sections(parts: Sequence[DataFrame], order: str = "section") -> DataFrame:
    """Frames one after the other, with the number of the section each row came from."""
    out = parts[0].withColumn(order, F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn(order, F.lit(i)))
    return out


def zip_groups(df: DataFrame, key: Sequence[str], arrays: Mapping[str, Column], at: str = "group_no") -> DataFrame:
    """The i-th members of several arrays side by side, as many rows as the shortest array has."""
    shortest = F.least(*[F.size(a) for a in arrays.values()]) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
    fields = [F.slice(a, 1, F.greatest(shortest, F.lit(0))).alias(n) for n, a in arrays.items()]
    cut = df.select(*key, *fields)
    return cut.select(*key, F.posexplode(F.arrays_zip(*arrays)).alias(at, "_z")).select(*key, at, *[F.col(f"_z.{n}").alias(n) for n in arrays])


def prioritised(base: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame, str]], value: str, source: str) -> DataFrame:
    """``base`` with the value of the first source that has one for the key, and that source's name.

    Sources are (name, frame, column); one value per key counts, the least if there are more.
    They are united with their priority and reduced before one join.
    """
    parts = [d.where(F.col(c).isNotNull()).select(F.col(key), F.lit(i).alias("_p"), F.col(c).alias("_v"), F.lit(n).alias("_n")) for i, (n, d, c) in enumerate(sources)]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    best = united.groupBy(key).agg(F.min(F.struct("_p", "_v", "_n")).alias("_b"))
    return base.join(best, key, "left").withColumn(value, F.col("_b._v")).withColumn(source, F.col("_b._n")).drop("_b")


def pivot_fixed(df: DataFrame, key: Sequence[str], column: str, values: Sequence[str], cell: Column) -> DataFrame:
    """Wide table with one column for each of a fixed list of values."""
    return df.groupBy(*key).pivot(column, list(values)).agg(cell)


def blocks(df: DataFrame, order: Sequence[str], size: int, seed: str) -> DataFrame:
    """``df`` with ``block_no`` and ``place``: blocks of ``size`` in order, rows shuffled by a seeded hash within a block; the last block may be short."""
    numbered = number_rows(df, order, "_rn")
    out = numbered.withColumn("block_no", F.floor((F.col("_rn") - 1) / size))
    inside = Window.partitionBy("block_no").orderBy(F.xxhash64(F.lit(seed), "_rn"), "_rn")
    return out.withColumn("place", F.row_number().over(inside)).drop("_rn")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """``df`` with global row numbers from 1 by ``order`` (make it total with a key at its end).

    A window without partitions would sort everything in one task. Here rows are spread by
    range over many tasks and sorted there, which numbers them within their part; each
    part's rows are counted, and the counts of the parts before it are added. Only one count
    a part is gathered. The numbered rows are checkpointed, so that a repeated task cannot
    see other parts than the count did; they are shuffled and sorted once.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).withColumn("_id", F.monotonically_increasing_id()))
    # The upper bits of these ids are the part, the lower 33 the place in it.
    placed = ranged.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before") + 1).drop("_part", "_place", "_before")
