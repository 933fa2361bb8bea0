"""References to records that do not exist (problem 4).

Method: composite keys with partial nulls. References are grouped by their null mask; each
mask is checked by one anti-join on its non-null columns under the declared match semantics.

Where a reference only holds at a time (``valid``), the anti-join asks for a span of validity
of that key around that time. The target rows are merged to disjoint spans first, so that a
key has a span more only where it was gone for a while. They are merged within minutes, what
is left within days, and what is left of these by key: a key that holds a third of all rows
is spread over its minutes and days, and each step hands on one span where spans touch. The
references, one row each, go through one shuffle; the anti-join keeps them as its streamed
side, which adaptive execution splits where one key holds many of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMPLE, PARTIAL, FULL = "simple", "partial", "full"


@dataclass(frozen=True)
class Validity:
    """Names of the columns that say when a target row is in force, and when a reference is made."""

    start: str
    end: str
    at: str


_FAR = "9999-12-31 23:59:59.999999"

#: Periods within which spans are merged before they are merged by key.
PERIODS = ("minute", "day")


def _has_mask(keys: Sequence[str], mask: int) -> Column:
    """Whether exactly the columns of a null mask are null."""
    return reduce(and_, [F.col(key).isNull() if mask >> k & 1 else F.col(key).isNotNull() for k, key in enumerate(keys)])


def spans(targets: DataFrame, keys: Sequence[str], valid: Validity) -> DataFrame:
    """Disjoint spans of validity of each key: ``_k0``, ..., ``_from`` (included), ``_to`` (not included).

    Rows with a null in the key, without a start, or whose end is not after their start
    give none; rows without an end are valid for ever.
    """
    parts = [f"_k{k}" for k in range(len(keys))]
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    rows = targets.select(*[F.col(c).alias(p) for c, p in zip(keys, parts)], stamp(valid.start).alias("_from"), F.coalesce(stamp(valid.end), F.to_timestamp_ntz(F.lit(_FAR))).alias("_to"))
    rows = rows.where(F.expr(" and ".join(f"{p} is not null" for p in parts)) & (F.col("_from") < F.col("_to")))
    # Of rows that start together only the latest end matters; repeated deliveries combine before the shuffle.
    rows = rows.groupBy(*parts, "_from").agg(F.max("_to").alias("_to"))
    for period in (*PERIODS, None):
        rows = rows.withColumn("_period", F.date_trunc(period, "_from")) if period else rows
        group = [*parts, "_period"] if period else parts
        order = Window.partitionBy(*group).orderBy("_from")
        reached = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
        begun = rows.withColumn("_new", F.when(reached >= F.col("_from"), 0).otherwise(1))
        numbered = begun.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rows = numbered.groupBy(*group, "_no").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).select(*parts, "_from", "_to")
    return rows


def _missing(refs: DataFrame, targets: DataFrame, keys: list[str], target_keys: list[str], valid: Validity | None) -> DataFrame:
    """The anti-join of one null mask."""
    if valid is None:
        there = targets.select(*[F.col(t).alias(f"_k{k}") for k, t in enumerate(target_keys)]).distinct()
    else:
        there = spans(targets, target_keys, valid)
    met = [refs[key] == there[f"_k{k}"] for k, key in enumerate(keys)]
    if valid is not None:
        at = refs[valid.at].cast("timestamp_ntz")
        met += [there["_from"] <= at, at < there["_to"]]
    return refs.join(there, met, "left_anti")


def orphan_references(refs: DataFrame, targets: DataFrame, keys: Sequence[str], target_keys: Sequence[str] | None = None, *, match: str = SIMPLE, valid: Validity | None = None) -> DataFrame:
    """The rows of ``refs`` whose key no row of ``targets`` answers to, with their columns as they are.

    ``match`` is the SQL match rule for keys with nulls: ``simple`` - a key with any null is
    no reference; ``partial`` - the non-null columns must be met by one target row, a key of
    nulls only is no reference; ``full`` - a key of nulls only is no reference, one with some
    nulls is an orphan. With ``valid`` a target answers only if its start is not after the
    reference's time and its end is null or after that time; a reference without a time is
    an orphan, and a target without a start answers nothing.

    Defined cases: repeated references are each reported; repeated targets count once; with
    empty ``targets`` all references are orphans, with empty ``refs`` there are none; target
    columns named like reference columns do not clash, as only the keys and times are taken;
    empty strings are ordinary values; texts may be of any length.
    """
    keys, target_keys = list(keys), list(target_keys or keys)
    if match not in (SIMPLE, PARTIAL, FULL):
        raise ValueError(f"unknown match rule {match!r}")
    all_null = (1 << len(keys)) - 1
    masks = range(all_null) if match == PARTIAL else [0]  # bit k of a mask: column k is null
    found = []
    for mask in masks:
        at = [k for k in range(len(keys)) if not mask >> k & 1]
        own = refs.where(_has_mask(keys, mask))
        found.append(_missing(own, targets, [keys[k] for k in at], [target_keys[k] for k in at], valid))
    if match == FULL:
        found += [refs.where(_has_mask(keys, mask)) for mask in range(1, all_null)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def orphan_report(orphans: DataFrame, table_name: str, field: str, at: str) -> DataFrame:
    """Counts of orphans: ``table_name``, ``field``, ``year_month`` (null without a time), ``orphans``."""
    return orphans.groupBy(F.lit(table_name).alias("table_name"), F.col(field).alias("field"), F.date_format(F.col(at), "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("orphans"))
