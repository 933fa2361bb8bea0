"""Deeply nested records as related flat tables (problem 5).

Method: Merkle subtree identities. Every object gets an identity bottom-up: its members are
canonicalised (names sorted, null and absent members alike, child objects replaced by their
identities) and hashed. Identical objects are stored once in the node tables; every
occurrence is kept as a bridge row with the identities of parent and child and its ordinals.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

RECORD, SENSE, EXAMPLE, TRANSLATION = "record", "sense", "example", "translation"

#: Which member of which kind of object holds a list of child objects, and of what kind.
CHILDREN = {RECORD: {"senses": SENSE, "translations": TRANSLATION}, SENSE: {"examples": EXAMPLE, "translations": TRANSLATION}}


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_SCALARS = json.JSONDecoder(parse_constant=_no_constant)
_BLANKS = re.compile(r"[ \t\n\r]*")


def _name(text: str, i: int) -> tuple[str, int]:
    """A member's name at ``i`` and where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError("no name")
    name, i = scanstring(text, i + 1, True)
    i = _BLANKS.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError("no colon")
    return name, _BLANKS.match(text, i + 1).end()


def _loads_deep(text: str) -> Any:
    """As json.loads, for any depth."""
    open_: list[tuple[Any, str | None]] = []
    i = _BLANKS.match(text).end()
    while True:
        ch = text[i : i + 1]
        if ch == "{" or ch == "[":
            value: Any = {} if ch == "{" else []
            i = _BLANKS.match(text, i + 1).end()
            if text[i : i + 1] != ("}" if ch == "{" else "]"):
                name = None
                if ch == "{":
                    name, i = _name(text, i)
                open_.append((value, name))
                continue
            i += 1
        else:
            value, i = _SCALARS.raw_decode(text, i)
        while True:
            i = _BLANKS.match(text, i).end()
            if not open_:
                if i < len(text):
                    raise ValueError("more than one value")
                return value
            holder, name = open_[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[name] = value
            ch = text[i : i + 1]
            if ch == ",":
                i = _BLANKS.match(text, i + 1).end()
                if isinstance(holder, dict):
                    name, i = _name(text, i)
                    open_[-1] = (holder, name)
                break
            if ch != ("]" if isinstance(holder, list) else "}"):
                raise ValueError("not closed")
            open_.pop()
            value, i = holder, i + 1


def _dumps_deep(value: Any) -> str:
    """Canonical text, for any depth."""
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]
    while todo:
        done, x = todo.pop()
        if done or not isinstance(x, (dict, list)):
            out.append(x if done else json.dumps(x))
            continue
        is_map = isinstance(x, dict)
        parts: list[tuple[bool, Any]] = [(True, "{" if is_map else "[")]
        for n, k in enumerate(sorted(x) if is_map else x):
            parts.append((True, ("," if n else "") + (json.dumps(k) + ":" if is_map else "")))
            parts.append((False, x[k] if is_map else k))
        todo.extend(reversed([*parts, (True, "}" if is_map else "]")]))
    return "".join(out)


def read_object(line: str | None) -> dict | None:
    """The object a line holds, however deep and with numbers of any length; None if the line is null, is not valid JSON or holds something else."""
    if line is None:
        return None
    sys.set_int_max_str_digits(0)  # longer integers are valid JSON too
    try:
        try:
            value = json.loads(line, parse_constant=_no_constant)
        except RecursionError:
            value = _loads_deep(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _identity(kind: str, members: dict[str, Any]) -> tuple[str, str]:
    own = {k: v for k, v in members.items() if v is not None}
    try:
        body = json.dumps(own, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    except RecursionError:
        body = _dumps_deep(own)
    return hashlib.blake2b(f"{kind}\n{body}".encode(), digest_size=16).hexdigest(), body


def flatten(kind: str, value: dict, occurrences: list, nodes: dict[str, tuple[str, str]], sense_no: int = -1) -> str:
    """Identity of ``value``; its child occurrences and the nodes of its subtree are added to the lists.

    An occurrence is (parent identity, child identity, child kind, sense number, child number).
    """
    own = dict(value)
    pending = []
    for member, child_kind in CHILDREN.get(kind, {}).items():
        children = own.pop(member, None)
        if isinstance(children, dict):
            children = [children]
        if not isinstance(children, list):
            if children is not None:
                own[member] = children
            continue
        identities: list[Any] = []
        for no, child in enumerate(children):
            if not isinstance(child, dict):
                identities.append(child)
                continue
            at = (no, -1) if child_kind == SENSE else (sense_no, no)
            identity = flatten(child_kind, child, occurrences, nodes, no if child_kind == SENSE else sense_no)
            identities.append("#" + identity)
            pending.append((identity, child_kind, *at))
        if identities:
            own[member] = identities
    identity, body = _identity(kind, own)
    nodes[identity] = (kind, body)
    occurrences.extend((identity, *x) for x in pending)
    return identity


def occurrences(records: DataFrame, *, key: str = "rec_id", line: str = "raw_line") -> DataFrame:
    """Bridge rows: ``key``, ``parent_id``, ``node_id``, ``child``, ``sense_no``, ``child_no``, ``body``.

    ``child`` is ``record`` (sense_no and child_no -1, no parent), ``sense``, ``example`` or
    ``translation``. Numbers are positions in the source list, from 0; translations of the
    record itself have sense_no -1, senses child_no -1. ``body`` is the canonical text of the
    node (JSON; members that were lists of objects hold the identities); it is stored once a
    batch, with the first of the occurrences there, and is null with the others.

    Defined cases: a null line, a line that is not valid JSON (NaN and Infinity are not) or
    one that holds no object gives no rows; null members and members that are no objects keep
    their position and give no row; a list written as its one bare object has position 0;
    absent, null and empty lists give no rows; repeated lines and repeated or null keys give
    their rows each; an empty table gives none; other columns are ignored whatever their names.
    """
    schema = StructType(
        [StructField(key, records.schema[key].dataType)]
        + [StructField(c, StringType()) for c in ("parent_id", "node_id", "child")]
        + [StructField(c, IntegerType()) for c in ("sense_no", "child_no")]
        + [StructField("body", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            stored: set[str] = set()
            for i, text in enumerate(batch.column(1).to_pylist()):
                value = read_object(text)
                if value is None:
                    continue
                seen: list = []
                nodes: dict[str, tuple[str, str]] = {}
                root = flatten(RECORD, value, seen, nodes)
                for parent, child, kind, s, c in [(None, root, RECORD, -1, -1), *seen]:
                    rows.append((parent, child, kind, s, c, None if child in stored else nodes[child][1]))
                    stored.add(child)
                at.extend([i] * (len(rows) - len(at)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return records.select(F.col(key), F.col(line).cast("string").alias("_line")).mapInArrow(run, schema)


def node_table(bridge: DataFrame, kind: str) -> DataFrame:
    """The distinct objects of a kind: ``node_id``, ``body``, ``n_occurrences``."""
    return bridge.where(F.col("child") == kind).groupBy("node_id").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))


def _strings(member: str) -> Column:
    # A list of strings may be written as one bare string.
    text = F.get_json_object("body", f"$.{member}")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def sense_table(bridge: DataFrame) -> DataFrame:
    """Distinct senses with their scalar lists as arrays."""
    return node_table(bridge, SENSE).select("node_id", *[_strings(m).alias(m) for m in ("glosses", "raw_glosses", "tags")], "n_occurrences")


def example_table(bridge: DataFrame) -> DataFrame:
    """Distinct examples."""
    return node_table(bridge, EXAMPLE).select("node_id", *[F.get_json_object("body", f"$.{m}").alias(m) for m in ("text", "english", "type")], "n_occurrences")


def translation_table(bridge: DataFrame) -> DataFrame:
    """Distinct translations."""
    return node_table(bridge, TRANSLATION).select("node_id", *[F.get_json_object("body", f"$.{m}").alias(m) for m in ("word", "code", "sense", "romanization")], _strings("tags").alias("tags"), "n_occurrences")
