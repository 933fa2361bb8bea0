"""Queries of the general training-data operators (problems 1, 2, 4, 5, 6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import nested, orphans, packed, rejects, skew
from lexmill.plans import twins
from lexmill.session import table

PACKED_FIELDS = ["translationeng", "tags", "synonyms", "wordclass"]
NAMING_FIELDS = ["synonyms", "antonyms"]
HOT_SHARE = 0.02


def p1_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.load_lines(table(spark, sf, "dump_lines"), table(spark, sf, "iso_639_3"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(p1_lines(spark, sf)).select("line_id", "reason")


def p1_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.accepted(p1_lines(spark, sf))


def p1_bad_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = rejects.rejected(p1_lines(spark, sf)).where("reason = 'value'").select(F.explode("bad_cells").alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack_fields(table(spark, sf, "word_list"), "row_id", PACKED_FIELDS).drop("known")


def p2_known(spark: SparkSession, sf: str) -> DataFrame:
    """Values of each field by whether they are in its dictionary."""
    return packed.unpack_fields(table(spark, sf, "word_list"), "row_id", PACKED_FIELDS).groupBy("field", "known").agg(F.count(F.lit(1)).alias("n"))


def naming_rows(words: DataFrame) -> DataFrame:
    """Each name in the referring fields: ``row_id``, ``added_at``, ``field``, ``target``; once per row and field."""
    # The parts of a compound are quoted, which makes it a packed field like the others.
    quoted = F.transform(F.split("lexiliasel", r"\+"), lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
    compound = F.when(F.col("lexiliasel").contains("+") & ~F.col("lexiliasel").rlike("[()]"), F.array_join(quoted, ","))
    listed = words.select("row_id", "added_at", *NAMING_FIELDS, compound.alias("lexiliasel"))
    names = packed.unpack_fields(listed, "row_id", [*NAMING_FIELDS, "lexiliasel"], carry=["added_at"], once=True)
    return names.select("row_id", "added_at", "field", F.col("item").alias("target"))


def p4_orphans(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "word_list")
    valid = orphans.Validity(start="added_at", end="deleted_at", at="added_at")
    return orphans.orphan_references(naming_rows(words), words, ["target"], ["word"], match=orphans.SIMPLE, valid=valid)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_orphans(spark, sf).select("row_id", "field", "target", F.date_format("added_at", "yyyy-MM").alias("year_month"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(p4_orphans(spark, sf), "word_list", "field", "added_at")


def p4_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded lines whose (source language, headword, target language) the dump does not hold, under each match rule; the source may be missing."""
    lines = p1_loaded(spark, sf).select("line_id", F.nullif("c0", F.lit("")).alias("c0"), "c1", "c5")
    tc = table(spark, sf, "dump_tc").select("c0", "c1", "c5")
    found = [orphans.orphan_references(lines, tc, ["c0", "c1", "c5"], match=m).select("line_id", F.lit(m).alias("rule")) for m in (orphans.SIMPLE, orphans.PARTIAL, orphans.FULL)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p5_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return nested.occurrences(table(spark, sf, "raw_wiktextract"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_bridge(spark, sf).where(F.col("child") != nested.RECORD).select("rec_id", "child", "sense_no", "child_no")


def p5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct objects and occurrences of each kind."""
    return p5_bridge(spark, sf).where(F.col("child") != nested.RECORD).groupBy("child", "node_id").agg(F.count(F.lit(1)).alias("n")).groupBy("child").agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("occurrences"))


def p5_senses(spark: SparkSession, sf: str) -> DataFrame:
    t = nested.sense_table(p5_bridge(spark, sf))
    return t.select(*[F.array_join(c, "|").alias(c) for c in ("glosses", "raw_glosses", "tags")], "n_occurrences")


def p5_examples(spark: SparkSession, sf: str) -> DataFrame:
    return nested.example_table(p5_bridge(spark, sf)).drop("node_id")


def p5_translations(spark: SparkSession, sf: str) -> DataFrame:
    t = nested.translation_table(p5_bridge(spark, sf))
    return t.withColumn("tags", F.array_join("tags", "|")).drop("node_id")


def p6_headwords(spark: SparkSession, sf: str) -> DataFrame:
    """Per headword its rows, and those whose language meets the language table."""
    langs = table(spark, sf, "iso_639_3").select("id").distinct()
    return skew.eager_join_aggregate(table(spark, sf, "dump_tc"), langs, ["c5"], ["id"], by_left=["c1"], how="left")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.hot_keys(p6_headwords(spark, sf), "c1", "left_rows", HOT_SHARE).select("c1")


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p6_headwords(spark, sf).select("c1", F.col("left_rows").alias("n_rows"), F.col("met_rows").alias("n_known"))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_bad_cells, p2_found, p2_known, p4_found, p4_report, p4_lines, p5_found, p5_nodes, p5_senses, p5_examples, p5_translations, p6_found, p6_counts)}

_FIELD = r'(?:[^"\t][^\t]*|"(?:[^"]|"")*")?'
_P1 = rf"""
with line as (
  select line_id, regexp_replace(raw_line, '\r\z', '') as t from dump_lines),
split as (
  select line_id, t, t is not null and not regexp_full_match(t, '{_FIELD}(?:\t{_FIELD})*', 's') as bad_quoting,
         list_transform(regexp_extract_all(t || chr(9), '("(?:[^"]|"")*"|[^\t]*)\t', 1, 's'),
           lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as f
  from line),
judged as (
  select line_id, f, case
    when bad_quoting then 'quoting'
    when t is null or len(f) not between 7 and 11 then 'columns'
    when f[4] <> 'tr' or f[6] not in (select id from iso_639_3 where id is not null)
      or not regexp_matches(f[7], '[\p{{L}}\p{{Nd}}]') or regexp_matches(f[7], '[\p{{Cc}}\x{{FFFD}}]')
      or len(list_filter(f[8:], lambda x: not regexp_full_match(x, '|[mfncp]|(?:tr|alt|lit)=.+|sc=[A-Z][a-z]{{3}}', 's'))) > 0
    then 'value' end as reason
  from split)
"""
# Items by the rule for closed marks.
_ITEM = r"""(?:"(?:[^"]|"")*"|“[^”]*”|\((?:[^()"]|"(?:[^"]|"")*"|\([^()]*\))*\)|[\p{L}\p{M}\p{N}\p{Zs}.\-+_'':])+"""


def _items(column: str) -> str:
    return rf"""list_filter(list_transform(regexp_extract_all({column}, '{_ITEM}'), lambda x:
      trim(case when regexp_full_match(trim(x), '"(?:[^"]|"")*"', 's') then replace(trim(x)[2:-2], '""', '"')
           when regexp_full_match(trim(x), '“[^”]*”', 's') then trim(x)[2:-2] else trim(x) end)), lambda x: x <> '')"""


_P4 = f"""
with named as (
  select row_id, 'synonyms' as field, unnest({_items('synonyms')}) as target, added_at from word_list
  union select row_id, 'antonyms', unnest({_items('antonyms')}), added_at from word_list
  union select row_id, 'lexiliasel', trim(unnest(string_split(lexiliasel, '+'))), added_at from word_list
    where contains(lexiliasel, '+') and not regexp_matches(lexiliasel, '[()]')),
orphan as (
  select * from named n where target <> '' and not exists (
    select 1 from word_list w where w.word = n.target and w.added_at <= n.added_at
      and (w.deleted_at is null or w.deleted_at > n.added_at)))
"""

_ARRAY = "case json_type({0}) when 'ARRAY' then json_extract({0}, '$[*]') when 'OBJECT' then [{0}] else [] end"
_P5 = f"""
with rec as (select rec_id, raw_line::json as j from raw_wiktextract where json_valid(raw_line) and json_type(case when json_valid(raw_line) then raw_line end) = 'OBJECT'),
s0 as (select rec_id, {_ARRAY.format("json_extract(j, '$.senses')")} as m from rec),
s1 as (select rec_id, m[i] as o, i - 1 as no from (select rec_id, m, unnest(range(1, len(m) + 1)) as i from s0)),
s as (select rec_id, o, no from s1 where json_type(o) = 'OBJECT'),
e0 as (select rec_id, no, {_ARRAY.format("json_extract(o, '$.examples')")} as m from s),
t0 as (select rec_id, no, {_ARRAY.format("json_extract(o, '$.translations')")} as m from s
       union all select rec_id, -1, {_ARRAY.format("json_extract(j, '$.translations')")} from rec),
e as (select rec_id, no, m[i] as o, i - 1 as child_no from (select *, unnest(range(1, len(m) + 1)) as i from e0)),
t as (select rec_id, no, m[i] as o, i - 1 as child_no from (select *, unnest(range(1, len(m) + 1)) as i from t0))
select rec_id, 'sense' as child, no::int as sense_no, -1::int as child_no from s
union all select rec_id, 'example', no::int, child_no::int from e where json_type(o) = 'OBJECT'
union all select rec_id, 'translation', no::int, child_no::int from t where json_type(o) = 'OBJECT'
"""

_P2_ITEMS = " union all ".join(f"select '{f}' as field, unnest({_items(f)}) as item from word_list where {f} is not null" for f in PACKED_FIELDS)
_P2_CELLS = " union all ".join(f"select '{f}' as field, trim({f}) as item from word_list" for f in PACKED_FIELDS)
_P2_KNOWN = rf"""
with item as ({_P2_ITEMS}), cell as ({_P2_CELLS}),
dict as (select distinct field, item, true as known from cell where regexp_full_match(item, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Zs}}.\-+_'':]+')
  union select field, item, true from item where regexp_matches(item, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Zs}}.\-+_'':()]'))
select field, coalesce(known, false) as known, count(*) as n from item left join dict using (field, item) group by all
"""

_EXTRA = "regexp_full_match({0}, '|[mfncp]|(?:tr|alt|lit)=.+|sc=[A-Z][a-z]{{3}}', 's')"
_P1_CELLS = _P1 + rf""", cell as (
  select unnest([case when f[4] <> 'tr' then 'c3' end, case when f[6] not in (select id from iso_639_3 where id is not null) then 'c5' end,
    case when not regexp_matches(f[7], '[\p{{L}}\p{{Nd}}]') or regexp_matches(f[7], '[\p{{Cc}}\x{{FFFD}}]') then 'c6' end,
    {", ".join(f"case when len(f) > {i} and not {_EXTRA.format(f'f[{i + 1}]')} then 'c{i}' end" for i in range(7, 11))}]) as cell from judged where reason = 'value')
select cell, count(*) as n from cell where cell is not null group by cell"""

ORACLE_SQL = {
    "p1_bad_cells": _P1_CELLS,
    "p1_found": _P1 + "select line_id, reason from judged where reason is not null",
    "p1_loaded": _P1 + "select line_id, " + ", ".join(f"f[{i + 1}] as c{i}" for i in range(11)) + " from judged where reason is null",
    "p2_found": " union all ".join(
        f"select row_id, '{f}' as field, i::int as pos_no, v[i] as item from (select row_id, v, unnest(range(1, len(v) + 1)) as i from (select row_id, {_items(f)} as v from word_list where {f} is not null))" for f in PACKED_FIELDS
    ),
    "p2_known": _P2_KNOWN,
    "p4_found": _P4 + "select row_id, field, target, strftime(added_at, '%Y-%m') as year_month from orphan",
    "p4_report": _P4 + "select 'word_list' as table_name, field, strftime(added_at, '%Y-%m') as year_month, count(*) as orphans from orphan group by all",
    "p4_lines": _P1 + """, line_key as (select line_id, nullif(f[1], '') as c0, f[2] as c1, f[6] as c5 from judged where reason is null),
missing as (select *, not exists (select 1 from dump_tc d where (l.c0 is null or d.c0 = l.c0) and d.c1 = l.c1 and d.c5 = l.c5) as missing from line_key l)
select line_id, 'simple' as rule from missing where c0 is not null and missing union all select line_id, 'partial' from missing where missing union all select line_id, 'full' from missing where c0 is null or missing""",
    "p5_found": _P5,
    "p5_nodes": twins.NODES,
    "p5_senses": twins.SENSE_NODES,
    "p5_examples": twins.EXAMPLE_NODES,
    "p5_translations": twins.TRANSLATION_NODES,
    "p6_found": "select c1 from dump_tc where c1 is not null group by c1 having count(*) >= 0.02 * (select count(*) from dump_tc)",
    "p6_counts": "select c1, count(*) as n_rows, count(*) filter (where c5 in (select id from iso_639_3)) as n_known from dump_tc group by c1",
}
