"""Readers of lexical inputs into typed DataFrames.

All fields are read as strings by name with declared schemas; empty cells become null only
where ``nullValue`` says so, so that words such as ``nan`` or ``null`` survive. Readers of
files keep ``line_no`` only where the format needs it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from lexmill.functions.text import prefix_key
from lexmill.operators.rows import keep_first, keep_last
from lexmill.session import broadcast_if_small


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


DUMP = strings("src_lang", "word", "pos", "kind", "sense", "lang", "translation", "extra1", "extra2", "extra3", "extra4")
LANGUAGES = strings("Id", "Part2b", "Part2t", "Part1", "Scope", "Language_Type", "Ref_Name", "Comment")
# The lists inside senses and translations, with the type of their members.
SENSE_LISTS = {**dict.fromkeys(("glosses", "raw_glosses", "tags"), StringType()), "examples": strings("text", "english", "type")}
TRANSLATION_LISTS = {"tags": StringType()}
DICTIONARY = StructType(
    [
        *strings("word", "lang", "pos").fields,
        StructField("senses", ArrayType(StructType([StructField(n, ArrayType(k)) for n, k in SENSE_LISTS.items()]))),
        StructField("translations", ArrayType(StructType([*strings("word", "sense", "code", "romanization").fields, *[StructField(n, ArrayType(k)) for n, k in TRANSLATION_LISTS.items()]]))),
    ]
)


def csv(spark: SparkSession, path: str, schema: StructType, *, sep: str = ",", header: bool = True, quote: str = '"', multiline: bool = False) -> DataFrame:
    """Delimited text with doubled quotes; columns by the declared names."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", quote).option("escape", quote).option("nullValue", "").option("enforceSchema", False if header else True)
    return reader.option("multiLine", multiline).csv(path)


def translation_dump(spark: SparkSession, path: str) -> DataFrame:
    """A directory of ragged translation files as one table of distinct rows.

    Rows with fewer than two columns are left out. Every file begins with a copy of one data
    row; being a duplicate it disappears with the other duplicates, one copy stays.
    """
    raw = spark.read.schema(DUMP).option("sep", "\t").option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return distinct_translations(raw)


def distinct_translations(rows: DataFrame, word: str = "word") -> DataFrame:
    """Rows with a headword, each once."""
    return rows.where(F.col(word).isNotNull()).distinct()


def with_prefix(dump: DataFrame, word: str = "word") -> DataFrame:
    """The dump with its partition column ``pfx``."""
    return dump.withColumn("pfx", prefix_key(word))


def prefix_lookup(dump: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """Rows of a dump partitioned by ``pfx`` for some words; the join on ``pfx`` too lets Spark prune partitions."""
    keys = words.select(F.col(word).alias("word"), prefix_key(word).alias("pfx")).distinct()
    return dump.join(keys, ["pfx", "word"])


def _objects(listed: Column, members: StructType, lists: dict[str, DataType]) -> Column:
    """The objects of a JSON list, of whose ``lists`` each may be written as its one bare member.

    The list is read twice, with the inner lists as lists and as their one bare member; a null
    in the one reading is filled from the other.
    """
    bare = ArrayType(StructType([StructField(f.name, lists.get(f.name, f.dataType)) for f in members]))
    member = lambda a, b, n: F.coalesce(a[n], F.when(b[n].isNotNull(), F.array(b[n]))) if n in lists else a[n]
    one = lambda a, b: F.when(a.isNotNull(), F.struct(*[member(a, b, n).alias(n) for n in members.names]))
    return F.zip_with(F.from_json(listed, ArrayType(members)), F.from_json(listed, bare), one)


def parse_dictionary(lines: DataFrame, column: str = "raw_line") -> DataFrame:
    """Dictionary records from lines of JSON; lines that are broken or lack ``word`` or ``lang`` are left out.

    A list may be written as its one bare member. The steps are projections of their own, so
    that what one parses is not parsed again wherever the next refers to it.
    """
    rest = [c for c in lines.columns if c != column and c not in DICTIONARY.names]
    texts = lines.select(*rest, F.from_json(column, strings(*DICTIONARY.names), {"mode": "PERMISSIVE"}).alias("_t")).where("_t.word is not null and _t.lang is not null")
    listed = lambda t: F.when(F.startswith(F.ltrim(t), F.lit("{")), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    wrapped = texts.select(*rest, *[F.col(f"_t.{n}").alias(n) for n in ("word", "lang", "pos")], listed(F.col("_t.senses")).alias("_senses"), listed(F.col("_t.translations")).alias("_translations"))
    lists = (("senses", SENSE_LISTS), ("translations", TRANSLATION_LISTS))
    return wrapped.select(*rest, "word", "lang", "pos", *[_objects(F.col(f"_{n}"), DICTIONARY[n].dataType.elementType, inner).alias(n) for n, inner in lists])


def dictionary(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    return parse_dictionary(spark.read.text(path), column)


def translations(records: DataFrame, language: str = "English") -> DataFrame:
    """Distinct translations (word, pos, sense, lang, tr_word, romanization, tags) of one language's records.

    A translation needs a word, a sense and a code. The romanization is kept only with tags.
    """
    t = records.where(F.col("lang") == language).select("word", "pos", F.explode("translations").alias("t"))
    t = t.where("t.word is not null and t.sense is not null and t.code is not null")
    tags = F.coalesce(F.col("t.tags"), F.array().cast("array<string>"))
    return t.select(
        "word",
        "pos",
        F.col("t.sense").alias("sense"),
        F.col("t.code").alias("lang"),
        F.col("t.word").alias("tr_word"),
        F.when(F.size(tags) > 0, F.col("t.romanization")).alias("romanization"),
        tags.alias("tags"),
    ).distinct()


def senses(records: DataFrame, order: Sequence[str] = (), language: str = "English") -> DataFrame:
    """Senses (word, pos, sense_no, glosses, raw_glosses, tags, examples); numbers run over all records of a (word, pos) in order."""
    s = records.where(F.col("lang") == language).select("word", "pos", *order, F.posexplode("senses").alias("_i", "s"))
    w = Window.partitionBy("word", "pos").orderBy(*order, "_i")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(f"s.{n}"), empty).alias(n) for n in ("glosses", "raw_glosses", "tags")]
    return s.where("s is not null").select("word", "pos", (F.row_number().over(w) - 1).alias("sense_no"), *lists, F.col("s.examples").alias("examples"))


def foreign_pos(records: DataFrame, language: str = "Spanish") -> DataFrame:
    """Distinct parts of speech of another language's words."""
    return records.where(F.col("lang") == language).select("word", "pos").distinct()


def language_names(languages: DataFrame, code: str = "Id", name: str = "Ref_Name") -> DataFrame:
    """Code -> name, the first of repeated codes in the order of their names (give an order column for another)."""
    return keep_first(languages.select(F.col(code).alias("code"), F.col(name).alias("name")), ["code"], ["name"])


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object as (code, name) rows."""
    return json_pairs(spark.read.text(path, wholetext=True), "value")


def json_pairs(texts: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """The members of the JSON object in a column as (code, name) rows."""
    return texts.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("code", "name"))


def markings(rows: DataFrame, order: str) -> DataFrame:
    """Reviewers' markings (glb, eng, pos, sense, app, tier), the last row of a key wins, rows without a tier do not count.

    The older layout has a column a tier; the highest of expert, vetted, llm, script counts.
    """
    names = rows.columns
    cell = lambda c: F.nullif(F.col(c), F.lit("")) if c in names else F.lit(None).cast("string")
    text = lambda c: F.coalesce(F.col(c) if c in names else F.lit(None).cast("string"), F.lit(""))
    tier = cell("Tier") if "Tier" in names else F.coalesce(*[cell(c) for c in ("Expert?", "Vetted?", "LLM?", "Script?")])
    sense = "Wiktionary Sense (in Translations)" if "Wiktionary Sense (in Translations)" in names else "Sense"
    out = rows.select(text("Glb").alias("glb"), text("Eng").alias("eng"), text("Prt of Sp").alias("pos"), text(sense).alias("sense"), text("App?").alias("app"), tier.alias("tier"), F.col(order).alias("_o"))
    return keep_last(out.where(F.col("tier").isNotNull()), ["glb", "eng", "pos", "sense"], ["_o"]).drop("_o")


def first_existing(*paths: str) -> str | None:
    """The first path that exists, of a chain of sources."""
    return next((p for p in paths if os.path.exists(p)), None)


def newest(folder: str, prefix: str) -> str | None:
    """The file of a folder with the prefix and the greatest name."""
    names = sorted((n for n in os.listdir(folder) if n.startswith(prefix)), reverse=True) if os.path.isdir(folder) else []
    return os.path.join(folder, names[0]) if names else None


def key_value_rows(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Two-column tables as (key, value): rows with both, the last of a key wins."""
    pairs = rows.select(F.trim(key).alias("key"), F.trim(value).alias("value"), F.col(order).alias("_o")).where("key <> '' and value <> ''")
    return keep_last(pairs, ["key"], ["_o"]).drop("_o")


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """The distinct non-blank lines of a file, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def constructions(rows: DataFrame) -> DataFrame:
    """Numbered example columns as one list a word, empty ones left out."""
    pairs = F.array(*[F.struct(F.trim(f"construction{i}").alias("text"), F.trim(f"construction{i}basatayti").alias("translation")) for i in (1, 2)])
    return rows.select(F.col("Lexi").alias("word"), "to_exclude", F.filter(pairs, lambda p: F.coalesce(p["text"], F.lit("")) != "").alias("constructions"))


def unpivot_labels(rows: DataFrame, key: str) -> DataFrame:
    """A wide table of labels as (key, lang, label) without empty ones."""
    langs = [c for c in rows.columns if c != key]
    return rows.unpivot([key], langs, "lang", "label").where(F.coalesce(F.col("label"), F.lit("")) != "")


def tmx(spark: SparkSession, path: str, source: str = "glb") -> DataFrame:
    """Translation units of a TMX file: ``seg``, ``translations`` (map), ``context``; units without the source language are left out."""
    schema = "prop array<struct<_VALUE:string,_type:string>>, tuv array<struct<`_xml:lang`:string,seg:string>>"
    units = spark.read.format("xml").option("rowTag", "tu").schema(schema).load(path)
    texts = F.map_from_entries(F.array_distinct(F.transform(F.filter("tuv", lambda t: t["seg"].isNotNull()), lambda t: F.struct(t["_xml:lang"], t["seg"]))))
    context = F.get(F.filter("prop", lambda p: p["_type"] == "x-context"), 0)["_VALUE"]
    out = units.select(texts.alias("_t"), context.alias("context"))
    return out.select(F.col("_t")[source].alias("seg"), F.map_filter("_t", lambda k, v: k != source).alias("translations"), "context").where("seg is not null")


def alignment_tokens(line: Column) -> Column:
    """Source words with the positions (from 0) aligned to them, of the third line of an alignment record; NULL is left out."""
    pattern = r"(\S+)\s+\(\{\s*((?:\d+\s*)*)\}\)"
    words, places = F.regexp_extract_all(line, F.lit(pattern), 1), F.regexp_extract_all(line, F.lit(pattern), 2)
    pairs = F.zip_with(words, places, lambda w, p: F.struct(w.alias("word"), F.transform(F.filter(F.split(F.trim(p), r"\s+"), lambda x: x != ""), lambda x: x.cast("int") - 1).alias("positions")))
    return F.filter(pairs, lambda x: x["word"] != "NULL")


def alignments(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """Records of three lines (comment, target tokens, aligned source): ``rec_no``, ``target``, ``word``, ``positions``; the last of equal words in a record wins."""
    rec = lines.select(F.floor(F.col(line_no) / 3).alias("rec_no"), (F.col(line_no) % 3).alias("_k"), F.col(value).alias("_v"))
    wide = rec.groupBy("rec_no").agg(F.max(F.when(F.col("_k") == 1, F.col("_v"))).alias("target"), F.max(F.when(F.col("_k") == 2, F.col("_v"))).alias("_source"))
    flat = wide.select("rec_no", "target", F.posexplode(alignment_tokens(F.col("_source"))).alias("_i", "_w")).select("rec_no", "target", "_i", "_w.*")
    return keep_last(flat, ["rec_no", "word"], ["_i"]).select("rec_no", "target", "word", "positions")


def corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Texts in the order given: ``text_name``, ``text_order``, ``content``."""
    names = spark.createDataFrame([(os.path.basename(p), i) for i, p in enumerate(paths)], "text_name string, text_order int")
    texts = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("text_name"), F.col("value").alias("content"))
    return texts.join(broadcast_if_small(names), "text_name")


def spreadsheet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A workbook's first sheet, read on the driver through pandas where its reader is installed; else the text file of that name."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError:
        return csv(spark, os.path.splitext(path)[0] + ".tsv", schema, sep="\t")
    frame = pd.read_excel(path, dtype=str).astype(object)
    return spark.createDataFrame(frame.where(frame.notna(), None), schema)
