"""Queries of the text operators (problems 3, 7, 8, 9) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, leakage, lookalike, pieces


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vocabulary(spark: SparkSession, sf: str) -> lookalike.Vocabulary:
    texts = _table(spark, sf, "dump_tc").select(F.col("c6").alias("t")).unionByName(_table(spark, sf, "menalari_extension").select(F.col("globasa").alias("t")))
    return lookalike.Vocabulary(lookalike.vocabulary(texts, "t"), spark)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    words = _vocabulary(spark, sf)
    found = [
        lookalike.same_look_pairs(_table(spark, sf, name), key, column, within, words).select(F.lit(name).alias("table_name"), "id_a", "id_b")
        for name, key, column, within in (("dump_tc", "row_id", "c6", ["c1", "c5"]), ("menalari_extension", "ext_id", "globasa", []))
    ]
    return found[0].unionByName(found[1])


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each text of the two columns in its one form, the class it belongs to."""
    words = _vocabulary(spark, sf)
    forms = [
        lookalike.unify(_table(spark, sf, name).select(F.col(key).alias("row_key"), F.col(column).alias("written")), "written", "form", words).select(F.lit(name).alias("table_name"), "row_key", "form")
        for name, key, column in (("dump_tc", "row_id", "c6"), ("menalari_extension", "ext_id", "globasa"))
    ]
    return forms[0].unionByName(forms[1])


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items, with the number of documents they are in."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_documents(_table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """A text over the limit is one with a second piece."""
    return p9_pieces(spark, sf).where(F.col("piece_no") == 1).select("doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_forms, p7_ids, p8_found, p8_items, p9_found, p9_pieces)}

_P8 = r"""
with dw as (select doc_id, regexp_extract_all(lower(text), '\p{L}+') as w from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower(text), '\p{L}+') as w from eval_items where text is not null),
d as (select doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12)),
i as (select item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12)),
found as (select distinct doc_id, item_id from d join i using (g))
"""

ORACLE_SQL = {
    "p8_found": _P8 + "select doc_id, item_id from found",
    "p8_items": _P8 + "select item_id, count(*) as n_documents from found group by item_id",
}
