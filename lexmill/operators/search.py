"""Search and lookup: inverted indexes, tiered suggestions, tags, derived words, glossaries, lookup payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import text as T
from lexmill.operators.rows import keep_first
from lexmill.session import broadcast_if_small

SUGGESTIONS, SHORTEST_QUERY, EXAMPLES, LONGEST_PHRASE = 15, 2, 20, 5

# Shown names of parts of speech and verb types.
POS_NAMES = {
    "NOUN": "noun",
    "PROPER_NOUN": "proper noun",
    "NOUN_PHRASE": "noun phrase",
    "VERB": "verb",
    "VERB_PHRASE": "verb phrase",
    "ADJECTIVE": "adjective",
    "PROPER_ADJECTIVE": "proper adjective",
    "ADJECTIVE_PHRASE": "adjective phrase",
    "ADVERB": "adverb",
    "VERBAL_ADVERB": "verbal adverb",
    "PHRASAL_ADVERB": "adverb phrase",
    "PRONOUN": "pronoun",
    "POSSESSIVE_PRONOUN": "possessive pronoun",
    "POSSESSIVE_ADJECTIVE": "possessive adjective",
    "PREPOSITION": "preposition",
    "PHRASAL_PREPOSITION": "phrasal preposition",
    "PREPOSITIONAL_PHRASE": "prepositional phrase",
    "POSTPOSITION": "postposition",
    "CONJUNCTION": "conjunction",
    "PHRASAL_CONJUNCTION": "phrasal conjunction",
    "CONJUNCTION_PHRASE": "conjunction phrase",
    "DETERMINER": "determiner",
    "NUMBER": "number",
    "PARTICLE": "particle",
    "INTERJECTION": "interjection",
    "PREFIX": "prefix",
    "PHRASE": "phrase",
}
VERB_NAMES = {
    "TRANSITIVE": "transitive",
    "INTRANSITIVE": "intransitive",
    "ECHO_TRANSITIVE": "echo-transitive",
    "COPULAR": "copular",
    "AUXILIARY": "auxiliary",
    "INTRANSITIVE_CU": "intransitive (-cu)",
    "FEELING": "feeling (hisi)",
    "STATE": "state (jotay)",
}


def term_index(words: DataFrame, columns: dict[str, str], word: str = "word") -> DataFrame:
    """(lang, term, word), distinct; ``columns`` maps each translation column to its language. Several columns may feed one language."""
    cells = F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.col(c).alias("text")) for c, lang in columns.items()])).alias("c")
    rows = words.select(F.col(word).alias("word"), cells).where("c.text is not null")
    return rows.select("c.lang", F.explode(T.index_terms("c.text")).alias("term"), "word").distinct()


def index_size(index: DataFrame) -> DataFrame:
    return index.groupBy("lang").agg(F.count_distinct("term").alias("terms"))


def tag_rows(words: DataFrame, tags: str, word: str = "word") -> DataFrame:
    """(tag, word), as often as a word carries a tag."""
    return words.select(F.explode(T.split_items(tags)).alias("tag"), F.col(word).alias("word"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_words(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.col("tag") == tag).select("word").orderBy("word")


def suggest(words: DataFrame, index: DataFrame, query: str, langs: Sequence[str], *, word: str = "word", order: str = "ord", limit: int = SUGGESTIONS) -> DataFrame:
    """Suggestions for what was typed: (place, word, tier).

    Tiers in order: the word itself (as typed, else in lower case); words that begin with it,
    in list order; then for each language words of that very term, and words of terms that
    begin with it. Words equal but for case come once, at their best tier; queries of fewer
    than two characters give nothing.
    """
    q = query.strip()
    low = q.lower()
    empty = words.sparkSession.createDataFrame([], "place bigint, word string, tier int")
    if len(q) < SHORTEST_QUERY:
        return empty
    own = words.select(F.col(word).alias("word"), F.col(order).cast("double").alias("_o")).where("word is not null and word <> ''")
    tiers = [own.where(F.col("word").isin(q, low)).select("word", F.lit(0).alias("tier"), F.when(F.col("word") == q, 0.0).otherwise(1.0).alias("_o"), F.lit("").alias("_t"))]
    tiers.append(own.where(F.startswith(F.lower("word"), F.lit(low))).select("word", F.lit(1).alias("tier"), "_o", F.lit("").alias("_t")))
    for i, lang in enumerate(langs):
        terms = index.where((F.col("lang") == lang) & F.startswith("term", F.lit(low)))
        tiers.append(terms.select("word", F.when(F.col("term") == low, 2 + 2 * i).otherwise(3 + 2 * i).alias("tier"), F.lit(0.0).alias("_o"), F.when(F.col("term") == low, F.lit("")).otherwise(F.col("term")).alias("_t")))
    united = tiers[0]
    for t in tiers[1:]:
        united = united.unionByName(t)
    best = united.groupBy(F.lower("word").alias("_k")).agg(F.min(F.struct("tier", "_o", "_t", "word")).alias("_b"))
    top = best.orderBy("_b").limit(limit)
    rows = top.agg(F.array_sort(F.collect_list("_b")).alias("_l")).select(F.posexplode("_l").alias("place", "_b"))  # at most ``limit`` rows
    return rows.select(F.col("place").cast("bigint").alias("place"), "_b.word", "_b.tier")


def derived_index(words: DataFrame, etymology: str, word: str = "word") -> DataFrame:
    """(part, word): the words whose etymology is purely a compound with the part."""
    parts = F.array_distinct(T.compound_parts(etymology))
    return words.select(F.explode(parts).alias("part"), F.col(word).alias("word")).where(F.lower("word") != F.col("part")).distinct()


def derived_words(index: DataFrame, word: str | Column) -> DataFrame:
    return index.where(F.col("part") == F.lower(F.lit(word) if isinstance(word, str) else word)).select("word").orderBy("word")


def point_get(table: DataFrame, key: str, word: str = "word") -> DataFrame:
    """The rows of a key, in lower case if there are none as written."""
    rows = table.where(F.col(word).isin(key, key.lower()))
    exact = rows.agg(F.max(F.when(F.col(word) == key, 1).otherwise(0)).alias("e")).scalar()
    return rows.where((F.col(word) == key) | (F.coalesce(exact, F.lit(0)) == 0))


def flagged(words: DataFrame, members: DataFrame, flag: str, word: str = "word") -> DataFrame:
    """``words`` with a boolean for membership in a set."""
    m = members.select(F.col(word)).distinct().withColumn(flag, F.lit(True))
    return words.join(m, word, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_files(words: DataFrame, files: DataFrame, flag: str, suffix: str, word: str = "word", path: str = "path") -> DataFrame:
    """``words`` with a boolean for a file named like the word in a listing of paths."""
    names = files.select(F.regexp_extract(path, r"([^/]+)\Q." + suffix + r"\E\z", 1).alias(word)).where(F.col(word) != "")
    return flagged(words, names, flag, word)


def attach(words: DataFrame, sides: dict[str, DataFrame], word: str = "word", order: str | None = None) -> DataFrame:
    """Left joins with the first row of each side table, its columns as one struct column; sides of a proven size are broadcast."""
    out = words
    for name, side in sides.items():
        rest = [c for c in side.columns if c != word]
        one = keep_first(side, [word], [order] if order and order in rest else rest).select(word, F.struct(*rest).alias(name))
        out = out.join(broadcast_if_small(one), word, "left")
    return out


def sentence_index(units: DataFrame, seg: str, order: str) -> DataFrame:
    """(token, ord, seg): each token of a sentence once."""
    tokens = F.array_distinct(T.letter_tokens(seg))
    return units.select(F.explode(tokens).alias("token"), F.col(order).alias("ord"), F.col(seg).alias("seg"))


def top_examples(index: DataFrame, words: DataFrame, word: str = "word", limit: int = EXAMPLES) -> DataFrame:
    """(word, ord, seg): the first sentences of each word.

    Sentences are ranked within 64 parts of each word first, then among what the parts kept,
    so a word that stands in a third of all sentences does not sort them in one task.
    """
    hits = index.join(words.select(F.col(word).alias("word"), F.lower(word).alias("token")).distinct(), "token").select("word", "ord", "seg")
    part = F.pmod(F.xxhash64("ord"), F.lit(64))
    local = Window.partitionBy("word", "_part").orderBy("ord", "seg")
    kept = hits.withColumn("_part", part).withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= limit)
    final = Window.partitionBy("word").orderBy("ord", "seg")
    return kept.withColumn("_n", F.row_number().over(final)).where(F.col("_n") <= limit).select("word", "ord", "seg")


def phrases(tokens: str, longest: int = LONGEST_PHRASE) -> Column:
    """Distinct runs of one to ``longest`` tokens of an array column, joined by blanks."""
    toks = F.col(tokens)
    sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: n <= F.size(toks))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " ")))))


def glossary(sentences: DataFrame, key: Sequence[str], seg: str, words: DataFrame, translation: str, word: str = "word", longest: int = LONGEST_PHRASE) -> DataFrame:
    """(key, phrase, gloss): dictionary entries among the phrases of each sentence, with their short gloss; the least gloss of repeated entries."""
    cut = sentences.select(*key, T.letter_tokens(seg).alias("_t"))  # tokens are a column, so that they are found once a sentence
    spread = cut.select(*key, F.explode(phrases("_t", longest)).alias("phrase"))
    known = words.select(F.lower(word).alias("phrase"), T.short_gloss(translation).alias("gloss")).groupBy("phrase").agg(F.min("gloss").alias("gloss"))
    return spread.join(broadcast_if_small(known), "phrase").select(*key, "phrase", "gloss")


def aligned_sentences(units: DataFrame, aligned: DataFrame, seg: str = "seg") -> DataFrame:
    """``units`` with ``alignments`` (word -> positions), joined on the sentence as the aligner writes it; the last record of equal sentences counts."""
    maps = aligned.groupBy("rec_no", "target").agg(F.map_from_entries(F.collect_list(F.struct("word", F.array_sort("positions")))).alias("alignments"))
    last = maps.groupBy(F.lower(F.trim("target")).alias("_key")).agg(F.max_by("alignments", "rec_no").alias("alignments"))
    return units.withColumn("_key", F.array_join(T.spaced_tokens(seg), " ")).join(last, "_key", "left").drop("_key")


def pos_name(pos: Column) -> Column:
    return F.coalesce(F.try_element_at(G.string_map(POS_NAMES), pos), F.lit("phrase"))


def verb_name(verb: Column) -> Column:
    return F.try_element_at(G.string_map(VERB_NAMES), verb)


def translation_groups(words: DataFrame, core: dict[str, str], extension: dict[str, str], exclude: DataFrame | None = None) -> DataFrame:
    """(word, group_no, pos, verb_type, lang, texts): translations by meaning group.

    Groups are the distinct (part of speech, verb type) of the leading language (``eng``).
    ``core`` columns (column -> name) are aligned by these two, ``extension`` columns by the
    number of the group. ``exclude`` (word, gloss) removes exact leading glosses.
    """
    key = lambda g: F.struct(pos_name(g["pos"]).alias("pos"), verb_name(g["verb_type"]).alias("verb_type"))
    entry = lambda k, lang, text, no=None: F.struct(k.alias("k"), F.lit(lang).alias("lang"), text.alias("text"), (F.lit(None).cast("int") if no is None else no).alias("no"))
    lead = F.transform("_e", lambda g: entry(key(g), "English", g["gloss"]))

    def glosses(column: str, lang: str) -> Column:
        return F.transform(G.parse_translation(column, F.col("_e"), "wordclass"), lambda g: entry(key(g), lang, T.strip_gender(g["gloss"])))

    def cells(column: str, lang: str) -> Column:
        shown = lambda x: F.concat(x["text"], F.coalesce(F.concat(F.lit(" <"), x["gender"], F.lit(">")), F.lit("")))
        groups = F.slice(T.parse_cell(column), 1, F.size("_g"))
        return F.flatten(F.transform(groups, lambda items, i: F.transform(items, lambda x: entry(F.get("_g", i), lang, shown(x), i))))

    # Every language of a word comes out of one row, so that the leading gloss is parsed once.
    parsed = words.withColumn("_e", G.parse_annotated("eng", "wordclass")).withColumn("_g", F.array_distinct(F.transform("_e", key)))
    empty = lambda a: F.coalesce(a, F.array().cast("array<struct<k:struct<pos:string,verb_type:string>,lang:string,text:string,no:int>>"))
    found = parsed.select("word", "_g", F.explode(F.concat(*map(empty, [lead, *(glosses(c, lang) for c, lang in core.items()), *(cells(c, lang) for c, lang in extension.items())]))).alias("x"))
    out = found.select("word", F.coalesce(F.col("x.no").cast("bigint"), F.array_position("_g", F.col("x.k")) - 1).alias("group_no"), "x.k.pos", "x.k.verb_type", "x.lang", "x.text").where("group_no >= 0")
    if exclude is not None:
        out = out.join(exclude.select("word", F.col("gloss").alias("text"), F.lit("English").alias("lang")), ["word", "text", "lang"], "left_anti")
    return out.groupBy("word", "group_no", "pos", "verb_type", "lang").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def lookup(words: DataFrame, key: str, sides: dict[str, DataFrame], derived: DataFrame, groups: DataFrame, examples: DataFrame) -> DataFrame:
    """One JSON document for a word: its fields, side tables, derived words, translation groups and examples; (word, payload)."""
    entry = attach(point_get(words, key), sides)
    per = lambda df, name, *cols: df.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    found = derived.where(F.col("part") == key.lower()).agg(F.array_sort(F.collect_list("word")).alias("derived"))
    out = entry.join(per(groups.join(entry.select("word").distinct(), "word", "left_semi"), "translations", "group_no", "pos", "verb_type", "lang", "texts"), "word", "left")
    out = out.join(per(examples.join(entry.select("word").distinct(), "word", "left_semi"), "examples", "ord", "seg"), "word", "left")
    lists = [T.split_items(c).alias(c) if c in ("synonyms", "antonyms", "tags") else F.col(c) for c in entry.columns]
    return out.select("word", F.to_json(F.struct(*lists, "translations", "examples", found.scalar().alias("derived"))).alias("payload"))
