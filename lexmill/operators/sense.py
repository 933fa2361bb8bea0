"""Alignment of words to dictionary senses, with cross-validation, inherited markings and the folded extension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import text as T

# Other parts of speech under which a gloss is looked up too; the second table
# holds only for words with one dictionary part of speech.
POS_FALLBACKS = {"noun": ["name"], "name": ["noun"], "phrase": ["particle", "adv"], "verb particle": ["adv"]}
SINGLE_POS_FALLBACKS = {"noun": ["verb"], "adj": ["adv"]}
# Virtual language = (parent language, tag, display name); further tags of varieties.
DIALECTS = {
    "de-ale": ("de", "Alemannic-German", "Alemannic"),
    "de-nds": ("de", "German-Low-German", "Low German"),
    "de-rfr": ("de", "Rhine-Franconian", "Rhine Franc."),
    "ar-egy": ("ar", "Egyptian-Arabic", "Egyptian Ar."),
    "ar-hji": ("ar", "Hijazi-Arabic", "Hijazi Ar."),
    "ar-mor": ("ar", "Moroccan-Arabic", "Moroccan Ar."),
    "ar-glf": ("ar", "Gulf-Arabic", "Gulf Ar."),
    "cmn-hok": ("cmn", "Hokkien", "Hokkien"),
    "cmn-dun": ("cmn", "Dungan", "Dungan"),
}
OTHER_VARIETIES = ["Southern-Zazaki", "Valencian", "Taraškievica", "Föhr-Amrum", "Mooring"]
VARIETY_TAGS = [tag for _, tag, _ in DIALECTS.values()] + OTHER_VARIETIES

OVERLAP = 0.5


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def pos_keys(pos: Column, single: Column) -> Column:
    """Parts of speech to look a gloss up under, in order."""
    more = F.coalesce(F.try_element_at(G.list_map(POS_FALLBACKS), pos), _strings())
    extra = F.when(single, F.coalesce(F.try_element_at(G.list_map(SINGLE_POS_FALLBACKS), pos), _strings())).otherwise(_strings())
    return F.concat(F.array(pos), more, extra)


def fallback_join(left: DataFrame, right: DataFrame, keys: Sequence[str], tries: Column, name: str, how: str = "inner") -> DataFrame:
    """Join under each of several values of one key; all hits count. ``tries`` is an array, ``name`` the key's name on the right."""
    return left.withColumn(name, F.explode(tries)).join(right, [*keys, name], how)


def misses(left: DataFrame, right: DataFrame, keys: Sequence[str], tries: Column, name: str) -> DataFrame:
    """Rows of ``left`` that no value of the key finds: a row is a hit if any of its tries is, tested by one semi-join and one anti-join."""
    with_id = left.withColumn("_row", F.struct(*left.columns))
    hit = with_id.select("_row", *keys, F.explode(tries).alias(name)).join(right.select(*keys, name).distinct(), [*keys, name], "left_semi").select("_row").distinct()
    return with_id.join(hit, with_id["_row"].eqNullSafe(hit["_row"]), "left_anti").select(*left.columns)


def variant_priority(variants: Sequence[Column], table: Column) -> Column:
    """The value of the first of several key variants that a map holds."""
    return F.coalesce(*[F.try_element_at(table, v) for v in variants])


def keep_standard(translations: DataFrame) -> DataFrame:
    """Translations that carry no tag of a variety."""
    return translations.where(~F.arrays_overlap("tags", _strings(*VARIETY_TAGS)))


def with_dialects(translations: DataFrame) -> DataFrame:
    """Standard translations under their own code, those of a dialect under its virtual code (one each if they have several)."""
    virtual = F.array_compact(F.array(*[F.when((F.col("lang") == parent) & F.array_contains("tags", tag), F.lit(code)) for code, (parent, tag, _) in DIALECTS.items()]))
    own = F.when(~F.arrays_overlap("tags", _strings(*VARIETY_TAGS)), F.array("lang")).otherwise(_strings())
    return translations.withColumn("lang", F.explode(F.concat(own, virtual)))


def display_name(code: Column, two_letter: Column, iso: Column) -> Column:
    """Name of a language code: dialect, two-letter name, ISO name, code."""
    dialect = F.try_element_at(G.string_map({c: name for c, (_, _, name) in DIALECTS.items()}), code)
    return F.coalesce(dialect, two_letter, iso, code)


def match_definitions(keys: DataFrame, senses: DataFrame) -> DataFrame:
    """For each (word, pos, sense) the dictionary sense it means: ``sense_no``, ``definition``, ``examples`` (three).

    The first sense with the key (or what follows its colon) inside a gloss; else inside a raw
    gloss; else the one with the largest share of the key's content words, the first of
    equals, if that is at least ``OVERLAP``. Keys without a match are left out.
    """
    k = keys.select("word", "pos", "sense").distinct()
    k = k.withColumn("_k", T.strip(F.lower("sense"))).where("_k <> ''")
    k = k.withColumn("_after", F.when(F.contains("_k", F.lit(":")), T.strip(F.substr("_k", F.instr("_k", ":") + 1))).otherwise(""))
    k = k.withColumn("_w", T.content_words("sense"))
    inside = lambda g: F.contains(F.lower(g), F.col("_k")) | ((F.col("_after") != "") & F.contains(F.lower(g), F.col("_after")))
    share = lambda g: F.size(F.array_intersect("_w", T.content_words(g))) / F.size("_w")
    pair = k.join(senses, ["word", "pos"])
    scored = pair.withColumn("_share", F.when(F.size("_w") > 0, F.array_max(F.transform("glosses", share))))
    tier = F.when(F.exists("glosses", inside), 1).when(F.exists("raw_glosses", inside), 2).when(F.col("_share") >= OVERLAP, 3)
    scored = scored.withColumn("_tier", tier).where("_tier is not null")
    order = F.struct("_tier", F.when(F.col("_tier") == 3, -F.col("_share")).otherwise(F.lit(0.0)), "sense_no")
    definition = F.coalesce(F.try_element_at("glosses", F.lit(-1)), F.lit(""))
    examples = F.transform(F.slice(F.coalesce("examples", F.array().cast("array<struct<text:string,english:string,type:string>>")), 1, 3), lambda e: F.coalesce(e["text"], F.lit("")))
    best = scored.groupBy("word", "pos", "sense").agg(F.min_by(F.struct("sense_no", definition.alias("definition"), examples.alias("examples")), order).alias("_b"))
    return best.select("word", "pos", "sense", "_b.*")


def validation(found: Column, known: Column) -> tuple[Column, Column, Column]:
    """Of one evidence language: whether both sides have words, whether they share one, and ``matched /unmatched/`` as text."""
    have = (F.size(found) > 0) & (F.size(known) > 0)
    matched, unmatched = F.array_sort(F.array_intersect(found, known)), F.array_sort(F.array_except(found, known))
    text = F.concat(F.array_join(matched, ", "), F.when(F.size(unmatched) > 0, F.concat(F.lit(" /"), F.array_join(unmatched, ", "), F.lit("/"))).otherwise(""))
    return have, have & (F.size(matched) > 0), F.when(have, text).otherwise("")


def crossvalidate(spa_found: Column, spa_known: Column, epo_found: Column, epo_known: Column) -> Column:
    """struct(app, spa, epo): 's' if a language has evidence and every language that has matches."""
    a, am, at = validation(spa_found, spa_known)
    b, bm, bt = validation(epo_found, epo_known)
    passed = (am | ~a) & (bm | ~b) & (a | b)
    return F.struct(F.when(passed, "s").otherwise("").alias("app"), at.alias("spa"), bt.alias("epo"))


def lookups(words: DataFrame) -> DataFrame:
    """One row for each thing to look up: of ``words`` (word, wordclass, eng, spa, epo) the glosses with their parts, clarification and evidence.

    Columns: word, group_no, wikt_pos, eng_word, clarification, original, spa_words,
    epo_words, single_pos. Words without a leading gloss and glosses without a dictionary
    part of speech have none.
    """
    parsed = words.select("word", "wordclass", "spa", "epo", G.parse_annotated("eng", "wordclass").alias("eng"))
    parsed = parsed.where(F.size("eng") > 0)
    parsed = parsed.withColumn("spa", G.parse_translation("spa", F.col("eng"), "wordclass")).withColumn("epo", G.parse_translation("epo", F.col("eng"), "wordclass"))
    distinct_pos = F.array_distinct(F.array_compact(F.transform("eng", lambda g: G.dictionary_pos(g["pos"]))))
    rows = parsed.select("word", "spa", "epo", (F.size(distinct_pos) == 1).alias("single_pos"), F.posexplode("eng").alias("group_no", "g"))
    rows = rows.withColumn("wikt_pos", G.dictionary_pos(F.col("g.pos"))).where("wikt_pos is not null")
    evidence = lambda c: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda g: g["pos"] == F.col("g.pos")), lambda g: T.expand_items(g["gloss"]))))
    rows = rows.select("word", "group_no", "wikt_pos", "single_pos", evidence("spa").alias("spa_words"), evidence("epo").alias("epo_words"), F.explode(T.split_items("g.gloss")).alias("original"))
    rows = rows.withColumn("_a", T.italic_annotation("original")).where("_a.text <> ''")
    return rows.select("word", "group_no", "wikt_pos", "single_pos", "spa_words", "epo_words", "original", F.col("_a.note").alias("clarification"), F.explode(T.expand_context("_a.text")).alias("eng_word"))


def align_senses(words: DataFrame, translations: DataFrame, senses: DataFrame, markings: DataFrame | None = None, *, spa_codes: Sequence[str] = ("es",), epo_codes: Sequence[str] = ("eo",)) -> DataFrame:
    """Per-sense rows of a word list: word, group_no, eng_word, clarification, pos, sense, definition, example1..3, app, tier, spa, epo.

    Glosses that begin with an underscore, and those that no part of speech finds, come out
    as stubs without a sense; so do words without a gloss (only the word). ``spa_codes`` and
    ``epo_codes`` are the codes of the translations that are evidence.
    """
    rows = lookups(words)
    named = rows.where(~F.startswith("eng_word", F.lit("_")))
    evidence = translations.groupBy("word", "pos", "sense").agg(*[F.array_sort(F.collect_set(F.when(F.col("lang").isin(*codes), F.col("tr_word")))).alias(name) for name, codes in (("_es", spa_codes), ("_eo", epo_codes))])
    keyed = evidence.withColumnsRenamed({"word": "eng_word"})
    hits = fallback_join(named, keyed, ["eng_word"], pos_keys(F.col("wikt_pos"), F.col("single_pos")), "pos")
    defined = match_definitions(translations, senses).withColumnsRenamed({"word": "eng_word"}).drop("sense_no")
    hits = hits.join(defined, ["eng_word", "pos", "sense"], "left")
    hits = hits.withColumn("_v", crossvalidate(F.col("_es"), F.col("spa_words"), F.col("_eo"), F.col("epo_words")))
    if markings is not None:
        own = markings.groupBy(F.col("glb").alias("word"), "pos", "sense").agg(F.map_from_entries(F.collect_list(F.struct("eng", F.struct("app", "tier")))).alias("_m"))
        hits = hits.join(own, ["word", "pos", "sense"], "left")
        variants = [F.col("eng_word"), F.col("original"), T.strip(F.regexp_replace("original", r"\(.*?\)", "")), T.strip(F.regexp_replace("original", "[()]", ""))]
        hits = hits.withColumn("_i", variant_priority(variants, F.col("_m")))
    else:
        hits = hits.withColumn("_i", F.lit(None).cast("struct<app:string,tier:string>"))
    examples = [F.coalesce(F.get("examples", i), F.lit("")).alias(f"example{i + 1}") for i in range(3)]
    full = hits.select(
        "word", "group_no", "eng_word", "clarification", "pos", "sense", F.coalesce("definition", F.lit("")).alias("definition"), *examples,
        F.when(F.col("_i").isNotNull(), F.col("_i.app")).otherwise(F.col("_v.app")).alias("app"), F.coalesce("_i.tier", F.lit("")).alias("tier"), F.col("_v.spa").alias("spa"), F.col("_v.epo").alias("epo"),
    )
    missed = misses(named, keyed, ["eng_word"], pos_keys(F.col("wikt_pos"), F.col("single_pos")), "pos").unionByName(rows.where(F.startswith("eng_word", F.lit("_"))))
    stubs = missed.select("word", "group_no", "eng_word", "clarification", F.col("wikt_pos").alias("pos"))
    bare = words.where(F.size(G.parse_annotated("eng", "wordclass")) == 0).select("word")
    return full.unionByName(stubs, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True)


def accepted(rows: DataFrame, tiers: Sequence[str] = ("v", "e")) -> DataFrame:
    """Rows that reviewers of these tiers accepted."""
    return rows.where((F.col("app") == "s") & F.col("tier").isin(*tiers))


def extension_cells(rows: DataFrame, translations: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Folded translations of accepted senses: (word, lang, cell). ``notes`` (word, lang, item, note) adds ``(_note_)`` to items."""
    keys = rows.select("word", "group_no", "eng_word", "pos", "sense").distinct()
    t = with_dialects(translations).withColumnsRenamed({"word": "eng_word"})
    found = keys.join(t, ["eng_word", "pos", "sense"])
    text = T.render_gendered("tr_word", "pos", "tags")
    if notes is not None:
        parent = F.coalesce(F.try_element_at(G.string_map({c: p for c, (p, _, _) in DIALECTS.items()}), F.col("lang")), F.col("lang"))
        found = found.withColumn("_p", parent).join(notes.select("word", F.col("lang").alias("_p"), F.col("item").alias("tr_word"), "note"), ["word", "_p", "tr_word"], "left")
        text = F.when(F.col("note").isNotNull(), F.concat(text, F.lit(" (_"), F.col("note"), F.lit("_)"))).otherwise(text)
    groups = found.groupBy("word", "lang", "group_no").agg(F.array_join(F.array_sort(F.collect_set(text)), ", ").alias("_g"))
    return groups.groupBy("word", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "_g"))), lambda g: g["_g"]), "; ").alias("cell"))


def eng_with_senses(rows: DataFrame) -> DataFrame:
    """(word, eng_with_senses): each accepted gloss with its senses as ``gloss [a|b]``."""
    per = rows.groupBy("word", "eng_word").agg(F.array_join(F.array_sort(F.collect_set("sense")), "|").alias("_s"), F.min("group_no").alias("_o"))
    item = F.concat("eng_word", F.lit(" ["), "_s", F.lit("]"))
    return per.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", item.alias("_t")))), lambda x: x["_t"]), ", ").alias("eng_with_senses"))


def extension_table(words: DataFrame, rows: DataFrame, translations: DataFrame, langs: Sequence[str], notes: DataFrame | None = None) -> DataFrame:
    """The wide table: word, eng_with_senses and one column for each of ``langs``; words without accepted senses have empty cells."""
    good = accepted(rows)
    wide = extension_cells(good, translations, notes).groupBy("word").pivot("lang", list(langs)).agg(F.first("cell"))
    return words.select("word").distinct().join(eng_with_senses(good), "word", "left").join(wide, "word", "left").na.fill("")


def fold_items(rows: DataFrame, keys: Sequence[str], item: str, cell: str) -> DataFrame:
    """The distinct items of each key, sorted and joined by comma and blank."""
    return rows.select(*keys, item).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias(cell))


def vetted_fold(rows: DataFrame, word: str, pos: str, sense: str, lang: str, item: str) -> DataFrame:
    """Accepted rows folded twice: items by (word, pos, lang), these by word and lang in the order of pos; with the word's parts of speech and senses."""
    inner = fold_items(rows, [word, pos, lang], item, "_i")
    cells = inner.groupBy(word, lang).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_i"))), lambda x: x["_i"]), "; ").alias("cell"))
    heads = rows.groupBy(word).agg(F.array_join(F.array_sort(F.collect_set(pos)), "; ").alias("pos_list"), F.array_join(F.array_sort(F.collect_set(sense)), "; ").alias("senses"))
    return cells.join(heads, word)


def word_report(dump: DataFrame, words: DataFrame) -> DataFrame:
    """Translations of some (word, pos) by sense and language, sorted and joined; the page suffix of words is dropped."""
    clean = dump.withColumn("word", F.regexp_replace("word", "/translations$", ""))
    rows = clean.join(words.select("word", "pos").distinct(), ["word", "pos"])
    return rows.groupBy("word", "pos", "sense", "lang").agg(F.array_join(F.array_sort(F.collect_set("translation")), ", ").alias("translations"))
