"""Exports: dictionary lines, flash-card rows, page candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import script as S
from lexmill.functions import text as T

# pronoun = gender code; foreign gender marker = code; word class = tags of its groups.
PRONOUN_GENDERS = {"te": "ut", "to": "nt", "mante": "m", "femte": "f"}
FOREIGN_GENDERS = {"m": "m", "f": "f", "n": "nt"}
CLASS_TAGS = {
    "n": ["n"],
    "f": ["vblex"],
    "f.sah": ["vbmod"],
    "b": ["n", "vblex"],
    "t": ["adj", "adv"],
    "s": ["adj"],
    "p jm": ["adv"],
    "m": ["adv"],
    "su n": ["np"],
    "su t": ["adj"],
    "il": ["ij"],
    "l": ["cnjsub"],
    "num": ["num"],
    "p": ["pr"],
    "pn": ["prn"],
    "d": ["det"],
}
FUNCTION_CLASSES = ["p", "d", "l"]
NO_GENDER = "GD"


def genders(pronouns: Column) -> Column:
    """Gender codes of a pronoun list, the default code if there are none."""
    codes = F.array_compact(F.transform(T.split_items(pronouns), lambda p: F.try_element_at(G.string_map(PRONOUN_GENDERS), p)))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(NO_GENDER)))


def content_words(words: DataFrame, function_words: bool = False, classes: Sequence[str] = FUNCTION_CLASSES) -> DataFrame:
    """Words that are no affixes, of content classes or of function classes."""
    known = F.col("wordclass").isin(*classes)
    return words.where(~F.startswith("word", F.lit("-")) & (known if function_words else ~F.coalesce(known, F.lit(False))))


def last_class_in(words: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Words the last of whose classes, by its first dotted part, is in the list."""
    return words.where(G.class_key(F.element_at(F.split("wordclass", "; "), -1)).isin(*classes))


def dictionary_lines(words: DataFrame, languages: Sequence[str], pronouns: DataFrame | None = None, gendered: Sequence[str] = (), function_words: bool = False) -> DataFrame:
    """(lang, word, line): XML entries of the bilingual dictionaries, and of the monolingual one under ``mono``.

    ``words``: word, wordclass and a translation column for each of ``languages``. Group i of a
    translation belongs to the i-th tag of the word class. Nouns have an entry for each
    gender of the word; ``gendered`` languages one more for each marker of the translation.
    Other groups have no gender. Glosses that begin with an underscore are left out. Content
    words and function words (``function_words``) are exported apart.
    """
    w = content_words(words, function_words)
    if pronouns is not None:
        w = w.join(pronouns.select("word", F.col("pronoun").alias("_p")), "word", "left")
    else:
        w = w.withColumn("_p", F.lit(None).cast("string"))
    known = G.list_map(CLASS_TAGS)
    tags = F.coalesce(F.try_element_at(known, F.col("wordclass")), F.try_element_at(known, G.class_key("wordclass")))
    base = w.select("*", genders(F.col("_p")).alias("_g"), F.posexplode(tags).alias("_i", "tag"))
    left = T.xml_blanks("word")
    noun = F.col("tag").isin("n", "np")
    mono_noun = F.transform("_g", lambda g: F.concat(F.lit('<e lm="'), F.col("word"), F.lit('">       <i>'), left, F.when(g == NO_GENDER, F.lit('</i><par n="__n"/></e>')).otherwise(F.concat(F.lit('</i><par n="__n_'), g, F.lit('"/></e>')))))
    mono_other = F.array(F.concat(F.lit("<e><p><l>"), F.col("word"), F.lit("</l>       <r>"), F.col("word"), F.lit('<s n = "'), F.col("tag"), F.lit('"/></r></p></e>')))
    out = base.select(F.lit("mono").alias("lang"), "word", F.explode(F.when(noun, mono_noun).otherwise(mono_other)).alias("line"))
    mark = lambda c: F.concat(F.lit('<s n = "'), c, F.lit('"/>'))
    for lang in languages:
        groups = T.split_groups(T.strip_italic(lang))
        items = F.flatten(F.transform(F.split(F.get(groups, F.col("_i")), ", "), lambda g: F.when(noun, T.expand_parentheses(T.strip(g))).otherwise(F.array(T.strip(g)))))
        own = base.select("word", "tag", F.when(noun, F.col("_g")).otherwise(F.array(F.lit(None).cast("string"))).alias("_g"), F.explode(items).alias("item"))
        own = own.where((F.col("item") != "") & ~F.startswith("item", F.lit("_"))).select("word", "tag", F.explode("_g").alias("g"), "item")
        marked = F.regexp_extract_all("item", F.lit("<([mfn])>"), 1) if lang in gendered else F.array().cast("array<string>")
        foreign = F.when(noun & (F.size(marked) > 0), F.transform(marked, lambda m: F.try_element_at(G.string_map(FOREIGN_GENDERS), m))).otherwise(F.array(F.lit(None).cast("string")))
        own = own.withColumn("f", F.explode(foreign)) if lang in gendered else own.withColumn("f", F.lit(None).cast("string"))
        right = T.xml_blanks(F.regexp_replace("item", "<.*?>", "")) if lang in gendered else T.xml_blanks("item")
        line = F.concat(F.lit("<e><p><l>"), F.when(noun, left).otherwise(F.col("word")), mark(F.col("tag")), F.coalesce(mark(F.col("g")), F.lit("")), F.lit("</l>   <r>"), right, mark(F.col("tag")), F.coalesce(mark(F.col("f")), F.lit("")), F.lit("</r></p></e>"))
        out = out.unionByName(own.select(F.lit(lang).alias("lang"), "word", line.alias("line")))
    return out


def _slot(glosses: Column, types: Sequence[str]) -> Column:
    """The last gloss of one of the verb types, as markup."""
    found = F.filter(glosses, lambda g: (g["pos"] == "VERB") & g["verb_type"].isin(*types))
    return F.coalesce(T.bold_html(F.try_element_at(F.transform(found, lambda g: g["gloss"]), F.lit(-1))), F.lit(""))


def card_pos(pos: Column) -> Column:
    """Name of a part of speech on a card."""
    words = F.replace(F.lower(pos), F.lit("_"), F.lit(" "))
    return F.when(pos == "VERBAL_ADVERB", F.lit("Verbal-Adverb")).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))))


CARD_COLUMNS = (
    "word stressed pos1 pos2 pos3 meaning1 meaning2 meaning3 animate_adjective inanimate_adjective transitive echo_transitive intransitive copula image image_source nsfw second_image second_image_source animation animation_source "
    "anaphor antonyms example example_cloze example_translation second_example second_example_cloze second_example_translation third_example third_example_cloze third_example_translation spoken_audio spoken_codec sound sound_source sound_codec sound_label tags"
).split()


def card_rows(ranking: DataFrame, words: DataFrame, *, pronouns: DataFrame | None = None, images: DataFrame | None = None, nsfw: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """Flash-card rows in ranking order (``rank``), with the columns of ``CARD_COLUMNS``.

    ``ranking``: rank, word, example, source, english. ``words``: word, wordclass, eng, antonyms,
    tags. Words that are no dictionary entries and the sentinel entry are left out. Verbs go
    to a slot by their type, other glosses to the three meaning slots in order.
    """
    r = ranking.where(F.lower("word") != "devtest").join(words.select("word", "wordclass", "eng", "antonyms", F.col("tags").alias("_tags")), "word")
    none = F.lit(None).cast("string")
    side = lambda df, **cols: r.join(df.select("word", *[F.col(c).alias(n) for n, c in cols.items()]), "word", "left")
    r = side(pronouns, _p="pronoun") if pronouns is not None else r.withColumn("_p", none)
    r = side(images, _url="direct_url", _page="source_page") if images is not None else r.withColumns({"_url": none, "_page": none})
    r = side(exclusions, _x="to_exclude") if exclusions is not None else r.withColumn("_x", none)
    if nsfw is not None:
        r = r.join(nsfw.select("word").distinct().withColumn("_n", F.lit("y")), "word", "left")
    else:
        r = r.withColumn("_n", none)
    cut = F.when(F.coalesce("_x", F.lit("")) != "", F.btrim(F.replace("eng", F.col("_x"), F.lit("")), F.lit("; ,"))).otherwise(F.col("eng"))
    r = r.withColumn("_g", G.parse_entry(cut, "wordclass"))
    plain = F.filter("_g", lambda g: g["pos"] != "VERB")
    text = lambda c: F.coalesce(c, F.lit(""))
    gif = F.endswith("_url", F.lit(".gif"))
    people = F.split("_p", ",")
    tags = F.concat_ws(" ", F.array_join(T.normal_tags("_tags"), " "), F.replace("source", F.lit(" "), F.lit("_")))
    made = {
        "word": F.col("word"),
        "stressed": F.when(T.syllables("word") > 1, S.stress_sentence("word")).otherwise(""),
        "transitive": _slot(F.col("_g"), ["TRANSITIVE"]),
        "echo_transitive": _slot(F.col("_g"), ["ECHO_TRANSITIVE"]),
        "intransitive": _slot(F.col("_g"), ["INTRANSITIVE", "INTRANSITIVE_CU", "FEELING", "STATE"]),
        "copula": _slot(F.col("_g"), ["COPULAR"]),
        "image": text(F.when(~gif, F.col("_url"))),
        "image_source": text(F.when(~gif, F.col("_page"))),
        "nsfw": text(F.when(F.col("_url").isNotNull(), F.col("_n"))),
        "animation": text(F.when(gif, F.col("_url"))),
        "animation_source": text(F.when(gif, F.col("_page"))),
        "anaphor": text(F.get(people, 0)),
        "antonyms": text(F.col("antonyms")),
        "example": text(T.bold_html("example")),
        "example_cloze": text(T.bold_html(T.cloze("example"))),
        "example_translation": text(T.bold_html("english")),
        "tags": tags,
    }
    for i in range(3):
        made[f"pos{i + 1}"] = text(F.get(F.transform(plain, lambda g: card_pos(g["pos"])), i))
        made[f"meaning{i + 1}"] = text(T.bold_html(F.get(F.transform(plain, lambda g: g["gloss"]), i)))
    return r.select("rank", *[made.get(c, F.lit("")).alias(c) for c in CARD_COLUMNS])


def card_html(picture: Column, nsfw: Column, example: Column, translation: Column) -> Column:
    """Body of a card: picture (folded away if it is not for everyone), example, translation."""
    image = F.when(picture != "", F.concat(F.lit('<img src="'), picture, F.lit('">'))).otherwise("")
    folded = F.when((nsfw != "") & (picture != ""), F.concat(F.lit("<details><summary>NSFW</summary>"), image, F.lit("</details>"))).otherwise(image)
    return F.concat(folded, F.lit("<div>"), example, F.lit("</div><div>"), translation, F.lit("</div>"))


def page_candidates(words: DataFrame, mode: str, elements: DataFrame | None = None) -> DataFrame:
    """(word, page): words whose page is worth a look, by mode.

    ``general``: two parts of speech and one gloss in the first group; ``bio``: first class ``b``
    and a last gloss of the first group with underscores at an end; ``atomic``: one that is an
    element's name. Annotations count as plain parentheses.
    """
    plain = F.replace(F.replace("eng", F.lit("(_"), F.lit("(")), F.lit("_)"), F.lit(")"))
    glosses = T.split_items_strict(T.split_groups(plain)[0])
    classes = F.split("wordclass", "; ")
    keys = F.transform(classes, lambda c: F.when(F.startswith(c, F.lit("b.")), F.lit("b")).otherwise(c))
    n_pos = F.aggregate(keys, F.lit(0), lambda n, k: n + F.coalesce(F.size(G.class_pos(k)), F.lit(0)))
    w = words.where("eng is not null").withColumns({"_first": T.strip(glosses[0]), "_last": T.strip(F.element_at(glosses, -1))})
    if mode == "general":
        return w.where((n_pos == 2) & (F.size(glosses) == 1)).select("word", F.col("_first").alias("page"))
    if mode == "bio":
        bare = F.btrim("_last", F.lit("_"))
        return w.where((classes[0] == "b") & (bare != F.col("_last"))).select("word", bare.alias("page"))
    if mode == "atomic" and elements is not None:
        names = elements.select(F.col("element").alias("page")).distinct()
        return w.withColumn("page", F.col("_last")).join(names, "page").select("word", "page")
    raise ValueError(f"unknown mode {mode!r}")
