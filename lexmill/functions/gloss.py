"""The gloss mini-language as Column expressions.

A gloss text has groups (``n: house, home; v.tr: shelter``). A group may begin with an
annotation that says part of speech, verb type and affix type; the word class of the entry
refines or replaces it. Parsed glosses are arrays of
``struct<gloss, pos, verb_type, qualifier, affix_type>``.

The tables are data: they may be replaced by tables of another language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import ColumnLike, _c, expand_context, let, split_groups, strip

Annotations = dict[str, list[tuple[str, str | None, str | None]]]

GLOSS = "struct<gloss:string,pos:string,verb_type:string,qualifier:string,affix_type:string>"

# Annotation -> (part of speech, verb type, affix type), several where it stands for several.
ANNOTATIONS = {
    "n": [("NOUN", None, None)],
    "n phrs": [("NOUN_PHRASE", None, None)],
    "n sfx": [("NOUN", None, "SUFFIX")],
    "v.tr": [("VERB", "TRANSITIVE", None)],
    "v.intr": [("VERB", "INTRANSITIVE", None)],
    "v.intr (optional -cu)": [("VERB", "INTRANSITIVE_CU", None)],
    "v.cop": [("VERB", "COPULAR", None)],
    "v.aux": [("VERB", "AUXILIARY", None)],
    "v phrs": [("VERB_PHRASE", None, None)],
    "v.tr sfx": [("VERB", "TRANSITIVE", "SUFFIX")],
    "n/v.tr sfx": [("NOUN", None, "SUFFIX"), ("VERB", "TRANSITIVE", "SUFFIX")],
    "n/v.intr sfx": [("NOUN", None, "SUFFIX"), ("VERB", "INTRANSITIVE", "SUFFIX")],
    "adj/adv sfx": [("ADJECTIVE", None, "SUFFIX"), ("VERBAL_ADVERB", None, "SUFFIX")],
    "adj": [("ADJECTIVE", None, None)],
    "adj phrs": [("ADJECTIVE_PHRASE", None, None)],
    "adj sfx": [("ADJECTIVE", None, "SUFFIX")],
    "adv": [("ADVERB", None, None)],
    "adv phrs": [("PHRASAL_ADVERB", None, None)],
    "adv sfx": [("ADVERB", None, "SUFFIX")],
    "m": [("ADVERB", None, None)],
    "interj": [("INTERJECTION", None, None)],
    "prep": [("PREPOSITION", None, None)],
    "prep phrs": [("PHRASAL_PREPOSITION", None, None)],
    "prep phrase": [("PREPOSITIONAL_PHRASE", None, None)],
    "conj": [("CONJUNCTION", None, None)],
    "conj phrs": [("PHRASAL_CONJUNCTION", None, None)],
    "cop plus prep": [("VERB", "COPULAR", None)],
    "det": [("DETERMINER", None, None)],
    "pron": [("PRONOUN", None, None)],
    "num": [("NUMBER", None, None)],
    "par": [("PARTICLE", None, None)],
    "prop n": [("PROPER_NOUN", None, None)],
    "prop adj": [("PROPER_ADJECTIVE", None, None)],
    "poss pron": [("POSSESSIVE_PRONOUN", None, None)],
    "poss adj": [("POSSESSIVE_ADJECTIVE", None, None)],
    "pfx": [("PREFIX", None, "PREFIX")],
    "root pfx": [("PREFIX", None, "PREFIX")],
    "bound root": [("PREFIX", None, "PREFIX")],
    "root sfx (attached to nouns)": [("NOUN", None, "SUFFIX")],
    "phrs": [("PHRASE", None, None)],
}
TRANSLATION_ANNOTATIONS = {
    "s": [("NOUN", None, None)],
    "v.tr": [("VERB", "TRANSITIVE", None)],
    "v.ntr": [("VERB", "INTRANSITIVE", None)],
    "tr": [("VERB", "TRANSITIVE", None)],
    "intr": [("VERB", "INTRANSITIVE", None)],
    "adj": [("ADJECTIVE", None, None)],
    "adv": [("ADVERB", None, None)],
    "interj": [("INTERJECTION", None, None)],
    "prop n": [("PROPER_NOUN", None, None)],
}
# Word class -> parts of speech in order.
WORD_CLASSES = {
    "n": ["NOUN"],
    "f": ["VERB"],
    "f.sah": ["VERB"],
    "f.oro": ["VERB", "VERB"],
    "f.lin": ["VERB"],
    "b": ["NOUN", "VERB"],
    "b.oj": ["NOUN", "VERB"],
    "b.oj.ru": ["NOUN", "VERB"],
    "b.nenoj": ["NOUN", "VERB"],
    "b.lin": ["NOUN", "VERB"],
    "b.oro": ["NOUN", "VERB", "VERB"],
    "b.oro.hisi": ["NOUN", "VERB", "VERB"],
    "b.oro.jotay": ["NOUN", "VERB", "VERB"],
    "b.oro.harka": ["NOUN", "VERB", "VERB"],
    "t": ["ADJECTIVE", "VERBAL_ADVERB"],
    "s": ["ADJECTIVE"],
    "m": ["ADVERB"],
    "p jm": ["PREPOSITIONAL_PHRASE"],
    "n jm": ["NOUN_PHRASE"],
    "t jm": ["ADJECTIVE_PHRASE"],
    "m jm": ["PHRASAL_ADVERB"],
    "s jm": ["ADJECTIVE_PHRASE"],
    "lfik": ["PREFIX"],
    "xfik": ["NOUN"],
    "b xfik": ["NOUN", "VERB"],
    "b.oj xfik": ["NOUN", "VERB"],
    "b.nenoj xfik": ["NOUN", "VERB"],
    "m xfik": ["ADVERB"],
    "t xfik": ["ADJECTIVE", "VERBAL_ADVERB"],
    "su n": ["PROPER_NOUN"],
    "su t": ["PROPER_ADJECTIVE"],
    "su s": ["POSSESSIVE_ADJECTIVE"],
    "su pn": ["POSSESSIVE_PRONOUN"],
    "il": ["INTERJECTION"],
    "l": ["CONJUNCTION"],
    "num": ["NUMBER"],
    "p": ["PREPOSITION"],
    "xp": ["POSTPOSITION"],
    "pn": ["PRONOUN"],
    "jm p": ["PHRASAL_PREPOSITION"],
    "jm l": ["PHRASAL_CONJUNCTION"],
    "jm t": ["PHRASAL_ADVERB"],
    "f jm": ["VERB_PHRASE"],
    "l jm": ["CONJUNCTION_PHRASE"],
    "jm": ["PHRASE"],
    "d": ["DETERMINER"],
    "par": ["PARTICLE"],
    "f par": ["PARTICLE"],
    "b; il": ["NOUN", "INTERJECTION"],
    "b.oj; il": ["NOUN", "VERB", "INTERJECTION"],
    "b.oj.ru; il": ["NOUN", "VERB", "INTERJECTION"],
    "b.nenoj; il": ["NOUN", "VERB", "INTERJECTION"],
    "b.oro.hisi; il": ["NOUN", "VERB", "VERB", "INTERJECTION"],
    "b.oj; b.nenoj.p": ["NOUN", "VERB", "VERB"],
    "b.oj.ru; b.nenoj.p": ["NOUN", "VERB", "VERB"],
    "t; f.sah": ["ADJECTIVE", "VERBAL_ADVERB", "VERB"],
    "t; il": ["ADJECTIVE", "VERBAL_ADVERB", "INTERJECTION"],
    "d; m": ["DETERMINER", "ADVERB"],
    "num; d": ["NUMBER", "DETERMINER"],
    "p; lfik": ["PREPOSITION", "PREFIX"],
    "tabl: pn": ["PRONOUN"],
    "tabl: m": ["ADVERB"],
    "tabl: d": ["DETERMINER"],
    "tabl: t": ["ADJECTIVE", "VERBAL_ADVERB"],
    "tabl: l": ["CONJUNCTION"],
    "tabl: su s": ["POSSESSIVE_ADJECTIVE"],
    "tabl: d; m": ["DETERMINER", "ADVERB"],
    "tabl: m; l": ["ADVERB", "CONJUNCTION"],
    "tabl: num; d": ["NUMBER", "DETERMINER"],
    "nenhuru genu": ["PREFIX"],
}
# Part of a word class -> verb type.
VERB_CLASSES = {
    "nenoj": "INTRANSITIVE",
    "oj": "TRANSITIVE",
    "lin": "COPULAR",
    "ru": "ECHO_TRANSITIVE",
    "sah": "AUXILIARY",
    "hisi": "FEELING",
    "jotay": "STATE",
    "harka": "INTRANSITIVE_CU",
}
# Part of speech -> name in the sense dictionary; others have none.
DICTIONARY_POS = {
    "NOUN": "noun",
    "PROPER_NOUN": "name",
    "VERB": "verb",
    "ADJECTIVE": "adj",
    "PROPER_ADJECTIVE": "adj",
    "VERBAL_ADVERB": "adv",
    "ADVERB": "adv",
    "PHRASAL_ADVERB": "adv",
    "INTERJECTION": "intj",
    "PRONOUN": "pron",
    "POSSESSIVE_PRONOUN": "pron",
    "NUMBER": "num",
    "PREPOSITION": "prep",
    "PHRASAL_PREPOSITION": "prep_phrase",
    "PREPOSITIONAL_PHRASE": "prep_phrase",
    "CONJUNCTION": "conj",
    "DETERMINER": "det",
    "PARTICLE": "particle",
    "PREFIX": "prefix",
    "POSSESSIVE_ADJECTIVE": "adj",
    "PHRASE": "phrase",
}


def string_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def list_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _entry_map(table: Annotations) -> Column:
    value = lambda x: F.lit(x).cast("string")
    entry = lambda e: F.struct(*[value(x).alias(n) for x, n in zip(e, ("pos", "verb_type", "affix_type"))])
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(entry, v)))])


def _look(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def annotation(segment: ColumnLike, table: Annotations = ANNOTATIONS) -> Column:
    """struct(prefix, gloss, qualifier) of one group; prefix is null where no annotation is known.

    The longest known annotation before a colon counts; failing that a known annotation
    followed by a qualifier in parentheses and a colon.
    """
    keys = sorted(table, key=len, reverse=True)
    exact = "^(" + "|".join(map(re.escape, keys)) + "):"
    qualified = [r"^([a-z][a-z./]*)\s*\(([^)]+)\)\s*:", r"^([a-z][a-z./ ]+?)\s*\(([^)]+)\)\s*:"]
    none = F.lit(None).cast("string")

    def named(prefix: Column, gloss: Column, qualifier: Column) -> Column:
        return F.named_struct(F.lit("prefix"), prefix, F.lit("gloss"), strip(gloss), F.lit("qualifier"), qualifier)

    def base(low: Column) -> Column:
        return F.coalesce(*[F.when(F.regexp_extract(low, p, 1).isin(*keys), F.named_struct(F.lit("base"), F.regexp_extract(low, p, 1), F.lit("qualifier"), strip(F.regexp_extract(low, p, 2)))) for p in qualified])

    def read(s: Column) -> Column:
        parts = F.named_struct(F.lit("known"), F.regexp_extract(F.lower(s), exact, 1), F.lit("base"), base(F.lower(s)))
        return let(
            parts,
            lambda p: F.when(
                p["known"] != "",
                named(p["known"], F.substr(s, F.length(p["known"]) + 2), F.nullif(F.regexp_extract(p["known"], r"\(([^)]+)\)", 1), F.lit(""))),
            )
            .when(p["base"].isNotNull(), named(p["base"]["base"], F.substr(s, F.instr(s, ":") + 1), p["base"]["qualifier"]))
            .otherwise(named(none, s, none)),
        )

    return let(strip(segment), read)


def verb_class(word_class: ColumnLike) -> Column:
    """Verb type of the last part of a word class that has one."""
    parts = F.transform(F.split(F.replace(_c(word_class), F.lit(";"), F.lit(".")), r"\."), strip)
    found = F.filter(F.reverse(parts), lambda p: p.isin(*VERB_CLASSES))
    return _look(string_map(VERB_CLASSES), F.get(found, 0))


def refine(verb_type: Column, word_class: ColumnLike) -> Column:
    """Verb type of an annotation as the word class narrows it."""
    own = verb_class(word_class)
    return (
        F.when((verb_type == "INTRANSITIVE") & own.isin("FEELING", "STATE"), own)
        .when((verb_type == "TRANSITIVE") & _c(word_class).contains(".ru"), F.lit("ECHO_TRANSITIVE"))
        .otherwise(verb_type)
    )


def class_pos(word_class: ColumnLike) -> Column:
    """Parts of speech of a word class; null if the class is unknown."""
    return _look(list_map(WORD_CLASSES), _c(word_class))


def _gloss(gloss: Column, pos: Column, verb: Column | None = None, qualifier: Column | None = None, affix: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    values = {"gloss": gloss, "pos": pos, "verb_type": verb, "qualifier": qualifier, "affix_type": affix}
    return F.named_struct(*[x for name, v in values.items() for x in (F.lit(name), none if v is None else v)])


def _by_class(gloss: Column, place: Column, pos: Column) -> Column:
    """A gloss with the part of speech its place has in the class, the last beyond it, PHRASE without a class."""
    return _gloss(gloss, F.when(pos.isNull(), F.lit("PHRASE")).otherwise(F.element_at(pos, F.least(place + 1, F.size(pos)))))


def parse_annotated(text: ColumnLike, word_class: ColumnLike) -> Column:
    """Parsed glosses of the leading language.

    Annotated groups give one gloss for each part of speech and each context variant. A group
    without an annotation takes the part of speech at the place the output has reached, which
    is why the groups are folded in order.
    """
    cls = _c(word_class)
    pos = class_pos(cls)
    table = _entry_map(ANNOTATIONS)

    def read(a: Column) -> Column:
        return F.named_struct(F.lit("gloss"), a["gloss"], F.lit("qualifier"), a["qualifier"], F.lit("entries"), _look(table, a["prefix"]), F.lit("variants"), expand_context(a["gloss"]))

    def step(done: Column, seg: Column) -> Column:
        annotated = F.flatten(F.transform(seg["entries"], lambda e: F.transform(seg["variants"], lambda g: _gloss(g, e["pos"], refine(e["verb_type"], cls), seg["qualifier"], e["affix_type"]))))
        plain = F.array(_by_class(seg["gloss"], F.size(done), pos))
        return F.concat(done, F.when(seg["entries"].isNotNull(), annotated).otherwise(plain)).cast(f"array<{GLOSS}>")

    empty = F.array().cast(f"array<{GLOSS}>")
    parsed = F.aggregate(F.transform(F.transform(split_groups(text), lambda g: annotation(g)), read), empty, step)
    return F.when(F.coalesce(strip(text), F.lit("")) == "", empty).otherwise(parsed)


def alignment(glosses: Column) -> Column:
    """The first gloss of each (part of speech, verb type, affix type), in order."""
    key = lambda g: F.concat_ws("/", g["pos"], F.coalesce(g["verb_type"], F.lit("-")), F.coalesce(g["affix_type"], F.lit("-")))
    return let(F.transform(glosses, key), lambda keys: F.filter(glosses, lambda g, i: F.array_position(keys, key(g)) == i + 1))


def parse_translation(text: ColumnLike, leading: Column, word_class: ColumnLike) -> Column:
    """Parsed glosses of another language: by its own annotation, else by the place in the leading language, else by the word class."""
    table = _entry_map(TRANSLATION_ANNOTATIONS)
    pos = class_pos(word_class)
    empty = F.array().cast(f"array<{GLOSS}>")

    def read(aligned: Column, a: Column, i: Column) -> Column:
        # Without an annotation the gloss is the whole group.
        entries, s, lead = _look(table, a["prefix"]), a["gloss"], F.get(aligned, i)
        own = F.transform(entries, lambda e: _gloss(s, e["pos"], e["verb_type"], a["qualifier"], e["affix_type"]))
        placed = F.array(_gloss(s, lead["pos"], lead["verb_type"], lead["qualifier"], lead["affix_type"]))
        return F.when(entries.isNotNull(), own).when(s == "", empty).when(i < F.size(aligned), placed).otherwise(F.array(_by_class(s, i, pos)))

    groups = F.transform(split_groups(text), lambda g: annotation(g, TRANSLATION_ANNOTATIONS))
    parsed = let(alignment(leading), lambda aligned: F.flatten(F.transform(groups, lambda a, i: read(aligned, a, i))))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", empty).otherwise(parsed)


def default_pos(word_class: ColumnLike) -> Column:
    """struct(pos, verb_type) of an entry known by its word class only."""
    cls, pos = _c(word_class), class_pos(word_class)
    out = lambda p, v=None: F.struct((F.lit(p) if isinstance(p, str) else p).alias("pos"), (F.lit(v).cast("string") if not isinstance(v, Column) else v).alias("verb_type"))
    return (
        F.when(cls == "b", out("NOUN"))
        .when((cls == "t") | cls.startswith("tabl: t"), out("ADJECTIVE"))
        .when(cls.startswith("b.") | cls.startswith("f."), out("VERB", F.coalesce(verb_class(cls), F.lit("TRANSITIVE"))))
        .when(pos.isNotNull(), out(pos[0]))
        .otherwise(out("PHRASE"))
    )


def _without(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def parse_legacy(text: ColumnLike, word_class: ColumnLike) -> Column:
    """Parsed glosses of entries in the older notation (``tr:``, ``intr:``, ``tr/intr (optional -cu):``)."""
    groups, classes = split_groups(text), F.split(_c(word_class), "; ")
    n = F.size(groups)
    known = list_map(WORD_CLASSES)
    dotted = lambda p: p.startswith("b.") | p.startswith("f.")

    def class_list(p: Column) -> Column:
        key = F.when(p.isin("b.oro", "f.oro"), p).when(dotted(p), F.substring(p, 1, 1)).otherwise(p)
        return F.when((key == "b") & (n == F.size(classes)), F.array(F.lit("NOUN"))).otherwise(F.coalesce(_look(known, key), F.array().cast("array<string>")))

    pos = F.flatten(F.transform(classes, class_list))
    verbal = F.filter(classes, dotted)
    way = F.coalesce(F.element_at(F.split(F.try_element_at(verbal, F.lit(-1)), r"\."), -1), F.lit(""))
    empty = F.array().cast(f"array<{GLOSS}>")
    verb = lambda g, v: _gloss(g, F.lit("VERB"), F.lit(v) if isinstance(v, str) else v)
    both = lambda g, p, v: F.array(verb(_without(g, p), v), verb(_without(g, p), "TRANSITIVE"))
    cu = "tr/intr (optional -cu):"
    g0 = groups[0]
    single = (
        F.when(way == "oj", F.array(verb(_without(g0, "tr: "), "TRANSITIVE")))
        .when(way == "nenoj", F.array(verb(_without(g0, "intr (optional -cu): "), "INTRANSITIVE_CU")))
        .when(way == "oro", F.when(g0.contains(cu), both(g0, cu, "INTRANSITIVE_CU")).otherwise(empty))
        .when(way == "lin", F.array(verb(g0, "COPULAR")))
        .when(way == "ru", F.array(verb(g0, "ECHO_TRANSITIVE")))
        .when(F.size(pos) > 0, F.array(_gloss(g0, F.get(pos, 0))))
        .otherwise(empty)
    )
    types = string_map(VERB_CLASSES)

    def read(g: Column, i: Column) -> Column:
        own = F.get(pos, F.least(i, F.size(pos) - 1))
        mixed = (
            F.when(g.contains("tr:") & ~g.contains("intr:"), F.array(verb(_without(g, "tr: "), "TRANSITIVE")))
            .when(g.contains(cu), both(g, cu, "INTRANSITIVE_CU"))
            .when(g.contains("tr/intr:"), both(g, "tr/intr:", "INTRANSITIVE"))
            .when(g.contains("intr (optional -cu): "), F.array(verb(_without(g, "intr (optional -cu): "), "INTRANSITIVE_CU")))
            .when(g.contains("intr: "), F.array(verb(_without(g, "intr: "), "INTRANSITIVE")))
            .otherwise(empty)
        )
        typed = _look(types, way)
        return (
            F.when((g == "") | ((way == "") & (i >= F.size(pos))), empty)
            .when((i < F.size(pos)) & (F.get(pos, i) == "VERB"), F.when(way == "oro", mixed).when(typed.isNotNull(), F.array(verb(g, typed))).otherwise(empty))
            .otherwise(F.array(_gloss(g, F.coalesce(own, F.lit("PHRASE")))))
        )

    return F.when(n == 1, single).otherwise(F.flatten(F.transform(groups, read)))


def parse_entry(text: ColumnLike, word_class: ColumnLike) -> Column:
    """Parsed glosses in either notation; the first group tells which."""
    annotated = annotation(split_groups(text)[0])["prefix"].isNotNull()
    empty = F.array().cast(f"array<{GLOSS}>")
    return F.when(F.coalesce(strip(text), F.lit("")) == "", empty).when(annotated, parse_annotated(text, word_class)).otherwise(parse_legacy(text, word_class))


def dictionary_pos(pos: ColumnLike) -> Column:
    """Name of a part of speech in the sense dictionary; null if it has none."""
    return _look(string_map(DICTIONARY_POS), _c(pos))


def class_key(word_class: ColumnLike) -> Column:
    """First dotted part of a word class."""
    return F.substring_index(_c(word_class), ".", 1)
