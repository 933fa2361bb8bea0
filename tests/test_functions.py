"""Golden vectors of the Column functions."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import script as S
from lexmill.functions import text as T


@pytest.fixture(scope="module")
def ev(spark):
    def run(fn, *values):
        df = spark.range(1).select(*[F.lit(v).alias(f"a{i}") for i, v in enumerate(values)])
        return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]

    return run


def test_context_and_annotations(ev):
    assert ev(T.expand_context, "(have a particular) smell") == ["smell", "have a particular smell"]
    assert ev(T.expand_context, "sourdough (bread)") == ["sourdough", "sourdough bread"]
    assert ev(T.expand_context, "(_note_) x") == ["(_note_) x"]
    assert ev(T.annotation_map, "absurdidad (_dicho o hecho absurdo_), ridiculez") == {"absurdidad": "dicho o hecho absurdo"}
    assert ev(T.expand_parentheses, "a (b) c") == ["a  c", "a b c"]
    assert tuple(ev(T.italic_annotation, "x (_a_) y (_b_)")) == ("x  y", "a, b")


def test_cells_and_folds(ev):
    groups = ev(T.parse_cell, "Haus <n>, Heim <n>; wohnen")
    assert [[tuple(i) for i in g] for g in groups] == [[("Haus", "n"), ("Heim", "n")], [("wohnen", None)]]
    assert ev(lambda c: T.fold_cell(T.parse_cell(c)), "a <m>, b; c") == "a <m>, b; c"
    assert ev(T.parse_cell, "False") == [] and ev(T.parse_cell, "") == []
    empty_first = lambda c: T.fold_groups(F.array(F.array().cast("array<string>"), F.array(c)))
    assert ev(empty_first, "a") == "a"
    assert ev(lambda c: T.fold_groups(F.array(F.array().cast("array<string>"), F.array(c)), skip_empty=False), "a") == "; a"
    tags = lambda w: T.render_gendered(w, F.lit("noun"), F.array(F.lit("masculine"), F.lit("feminine")))
    assert ev(tags, "x") == "x <m>/<f>"


def test_tokens(ev):
    assert ev(T.content_words, "The banker's House of a house") == ["banker", "house"]
    assert ev(T.sentences, "A b. c\n d.") == ["A b.", "c.", "d."]
    assert ev(T.cloze, "a **b** c") == "a [...] c" and ev(T.bold_html, "**b**") == "<p><strong>b</strong></p>"
    assert ev(T.index_terms, "n: House (big), _foo_ home; x") == ["house big", "home"]
    assert ev(T.compound_parts, "kasa + -Idi") == ["kasa", "idi"] and ev(T.compound_parts, "English (house)") is None
    assert ev(T.prefix_key, "ux") == "UX" and ev(T.prefix_key, "u") == "single_char" and ev(T.prefix_key, "a/b") == "single_char"
    assert ev(T.normal_tags, "kitchen tool, food") == ["kitchen_tool", "food"]
    assert ev(lambda a: T.labelled_lines(F.array(F.lit("n"), F.lit("v")), F.array(a)), "x") == "**n**: x"
    assert ev(lambda a: T.key_value([a], "tr"), "tr=a=b") == "a=b"
    assert ev(T.page_link, '<td class="infobox-image"><a href="/x">') == "/x"
    assert ev(T.spaced_tokens, "A, b!") == ["a", ",", "b", "!"]
    assert ev(T.split_items_outside_parentheses, "a (b, c), d") == ["a (b, c)", " d"]


def test_annotation(ev):
    assert tuple(ev(G.annotation, "v.intr (optional -cu): burn")) == ("v.intr (optional -cu)", "burn", "optional -cu")
    assert tuple(ev(G.annotation, "poss adj (relative clause): x")) == ("poss adj", "x", "relative clause")
    assert tuple(ev(G.annotation, "plain")) == (None, "plain", None)


def glosses(rows):
    return [(r["gloss"], r["pos"], r["verb_type"], r["affix_type"]) for r in rows]


def test_parse(ev):
    two = ev(G.parse_annotated, "n/v.tr sfx: x", "n")
    assert glosses(two) == [("x", "NOUN", None, "SUFFIX"), ("x", "VERB", "TRANSITIVE", "SUFFIX")]
    assert glosses(ev(G.parse_annotated, "v.intr: a", "b.oro.hisi")) == [("a", "VERB", "FEELING", None)]
    assert glosses(ev(G.parse_annotated, "v.tr: a", "b.oj.ru")) == [("a", "VERB", "ECHO_TRANSITIVE", None)]
    assert glosses(ev(G.parse_annotated, "n: (big) a; b; c", "b")) == [("a", "NOUN", None, None), ("big a", "NOUN", None, None), ("b", "VERB", None, None), ("c", "VERB", None, None)]
    assert glosses(ev(G.parse_annotated, "a", "unknown")) == [("a", "PHRASE", None, None)]
    assert ev(G.parse_annotated, "  ", "n") == []
    t = lambda a, b, c: G.parse_translation(c, G.parse_annotated(a, b), b)
    assert glosses(ev(t, "n: house; v.tr: shelter", "b.oj", "casa; alojar; extra; tr: foo")) == [("casa", "NOUN", None, None), ("alojar", "VERB", "TRANSITIVE", None), ("extra", "VERB", None, None), ("foo", "VERB", "TRANSITIVE", None)]


def test_legacy(ev):
    assert glosses(ev(G.parse_entry, "tr/intr (optional -cu):burn", "b.oro")) == [("burn", "VERB", "INTRANSITIVE_CU", None), ("burn", "VERB", "TRANSITIVE", None)]
    assert glosses(ev(G.parse_entry, "house", "n")) == [("house", "NOUN", None, None)]
    assert glosses(ev(G.parse_entry, "visit; go", "b.oj")) == [("visit", "NOUN", None, None), ("go", "VERB", "TRANSITIVE", None)]
    assert tuple(ev(G.default_pos, "b")) == ("NOUN", None) and tuple(ev(G.default_pos, "b.nenoj")) == ("VERB", "INTRANSITIVE") and tuple(ev(G.default_pos, "t")) == ("ADJECTIVE", None)


def test_scripts(ev):
    assert [ev(S.stress_word, w) for w in ("lobasa", "fe", "basan", "ba")] == ["lobása", "fe", "basán", "bá"]
    assert ev(S.latin_stressed, "ba") == "ba" and ev(S.stress_sentence, "ba!") == "ba!"
    assert ev(S.cyrillic, "yam") == "ям" and ev(S.cyrillic, "lobasa") == "лоба́са"
    assert ev(lambda c: S.convert_sentence(c, "Cyrillic"), "yusu, yo!") == "ю́су, йо!"
    assert ev(S.featural, "rrr") == "\ue2ce\ue2db"
    assert ev(T.syllables, "basa -ka un") == 3


def test_emphasis_and_names(ev):
    assert ev(lambda t: T.emphasise_phrase(t, F.lit("red fox")), "A Red fox, redfox") == "A **Red fox**, redfox"
    assert ev(lambda t: T.emphasise_first(t, F.array(F.lit("owl"), F.lit("fox"))), "One fox.") == "One **fox**."
    assert ev(lambda t: T.emphasise_first(t, F.array(F.lit("owl"))), "One fox.") == "One fox."
    assert ev(lambda n: T.plain_file_name(n, "ogg"), "ka_sa.ogg") and not ev(lambda n: T.plain_file_name(n, "ogg"), "../x.ogg")
