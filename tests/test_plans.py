"""Queries on small fixture tables."""

import datetime as dt
import json

import pytest

from lexmill.plans import corpora, lexical

DAY = dt.datetime(2024, 1, 1)


def out(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def record(word, senses, translations):
    return json.dumps({"word": word, "lang": "English", "pos": "noun", "senses": senses, "translations": translations})


def test_extension_table_has_cells(spark, tables):
    words = [(1, "kasa", "n", "n: house", "casa", "domo", DAY), (2, "sui", "n", "n: water", "x", None, DAY)]
    tables("word_list", [(*w, None, None) for w in words], "row_id bigint, word string, wordclass string, translationeng string, translationspa string, translationepo string, added_at timestamp, tags string, antonyms string")
    tr = lambda *codes: [{"word": w, "sense": "to live in", "code": c} for c, w in codes]
    records = [record("house", [{"glosses": ["to live in"]}], tr(("qct", "casa"), ("qcp", "domo"), ("qeu", "Haus"))), record("water", [], tr(("qig", "agua"), ("qew", "eau")))]
    tables("raw_wiktextract", list(enumerate(records)), "rec_id bigint, raw_line string")
    sf = tables("dump_tc", [(1, "house", "Noun", "to live in", "qzz", "m"), (2, "wall", "Noun", "to live in", "qzz", "m")], "row_id bigint, c1 string, c2 string, c4 string, c6 string, c7 string")
    got = out(lexical.q_sense_alignment(spark, sf).where("sense is not null"), "word", "pos", "app", "tier", "spa", "epo")
    assert got == [("kasa", "noun", "s", "v", "casa", "domo"), ("sui", "noun", "", "", " /agua/", "")]
    assert out(lexical.q_extension_table(spark, sf), "word", "eng_with_senses", "qig", "qeu", "qew") == [("kasa", "house [to live in]", "", "Haus", ""), ("sui", "", "", "", "")]


def test_zipf_pairs_rank_words(spark, tables):
    sf = tables("documents", [(1, "a", "one two two"), (2, "b", "two One three"), (3, "b", None)], "doc_id bigint, source string, text string")
    got = {(r["i"], r["j"]): r["b"] for r in corpora.c_zipf_pairs(spark, sf).collect()}
    assert set(got) == {(i, j) for i in range(3) for j in range(3)}  # two, one, three
    assert (got[1, 0], got[0, 0], got[2, 1]) == (-2.0, -1.0, 0.0)


def test_extension_columns_of_every_language(spark, tables):
    tables("word_list", [(1, "kasa", "n", "house", None, None, None, None, DAY)], "row_id bigint, word string, wordclass string, translationeng string, translationspa string, translationepo string, lexiliasel string, example string, added_at timestamp")
    sf = tables("menalari_extension", [(7, "kasa", "Haus <n>", "maison <f>", "дом", "房子")], "ext_id bigint, globasa string, deu string, fra string, rus string, zho string")
    tables("documents", [(3, "A red House. The wall."), (4, None)], "doc_id bigint, text string")
    texts = [("Chinese", "房子"), ("English", "house"), ("French", "maison <f>"), ("German", "Haus <n>"), ("Russian", "дом")]
    assert out(lexical.q_translation_groups(spark, sf), "lang", "texts") == texts
    payload = json.loads(lexical.q_lookup(spark, sf).first()["payload"])
    assert sorted((t["lang"], *t["texts"]) for t in payload["translations"]) == texts
    assert payload["examples"] == [{"ord": 300000, "seg": "A red House."}] and payload["extension"]["deu"] == "Haus <n>" and payload["derived"] == []
    assert out(lexical.t_cells(spark, sf), "lang", "text_", "gender") == [("deu", "Haus", "n"), ("fra", "maison", "f"), ("rus", "дом", None), ("zho", "房子", None)]
    assert out(lexical.t_cell_round_trip(spark, sf), "lang", "cell") == [("deu", "Haus <n>"), ("fra", "maison <f>"), ("rus", "дом"), ("zho", "房子")]


def test_corpus_ranking_is_composed(spark, tables):
    tables("word_list", [(1, "kasa", "house", DAY), (2, "kasa kom", "x", DAY), (3, "meza", None, DAY), (4, "sui", "water", DAY), (5, "kom", None, DAY)], "row_id bigint, word string, translationeng string, added_at timestamp")
    tables("dump_tc", [(1, "sui"), (2, "fire")], "row_id bigint, c1 string")
    sf = tables("documents", [(1, "b", "Un kasa kom meza. Meza meza is big here."), (2, "a", "Meza one. Two meza stand here."), (3, "c", "house")], "doc_id bigint, source string, text string")
    got = out(corpora.c_corpus_ranking(spark, sf), "section", "rank", "word", "source", "cnt", "first_passage")
    assert got == sorted([(0, 1, "meza", "a", 2, "Two meza stand here."), (0, 2, "kasa kom", "b", 1, "Un kasa kom meza."), (0, 3, "house", "c", 1, None), (1, None, "fire", None, None, None), (1, None, "sui", None, None, None), (2, None, "kasa", None, None, None), (2, None, "kom", None, None, None)], key=repr)


def test_lists_written_as_one_bare_member(spark, tables):
    sense = {"glosses": "to live in", "tags": ["a", "b"], "examples": {"text": "my house"}}
    tr = {"word": "casa", "sense": "to live in", "code": "qig", "tags": "feminine"}
    lists = {"glosses": ["to live in"], "tags": "[x", "examples": [{"text": "e"}, None]}
    records = [record("house", sense, tr), record("home", [None, lists], [tr, None]), record("void", None, []), "{bad", record("word", {}, "odd")]
    sf = tables("raw_wiktextract", list(enumerate(records)), "rec_id bigint, raw_line string")
    assert out(lexical.s_senses(spark, sf), "word", "glosses", "n_examples") == [("home", "to live in", 2), ("house", "to live in", 1), ("word", "", None)]
    t = lexical.readers.translations(lexical.readers.parse_dictionary(spark.read.parquet(f"{sf}/raw_wiktextract.parquet")))
    assert out(t, "word", "tags") == [("home", ["feminine"]), ("house", ["feminine"])] == [(w, ["feminine"]) for w, *_ in out(lexical.s_translations(spark, sf), "word")]
    tags = lexical.readers.senses(lexical.readers.parse_dictionary(spark.read.parquet(f"{sf}/raw_wiktextract.parquet")))
    assert out(tags, "word", "tags") == [("home", ["[x"]), ("house", ["a", "b"]), ("word", [])]
    assert out(lexical.q_sense_definitions(spark, sf), "word", "definition", "examples") == [("home", "to live in", "e|"), ("house", "to live in", "my house")]


def test_phrases_in_sentences_of_documents(spark, tables):
    tables("documents", [(1, "a", "Buy the red house. Some red-house, x"), (2, "a", None)], "doc_id bigint, source string, text string")
    tables("word_list", [(1, "red-house", "buy, Red House", DAY), (2, "Buy the", None, DAY), (3, None, "x", DAY)], "row_id bigint, word string, translationeng string, added_at timestamp")
    sf = tables("dump_tc", [("house",), ("three word entry",), (None,)], "c1 string")
    assert out(corpora.c_phrase_hits(spark, sf), "no", "start", "phrase") == [(0, 1, "buy the"), (0, 1, "buy"), (0, 3, "red house"), (0, 4, "house"), (1, 2, "red house"), (1, 3, "house")]
    assert out(corpora.c_two_word_entries(spark, sf), "doc_id", "entry", "n") == [(1, "buy the", 1), (1, "red house", 2)]
    assert out(corpora.c_emphasis(spark, sf), "no", "marked") == [(0, "Buy **the** red house."), (1, "**Some** red-house, x.")]


def test_lookup_and_pivot_over_all_rows(spark, tables):
    tables("word_list", [("kasa", "house, set"), (None, None)], "word string, translationeng string")
    tables("iso_639_3", [("qaa",), ("qab",)], "id string")
    sf = tables("dump_tc", [(1, "house", None, "sense", "qaa", "x", None), (2, "bat", None, None, "qab", "y", None), (3, "zoo", None, None, "qzz", "z", None), (4, None, None, None, "qaa", "v", None)], "row_id bigint, c1 string, c2 string, c4 string, c5 string, c6 string, c7 string")
    assert out(lexical.s_prefix_lookup(spark, sf), "row_id") == [(1,), (2,), (3,)]
    assert out(lexical.pivot_languages(spark, sf), "c1", "qaa", "qab") == sorted([("house", "x", None), ("bat", None, "y"), ("zoo", None, None), (None, "v", None)], key=repr)
