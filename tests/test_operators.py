"""Operators of the lexical engine on small fixtures."""

import json

from pyspark.sql import functions as F

from lexmill.operators import corpus, export, graph, rows, search, sense
from lexmill.sources import readers, writers
from lexmill.streaming import ingest


def out(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def word_rows(spark):
    data = [("kasa", "n", "n: house, home", "casa, hogar", "domo, hejmo", "place, dwelling", None, "English (house)"), ("kasaidi", "b.oj", "n: (home) visit; v.tr: visit", "visita; visitar", "vizito; viziti", "motion", "kasa", "kasa + idi"), ("-ya", "xfik", "n sfx: -ness", None, None, None, None, None), ("devtest", "n", "n: x", None, None, None, None, None), ("nan", "n", None, None, None, None, None, None)]
    return spark.createDataFrame(data, "word string, wordclass string, eng string, spa string, epo string, tags string, antonyms string, lexiliasel string")


def dictionary(spark):
    records = [
        {"word": "house", "lang": "English", "pos": "noun", "senses": [{"glosses": ["a building for living in"], "examples": [{"text": "my house"}]}], "translations": [{"word": "casa", "sense": "building for living in", "code": "es", "tags": ["feminine"]}, {"word": "domo", "sense": "building for living in", "code": "eo"}, {"word": "Haus", "sense": "building for living in", "code": "de", "tags": ["neuter"], "romanization": "haus"}, {"word": "Hus", "sense": "building for living in", "code": "de", "tags": ["Alemannic-German"]}, {"word": "x", "code": "de"}]},
        {"word": "casa", "lang": "Spanish", "pos": "noun"},
        {"lang": "English"},
    ]
    lines = [json.dumps(r) for r in records] + ["{bad json", None]
    return readers.parse_dictionary(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "rec_id int, raw_line string"))


def test_readers(spark, tmp_path):
    d = dictionary(spark)
    assert d.count() == 2 and readers.translations(d).count() == 4
    assert out(readers.foreign_pos(d), "word", "pos") == [("casa", "noun")]
    assert readers.senses(d).first()["sense_no"] == 0
    (tmp_path / "dump").mkdir()
    row = 'eng\tuxor\tNoun\ttr\t"a ""spouse"""\tdeu\tGatte\tm\n'
    for name in ("UX.tsv", "ux.tsv"):
        (tmp_path / "dump" / name).write_text("eng\tzeta\tNoun\ttr\ts\thin\tx\n" + row + "lone\n")
    dump = readers.translation_dump(spark, str(tmp_path / "dump"))
    assert out(dump, "word", "sense", "translation", "extra1") == [("uxor", 'a "spouse"', "Gatte", "m"), ("zeta", "s", "x", None)]
    legacy = spark.createDataFrame([("w", "e", "n", "s", "s", "", "v", "l", 1), ("w", "e", "n", "s", "", "", "", "", 2)], "Glb string, Eng string, `Prt of Sp` string, Sense string, `App?` string, `Expert?` string, `Vetted?` string, `LLM?` string, o int")
    assert out(readers.markings(legacy, "o"), "app", "tier") == [("s", "v")]
    (tmp_path / "x.tmx").write_text('<tmx><body><tu><prop type="x-context">c</prop><tuv xml:lang="glb"><seg>kasa</seg></tuv><tuv xml:lang="en"><seg>house</seg></tuv></tu></body></tmx>')
    unit = readers.tmx(spark, str(tmp_path / "x.tmx")).first()
    assert (unit["seg"], unit["translations"], unit["context"]) == ("kasa", {"en": "house"}, "c")
    lines = spark.createDataFrame([(0, "# c"), (1, "the house"), (2, "NULL ({ }) kasa ({ 1 2 }) x ({ })")], "line_no int, value string")
    assert out(readers.alignments(lines), "word", "positions") == [("kasa", [0, 1]), ("x", [])]
    assert readers.first_existing(str(tmp_path / "no"), str(tmp_path)) == str(tmp_path) and readers.newest(str(tmp_path), "x") == str(tmp_path / "x.tmx")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("kasa", 1), ("ka", 2), ("a", 3)], "word string, v int")
    writers.prefix_partitioned(df, str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"pfx=KA", "pfx=single_char"}
    writers.word_store(df, {"side": spark.createDataFrame([("kasa", "s"), ("zz", "t")], "word string, s string")}, {}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "side")).count() == 1
    writers.delimited(df, str(tmp_path / "d"), order=["v"])
    writers.lines(df.select(F.lit("en").alias("lang"), F.col("word").alias("line")), str(tmp_path / "l"), by=["lang"])
    writers.ngrams(spark.createDataFrame([(1, "a", 3)], "n int, gram string, cnt int"), str(tmp_path / "n"))
    assert (tmp_path / "l" / "lang=en").exists() and (tmp_path / "n" / "n=1").exists()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"word": "house", "lang": "English", "pos": "noun", "translations": [{"word": "casa", "sense": "s", "code": "es"}]}) + "\n{bad\n")
    q = ingest.load_translations(ingest.dictionary_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_crossvalidation_truth_table(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    sides = {"none": (arr(), arr("a")), "match": (arr("a", "b"), arr("a")), "miss": (arr("b"), arr("a"))}
    for s, (sf, sk) in sides.items():
        for e, (ef, ek) in sides.items():
            v = spark.range(1).select(sense.crossvalidate(sf, sk, ef, ek).alias("v")).first()["v"]
            assert (v["app"] == "s") == ("miss" not in (s, e) and "match" in (s, e))
            assert v["spa"] == {"none": "", "match": "a /b/", "miss": " /b/"}[s]


def test_sense_alignment(spark):
    d = dictionary(spark)
    t, s = readers.translations(d), readers.senses(d)
    w = word_rows(spark)
    marks = spark.createDataFrame([("kasa", "house", "noun", "building for living in", "s", "v")], "glb string, eng string, pos string, sense string, app string, tier string")
    got = sense.align_senses(w, t, s, marks)
    hit = got.where("sense is not null").collect()
    assert len(hit) == 1 and hit[0]["definition"] == "a building for living in" and hit[0]["example1"] == "my house"
    assert (hit[0]["app"], hit[0]["tier"], hit[0]["spa"], hit[0]["epo"]) == ("s", "v", "casa", "domo")
    assert {r["word"] for r in got.where("eng_word is null").collect()} == {"nan"}
    wide = {r["word"]: r for r in sense.extension_table(w, got, t, ["de", "de-ale", "fr"]).collect()}
    assert (wide["kasa"]["de"], wide["kasa"]["de-ale"], wide["kasa"]["fr"]) == ("Haus <n>", "Hus", "")
    assert wide["kasa"]["eng_with_senses"] == "house [building for living in]" and wide["nan"]["de"] == ""
    again = sense.align_senses(w, t, s, marks)
    assert out(again, *again.columns) == out(got, *got.columns)


def test_definition_tiers(spark):
    keys = spark.createDataFrame([("w", "n", "gambling: banker's funds"), ("w", "n", "big red house"), ("w", "n", "zzz"), ("w", "n", "")], "word string, pos string, sense string")
    senses = spark.createDataFrame([("w", "n", 0, ["a large red house"], ["raw"], [], None), ("w", "n", 1, ["the banker's funds"], [], [], None)], "word string, pos string, sense_no int, glosses array<string>, raw_glosses array<string>, tags array<string>, examples array<struct<text:string,english:string,type:string>>")
    assert set(out(sense.match_definitions(keys, senses), "sense", "sense_no")) == {("big red house", 0), ("gambling: banker's funds", 1)}


def test_graph(spark):
    edges = spark.createDataFrame([("s3", "s2"), ("s2", "s1"), ("s1", "s3"), ("s4", "s2")], "src string, dst string")
    closure = graph.ancestors(edges)
    assert closure.where("node = 's4'").count() == 3  # through a cycle
    cand = spark.createDataFrame([("kasa", "n", "s3"), ("ya", "n", "s9")], "word string, pos string, synset_id string")
    suffixes = spark.createDataFrame([("sa", "n", "s1", 0)], "suffix string, pos string, topic_id string, ord int")
    assert graph.suffix_filter(cand, suffixes, graph.ancestors(edges.where("src <> 's1'"))).count() == 2
    tags = spark.createDataFrame([("kasa", "place")], "word string, tag string")
    topics = spark.createDataFrame([("place", "n", "hypernym", "s8")], "tag string, pos string, kind string, topic_id string")
    instances = edges.limit(0)
    assert out(graph.tag_filter(cand, tags, topics, closure, instances), "word") == [("ya",)]
    th = spark.range(10).select(graph.threshold(F.col("id").cast("int")).alias("t")).collect()
    assert [r["t"] for r in th] == [0, 1, 2, 2, 2, 2, 2, 2, 2, 2]
    synsets = spark.createDataFrame([("s7", "i53558"), ("s8", "i85253")], "synset_id string, ili string")
    by_suffix, by_tag = graph.topic_tables(synsets)
    assert out(by_suffix, "suffix", "topic_id") == [("dom", "s7")] and out(by_tag, "tag", "kind", "topic_id") == [("daygeo", "instance_of", "s8"), ("dom", "hypernym", "s7")]
    rel = spark.createDataFrame([("s3", "antonym", "s4")], "src string, rel string, dst string")
    lem = spark.createDataFrame([("s4", "tent")], "synset_id string, lemma string")
    ant = spark.createDataFrame([("kasa", "tent")], "word string, lemma string")
    assert out(graph.antonym_confirmed(cand, rel, lem, ant), "word") == [("kasa",)]


QUERY = "word string, group_no int, pos string, eng array<string>, spa array<string>, epo array<string>"
SYNSET, LEMMA, EPO = "synset_id string, ili string, pos string, lexicon string", "synset_id string, lemma string", "ili string, lemma string, ord bigint"


def shuffled(df):
    """Bytes that the exchanges of a query hold; the query is run."""
    df.collect()

    def walk(node):
        own = node.metrics().get("dataSize").get().value() if node.nodeName() == "Exchange" else 0
        under = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(map(walk, under))

    return walk(df._jdf.queryExecution().executedPlan())


def scorings(df):
    """Times that the plan joins query words with lemmas."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")


def network(spark, n):
    """One synset that ``n`` words share, in both lexicons; each word is a query, and one of them has all Spanish words."""
    synsets = spark.createDataFrame([("e", "i", "n", "en"), ("s", "i", "n", "es")], SYNSET)
    lemmas = spark.createDataFrame([(k, f"{k}{x}") for x in range(n) for k in "es"], LEMMA)
    queries = spark.createDataFrame([(f"w{x}", 0, "n", [f"e{x}"], [f"s{i}" for i in (range(n) if x == 0 else [x])], []) for x in range(n)], QUERY)
    return queries, synsets, lemmas, spark.createDataFrame([], EPO)


def test_score_of_a_synset_with_many_lemmas(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        small, large = (graph.score_synsets(*network(spark, n)) for n in (200, 800))
        assert large.where("applicable").count() == 800
        assert shuffled(large) < 6 * shuffled(small)  # 16 times where each row holds all lemmas
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_align_synsets_with_many_lemmas(spark):
    def align(n):
        queries, synsets, lemmas, epo = network(spark, n)
        closure = spark.createDataFrame([("e", "up", 1)], "node string, ancestor string, depth bigint")
        suffixes = spark.createDataFrame([("1", "n", "up", 0), ("2", "n", "off", 1)], "suffix string, pos string, topic_id string, ord int")
        tags = spark.createDataFrame([("w4", "t"), ("w14", "u")], "word string, tag string")
        topics = spark.createDataFrame([("t", "n", "hypernym", "off"), ("u", "n", "hypernym", "up")], "tag string, pos string, kind string, topic_id string")
        marks = spark.createDataFrame([("w2", "n", "i", "s", "v"), ("w3", "n", "i", "", "v"), ("w5", "n", "j", "s", "v")], "word string, pos string, ili string, app string, vetted string")
        return graph.align_synsets(queries, synsets, lemmas, epo, closure=closure, suffixes=suffixes, tags=tags, topics=topics, instances=spark.createDataFrame([], "src string, dst string"), markings=marks)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        small, large = align(200), align(800)
        got = {(r["word"], r["ili"]): r["status"] for r in large.collect()}
        assert len(got) == 801 and got["w5", "j"] == "applicable"
        assert {k[0] for k, v in got.items() if v == "other"} == {"w3", "w4", *[f"w{x}" for x in range(12, 800, 10)]}
        assert shuffled(large) < 6 * shuffled(small)  # 16 times where each row holds all lemmas
        assert scorings(large) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_score_synsets(spark):
    synsets = spark.createDataFrame([("e1", "i1", "n", "en"), ("e2", "i2", "s", "en"), ("e2", "i2", "a", "en"), ("e3", "i3", "n", "en"), ("e4", None, "n", "en"), ("e5", "i1", "v", "en"), ("s1", "i1", "n", "es"), ("s0", "i1", "n", "es"), ("s3", "i3", "n", "es"), ("s", "i2", "n", "es")], SYNSET)
    lemmas = spark.createDataFrame([("e1", "house"), ("e1", "house"), ("e1", "home"), ("e2", "red"), ("e3", "home"), ("e4", "house"), ("e5", "house"), ("s1", "hogar"), ("s0", "casa"), ("s3", "hogar")], LEMMA)
    epo = spark.createDataFrame([("i3", "hejmo", 2), ("i3", "domo", 1)], EPO)
    queries = [
        ("kasa", 0, "n", ["house", "house"], ["casa"], []),  # both lexicons; s0 is the counterpart, not s1; e4 has none
        ("two", 0, "n", ["house", "x"], [], []),  # one query of two rows, which don't add up
        ("two", 0, "n", ["home", "x"], [], []),
        ("hogar", 0, "n", ["tent"], ["hogar"], ["domo"]),  # Spanish alone: a candidate, not applicable
        ("hejm", 0, "n", ["home", "x", "y"], None, ["domo"]),
        ("roxo", 0, "a", ["red", "x"], [], None),  # e2 counts once
    ]
    got = graph.score_synsets(spark.createDataFrame(queries, QUERY), synsets, lemmas, epo)
    assert out(got, "word", "synset_id", "applicable") == sorted(
        [("kasa", "e1", True), ("kasa", "e4", False), ("two", "e1", False), ("two", "e4", False), ("two", "e3", False), ("hogar", "e3", False), ("hejm", "e1", None), ("hejm", "e3", True), ("roxo", "e2", False)], key=repr
    )


def test_merge_words():
    entries = {"fe lefe", "fe lefe na", "no kwas", "a na", "(fe) duli mara"}
    lem = lambda *ws: {w: w for w in ws}
    assert corpus.merge_words("fe lefe na x".split(), lem("fe", "lefe", "na", "x"), entries) == ["fe lefe na", "x"]
    assert corpus.merge_words("a na".split(), lem("a", "na"), entries) == ["a na"]
    assert corpus.merge_words("duli mara".split(), lem("mara"), entries) == ["(fe) duli mara"]
    assert corpus.merge_words("zz".split(), {}, entries) == [] and corpus.merge_words("cel".split(), lem("cel"), entries) == ["cel"]


def test_corpus(spark):
    v = spark.createDataFrame([("kasa",), ("idi",), (None,)], "word string")
    t = spark.createDataFrame([("Bekasa,",), ("idili",), ("kasagi",), ("zz",), ("",), (None,)], "t string")
    assert out(corpus.lemmas(t, "t", v), "token", "lemma") == sorted([("Bekasa,", "kasa"), ("idili", "idi"), ("kasagi", "kasa"), ("zz", None), ("", None)], key=repr)
    grams = corpus.ngram_counts(spark.createDataFrame([("casa",)], "t string"), "t")
    assert out(grams, "gram") == [("a",), ("as",), ("c",), ("ca",), ("cas",), ("s",)]
    ranked = spark.createDataFrame([("a", 10, 1), ("b", 5, 2)], "w string, c int, rank bigint")
    assert {(r["i"], r["j"]): r["b"] for r in corpus.zipf_pairs(ranked, "c").collect()}[(0, 1)] == 5.0
    s = spark.createDataFrame([("Da kasa bon",)], "s string")
    assert s.select(corpus.emphasise("s", F.lit("kasa"), F.array(F.lit("kasa"))).alias("x")).first()["x"] == "Da **kasa** bon"


def test_search(spark):
    w = word_rows(spark).withColumn("ord", F.monotonically_increasing_id())
    idx = search.term_index(w, {"eng": "English", "spa": "Spanish"})
    assert [r["word"] for r in search.suggest(w, idx, "home", ["English"]).orderBy("place").collect()] == ["kasa", "kasaidi"]
    assert [r["word"] for r in search.suggest(w, idx, "kasa", ["English"]).orderBy("place").collect()] == ["kasa", "kasaidi"]
    assert search.suggest(w, idx, "k", ["English"]).count() == 0
    assert out(search.derived_words(search.derived_index(w, "lexiliasel"), "Kasa"), "word") == [("kasaidi",)]
    assert out(search.point_get(w, "Kasa"), "word") == [("kasa",)] and search.point_get(w, "zz").count() == 0
    units = spark.createDataFrame([(i, "kasa kasaidi.") for i in range(30)], "ord int, seg string")
    top = search.top_examples(search.sentence_index(units, "seg", "ord"), w.select("word"))
    assert [r["ord"] for r in top.where("word = 'kasa'").orderBy("ord").collect()] == list(range(20))
    groups = search.translation_groups(w, {"spa": "Spanish"}, {"epo": "Esperanto"}, spark.createDataFrame([("kasaidi", "visit")], "word string, gloss string"))
    got = {(r["word"], r["group_no"], r["lang"]): r["texts"] for r in groups.collect()}
    assert got[("kasaidi", 1, "Spanish")] == ["visitar"] and got[("kasaidi", 0, "English")] == ["home visit"] and got[("kasaidi", 1, "Esperanto")] == ["viziti"]
    payload = json.loads(search.lookup(w, "kasa", {}, search.derived_index(w, "lexiliasel"), groups, top).first()["payload"])
    assert payload["derived"] == ["kasaidi"] and len(payload["examples"]) == 20
    aligned = spark.createDataFrame([(0, "kasa , bon", "kasa", [1])], "rec_no int, target string, word string, positions array<int>")
    one = search.aligned_sentences(spark.createDataFrame([("Kasa, bon",)], "seg string"), aligned).first()
    assert one["alignments"] == {"kasa": [1]}


def test_export(spark):
    w = word_rows(spark)
    lines = {(r["lang"], r["word"]): r["line"] for r in export.dictionary_lines(w.where("word = 'kasa'"), ["eng"]).collect()}
    assert lines[("mono", "kasa")] == '<e lm="kasa">       <i>kasa</i><par n="__n"/></e>'
    assert '<e><p><l>kasa<s n = "n"/><s n = "GD"/></l>   <r>home<s n = "n"/></r></p></e>' in {r["line"] for r in export.dictionary_lines(w.withColumn("eng", F.regexp_replace("eng", "n: ", "")).where("word = 'kasa'"), ["eng"]).collect()}
    pages = w.withColumn("eng", F.when(F.col("word") == "nan", F.lit("iron")).when(F.col("word") == "kasa", F.lit("x, _Felis_")).otherwise(F.col("eng")))
    elements = spark.createDataFrame([("iron",)], "element string")
    assert out(export.page_candidates(pages, "atomic", elements), "word", "page") == [("nan", "iron")]
    assert out(export.page_candidates(pages.withColumn("wordclass", F.lit("b")), "bio"), "word", "page") == [("kasa", "Felis")]
    ranking = spark.createDataFrame([(1, "kasaidi", "A **kasaidi** b", "src", "An **x**"), (2, "devtest", None, None, None), (3, "zz", None, None, None)], "rank int, word string, example string, source string, english string")
    images = spark.createDataFrame([("kasaidi", "u.gif", "p")], "word string, direct_url string, source_page string")
    card = export.card_rows(ranking, w, images=images).collect()
    assert len(card) == 1 and card[0]["transitive"] == "<p>visit</p>" and card[0]["meaning1"] == "<p>visit</p>" and card[0]["meaning2"] == "<p>home visit</p>"
    assert (card[0]["animation"], card[0]["image"], card[0]["example_cloze"], card[0]["tags"]) == ("u.gif", "", "<p>A [...] b</p>", "motion src")
    assert len(export.CARD_COLUMNS) == len(set(export.CARD_COLUMNS))


def test_rows(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["b", "a", "a", "c", "a"])], "o int, w string")
    assert out(rows.resume_from(df, "w", "a", "o"), "o") == [(1,), (2,), (3,), (4,)] and rows.resume_from(df, "w", "zz", "o").count() == 0
    assert out(rows.runs(df.withColumn("g", F.lit(1)), ["g"], ["o"], ["w"]), "o", "run_no") == [(0, 1), (1, 2), (2, 2), (3, 3), (4, 4)]
    assert out(rows.keep_first(df, ["w"], ["o"]), "w", "o") == [("a", 1), ("b", 0), ("c", 3)] and out(rows.keep_last(df, ["w"], ["o"]), "w", "o") == [("a", 4), ("b", 0), ("c", 3)]
    assert out(rows.number_rows(df, [F.desc("w"), F.col("o")]), "o", "rn") == [(0, 2), (1, 3), (2, 4), (3, 1), (4, 5)]
    assert rows.number_rows(df.limit(0), ["o"]).count() == 0
