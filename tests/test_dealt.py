"""The general training-data operators: defined cases, and random inputs against brute force."""

import csv
import datetime as dt
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import nested, orphans, packed, rejects, skew


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


LANGS = ("id string, id2 string", [("qaa", "x"), ("qab", "y"), (None, None), ("qaa", "dup")])


def lines_of(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "line_id bigint, raw_line string, reason string")


def langs(spark):
    return spark.createDataFrame(LANGS[1], LANGS[0])


GOOD = "eng\tset\tVerb\ttr\tx\tqaa\tfoo"


def test_lines_reasons_and_fields(spark):
    cases = {
        GOOD: None,
        GOOD + "\r": None,
        GOOD + "\tm\ttr=a\tsc=Latn\tlit=b": None,
        GOOD + "\tm\tm\tm\tm\tm": "columns",
        "a\tb": "columns",
        "": "columns",
        None: "columns",
        GOOD.replace("\tx\t", '\t"a ""b""\tc"\t'): None,
        GOOD.replace("\tx\t", '\t"a"b\t'): "quoting",
        GOOD.replace("\tx\t", '\t"a\t'): "quoting",
        GOOD.replace("\tx\t", '\t5" wide\t'): None,
        GOOD.replace("tr", "t"): "value",
        GOOD.replace("qaa", "qzz"): "value",
        GOOD.replace("foo", "?!"): "value",
        GOOD.replace("foo", "f\x07"): "value",
        GOOD.replace("foo", "f�"): "value",
        GOOD + "\tx": "value",
        GOOD + "\ttr=": "value",
        GOOD + "\tsc=LATN": "value",
        GOOD + "\t": None,
        GOOD.replace("\tx\t", "\ta\rb\nc\t"): None,
        GOOD.replace("foo", "f" * 200_000): None,
        GOOD + "\r\r": "value",
    }
    texts = list(cases)
    out = {r["line_id"]: r for r in rejects.load_lines(lines_of(spark, texts), langs(spark)).collect()}
    assert {i: out[i]["reason"] for i in out} == dict(enumerate(cases.values()))
    at = lambda text: out[texts.index(text)]
    assert at(GOOD + "\r")["c6"] == "foo" and at(GOOD)["c7"] is None
    assert at(GOOD.replace("\tx\t", '\t"a ""b""\tc"\t'))["c4"] == 'a "b"\tc'
    assert at(GOOD.replace("\tx\t", "\ta\rb\nc\t"))["c4"] == "a\rb\nc"
    assert at(GOOD.replace("tr", "t").replace("qaa", "qaa"))["bad_cells"] == ["c3"]


def test_lines_empty_tables_and_repeats(spark):
    assert rejects.load_lines(lines_of(spark, []), langs(spark)).count() == 0
    assert [r["reason"] for r in rejects.load_lines(lines_of(spark, [GOOD] * 2), langs(spark).limit(0)).collect()] == ["value"] * 2
    twice = lines_of(spark, [GOOD, GOOD]).withColumn("line_id", F.lit(None).cast("bigint"))
    assert rejects.load_lines(twice, langs(spark)).where("line_id is null and reason is null").count() == 2


def brute_reason(text, ids):
    if text is None:
        return "columns"
    text = text[:-1] if text.endswith("\r") else text
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(text, i)
            if not m or text[m.end() : m.end() + 1] not in ("", "\t"):
                return "quoting"
            fields.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            j = text.find("\t", i)
            j = len(text) if j < 0 else j
            fields.append(text[i:j])
            i = j
        if i >= len(text):
            break
        i += 1
    if not 7 <= len(fields) <= 11:
        return "columns"
    ok = fields[3] == "tr" and fields[5] in ids and any(c.isalnum() for c in fields[6]) and not re.search("[\x00-\x1f\x7f-\x9f�]", fields[6])
    return None if ok and all(re.fullmatch(r"|[mfncp]|(tr|alt|lit)=.+|sc=[A-Z][a-z]{3}", x, re.S) for x in fields[7:]) else "value"


def test_lines_random(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        parts = GOOD.split("\t") + rng.choices(["m", "", "tr=x", '"m"', "sc=Latn", "zz"], k=rng.randint(0, 5))
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = rng.choice(['"a"', '"a\tb"', '""', '"', 'a"b', "", '"a""b"', '"a"b', "tr"])
        texts.append("\t".join(parts) + rng.choice(["", "\r"]))
    out = {r["line_id"]: r["reason"] for r in rejects.load_lines(lines_of(spark, texts), langs(spark)).collect()}
    assert out == {i: brute_reason(t, {"qaa", "qab"}) for i, t in enumerate(texts)}


def test_lines_agree_with_csv_module(spark):
    texts = ['a\t"b ""c""\td"\te\ttr\t\tqaa\tx\tm', 'a\tb"c\td\ttr\te\tqab\t"y"']
    for r, t in zip(sorted(rejects.load_lines(lines_of(spark, texts), langs(spark)).collect(), key=lambda r: r["line_id"]), texts):
        want = next(csv.reader(io.StringIO(t), delimiter="\t"))
        assert [r[f"c{i}"] for i in range(len(want))] == want


# --- packed fields


def split(text, **kw):
    return packed.Segmenter(**kw).split(text)


def test_packed_rule():
    assert split("a, b;c|d/e\nf\tg•h、i，j；k·l") == list("abcdefghijkl")
    assert split("n: house (big, small), well-known; it's 3.5+x_y") == ["n: house (big, small)", "well-known", "it's 3.5+x_y"]
    assert split('"a, b"; "the ""old"" one"；“x; y”') == ["a, b", 'the "old" one', "x; y"]
    assert split(" ,, ;") == [] and split("(a (b, c), d), e") == ["(a (b, c), d)", "e"]
    assert split('"a" b, c') == ['"a" b', "c"] and split('""') == []
    assert split("काम, дом") == ["काम", "дом"]


def test_packed_unclosed_marks_and_dictionary():
    assert split('5" pane, x') == ["5", "pane", "x"]
    assert split("dull (sharp, round") == ["dull (sharp", "round"]
    assert split("dull (sharp, round", known=["dull (sharp, round"]) == ["dull (sharp, round"]
    assert split("salt, pepper, oil", known=["salt, pepper"]) == ["salt", "pepper", "oil"]
    assert split("salt, pepper, oil", known=["salt, pepper"], dictionary_protects=True) == ["salt, pepper", "oil"]


def test_packed_cover_is_by_the_dictionary():
    cover = lambda text, *known, **kw: packed.Segmenter(known, **kw).cover(text)
    assert cover("oil, salt; x", "salt", "oil") == [("oil", True), ("salt", True), ("x", False)]
    assert cover('"a, b", b', "a, b") == [("a, b", True), ("b", False)] and cover('"the ""old"" one"', 'the "old" one') == [('the "old" one', True)]
    assert cover("saltpan, pan", "salt", "pan") == [("saltpan", False), ("pan", True)]  # a hit must be a whole piece
    # Covers with equally many unknown pieces differ in the number of pieces; fewer unknown ones come first.
    assert cover("(a, b, c", "b, c", "(a") == [("(a", True), ("b, c", True)]
    assert cover("(a, b, c", "(a, b", "b, c", "c") == [("(a, b", True), ("c", True)]
    assert cover("(a, b, c, d", "(a, b", "b, c", "(a", "d") == [("(a", True), ("b, c", True), ("d", True)]


def test_packed_candidates_hold_every_piece_of_a_cover():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(['a', 'b', ', ', '; ', '"', '(', ')', ' ']) for _ in range(rng.randint(1, 14)))
        for protects in (False, True):
            pool = packed.candidates(text, 3, protects)
            known = {x for x in pool if rng.random() < 0.4}
            assert all(v in pool for v, k in packed.Segmenter(known, protects).cover(text) if k)


def test_packed_long_text_is_linear():
    assert len(split("(" * 20_000 + "a, b" + '"' * 3)) >= 2
    assert len(split("a," * 100_000)) == 100_000


def test_unpack_fields(spark):
    data = [(1, "a, b", "x", 9), (1, None, "", 9), (None, "a|a", " ", 8)]
    df = spark.createDataFrame(data, "row_id int, f string, field string, item int")
    assert rows(packed.unpack_fields(df, "row_id", ["f", "field"]), "row_id", "field", "pos_no", "item") == sorted(
        [(1, "f", 1, "a"), (1, "f", 2, "b"), (1, "field", 1, "x"), (None, "f", 1, "a"), (None, "f", 2, "a")], key=repr
    )
    assert packed.unpack_fields(df.limit(0), "row_id", ["f"]).count() == 0


def test_unpack_fields_learns_values_with_delimiters(spark):
    data = [(1, '"dull (sharp, round"; oil'), (2, "dull (sharp, round; oil"), (3, '"salt, pepper"'), (4, '5" salt, pepper'), (5, "salt, pepper"), (6, "mild (warm, soft"), (7, "mild (warm, soft")]
    df = spark.createDataFrame(data, "row_id int, f string")
    assert rows(packed.known_values(df, ["f"]), "field", "item") == [("f", "dull (sharp, round"), ("f", "salt, pepper")]
    got = {}
    for r in rows(packed.unpack_fields(df, "row_id", ["f"]), "row_id", "pos_no", "item"):
        got.setdefault(r[0], []).append(r[2])
    assert got == {1: ["dull (sharp, round", "oil"], 2: ["dull (sharp, round", "oil"], 3: ["salt, pepper"], 4: ["5", "salt, pepper"], 5: ["salt", "pepper"], 6: ["mild (warm", "soft"], 7: ["mild (warm", "soft"]}


def test_unpack_fields_broadcast_and_join_agree(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["oil", "salt", "salt, pepper", '"salt, pepper"', "dull (sharp", '"x; (y"', "x; (y", "a (b, c)", " ", ""])
    data = [(i, rng.choice([", ", "; ", "|"]).join(word() for _ in range(rng.randint(0, 5))), rng.choice([None, "oil", "x; (y, oil"]), i) for i in range(200)]
    df = spark.createDataFrame(data, "row_id int, f string, g string, item int")
    for protects in (False, True):
        ways = [rows(packed.unpack_fields(df, "row_id", ["f", "g"], dictionary_chars=n, dictionary_protects=protects), "row_id", "field", "pos_no", "item", "known") for n in (packed.DICTIONARY_CHARS, 0)]
        assert ways[0] == ways[1] and {r[4] for r in ways[0]} == {True, False}


def test_unpack_fields_carries_columns_and_drops_repeats(spark):
    df = spark.createDataFrame([(1, "a, b, a", "x"), (1, "a", None)], "row_id int, f string, at string")
    got = packed.unpack_fields(df, "row_id", ["f"], carry=["at"], once=True, dictionary={"f": ["b"]})
    assert rows(got, "row_id", "at", "pos_no", "item", "known") == sorted([(1, "x", 1, "a", False), (1, "x", 2, "b", True), (1, None, 1, "a", False)], key=repr)
    with pytest.raises(ValueError):
        packed.unpack_fields(df.withColumn("item", F.lit(1)), "row_id", ["f"], carry=["item"])


# --- orphans


def test_orphans_match_rules(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, None, None), (5, "q", "x"), (5, "q", "x")], "id int, k1 string, k2 string")
    targets = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", None, 3)], "k1 string, k2 string, id int")
    ids = lambda m: [r[0] for r in rows(orphans.orphan_references(refs, targets, ["k1", "k2"], match=m), "id")]
    assert ids("simple") == [5, 5] and ids("partial") == [3, 5, 5] and ids("full") == [2, 3, 5, 5]
    assert orphans.orphan_references(refs, targets.limit(0), ["k1", "k2"]).count() == 3
    assert orphans.orphan_references(refs.limit(0), targets, ["k1", "k2"], match="partial").count() == 0


def test_orphans_in_time_random(spark):
    rng = random.Random(3)
    day = lambda: rng.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)) for _ in range(9)]])
    targets = [(rng.choice(["a", "b", "", None]), day(), day()) for _ in range(60)]
    refs = [(i, rng.choice(["a", "b", "", "c", None]), day()) for i in range(300)]
    far = dt.datetime.max
    want = sorted(i for i, k, t in refs if k is not None and (t is None or not any(w == k and s is not None and s <= t and (e or far) > t for w, s, e in targets)))
    r = spark.createDataFrame(refs, "id int, key string, at timestamp_ntz")
    t = spark.createDataFrame(targets, "word string, at timestamp_ntz, gone timestamp_ntz")
    got = orphans.orphan_references(r, t, ["key"], ["word"], valid=orphans.Validity("at", "gone", "at"))
    assert sorted(x["id"] for x in got.collect()) == want
    assert got.columns == r.columns
    report = orphans.orphan_report(got.withColumn("field", F.lit("f")), "t", "field", "at")
    assert sum(x["orphans"] for x in report.collect()) == len(want)


def test_spans_merge_across_minutes_and_days(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.choice("ab"), a := start + dt.timedelta(seconds=rng.choice([1, 60, 86400]) * rng.randrange(300)), a + dt.timedelta(seconds=rng.choice([-5, 0, 1, 90, 90_000]))) for _ in range(150)]
    t = spark.createDataFrame(data, "k string, s timestamp_ntz, e timestamp_ntz")
    want = []
    for k in "ab":
        for s, e in sorted((s, e) for w, s, e in data if w == k and s < e):
            if want and want[-1][0] == k and want[-1][2] >= s:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    assert rows(orphans.spans(t, ["k"], orphans.Validity("s", "e", "s")), "_k0", "_from", "_to") == sorted(want, key=repr)


def test_orphans_in_time_with_null_masks_and_clashing_names(spark):
    at = dt.datetime(2024, 1, 2)
    refs = spark.createDataFrame([(1, "a", None, at), (2, "a", "y", at), (3, None, "x", at), (4, None, None, at), (5, "a", "x", None)], "_from int, k1 string, k2 string, _k0 timestamp_ntz")
    targets = spark.createDataFrame([("a", "x", dt.datetime(2024, 1, 1), None), ("b", "y", dt.datetime(2024, 1, 3), None)], "k1 string, k2 string, s timestamp_ntz, e timestamp_ntz")
    got = lambda m: [r[0] for r in rows(orphans.orphan_references(refs, targets, ["k1", "k2"], match=m, valid=orphans.Validity("s", "e", "_k0")), "_from")]
    assert got("simple") == [2, 5] and got("partial") == [2, 5] and got("full") == [1, 2, 3, 5]


# --- nested records


def test_nested_cases(spark):
    record = {"word": "w", "senses": [None, {"glosses": ["g"], "examples": [{"text": "e"}, None, "no object", {"text": "e"}], "translations": {"word": "t"}}, 7, []], "translations": [{"word": "t"}]}
    lines = [json.dumps(record), "{bad", None, "[1]", '{"senses": {"examples": null}}', '{"a": NaN}', "null", json.dumps(record)]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(lines)], "rec_id bigint, raw_line string, child string")
    found = nested.occurrences(df).where("child <> 'record'")
    one = [("example", 1, 0), ("example", 1, 3), ("sense", 1, -1), ("translation", -1, 0), ("translation", 1, 0)]
    assert rows(found, "rec_id", "child", "sense_no", "child_no") == sorted([(r, *x) for r in (0, 7) for x in one] + [(4, "sense", 0, -1)], key=repr)
    nodes = {r["node_id"]: r["n_occurrences"] for r in nested.example_table(nested.occurrences(df)).collect()}
    assert list(nodes.values()) == [4]  # stored once, occurs four times
    assert nested.translation_table(nested.occurrences(df)).count() == 1
    assert nested.occurrences(df.limit(0)).count() == 0


def test_nested_identity_is_of_the_content(spark):
    a, b = '{"senses":[{"glosses":["x"],"tags":null,"n":1}]}', '{"senses":[{"n":1, "glosses":["x"]}]}'
    df = spark.createDataFrame([(1, a), (2, b)], "rec_id int, raw_line string")
    assert nested.occurrences(df).select("child", "node_id").distinct().count() == 2  # one record, one sense
    bridge = nested.occurrences(df)
    parents = {r["node_id"] for r in bridge.where("child = 'record'").collect()}
    assert {r["parent_id"] for r in bridge.where("child = 'sense'").collect()} == parents
    assert nested.sense_table(bridge).first()["glosses"] == ["x"]


def test_nested_deep_and_long(spark):
    deep = '{"senses":' + "[" * 5000 + "]" * 5000 + "}"
    wide = json.dumps({"senses": [{"glosses": ["g" * 50]}] * 3000})
    df = spark.createDataFrame([(1, deep), (2, wide)], "rec_id int, raw_line string")
    assert nested.occurrences(df).where("rec_id = 2 and child = 'sense'").count() == 3000


def test_nested_any_depth_and_number(spark):
    deep = "[" * 100_000 + "]" * 100_000
    lines = ['{"senses":[{"x":' + deep + '}]}', '{"senses":[{"n":' + "7" * 5000 + "}]}", '{"senses":[{"x":' + deep[:-1] + "}]}", '{"senses":{"x":' + deep + ',"y":NaN}}']
    df = spark.createDataFrame(list(enumerate(lines)), "rec_id int, raw_line string")
    found = nested.occurrences(df).where("child = 'sense'")
    assert rows(found, "rec_id", "sense_no") == [(0, 0), (1, 0)]
    assert {r["rec_id"]: r["body"] for r in found.collect()} == {0: '{"x":' + deep + "}", 1: '{"n":' + "7" * 5000 + "}"}
    for text in ('{"b": [1, {"a": "x\\n", "c": []}, null], "a": {}}', "[]", ' {"a" : [ ] } '):
        assert nested._loads_deep(text) == json.loads(text) and nested._dumps_deep(json.loads(text)) == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    for text in ('{"a":1,}', "[1,]", "{} x", '{"a" 1}', "[", "", "[1 2]", "[NaN]"):
        try:
            nested._loads_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


# --- skew


def test_eager_join_equals_row_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.choice("ab"), rng.choice([1, 2, None])) for _ in range(200)], "k int, g string, v int")
    right = spark.createDataFrame([(rng.choice([1, 2, 3, None]), rng.choice("xy"), rng.choice([5, None])) for _ in range(40)], "k int, g string, v int")
    for how in ("inner", "left"):
        got = skew.eager_join_aggregate(left, right, ["k"], ["k"], by_left=["g"], by_right=["g"], sum_left={"sl": "v"}, sum_right={"sr": "v"}, how=how)
        l, r = left.alias("l"), right.alias("r")
        want = l.join(r, F.col("l.k") == F.col("r.k"), how).groupBy(F.col("l.g").alias("g"), F.col("r.g").alias("right_g")).agg(F.count(F.lit(1)).alias("join_rows"), F.sum("l.v").alias("sl"), F.sum("r.v").alias("sr"))
        cols = ["g", "right_g", "join_rows", "sl", "sr"]
        assert rows(got, *cols) == rows(want, *cols)
        per = skew.eager_join_aggregate(left, right, ["k"], ["k"], by_left=["g"], how=how)
        keys = {x["k"] for x in right.collect()} - {None}
        met = lambda g: sum(x["g"] == g and x["k"] in keys for x in left.collect())
        every = lambda g: met(g) if how == "inner" else sum(x["g"] == g for x in left.collect())
        assert rows(per, "g", "met_rows", "left_rows") == [(g, met(g), every(g)) for g in "ab"]
    assert skew.eager_join_aggregate(left.limit(0), right, ["k"], ["k"], by_left=["g"]).count() == 0


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 49 + [("b",)] * 2 + [(None,)] * 30 + [(c,) for c in "cdefghijklmnopqrstu"], "c1 string").withColumn("k", F.lit(1))
    per = skew.eager_join_aggregate(df, df.limit(0), ["k"], ["k"], by_left=["c1"], how="left")
    assert rows(skew.hot_keys(per, "c1", "left_rows", 0.02), "c1") == [("a",), ("b",)]
