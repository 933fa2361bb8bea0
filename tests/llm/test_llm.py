"""The text operators: defined cases, brute force, round trips against public libraries."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, leakage, lookalike, pieces

VOCABULARY = Path(bpe.DEFAULT_FOLDER) / bpe.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, piece_no int")


# --- look-alikes


def test_same_look():
    same = [("abc", "ａｂｃ"), ("é", "é"), ("a b", "a b"), (" a　", "a"), ("a​b﻿", "ab"), ("сор", "cop"), ("ガ", "ｶﾞ"), ("木", "⽊"), ("月", "⺝"), ("о⁠́", "ó"), ("ν", "v"), ("κα", "кα"), ("", "​ \t")]
    for a, b in same:
        assert lookalike.look_key(a) == lookalike.look_key(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("人", "入"), ("a b", "ab"), ("k", "к"), ("2", "²"), ("a  b", "a b"), ("è", "é")]:
        assert lookalike.look_key(a) != lookalike.look_key(b), (a, b)


def test_forms_are_equal_iff_looks_are():
    rng = random.Random(2)
    letters = list("аaсcеeоoνvκклλ ｂb​é") + ["é", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    for vocabulary in ([], ["сор", "cop", "ел", "ace", "νλ", "b"]):
        unifier = lookalike.Unifier(vocabulary)
        forms, looks = [unifier.text(t) for t in texts], [lookalike.look_key(t) for t in texts]
        assert len(set(zip(forms, looks))) == len(set(forms)) == len(set(looks))
        assert all(unifier.text(f) == f for f in forms)
    assert lookalike.Unifier(["сор"]).text("cop​") == "сор" and lookalike.Unifier([]).text("лоб") == "лоб" and lookalike.Unifier([]).text("лoб") == "лоб"


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["сор", "cop", "cop​", "kasa", "kasа", "Kasa", None, "", " ", "é", "é", "x" * 50_000, "x" * 50_000 + "⁠"]
    data = [(i, rng.choice(["a", "b", None]), rng.choice(texts), 1) for i in range(150)]
    df = spark.createDataFrame(data, "id int, g string, t string, _form int")
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] is not None and None not in (a[2], b[2]) and a[2] != b[2] and lookalike.look_key(a[2]) == lookalike.look_key(b[2]))
    for spellings in ([], ["сор", "kasa"]):
        got = lookalike.same_look_pairs(df, "id", "t", ["g"], spellings)
        assert sorted((r["id_a"], r["id_b"]) for r in got.collect()) == want
    assert lookalike.same_look_pairs(df.limit(0), "id", "t", [], []).count() == 0
    with pytest.raises(ValueError):
        lookalike.unify(df, "t", "g", [])


def test_automaton_weighs_edits():
    words = ["kasa", "kása", "сор", "cop", "mana"]
    near = lambda t, budget: lookalike.Automaton(words, budget).canonical(t)[0]
    # The first of the spellings at no cost; ignorables, widths and scripts cost nothing.
    assert near("cop", 0) == near("сo\u200bр", 0) == "сор" and near("ｋаsa", 0) == "kasa" and near("ka\u0301sa", 0) == "kása" and near("k\u200ba\u200b\u0301sa", 0) == "kása"
    assert near("Kasa", 0) is near("kas", 0) is near("kàsa", 0) is None
    # A letter of another case is cheaper than an accent, an accent than any other edit.
    assert near("Kasa", 1) == "kasa" and near("kàsa", 1) is None and near("kàsa", 2) == "kasa" and near("kas", 2) is None and near("kas", 3) == near("kasta", 3) == near("katа", 3) == "kasa"
    assert near("KÁSA", 6) == "kása" and near("mama", 3) == "mana"
    rng, letters = random.Random(3), ["a", "а", "\u0301", "\u200b", "b", "A"]

    def brute(a, b):
        a, b = list(lookalike._written(a)), list(lookalike._written(b))
        row = [0]
        for y in b:
            row.append(row[-1] + lookalike._cost("", y))
        for x in a:
            nxt = [row[0] + lookalike._cost(x, "")]
            for j, y in enumerate(b):
                nxt.append(min(row[j] + lookalike._cost(x, y), row[j + 1] + lookalike._cost(x, ""), nxt[j] + lookalike._cost("", y)))
            row = nxt
        return row[-1]

    for _ in range(300):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(4)]
        token = "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))
        for budget in (0, 2, 4):
            best = min((brute(token, w), i) for i, w in enumerate(words))
            got = lookalike.Automaton(words, budget).canonical(token)[0]
            want = words[best[1]] if best[0] <= budget else None
            assert got == want or (got is not None and want is not None and list(lookalike._written(got)) == list(lookalike._written(want)))


def test_written_symbols_are_the_decomposed_text():
    rng = random.Random(5)
    letters = ["a", "é", "\u0301", "\u0323", "\u200b", "ｶ", "ﾞ", "가", " ", "￣", "　"]
    for _ in range(500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
        assert "".join(lookalike._written(t)) == lookalike.symbols(t)


def test_vocabulary_decides_the_form_and_has_no_bound(spark):
    texts = ["сор", "сор", "cop", "kasa", "kasа", "ｋasa", "cop​", None, "", "été сор", "Kasa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = lookalike.vocabulary(df, "t")
    assert sorted((r["spelling"], r["by_table"]) for r in table.collect()) == [("Kasa", True), ("kasa", True), ("été", True), ("сор", False)]
    ways = [{r["id"]: r["f"] for r in lookalike.unify(df, "t", "f", lookalike.Vocabulary(table, spark, chars)).collect()} for chars in (1000, 5, 0)]
    assert ways[0] == ways[1] == ways[2] == dict(enumerate(["сор", "сор", "сор", "kasa", "kasa", "kasa", "сор", None, "", "été сор", "Kasa"]))
    near = {r["id"]: r["f"] for r in lookalike.unify(df, "t", "f", ["kasa"], budget=1).collect()}
    assert near[10] == near[3] == "kasa"
    pairs = [sorted(map(tuple, lookalike.same_look_pairs(df, "id", "t", [], lookalike.Vocabulary(table, spark, chars)).collect())) for chars in (1000, 0)]
    assert pairs[0] == pairs[1] == [(0, 2), (0, 6), (1, 2), (1, 6), (2, 6), (3, 4), (3, 5), (4, 5)]


# --- tokenizer


@needs_vocabulary
def test_ids_equal_the_libraries(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(str(VOCABULARY))
    reference.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "'s", "'", "1", ".", "é", "　", "\x1c", " ", "ら", "don't", "aaaa", "abab", "<|endoftext|>", "काम"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "ab" * 5000, "one two " * 5000]
    out = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_texts(docs(spark, texts)).collect()}
    assert out == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


@needs_vocabulary
def test_ids_of_repeats_and_empty_tables(spark):
    df = docs(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert bpe.encode_texts(df.unionAll(df)).where("doc_id is null").count() == 2
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_steps_cover_everything():
    assert list(bpe.steps([])) == [] and list(bpe.steps(["aa", None, "b" * 9, "c"], 3)) == [(0, 2), (2, 3), (3, 4)]


# --- leaks


def brute_leaks(documents, items):
    import regex

    grams = lambda t: {tuple(w[i : i + 12]) for w in [regex.findall(r"\p{L}+", (t or "").lower())] for i in range(len(w) - 11)}
    return sorted((d, i) for d, t in documents for i, u in items if grams(t) & grams(u))


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["der", "Fox", "jumps", "ov", "ré", "lazy"]) if rng.random() < 0.5 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 12, 13, 40])))) for i in range(30)] + [(98, None), (99, "a " * 40)]
    documents = []
    for d in range(80):
        words = [word() for _ in range(rng.choice([0, 8, 60]))]
        source = (rng.choice(items)[1] or "").split()
        n = rng.choice([10, 11, 12, 13, 20])
        if len(source) >= n:
            a = rng.randrange(len(source) - n + 1)
            words[len(words) // 2 : len(words) // 2] = [w.upper() for w in source[a : a + n]]
        documents.append((d, rng.choice([" ", ", ", " 1\n"]).join(words)))
    documents += [(100, None), (101, "A-" * 13), (102, documents[0][1])]
    d = spark.createDataFrame(documents, "doc_id int, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1))
    want = brute_leaks(documents, items)
    assert any(want)
    for limit in (leakage.BROADCAST_FINGERPRINTS, 0):  # both ways of joining
        assert sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, broadcast_limit=limit).collect()) == want
    assert leakage.find_leaks(d, i.limit(0)).count() == leakage.find_leaks(d.limit(0), i, broadcast_limit=0).count() == 0
    long_items = [(200 + k, " ".join(word() for _ in range(60))) for k in range(60)]
    inside = [(k, " ".join(word() for _ in range(9)) + " " + " ".join(t.split()[k % 40 : k % 40 + 12]) + " " + word()) for k, (_, t) in enumerate(long_items)]
    many, long_ = spark.createDataFrame(inside, "doc_id int, text string"), spark.createDataFrame(long_items, "item_id int, text string")
    assert sorted(map(tuple, leakage.find_leaks(many, long_, broadcast_limit=0).collect())) == brute_leaks(inside, long_items)
    twice = d.unionAll(d)
    for limit in (leakage.BROADCAST_FINGERPRINTS, 0):
        assert leakage.find_leaks(twice, i, broadcast_limit=limit).count() == len(want)


def test_bitmap_holds_every_fingerprint(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 500, np.uint64)
    h[:3] = [0, 2**64 - 1, 2**63]
    bits = np.frombuffer(leakage._bitmap(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "_gram bigint")), np.uint8)
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little"))) == set((h >> np.uint64(64 - leakage.FILTER_BITS)).tolist())


def test_every_window_keeps_a_fingerprint():
    rng = np.random.default_rng(0)
    words, counts = rng.integers(0, 50, 400).astype(np.uint64), np.array([0, 100, 5, 6, 12, 277])
    _, _, at = leakage.fingerprints(words, counts)
    ends = np.cumsum(counts)
    for s, e in zip(ends - counts, ends):
        assert all(((at >= a) & (at <= a + leakage.WINDOW - 1)).any() for a in range(s, e - leakage.SPAN + 1))


# --- pieces


@needs_vocabulary
def test_pieces_cover_overlap_and_fit(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeघкé木") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 15))) + rng.choice([". ", "! ", "。", ".\n\n"])
    texts = ["".join(sentence() for _ in range(n)) for n in (1, 30, 200)] + ["木" * 3000, "x" * 9000, " " * 4000, "\n" * 900, "a b " * 2000, None, "", "short"]
    limit, overlap = 200, 20
    own = bpe.Encoder(VOCABULARY.read_bytes())
    out = {}
    for r in pieces.split_documents(docs(spark, texts), limit=limit, overlap=overlap).orderBy("doc_id", "piece_no").collect():
        out.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        got = out[i]
        n = len(own.encode([t])[0]) if t else 0
        assert (len(got) > 1) == (n > limit) and [r["piece_no"] for r in got] == list(range(len(got)))
        if len(got) == 1:
            assert got[0]["piece"] == t and got[0]["n_tokens"] == n
            continue
        assert got[0]["start"] == 0 and got[-1]["end"] == len(t)
        for r in got:
            assert r["piece"] == t[r["start"] : r["end"]] and len(own.encode([r["piece"]])[0]) == r["n_tokens"] <= limit
        for a, b in zip(got, got[1:]):
            assert a["start"] < b["start"] < a["end"] < b["end"]
            shared = len(own.encode([t[b["start"] : a["end"]]])[0])
            assert overlap - 3 <= shared <= overlap + 6
    natural = {e for e in pieces.boundaries(texts[2])}
    assert all(r["end"] in natural for r in out[2][:-1])


def test_merge_prefers_weak_boundaries():
    W, S, P = pieces.WORD, pieces.SENTENCE, pieces.PARAGRAPH
    assert pieces.merge([4, 4, 4, 4], [S, P, S], 8) == [0, 2]
    assert pieces.merge([5, 5, 5], [W, W], 4) == [0, 1, 2] and pieces.merge([1], [], 9) == [0]
    assert pieces.merge([3, 3, 3, 3], [W, S, W], 12) == [0]
    sizes, strengths = [1] * 400, [W] * 399
    groups = pieces.merge(sizes, strengths, 16)
    assert max(np.diff([*groups, 400])) <= 16


@needs_vocabulary
def test_no_piece_is_ever_over_the_limit():
    own = bpe.Encoder(VOCABULARY.read_bytes())
    rng = random.Random(3)
    texts = ["".join(rng.choice("aё木🜁 \u0301zq\n") for _ in range(200)), "\U0001f701" * 60, "ё" * 90, "a1" * 90]
    for text in texts:
        for limit, overlap in ((4, 0), (4, 1), (5, 1), (9, 4), (40, 19), (40, 0)):
            got = pieces.split_text(text, own, limit, overlap)
            assert all(len(own.encode([text[a:b]])[0]) == n <= limit for a, b, n in got) and got[0][0] == 0 and got[-1][1] == len(text)
        assert all(x[0] <= y[0] <= x[1] < y[1] for x, y in zip(got, got[1:]))
    assert list(pieces._bounds(10, 4)) == [(10, 4), (8, 4), (6, 4), (3, 2), (2, 1), (1, 0)]


def test_missing_vocabulary_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bpe.encode_texts(docs(spark, ["a"]), folder=str(tmp_path))


def test_overlap_must_leave_room(spark):
    with pytest.raises(ValueError):
        pieces.split_documents(docs(spark, ["a"]), limit=100, overlap=60)
