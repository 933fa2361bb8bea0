"""Corpus analytics: lemmas, multi-word merging, counts, n-grams, first occurrences, ranking, rank-frequency pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN_PUNCTUATION, ColumnLike, _c, strip_marks
from lexmill.functions.text import sentences as sentences_of
from lexmill.operators.rows import number_rows, sections
from lexmill.session import broadcast_if_small

# Fixed values of the affix and multi-word rules: affixes stripped one after the other while the
# rest is a word, suffixes tried last, heads of multi-word entries, and words that continue one.
SEQUENTIAL = [("be", ""), ("du", ""), ("", "li"), ("", "ya"), ("", "ne"), ("", "do")]
LAST_RESORT = ["lari", "cu", "gi", "mo"]
CONTINUATIONS = ["kom", "xafe", "lefe", "leya", "xaya", "na", "hu", "mara", "watu", "din", "noce", "leki", "xaki"]


def char_ngrams(text: ColumnLike, longest: int = 3, include_last: bool = False) -> Column:
    """Character n-grams of the blank-separated tokens, letters only, as struct(n, gram).

    As counted by default, the last position of a word and a gram equal to the whole word are
    left out; ``include_last`` counts them.
    """
    extra = 1 if include_last else 0
    words = F.split(F.lower(_c(text)), " ")

    def grams(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: n < F.length(w) + extra)
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + extra), lambda j: F.struct(n.alias("n"), F.substr(w, j, n).alias("gram")))))

    return F.filter(F.flatten(F.transform(words, grams)), lambda g: g["gram"].rlike(r"^\p{L}+\z"))


def ngram_counts(texts: DataFrame, text: str, longest: int = 3, include_last: bool = False) -> DataFrame:
    """(n, gram, cnt). Words are counted first, so that grams are formed once a distinct word."""
    words = texts.select(F.explode(F.split(F.lower(text), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("_c"))
    grams = words.select("_c", F.explode(char_ngrams("w", longest, include_last)).alias("g"))
    return grams.groupBy("g.n", "g.gram").agg(F.sum("_c").alias("cnt"))


def lemmas(tokens: DataFrame, token: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(token, lemma) of the distinct tokens; lemma is null for those no rule leads to a word.

    Marks are trimmed and case is lowered. Each affix of ``SEQUENTIAL`` goes if the rest is a
    word; the result counts if it is a word itself, else the first suffix of ``LAST_RESORT``
    without which it is one. The vocabulary is probed by joins on the few candidates of each
    distinct token.
    """
    vocab = vocabulary.select(F.col(word).alias("_v")).where("_v is not null").distinct()
    base = tokens.select(F.col(token).alias("token")).where("token is not null").distinct().withColumn("_c", F.lower(strip_marks("token", TOKEN_PUNCTUATION + "\n")))

    def without(c: Column, affix: Column) -> Column:
        prefix, suffix = affix["prefix"], affix["suffix"]
        return (
            F.when((prefix != "") & F.startswith(c, prefix), F.substr(c, F.length(prefix) + 1))
            .when((suffix != "") & F.endswith(c, suffix), F.substr(c, F.lit(1), F.length(c) - F.length(suffix)))
            .otherwise(c)
        )

    # The affixes are folded over as data: spelled out step by step the plan would double with each.
    affixes = lambda pairs: F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("suffix")) for p, s in pairs])
    last_resort = affixes([("", s) for s in LAST_RESORT])
    every = F.concat(affixes(SEQUENTIAL), last_resort)
    forms = F.aggregate(every, F.array("_c"), lambda acc, a: F.array_union(acc, F.transform(acc, lambda c: without(c, a))))
    asked = base.select("token", "_c", F.explode(forms).alias("_v"))
    known = asked.join(vocab, "_v").groupBy("token").agg(F.collect_set("_v").alias("_known"))
    out = base.join(known, "token", "left").where("_known is not null")
    isin = lambda c: F.array_contains("_known", c)
    stripped = F.aggregate(affixes(SEQUENTIAL), F.col("_c"), lambda c, a: F.when(isin(without(c, a)), without(c, a)).otherwise(c))
    out = out.select("token", "_c", "_known", stripped.alias("_s"))
    tries = F.filter(F.transform(last_resort, lambda a: without(F.col("_s"), a)), isin)
    lemma = F.when(F.col("_c") == "", F.lit(None).cast("string")).when(isin(F.col("_s")), F.col("_s")).otherwise(F.get(tries, 0))
    found = out.select("token", lemma.alias("lemma"))
    return base.select("token").join(found, "token", "left")


def merge_words(raw: list[str], lemma_of: dict[str, str | None], entries: set[str]) -> list[str]:
    """Entries a sentence uses, left to right: lemmas, greedily joined to multi-word entries.

    ``fe`` takes up to two more words, ``cel``, ``he`` and ``no`` one, and any entry one of
    ``CONTINUATIONS``. A token without a lemma begins an entry only with a continuation word.
    """
    low = [w.lower() for w in raw]
    lem = lambda k: lemma_of.get(low[k]) if k < len(low) else None
    out, i, n = [], 0, len(raw)
    while i < n:
        entry = lem(i)
        if not entry:
            nxt = lem(i + 1)
            if i + 1 < n and nxt in CONTINUATIONS:
                joined = f"{low[i]} {nxt}"
                entry = joined if joined in entries else f"(fe) {joined}" if f"(fe) {joined}" in entries else None
                i += 2
            if not entry:
                i += 1
                continue
        entry = entry.strip(TOKEN_PUNCTUATION)
        heads = {"fe": 2, "cel": 1, "he": 1, "no": 1 if i + 2 < n else 0}.get(entry, 0)
        while heads and (nxt := lem(i + 1)) and f"{entry} {nxt}" in entries:
            entry, i, heads = f"{entry} {nxt}", i + 1, heads - 1
        nxt = lem(i + 1)
        if nxt in CONTINUATIONS and f"{entry} {nxt}" in entries:
            entry, i = f"{entry} {nxt}", i + 1
        out.append(entry)
        i += 1
    return out


def merged_entries(sentences: DataFrame, key: Sequence[str], sentence: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(key, seq, entry): the entries each sentence uses, in order.

    The scan over a sentence is stateful, so it runs in Python over Arrow batches. It needs
    no vocabulary there: the lemmas of a sentence's tokens and those of its token pairs and
    triples that are entries come with the sentence, found by joins.
    """
    rows = sentences.select(*key, F.col(sentence).alias("_s")).where("_s is not null").withColumn("_t", F.split("_s", " "))
    flat = rows.select(*key, F.explode(F.array_distinct(F.transform("_t", lambda t: F.lower(t)))).alias("token"))
    known = lemmas(flat, "token", vocabulary, word).where("lemma is not null")
    own = flat.join(known, "token").groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_l"))
    multi = vocabulary.select(F.col(word).alias("entry")).where(F.contains("entry", F.lit(" "))).distinct()
    # Candidate multi-word entries share a first word with the sentence; their number is the dictionary's, not the corpus'.
    heads = multi.withColumn("_h", F.split(F.regexp_replace("entry", r"^\(fe\) ", ""), " ")[0])
    first = flat.join(known, "token", "left").select(*key, F.explode(F.array_distinct(F.array_compact(F.array("token", "lemma")))).alias("_h"))
    fitting = first.join(heads, "_h").groupBy(*key).agg(F.collect_set("entry").alias("_e"))
    joined = rows.join(own, list(key), "left").join(fitting, list(key), "left")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, tokens, lemma_of, entries in zip(frame[list(key)].itertuples(index=False), frame["_t"], frame["_l"], frame["_e"]):
                table = dict(lemma_of) if lemma_of is not None else {}
                held = set(entries) if entries is not None else set()
                out += [(*k, i, e) for i, e in enumerate(merge_words(list(tokens), table, held))]
            yield pd.DataFrame(out, columns=[*key, "seq", "entry"])

    return joined.select(*key, "_t", "_l", "_e").mapInPandas(run, f"{fields}, seq int, entry string")


def word_counts(tokens: DataFrame, text: str, word: str) -> DataFrame:
    """(text, word, cnt, total): the count in each text and, where ``total`` is 1 and text null, over all texts; a text without a name is one of its own."""
    counts = tokens.where(F.col(word).isNotNull()).rollup(word, text).agg(F.count(F.lit(1)).alias("cnt"), F.grouping(text).cast("int").alias("total"), F.grouping(word).alias("_all"))
    return counts.where("_all = 0").select(text, word, "cnt", "total")


def first_passages(uses: DataFrame, word: str, passage: str, order: Sequence[str], longer_than: int = 3) -> DataFrame:
    """(word, passage): the first passage of more than ``longer_than`` tokens that uses the word."""
    long_ones = uses.where(F.size(F.filter(F.split(passage, r"\s+"), lambda t: t != "")) > longer_than)
    return long_ones.groupBy(word).agg(F.min_by(passage, F.struct(*order)).alias(passage))


def emission_order(uses: DataFrame, text_order: str, word: str, position: str) -> DataFrame:
    """Words in the order they are first met: by text, within it by frequency there, then by first use. Columns: word, text_order, cnt, first_pos, rank."""
    per = uses.groupBy(word, text_order).agg(F.count(F.lit(1)).alias("cnt"), F.min(position).alias("first_pos"))
    first = per.groupBy(word).agg(F.min_by(F.struct(text_order, "cnt", "first_pos"), F.col(text_order)).alias("_f")).select(word, "_f.*")
    return number_rows(first, [F.col(text_order), F.desc("cnt"), F.col("first_pos"), F.col(word)], "rank")


def frequency_rank(counts: DataFrame, word: str, cnt: str) -> DataFrame:
    """``counts`` with ``rank`` from 1 by falling count, then falling word."""
    return number_rows(counts, [F.desc(cnt), F.desc(word)], "rank")


def zipf_pairs(ranked: DataFrame, cnt: str, width: int = 201) -> DataFrame:
    """(i, j, b) for every rank i and the first ``width`` ranks j, from 0: ``b = -(r (j + 1) - i + 1) / (1 - r)``, r the ratio of counts; -1 where i = j or r = 1.

    The pairs are a fixed number a row: each row carries the array of the first counts, one small scalar.
    """
    head = ranked.where(F.col("rank") <= width).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(cnt).alias("c")))), lambda x: x["c"]).alias("h"))
    rows = ranked.select((F.col("rank") - 1).alias("i"), F.col(cnt).alias("_c"), head.scalar().alias("_h"))
    pairs = rows.select("i", "_c", F.posexplode("_h").alias("j", "_d"))
    r = F.col("_c") / F.col("_d")
    value = -(r * (F.col("j") + 1) - F.col("i") + 1) / F.when(r != 1, 1 - r)
    return pairs.select("i", F.col("j").cast("bigint").alias("j"), F.when((F.col("i") == F.col("j")) | (r == 1), F.lit(-1.0)).otherwise(value).alias("b"))


def ranking_sections(ranked: DataFrame, fallback: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Ranked words, then fallback words not yet there, then the rest of the dictionary, with ``section``."""
    second = fallback.join(ranked.select(word), word, "left_anti").select(word).distinct()
    third = dictionary.join(ranked.select(word), word, "left_anti").join(fallback.select(word), word, "left_anti").select(word).distinct()
    return sections([ranked.select(word), second, third])


def rank_corpus(texts: DataFrame, text: str, key: str, content: str, vocabulary: DataFrame, fallback: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """(section, rank, word, text, cnt, first_passage): the entries of a dictionary as a corpus uses them.

    Sentences become lemmas and merged entries; entries come in the order of their first text
    (by the order of ``text``), within it by frequency there and first use, each with its first
    passage of more than three tokens. Fallback words and the rest of the dictionary follow,
    without a rank.
    """
    sentences = texts.select(F.col(text).alias("_text"), F.col(key).alias("_doc"), F.posexplode(sentences_of(content)).alias("_no", "_s"))
    at = ["_text", "_doc", "_no"]
    entries = merged_entries(sentences, at, "_s", vocabulary, word).withColumnRenamed("entry", word)
    placed = emission_order(entries.withColumn("_at", F.struct("_doc", "_no", "seq")), "_text", word, "_at")
    passages = first_passages(entries.select(word, *at).distinct().join(sentences, at), word, "_s", at)
    ranked = placed.join(passages, word, "left").select(word, "rank", F.col("_text").alias(text), "cnt", F.col("_s").alias("first_passage"))
    return ranking_sections(ranked, fallback, dictionary, word).join(ranked, word, "left").select("section", "rank", word, text, "cnt", "first_passage")


def emphasise(sentence: ColumnLike, word: ColumnLike, forms: ColumnLike) -> Column:
    """The sentence with ``**`` around the word in each token that is one of its ``forms`` (an array of lower-case tokens without marks)."""
    tokens = F.split(_c(sentence), " ")
    mark = lambda t: F.regexp_replace(t, F.concat(F.lit(r"(?i)(\Q"), _c(word), F.lit(r"\E)")), F.lit("**$1**"))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(_c(forms), F.lower(strip_marks(t))), mark(t)).otherwise(t)), " ")


def phrase_hits(sentences: DataFrame, key: Sequence[str], words: str, phrases: DataFrame, phrase: str, longest: int = 5) -> DataFrame:
    """(key, start, phrase) for every phrase (words parted by blanks) that stands in a sentence's word array.

    Windows of one to ``longest`` words are formed only where the first word of a phrase
    stands. Phrases are broadcast if Catalyst's bound of their size allows it, else the same
    joins shuffle.
    """
    known = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null").distinct()
    heads, known = broadcast_if_small(known.select(F.split("phrase", " ")[0].alias("_h")).distinct()), broadcast_if_small(known)
    places = sentences.select(*key, F.col(words).alias("_t"), F.posexplode(words).alias("_i", "_h"))
    places = places.select(*key, (F.col("_i") + 1).alias("start"), "_h", F.slice("_t", F.col("_i") + 1, longest).alias("_t")).join(heads, "_h", "left_semi")
    windows = F.transform(F.sequence(F.lit(1), F.size("_t")), lambda n: F.array_join(F.slice("_t", 1, n), " "))
    return places.select(*key, "start", F.explode(windows).alias("phrase")).join(known, "phrase").select(*key, "start", "phrase")


def two_word_entries(tokens: DataFrame, partition: Sequence[str], order: Sequence[str], token: str, entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Places where a token and its follower make an entry."""
    follow = F.lead(token).over(Window.partitionBy(*partition).orderBy(*order))
    pairs = tokens.withColumn("_next", follow).where("_next is not null").withColumn(entry, F.concat_ws(" ", token, "_next")).drop("_next")
    return pairs.join(entries.select(entry).distinct(), entry, "left_semi")
