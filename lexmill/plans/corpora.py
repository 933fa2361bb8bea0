"""Queries over the documents: counts, n-grams, lemmas, first occurrences, ranking, rank-frequency pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus, graph, rows
from lexmill.plans.lexical import gloss_items, sentences, words
from lexmill.plans.twins import WORDS, strip
from lexmill.session import table
from lexmill.sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOK = r"tok as (select doc_id, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) as w, generate_subscripts(regexp_extract_all(lower(text), '\p{L}+'), 1) - 1 as pos from documents where text is not null)"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", "source", F.posexplode(T.letter_tokens("text")).alias("pos", "w"))


@query(f"with {_TOK} select w, count(*) as cnt from tok group by w")
def c_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))


@query("select w, count(*) as cnt from (select unnest(string_split(text, ' ')) as w from documents where text is not null) group by w")
def c_split_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.explode(T.tokens_by_blank("text")).alias("w"))
    return d.groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"with {_TOK} select source, w, count(*) as cnt, grouping(source)::int as total from tok group by grouping sets ((w, source), (w))")
def c_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each source and over all."""
    return corpus.word_counts(tokens(spark, sf), "source", "w")


@query(f"with {_TOK} select sum(cnt)::bigint as total, count(*) as distinct_words from (select w, count(*) as cnt from tok group by w)")
def c_total(spark: SparkSession, sf: str) -> DataFrame:
    counts = c_token_counts(spark, sf)
    return counts.agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("distinct_words"))


_GRAMS = r"""
with w as (select w, count(*) as c from (select unnest(string_split(lower(text), ' ')) as w from documents where text is not null) group by w),
n as (select w, c, unnest(range(1, least(length(w) - 1 + {extra}, 3) + 1)) as n from w),
g as (select c, n, w[j:j + n - 1] as gram from (select w, c, n, unnest(range(1, length(w) - n + 1 + {extra})) as j from n))
select n::int as n, gram, sum(c)::bigint as cnt from g where regexp_full_match(gram, '\p{{L}}+') group by all
"""


@query(_GRAMS.format(extra=0))
def c_char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-grams as counted by default, without the last position of a word."""
    return corpus.ngram_counts(table(spark, sf, "documents").where("text is not null"), "text")


@query(_GRAMS.format(extra=1))
def c_char_ngrams_whole(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ngram_counts(table(spark, sf, "documents").where("text is not null"), "text", include_last=True)


_BARE = "btok as (select distinct t as token, lower(trim(t, ':;#,.\"“”!?-*/+' || chr(10))) as c0 from (select unnest(string_split(text, ' ')) as t from documents where text is not null))"


def _lemma_sql() -> str:
    steps, at = [], "c0"
    for i, (prefix, suffix) in enumerate(corpus.SEQUENTIAL, 1):
        bare = f"(case when starts_with({at}, '{prefix}') then substr({at}, {len(prefix) + 1}) else {at} end)" if prefix else f"(case when ends_with({at}, '{suffix}') then left({at}, length({at}) - {len(suffix)}) else {at} end)"
        steps.append(f"s{i} as (select *, case when {bare} in (select word from v) then {bare} else {at} end as c{i} from {'btok' if i == 1 else f's{i - 1}'})")
        at = f"c{i}"
    last = [f"(case when ends_with({at}, '{s}') then left({at}, length({at}) - {len(s)}) else {at} end)" for s in corpus.LAST_RESORT]
    tries = " ".join(f"when {x} in (select word from v) then {x}" for x in last)
    return f"with v as (select word from word_list where word is not null union select unnest(regexp_extract_all(lower(translationeng), '\\p{{L}}+')) from word_list), {_BARE}, {', '.join(steps)} select token, case when {at} = '' then null when {at} in (select word from v) then {at} {tries} end as lemma from s{len(steps)}"


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The words of the list and those of its glosses."""
    w = table(spark, sf, "word_list")
    return w.select("word").unionByName(w.select(F.explode(T.letter_tokens("translationeng")).alias("word"))).where("word is not null").distinct()


@query(_lemma_sql())
def c_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").where("text is not null").select(F.explode(T.tokens_by_blank("text")).alias("t"))
    return corpus.lemmas(t, "t", vocabulary(spark, sf))


@query()
def c_merged_entries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences("text")).alias("no", "s"))
    return corpus.merged_entries(d, ["doc_id", "no"], "s", vocabulary(spark, sf))


_SENT = rf"sent as (select doc_id, unnest(v) || '.' as s, generate_subscripts(v, 1) - 1 as no from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda s: {strip('s')}), lambda s: s <> '') as v from documents where text is not null))"


@query(rf"with {_SENT}, u as (select distinct w, s, doc_id, no from (select unnest(regexp_extract_all(lower(s), '\p{{L}}+')) as w, s, doc_id, no from sent where len(list_filter(regexp_split_to_array(s, '[ \t\n\x0b\f\r]+'), lambda t: t <> '')) > 3)) select w, arg_min(s, doc_id * 100000 + no) as s from u group by w")
def c_first_passages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences("text")).alias("no", "s"))
    uses = d.select("doc_id", "no", "s", F.explode(F.array_distinct(T.letter_tokens("s"))).alias("w"))
    return corpus.first_passages(uses, "w", "s", ["doc_id", "no"]).select("w", "s")


@query(f"""
with {_TOK}, p as (select w, source, count(*) as cnt, min(doc_id * 1000000 + pos) as first_pos from tok group by all), r as (select *, row_number() over (partition by w order by source) as k from p)
select w, source, cnt, first_pos, row_number() over (order by source, cnt desc, first_pos, w) as rank from r where k = 1
""")
def c_first_emission(spark: SparkSession, sf: str) -> DataFrame:
    """Words in the order they are first met, the sources being the texts."""
    t = tokens(spark, sf).withColumn("at", F.col("doc_id") * 1000000 + F.col("pos"))
    return corpus.emission_order(t, "source", "w", "at").select("w", "source", "cnt", "first_pos", "rank")


@query(f"with {_TOK} select w, count(*) as cnt, row_number() over (order by count(*) desc, w desc) as rank from tok group by w")
def c_frequency_rank(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.frequency_rank(c_token_counts(spark, sf), "w", "cnt")


@query(f"""
with {_TOK}, r as (select w, cnt, row_number() over (order by cnt desc, w desc) - 1 as i from (select w, count(*) as cnt from tok group by w)), x as (select a.i, b.i as j, a.cnt / b.cnt as r from r a, r b where b.i <= 200)
select i, j, round(case when i = j or r = 1 then -1 else -(r * (j + 1) - i + 1) / (1 - r) end, 6) as b from x
""")
def c_zipf_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-frequency pairs of all words, each with the first 201 ranks."""
    return corpus.zipf_pairs(c_frequency_rank(spark, sf), "cnt").withColumn("b", F.round("b", 6))


@query(f"""
with {_TOK}, top as (select distinct w as word from tok), fb as (select distinct c1 as word from dump_tc where c1 not in (select word from top))
select word, 0 as section from top union all select word, 1 from fb union all select distinct word, 2 from word_list where word is not null and word not in (select word from top) and word not in (select word from fb)
""")
def c_ranking_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The words of the documents, then the headwords of the dump, then the rest of the dictionary."""
    top = c_token_counts(spark, sf).select(F.col("w").alias("word"))
    fallback = table(spark, sf, "dump_tc").select(F.col("c1").alias("word"))
    return corpus.ranking_sections(top, fallback, table(spark, sf, "word_list").where("word is not null").select("word"))


@query()
def c_corpus_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ranking: dictionary entries in the order the sources use them, with their first sentence, then headwords, then the rest."""
    texts = table(spark, sf, "documents").where("text is not null").select("source", "doc_id", "text")
    fallback = table(spark, sf, "dump_tc").select(F.col("c1").alias("word"))
    return corpus.rank_corpus(texts, "source", "doc_id", "text", vocabulary(spark, sf), fallback, table(spark, sf, "word_list").where("word is not null").select("word"))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of the word list, hyphens read as blanks, the items of its glosses, and the headwords of the dump."""
    w = table(spark, sf, "word_list").where("word is not null").select(F.lower(F.regexp_replace("word", "-", " ")).alias("p"))
    return w.unionByName(gloss_items(spark, sf).select(F.lower("gloss").alias("p"))).unionByName(table(spark, sf, "dump_tc").select(F.col("c1").alias("p")))


_PHRASES = f"{WORDS}, d as (select distinct lower(regexp_replace(word, '-', ' ', 'g')) as phrase from word_list where word is not null union select lower({strip("unnest(string_split(translationeng, ','))")}) from words where translationeng is not null union select distinct c1 from dump_tc)"


@query(rf"""
with {_SENT}, i as (select doc_id, no, regexp_extract_all(lower(s), '\p{{L}}+') as t from sent),
w as (select doc_id, no, n, unnest(range(1, len(t) - n + 2)) as start, t from (select doc_id, no, t, unnest(range(1, 6)) as n from i) where n <= len(t)), {_PHRASES}
select doc_id, no::int as no, start::int as start, array_to_string(t[start:start + n - 1], ' ') as phrase from w where array_to_string(t[start:start + n - 1], ' ') in (select phrase from d)
""")
def c_phrase_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary phrases in the sentences of the documents."""
    t = sentences(spark, sf).select("doc_id", "no", T.letter_tokens("s").alias("t"))
    return corpus.phrase_hits(t, ["doc_id", "no"], "t", phrases(spark, sf), "p")


@query(rf"""
with {_TOK}, p as (select w || ' ' || lead(w) over (partition by doc_id order by pos) as entry, doc_id, pos from tok), {_PHRASES}
select doc_id, entry, count(*) as n from p where entry in (select phrase from d where regexp_full_match(phrase, '\S+ \S+')) group by all
""")
def c_two_word_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The two-word entries of the dictionary wherever they stand in documents."""
    e = phrases(spark, sf).where(F.col("p").rlike(r"^\S+ \S+\z")).withColumnRenamed("p", "entry")
    return corpus.two_word_entries(tokens(spark, sf), ["doc_id"], ["pos"], "w", e).groupBy("doc_id", "entry").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
with {_SENT} select doc_id, no::int as no, array_to_string(list_transform(string_split(s, ' '), lambda x: case when lower(trim(x, ':;#,."“”!?-*/+' || chr(10))) in ('the', 'some') then regexp_replace(x, '(?i)(the|some)', '**\1**') else x end), ' ') as marked from sent
""")
def c_emphasis(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the documents with two words emphasised."""
    one = corpus.emphasise("s", F.lit("the"), F.array(F.lit("the")))
    return sentences(spark, sf).select("doc_id", "no", one.alias("m")).select("doc_id", "no", corpus.emphasise("m", F.lit("some"), F.array(F.lit("some"))).alias("marked"))


# --- sets, hierarchies and synsets ------------------------------------------------------------


@query("select n_nationkey::bigint as node, 100 + n_regionkey::bigint as ancestor, 1::bigint as depth from nation union all select n_nationkey, 999, 2 from nation union all select 100 + r_regionkey, 999, 1 from region")
def h_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(_edges(spark, sf))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 100).cast("bigint").alias("dst"))
    return n.unionByName(table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("src"), F.lit(999).cast("bigint").alias("dst")))


_TREE = "with recursive e(src, dst) as (select p_partkey, p_partkey // 2 from part where p_partkey > 1), r(node, ancestor, depth) as (select src, dst, 1 from e union all select r.node, e.dst, r.depth + 1 from r join e on r.ancestor = e.src)"


@query(_TREE + " select node::bigint as node, count(*) as n, max(depth)::bigint as depth from r group by node")
def h_deep_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors in a binary tree over the parts."""
    e = table(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return graph.ancestors(e).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@query("select s_suppkey as synset_id from supplier join nation on s_nationkey = n_nationkey where n_regionkey in (1, 2) union all select 100000 from region where r_regionkey = 0")
def h_under_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers under two regions, through their nation; a topic is under itself."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10000).alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    closure = graph.ancestors(_edges(spark, sf).unionByName(s))
    topics = spark.createDataFrame([(101,), (102,), (110000,)], "topic_id bigint")
    cand = s.select(F.col("src").alias("synset_id")).unionByName(spark.createDataFrame([(110000,)], "synset_id bigint"))
    return graph.under(cand, topics, closure).select((F.col("synset_id") - 10000).alias("synset_id"))


@query("select s_suppkey as word, s_nationkey::bigint as topic_id from supplier where s_suppkey % 2 = 0 union all select s_suppkey, 100 + n_regionkey from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 2 = 1")
def h_drop_dominated(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of each supplier: the world, its region and, for every other one, its nation; the most specific stays."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    region, nation = (F.col("n_regionkey") + 100).cast("bigint"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("bigint"))
    topics = s.select(F.col("s_suppkey").alias("word"), F.explode(F.array_compact(F.array(nation, region, F.lit(999).cast("bigint")))).alias("topic_id"))
    return graph.drop_dominated(topics, graph.ancestors(_edges(spark, sf)))


@query("""
select s_suppkey as k, s_nationkey as w, case when s_acctbal < 1000 then 'other' when s_acctbal < 3000 or s_acctbal > 6000 then 'applicable' else 'other' end as status from supplier
""")
def h_synset_status(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("w"), "s_acctbal")
    marks = t.where("s_acctbal < 3000").withColumn("app", F.when(F.col("s_acctbal") < 1000, "").otherwise("s")).withColumn("vetted", F.lit("v"))
    return graph.synset_status(t, t.where("s_acctbal > 6000"), marks, ["k", "w"])


def _network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A lexical network made of the dump: a sense is a synset, languages stand in for its lexicons."""
    d = table(spark, sf, "dump_tc").where("c4 is not null and c6 is not null and c2 is not null")
    en = d.select(F.concat(F.lit("en/"), "c2", F.lit("/"), "c4").alias("synset_id"), "c4", "c2", F.col("c1").alias("lemma"), F.lit("en").alias("lexicon"))
    es = d.where("c5 in ('qig', 'qct', 'qbb')").select(F.concat(F.lit("es/"), "c2", F.lit("/"), "c4").alias("synset_id"), "c4", "c2", F.col("c6").alias("lemma"), F.lit("es").alias("lexicon"))
    both = en.unionByName(es).withColumn("ili", F.concat("c2", F.lit("/"), "c4"))
    epo = d.where("c5 = 'qcp'").select(F.concat("c2", F.lit("/"), "c4").alias("ili"), F.col("c6").alias("lemma"), F.col("row_id").alias("ord"))
    return both.select("synset_id", "ili", F.col("c2").alias("pos"), "lexicon").distinct(), both.select("synset_id", "lemma").distinct(), epo


_SCORED = """
with d as (select * from dump_tc where c4 is not null and c6 is not null and c2 is not null),
en as (select c2 || '/' || c4 as ili, c2 as pos, list(distinct c1) as l from d group by all),
es as (select c2 || '/' || c4 as ili, list(distinct c6) as l from d where c5 in ('qig', 'qct', 'qbb') group by all),
ep as (select c2 || '/' || c4 as ili, arg_min(c6, row_id) as l from d where c5 = 'qcp' group by all),
q as (select 'w' || c1 as word, 0 as group_no, c2 as pos, [c1] as eng, list(distinct c6) filter (where c5 in ('qig', 'qct', 'qbb')) as spa, list_sort(list(distinct c6) filter (where c5 = 'qcp')) as epo from d group by c1, c2),
q2 as (select word, group_no, pos, eng, coalesce(spa, []) as spa, coalesce(epo, []) as epo from q),
eu as (select pos, ili, unnest(l) as w from en), su as (select en.pos, es.ili, unnest(es.l) as w from es join en using (ili)),
h as (select distinct word, q2.pos, ili, true as english from (select word, pos, unnest(eng) as w from q2) q2 join eu using (pos, w) union all select distinct word, q2.pos, ili, false from (select word, pos, unnest(spa) as w from q2) q2 join su using (pos, w)),
k as (select word, pos, ili, bool_or(english) as english from h group by all),
c as (select q2.*, k.ili, en.l as el, es.l as sl, ep.l as pl, k.english, true as spanish from k join q2 using (word, pos) join en on en.ili = k.ili left join es on es.ili = k.ili left join ep on ep.ili = k.ili),
scored as (
  select word, group_no, pos, ili, english and (case when sl is not null then len(list_intersect(el, eng)) + len(list_intersect(sl, spa)) >= [0, 1, 2, 2][least(len(eng) + len(spa), 3) + 1] else len(list_intersect(el, eng)) >= [0, 1, 2, 2][least(len(eng), 3) + 1] end or coalesce(pl = epo[1], false)) as applicable from c where english or spanish)
"""


@query(_SCORED + "select * from scored")
def h_score_synsets(spark: SparkSession, sf: str) -> DataFrame:
    return graph.score_synsets(_queries(spark, sf), *_network(spark, sf)).select("word", "group_no", "pos", "ili", "applicable")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dump_tc").where("c4 is not null and c6 is not null and c2 is not null")
    q = d.groupBy("c1", "c2").agg(F.collect_set(F.when(F.col("c5").isin("qig", "qct", "qbb"), F.col("c6"))).alias("spa"), F.array_sort(F.collect_set(F.when(F.col("c5") == "qcp", F.col("c6")))).alias("epo"))
    return q.select(F.concat(F.lit("w"), "c1").alias("word"), F.lit(0).alias("group_no"), F.col("c2").alias("pos"), F.array("c1").alias("eng"), "spa", "epo")


@query(_SCORED + """, marks as (select distinct 'w' || c1 as word, c2 as pos, c2 || '/' || c4 as ili, c7 = 'm' as good from dump_tc where c4 is not null and c2 is not null and c7 in ('m', 'f')),
tagged as (select distinct 'w' || c1 as word from dump_tc where c7 = 'n'),
m as (select word, 0 as group_no, pos, ili, bool_or(good) as good, bool_or(not good) as bad from marks where (word, pos) in (select word, pos from q2) group by all),
kept as (select word, group_no, pos, ili from scored where applicable and not (pos = 'Noun' and ends_with(word, 'ful')) and not (pos = 'Verb' and word in (select word from tagged))),
every as (select word, group_no, pos, ili from scored union select word, group_no, pos, ili from m)
select e.word, e.group_no, e.pos, e.ili, case when m.bad then 'other' when m.good or k.word is not null then 'applicable' else 'other' end as status
from every e left join m using (word, group_no, pos, ili) left join kept k using (word, group_no, pos, ili)
""")
def h_align_synsets(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, topics and reviewers in one: every synset lies under its part of speech; nouns on -ful and tagged verbs want another one."""
    synsets, lemmas, epo = _network(spark, sf)
    above = synsets.select(F.col("synset_id").alias("src"), F.concat(F.lit("topic/"), "pos").alias("dst")).distinct()
    suffixes = spark.createDataFrame([("ful", "Noun", "topic/Adjective", 0)], "suffix string, pos string, topic_id string, ord int")
    topics = spark.createDataFrame([("n", "Verb", "hypernym", "topic/Noun")], "tag string, pos string, kind string, topic_id string")
    d = table(spark, sf, "dump_tc").withColumn("word", F.concat(F.lit("w"), "c1"))
    marks = d.where("c4 is not null and c2 is not null and c7 in ('m', 'f')").select("word", F.col("c2").alias("pos"), F.concat("c2", F.lit("/"), "c4").alias("ili"), F.when(F.col("c7") == "m", "s").otherwise("").alias("app"), F.lit("v").alias("vetted"))
    tags = d.where("c7 = 'n'").select("word", F.lit("n").alias("tag")).distinct()
    instances = spark.createDataFrame([], "src string, dst string")
    return graph.align_synsets(_queries(spark, sf), synsets, lemmas, epo, closure=graph.ancestors(above), suffixes=suffixes, tags=tags, topics=topics, instances=instances, markings=marks)


@query("""
with s as (select c1, list_sort(list(distinct c6) filter (where c7 = 'm' and c6 is not null)) as a, list_sort(list(distinct c6) filter (where c7 = 'f' and c6 is not null)) as b from dump_tc group by c1)
select c1, case when len(list_intersect(a, b)) > 0 then len(list_intersect(a, b)) else coalesce(len(a), 0) end::int as n from s
""")
def h_progressive(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dump_tc")
    s = d.groupBy("c1").agg(*[F.collect_set(F.when(F.col("c7") == k, F.col("c6"))).alias(k) for k in "mf"])
    return s.select("c1", F.size(graph.progressive_intersection(F.array("m", "f"))).alias("n"))


# --- order-aware row operators over the driver's tables -----------------------------------------


@query("select event_type, run_no, count(*) as n, min(event_id) as first_id from (select *, sum(chg) over (partition by user_id order by ts, event_id) as run_no from (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is not distinct from event_type then 0 else 1 end as chg from events)) group by user_id, event_type, run_no")
def w_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = rows.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return r.groupBy("user_id", "event_type", "run_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).drop("user_id")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all")
def w_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rows.keep_last(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select md5(text) as digest, min(doc_id) as doc_id from documents where text is not null group by text")
def w_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("text", "doc_id")
    return rows.keep_first(d, ["text"], ["doc_id"]).select(F.md5("text").alias("digest"), "doc_id")


@query("select distinct c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10 from dump_tc")
def w_distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dump_tc").select([f"c{i}" for i in range(11)])
    return readers.distinct_translations(d, "c1")


@query("select line_id from dump_lines where line_no < 100")
def w_line_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The scan limit of the loader."""
    return rows.skip_lines(table(spark, sf, "dump_lines"), "line_no", 100).select("line_id")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as rn from orders")
def w_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Global row numbers without a one-task sort."""
    return rows.number_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "rn")


@query("select block_no, count(*) as n, count(distinct place) as places from (select (row_number() over (order by o_orderkey) - 1) // 5 as block_no, (row_number() over (order by o_orderkey) - 1) % 5 as place from orders) group by block_no")
def w_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of five, shuffled inside; the incomplete last one is kept."""
    b = rows.blocks(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, "seed")
    return b.groupBy("block_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"))


@query("select flag, l_orderkey, revenue from (select *, row_number() over (partition by flag order by revenue desc, l_orderkey) as k from (select l_returnflag as flag, l_orderkey, round(sum(l_extendedprice), 2) as revenue from lineitem group by all)) where k <= 20")
def w_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest orders of each flag."""
    per = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    w = Window.partitionBy("flag").orderBy(F.desc("revenue"), "l_orderkey")
    return per.withColumn("k", F.row_number().over(w)).where("k <= 20").drop("k")


@query("select k, sum(v)::bigint as total, count(*) as n from (select json_extract(props, '$.k')::bigint as v, event_type as k from events) group by k")
def w_json_map(spark: SparkSession, sf: str) -> DataFrame:
    m = readers.json_pairs(table(spark, sf, "events"), "props", ["event_type"])
    return m.where("code = 'k'").groupBy(F.col("event_type").alias("k")).agg(F.sum(F.col("name").cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"with {WORDS} select row_id, array_to_string(list_sort(list_intersect(string_split(tags, ', '), string_split('food, water, sky, plant', ', '))), ', ') as matched from words where tags is not null")
def w_set_render(spark: SparkSession, sf: str) -> DataFrame:
    want = F.array(*[F.lit(x) for x in ("food", "water", "sky", "plant")])
    return words(spark, sf).where("tags is not null").select("row_id", F.array_join(F.array_sort(F.array_intersect(F.split("tags", ", "), want)), ", ").alias("matched"))


