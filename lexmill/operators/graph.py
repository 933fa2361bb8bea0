"""Synset alignment: hierarchy closure, graded overlap, topic filters, status with human overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import broadcast_if_small, cut_lineage

# Overlap wanted for 0, 1, 2, ... query words; the last holds for more.
THRESHOLDS = [0, 1, 2, 2]
# Topic of derived nouns by suffix (in order), topics and classes of nouns by tag, as interlingual ids.
SUFFIX_TOPICS = {
    "dom": "i53558",
    "ya": "i35547",
    "tim": "i69080",
    "sa": "i69527",
    "ismo": "i68061",
    "krasi": "i35610",
    "tul": "i55130",
    "kamer": "i58265",
    "ista": "i88069",
    "yen": "i35561",
    "xey": "i35549",
    "kaxa": "i35546",
    "lari": "i35589",
    "kef": "i88364",
    "ente": "i35561",
}
TAG_TOPICS = {
    "hewan": ["i35563"],
    "piu": ["i43203"],
    "basa": ["i69527"],
    "yamxey": ["i76470"],
    "sabzi": ["i35564", "i105484"],
    "planta": ["i35564", "i105484"],
    "bio": ["i35552"],
    "tul": ["i55130", "i35573"],
    "fruta": ["i105676"],
    "jismulogi": ["i64399"],
    "futru": ["i105042"],
    "gluxey": ["i78658"],
    "mubile": ["i54111"],
    "dom": ["i53558"],
    "klima": ["i97626"],
    "figura": ["i35581"],
    "kimikali monlari": ["i113874"],
    "musikatul": ["i56458"],
    "labas": ["i52057", "i55130"],
    "calyo": ["i52319"],
    "materyal": ["i113651"],
    "petra": ["i114224", "i115285", "i114036"],
    "hoxinlyo": ["i78162", "i35564"],
}
TAG_CLASSES = {
    "daygeo": ["i85253"],
    "dexa": ["i81888"],
}


def topic_tables(synsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffix and tag tables that ``suffix_filter`` and ``tag_filter`` take, with the synsets (synset_id, ili) of their ids."""
    suffixes = [(k, "n", v, i) for i, (k, v) in enumerate(SUFFIX_TOPICS.items())]
    tags = [(k, "n", kind, ili) for table, kind in ((TAG_TOPICS, "hypernym"), (TAG_CLASSES, "instance_of")) for k, v in table.items() for ili in v]
    spark = synsets.sparkSession
    ids = synsets.select("ili", F.col("synset_id").alias("topic_id"))
    a = spark.createDataFrame(suffixes, "suffix string, pos string, ili string, ord int").join(ids, "ili").drop("ili")
    return a, spark.createDataFrame(tags, "tag string, pos string, kind string, ili string").join(ids, "ili").drop("ili")


def ancestors(edges: DataFrame, child: str = "src", parent: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, ancestor, depth) for every node and each of its ancestors, with the least depth; cycles are harmless.

    Each round joins paths with paths, so their length doubles and ``log2`` of the depth many
    rounds suffice. Every round is checkpointed, as the plan would double too.
    """
    paths = cut_lineage(edges.where(f"{child} is not null and {parent} is not null").groupBy(F.col(child).alias("node"), F.col(parent).alias("ancestor")).agg(F.lit(1).cast("bigint").alias("depth")))
    size = paths.count()
    for _ in range(max_rounds):
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node"), F.col("b.ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = cut_lineage(paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        grown = paths.count()
        if grown == size:
            break
        size = grown
    return paths


def under(synsets: DataFrame, topics: DataFrame, closure: DataFrame, synset: str = "synset_id", topic: str = "topic_id") -> DataFrame:
    """Rows of ``synsets`` that are a topic or have one among their ancestors; topics are matched on their shared columns (such as word)."""
    shared = [c for c in topics.columns if c != topic and c in synsets.columns]
    selves = synsets.select(F.col(synset).alias("node"), F.col(synset).alias("ancestor")).distinct()
    reach = closure.select("node", "ancestor").unionByName(selves)
    named = topics.select(*[F.col(c).alias(f"_{c}") for c in shared], F.col(topic).alias("ancestor")).distinct()
    good = reach.join(named, "ancestor").select("node", *[f"_{c}" for c in shared]).distinct()
    condition = [F.col(synset) == F.col("node"), *[F.col(c) == F.col(f"_{c}") for c in shared]]
    return synsets.join(good, condition, "left_semi")


def drop_dominated(topics: DataFrame, closure: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Topics of which no other topic of the same group is a descendant (the most specific ones)."""
    shared = [c for c in topics.columns if c != topic]
    deeper = topics.select(*shared, F.col(topic).alias("node")).join(closure.select("node", "ancestor"), "node").select(*shared, F.col("ancestor").alias(topic)).distinct()
    return topics.join(deeper, [*shared, topic], "left_anti")


def threshold(n: Column, table: Sequence[int] = THRESHOLDS) -> Column:
    """Overlap wanted for ``n`` query words."""
    return F.element_at(F.array(*map(F.lit, table)), F.least(n, F.lit(len(table) - 1)) + 1)


def antonym_confirmed(synsets: DataFrame, rel: DataFrame, lemmas: DataFrame, antonyms: DataFrame, synset: str = "synset_id") -> DataFrame:
    """Rows of ``synsets`` (with ``word``) one of whose antonym synsets has a lemma among the word's antonyms (``word``, ``lemma``)."""
    opposite = rel.where("rel = 'antonym'").select(F.col("src").alias(synset), F.col("dst").alias("_o"))
    theirs = opposite.join(lemmas.select(F.col("synset_id").alias("_o"), "lemma"), "_o").join(antonyms, "lemma").select(synset, "word").distinct()
    return synsets.join(theirs, [synset, "word"], "left_semi")


def score_synsets(queries: DataFrame, synsets: DataFrame, lemmas: DataFrame, epo: DataFrame) -> DataFrame:
    """Candidate synsets of each query with ``applicable``.

    ``queries``: word, group_no, pos, eng, spa, epo (arrays of words). ``synsets``: synset_id,
    ili, pos, lexicon ('en', 'es'). ``lemmas``: synset_id, lemma. ``epo``: ili, lemma, ord.
    A synset is a candidate if an English query word is a lemma of it, or a Spanish one of
    its counterpart. It is applicable if the lemmas of both languages that are query words
    reach the threshold for the number of words (of English alone where there is no
    counterpart), or if its first Esperanto lemma is the first Esperanto query word.

    A lemma that is a query word is one row of a join, without the other words of either side, so
    that no row grows with the number of lemmas; the rows of a query and a synset are then counted.
    """
    held = lemmas.select("synset_id", "lemma").distinct()
    named = synsets.join(held, "synset_id", "left_semi")
    es = named.where("lexicon = 'es'").groupBy("ili").agg(F.min("synset_id").alias("_es"))
    first_epo = epo.groupBy("ili").agg(F.min_by("lemma", "ord").alias("_epo_lemma"))
    # an English 's' answers queries for 's' and 'a'
    served = F.explode(F.when(F.col("pos") == "s", F.array(F.lit("s"), F.lit("a"))).otherwise(F.array("pos"))).alias("pos")
    en = named.where("lexicon = 'en'").select("synset_id", "ili", served).distinct().join(es, "ili", "left").join(first_epo, "ili", "left")
    sources = F.array_compact(F.array(F.struct(F.lit(True).alias("_english"), F.col("synset_id").alias("_held")), F.when(F.col("_es").isNotNull(), F.struct(F.lit(False).alias("_english"), F.col("_es").alias("_held")))))
    offered = en.select("synset_id", "ili", "pos", F.col("_es").isNotNull().alias("_paired"), "_epo_lemma", F.inline(sources))
    offered = offered.join(held.select(F.col("synset_id").alias("_held"), F.col("lemma").alias("_w")), "_held").drop("_held")

    def words(side: str, english: bool) -> Column:
        return F.transform(F.coalesce(F.array_distinct(side), F.array()), lambda w: F.struct(F.lit(english).alias("_english"), w.alias("_w")))

    # size and hash of the words tell two queries of one word, group and part of speech apart
    facts = [F.size("eng").alias("_n_eng"), F.size("spa").alias("_n_spa"), F.get("epo", 0).alias("_epo_word"), F.xxhash64("eng").alias("_eng"), F.xxhash64("spa").alias("_spa")]
    # taken before the words become rows, else each row would hold and hash all of them
    asked = queries.select("word", "group_no", "pos", *facts, F.concat(words("eng", True), words("spa", False)).alias("_words"))
    asked = asked.select(*[c for c in asked.columns if c != "_words"], F.inline("_words"))
    pair = ["word", "group_no", "pos", "synset_id", "ili"]
    # both aggregates below are served by this one shuffle
    met = asked.join(offered, ["_english", "_w", "pos"]).repartition(*pair)
    met = met.groupBy(*pair, "_n_eng", "_n_spa", "_epo_word", "_eng", "_spa", "_paired", "_epo_lemma").agg(F.count_if("_english").alias("_in_en"), F.count_if(~F.col("_english")).alias("_in_es"))
    both = F.when(F.col("_n_spa").isNotNull(), F.col("_in_en") + F.col("_in_es") >= threshold(F.col("_n_eng") + F.col("_n_spa")))
    alone = F.col("_in_en") >= threshold(F.col("_n_eng"))
    score = F.when(F.col("_paired"), both).otherwise(alone) | F.coalesce(F.col("_epo_lemma") == F.col("_epo_word"), F.lit(False))
    return met.groupBy(*pair).agg(F.bool_or((F.col("_in_en") > 0) & score).alias("applicable"))


def _with_ancestry(candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """``candidates`` with ``_up``: the synset and its ancestors, which are as many as the hierarchy is deep."""
    up = closure.groupBy(F.col("node").alias("synset_id")).agg(F.collect_set("ancestor").alias("_a"))
    own = F.array("synset_id")
    return candidates.join(up, "synset_id", "left").withColumn("_up", F.when(F.col("_a").isNull(), own).otherwise(F.concat(own, F.col("_a")))).drop("_a")


def suffix_filter(candidates: DataFrame, suffixes: DataFrame, closure: DataFrame) -> DataFrame:
    """Derived words keep the synsets under the topic of their suffix; words without a known suffix keep all.

    ``suffixes``: suffix, pos, topic_id, ord; the first in order counts. Candidates are read once.
    """
    return _suited_to_suffix(candidates, suffixes, closure).where("_suffix_suits").select(*candidates.columns)


def _suited_to_suffix(candidates: DataFrame, suffixes: DataFrame, closure: DataFrame) -> DataFrame:
    """All ``candidates`` with ``_suffix_suits``, whether ``suffix_filter`` keeps them."""
    tables = suffixes.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("ord", "suffix", "topic_id"))).alias("_s"))
    own = candidates.join(broadcast_if_small(tables), "pos", "left").withColumn("_topic", F.get(F.filter("_s", lambda x: F.endswith("word", x["suffix"])), 0)["topic_id"])
    suits = F.col("_topic").isNull() | F.array_contains("_up", F.col("_topic"))
    return _with_ancestry(own, closure).select(*candidates.columns, suits.alias("_suffix_suits"))


def tag_filter(candidates: DataFrame, tags: DataFrame, topics: DataFrame, closure: DataFrame, instances: DataFrame) -> DataFrame:
    """Words with topical tags keep the synsets under one of their most specific topics, or that are instances of one; others keep all.

    ``tags``: word, tag. ``topics``: tag, pos, kind ('hypernym' or 'instance_of'), topic_id.
    ``instances``: src, dst of the instance relation. Candidates are read once; topics come to
    them as one array a word.
    """
    return _suited_to_tags(candidates, tags, topics, closure, instances).where("_tags_suit").select(*candidates.columns)


def _suited_to_tags(candidates: DataFrame, tags: DataFrame, topics: DataFrame, closure: DataFrame, instances: DataFrame) -> DataFrame:
    """All ``candidates`` with ``_tags_suit``, whether ``tag_filter`` keeps them."""
    own = tags.join(broadcast_if_small(topics), "tag").select("word", "pos", "kind", "topic_id").distinct()
    above = drop_dominated(own.where("kind = 'hypernym'").drop("kind"), closure).groupBy("word", "pos").agg(F.collect_set("topic_id").alias("_above"))
    classes = own.groupBy("word", "pos").agg(F.collect_set(F.when(F.col("kind") == "instance_of", F.col("topic_id"))).alias("_classes"))
    of = instances.join(closure.select(F.col("node").alias("dst"), "ancestor"), "dst", "left")
    of = of.groupBy(F.col("src").alias("synset_id")).agg(F.array_distinct(F.concat(F.collect_set("dst"), F.collect_set("ancestor"))).alias("_of"))
    known = _with_ancestry(candidates, closure).join(of, "synset_id", "left").join(classes.join(above, ["word", "pos"], "left"), ["word", "pos"], "left")
    met = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return known.select(*candidates.columns, (F.col("_classes").isNull() | met("_up", "_above") | met("_of", "_classes")).alias("_tags_suit"))


def synset_status(total: DataFrame, applicable: DataFrame, markings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every candidate with ``status``: reviewers' judgment first ('s' applicable, '' other), then whether it was found applicable.

    Candidates only the markings name as applicable are added. The sets are tagged and reduced by one aggregation.
    """
    return _overruled([total.withColumn("_a", F.lit(None)), applicable.withColumn("_a", F.lit(1))], markings, keys)


def _overruled(found: Sequence[DataFrame], markings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``synset_status`` of candidates with ``_a``, 1 where they were found applicable."""
    tag = lambda df, **flags: df.select(*keys, *[flags.get(f, F.lit(None)).alias(f) for f in ("_a", "_in", "_out")])
    marks = markings.where("vetted = 'v'")
    parts = [*[tag(df, _a=F.col("_a")) for df in found], tag(marks.where("app = 's'"), _in=F.lit(1)), tag(marks.where("app <> 's' or app is null"), _out=F.lit(1))]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    flags = united.groupBy(*keys).agg(*[F.max(F.col(f).cast("int")).alias(f) for f in ("_a", "_in", "_out")])
    status = F.when(F.col("_out") == 1, "other").when((F.col("_in") == 1) | (F.col("_a") == 1), "applicable").otherwise("other")
    return flags.select(*keys, status.alias("status"))


def align_synsets(
    queries: DataFrame, synsets: DataFrame, lemmas: DataFrame, epo: DataFrame, *, closure: DataFrame, suffixes: DataFrame, tags: DataFrame, topics: DataFrame, instances: DataFrame, markings: DataFrame
) -> DataFrame:
    """(word, group_no, pos, ili, status): candidates of every query, scored, kept under the topics of the word's suffix and tags, and overruled by reviewers.

    The inputs are those of ``score_synsets``, ``suffix_filter`` and ``tag_filter``; ``markings``
    has word, pos, ili, app, vetted. Filters mark candidates and keep all, so that each is scored once.
    """
    scored = score_synsets(queries, synsets, lemmas, epo)
    suited = _suited_to_tags(_suited_to_suffix(scored, suffixes, closure), tags, topics, closure, instances)
    found = suited.withColumn("_a", F.when(F.col("applicable") & F.col("_suffix_suits") & F.col("_tags_suit"), 1))
    marks = markings.join(queries.select("word", "group_no", "pos").distinct(), ["word", "pos"])
    return _overruled([found], marks, ["word", "group_no", "pos", "ili"])


def progressive_intersection(sets: Column) -> Column:
    """Intersection of an array of sets one after the other, a set that would empty it left out."""
    rest = F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(sets, 0), lambda acc, x: F.when(F.size(F.array_intersect(acc, x)) > 0, F.array_intersect(acc, x)).otherwise(acc))
