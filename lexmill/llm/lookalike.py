"""Text that looks the same in one consistent form (problem 3).

Method: a weighted edit automaton traverses the trie of a vocabulary of spellings. It reads a
token as it is written: deleting an ignorable character and replacing a character by a
look-alike (other width, other script, accent apart or composed) cost nothing, other edits
cost what ``WEIGHTS`` says. Of the spellings it accepts within the budget the cheapest, and of
these the vocabulary's first, is the canonical one. Tokens it rejects are normalised by table.

With the budget of 0 both ways agree: what the automaton accepts is exactly what has the same
look key, and the table's form of a token is a function of its look key. Forms are then equal
if and only if the texts look the same; the vocabulary decides which of the equal looks is
shown. A larger budget unites near looks too, such as letters of another case.

The vocabulary has for each look the spelling that is most frequent in all rows. It is never
cut short: while its characters are within ``VOCABULARY_CHARS`` it is broadcast; beyond that
only spellings that differ from the table's form are, as the others change nothing; and if
these are too many, those a text could use are looked up by a join.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexmill.session import collect_bounded

# Letters of one shape in two scripts, as pairs.
LATIN_CYRILLIC = "aа cс eе oо pр xх yу sѕ iі jј hһ qԛ wԝ dԁ lӏ vѵ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YҮ VѴ QԚ WԜ"
LATIN_GREEK = "oο vν cϲ jϳ CϹ JͿ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ FϜ"
GREEK_CYRILLIC = "κк ΓГ ΠП ΦФ"
# Letters of further scripts, and second letters of a script, with the shape of the first of the pair.
MORE_SHAPES = "oօ oᴏ cᴄ vᴠ wᴡ zᴢ sꜱ gɡ ιɩ lӀ YУ μµ"
# Radical signs beyond the block that has decompositions, with the ideograph of the same shape.
RADICALS = {"⺀": "冫", "⺂": "乛", "⺈": "刀", "⺌": "小", "⺒": "巳", "⺓": "幺", "⺕": "彐", "⺙": "攵", "⺝": "月", "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺫": "罒", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺲": "罒", "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺻": "聿", "⺼": "肉", "⺾": "艹", "⺿": "艹", "⻁": "虎", "⻂": "衤", "⻃": "西", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻬": "齐", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻲": "亀", "⻳": "龟"}
# Format characters that can be seen, or that belong to what can be seen.
SEEN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢𑂽𑃍"
# Characters beside the format class that show nothing.
BLANK_LETTERS = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍"


def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Letter -> the one that stands for its shape; that one -> Cyrillic, -> Greek letter of the shape."""
    cyrillic, greek = dict(LATIN_CYRILLIC.split()), dict(LATIN_GREEK.split())
    shape = {other: own for pairs in (cyrillic, greek) for own, other in pairs.items()}
    for g, c in GREEK_CYRILLIC.split():
        shape[c], cyrillic[g], greek[g] = g, c, g
    for own, other in MORE_SHAPES.split():
        shape.setdefault(other, own)
    return shape, cyrillic, greek


SHAPE, CYRILLIC, GREEK = _tables()


@lru_cache(maxsize=None)
def plain(ch: str) -> str:
    """What a single character counts as before accents are taken apart: '' if it shows nothing, ' ' for every blank."""
    kind = unicodedata.category(ch)
    if ch.isspace() or kind == "Zs":
        return " "
    if (kind == "Cf" and ch not in SEEN_FORMATS) or kind == "Cc" or ch in BLANK_LETTERS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if ch in RADICALS:
        return RADICALS[ch]
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>")) or (how.startswith("<compat>") and "⺀" <= ch <= "⿟"):
        return unicodedata.normalize("NFKD", ch)
    return ch


def symbols(text: str) -> str:
    """The text without ignorables, with plain widths and blanks, accents apart and in order."""
    return unicodedata.normalize("NFD", "".join(map(plain, text)))


def look_key(text: str) -> str:
    """Equal for texts that look the same, and for no others."""
    return "".join(SHAPE.get(c, c) for c in symbols(text)).strip(" ")


def _script(ch: str) -> str:
    return "Latin" if "a" <= ch <= "z" or "A" <= ch <= "Z" else "Cyrillic" if "Ѐ" <= ch <= "ԯ" else "Greek" if "Ͱ" <= ch <= "Ͽ" else ""


def by_table(key: str) -> str:
    """The form of a token with this look key: in the script of the letters that have one shape only, Latin if there are none."""
    if not key.isascii():
        scripts = {_script(c) for c in key if not (c in CYRILLIC or c in GREEK)}
        if "Latin" not in scripts:
            own = CYRILLIC if "Cyrillic" in scripts else GREEK if "Greek" in scripts else {}
            key = "".join(own.get(c, c) for c in key)
    return unicodedata.normalize("NFC", key)


#: Costs of edits: letters of another case, accents, anything else.
WEIGHTS = {"case": 1, "accent": 2, "other": 3}


@lru_cache(maxsize=None)
def _read(ch: str) -> tuple[tuple[int, str], ...]:
    """The symbols a written character stands for, each with its combining class; none for an ignorable."""
    return tuple((unicodedata.combining(c), c) for c in unicodedata.normalize("NFD", plain(ch)))


def _written(token: str) -> Iterator[str]:
    """Symbols of a token in the order in which they are compared: runs of accents by their class."""
    marks: list[tuple[int, str]] = []
    for ch in token:
        for cls, c in _read(ch):
            if cls:
                marks.append((cls, c))
                continue
            if marks:
                yield from (m for _, m in sorted(marks, key=lambda m: m[0]))
                marks.clear()
            yield c
    yield from (m for _, m in sorted(marks, key=lambda m: m[0]))


def _cost(have: str, want: str) -> int:
    """Of replacing one symbol by another; '' stands for none."""
    if SHAPE.get(have, have) == SHAPE.get(want, want):
        return 0
    if have and want:
        return WEIGHTS["case"] if have.lower() == want.lower() else WEIGHTS["other"]
    return WEIGHTS["accent"] if unicodedata.combining(have or want) else WEIGHTS["other"]


class Automaton:
    """Trie of spellings, traversed with edits of bounded cost.

    ``edges`` leads from a node and the representative of a shape to all its letters' nodes.
    """

    def __init__(self, spellings: Iterable[str], budget: int = 0):
        self.budget = budget
        self.edges: dict[tuple[int, str], list[int]] = {}
        self.letters = [""]
        self.ends: dict[int, tuple[int, str]] = {}
        for order, spelling in enumerate(spellings):
            node = 0
            for c in _written(spelling):
                nodes = self.edges.setdefault((node, SHAPE.get(c, c)), [])
                child = next((x for x in nodes if self.letters[x] == c), None)
                if child is None:
                    child = len(self.letters)
                    self.letters.append(c)
                    nodes.append(child)
                node = child
            self.ends.setdefault(node, (order, spelling))
        self.children: dict[int, list[int]] = {}
        if budget:
            for (node, _), nodes in self.edges.items():
                self.children.setdefault(node, []).extend(nodes)

    def canonical(self, token: str) -> tuple[str | None, str]:
        """The spelling that the token matches at the least cost within the budget (None if there is none), and the token's look key."""
        states, key = self._skip({0: 0}), []
        for c in _written(token):
            shape = SHAPE.get(c, c)
            key.append(shape)
            states = self._step(states, c, shape)
        ends = [(cost, self.ends[n]) for n, cost in states.items() if n in self.ends]
        return (min(ends)[1][1] if ends else None), "".join(key)

    def _step(self, states: dict[int, int], c: str, shape: str) -> dict[int, int]:
        """States after reading a symbol: nodes with the least cost at which some spelling reaches them."""
        if not self.budget:
            return {child: 0 for n in states for child in self.edges.get((n, shape), ())}
        out: dict[int, int] = {}
        for n, cost in states.items():
            moves = [(child, cost + _cost(c, self.letters[child])) for child in self.children.get(n, ())]
            for to, total in [(n, cost + _cost(c, "")), *moves]:
                if total <= self.budget and total < out.get(to, total + 1):
                    out[to] = total
        return self._skip(out)

    def _skip(self, states: dict[int, int]) -> dict[int, int]:
        """States with those added that are reached by letters the token leaves out."""
        todo = list(states) if self.budget else []
        while todo:
            n = todo.pop()
            for child in self.children.get(n, ()):
                total = states[n] + _cost("", self.letters[child])
                if total <= self.budget and total < states.get(child, total + 1):
                    states[child] = total
                    todo.append(child)
        return states


# Width variants that stand for a blank with an accent.
_WITH_BLANK = {ord(c): plain(c) for c in map(chr, range(0xFF00, 0xFFF0)) if " " in plain(c)}
_BLANK = re.compile(r"\s|[\x1c-\x1f\x85]")


class Unifier:
    """Canonical form of whole texts; short texts and tokens seen before are remembered."""

    MEMORY, SHORT = 100_000, 200

    def __init__(self, spellings: Iterable[str], budget: int = 0):
        self.automaton = Automaton(spellings, budget)
        self.tokens: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _remember(self, memory: dict[str, str], written: str, form: str) -> str:
        if len(written) <= self.SHORT:
            if len(memory) >= self.MEMORY:
                memory.clear()
            memory[written] = form
        return form

    def token(self, written: str) -> str:
        found = self.tokens.get(written)
        if found is None:
            spelling, key = self.automaton.canonical(written)
            found = self._remember(self.tokens, written, by_table(key) if spelling is None else spelling)
        return found

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        found = self.texts.get(text)
        if found is None:
            parts = _BLANK.split(text if text.isascii() else text.translate(_WITH_BLANK))
            found = self._remember(self.texts, text, " ".join(map(self.token, parts)).strip(" "))
        return found


#: Java pattern of a token in one of the scripts with look-alikes, without ignorables or widths.
_CLEAN = r"^(?:[\p{IsLatin}&&[^＀-￯]]+|\p{IsCyrillic}+|\p{IsGreek}+)$"


#: Characters of all spellings together up to which they are broadcast.
VOCABULARY_CHARS = 2_000_000


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(look, spelling, by_table): for each look of a clean token its most frequent spelling, ties by spelling; counted over all rows.

    Clean is a token in one script, in plain width and without ignorables; it is composed
    here. ``by_table`` tells that the table would give the same spelling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spellings = [unicodedata.normalize("NFC", t) for t in batch.column(0).to_pylist()]
            looks = list(map(look_key, spellings))
            same = [by_table(k) == t for k, t in zip(looks, spellings)]
            yield pa.RecordBatch.from_arrays([pa.array(looks), pa.array(spellings), pa.array(same, pa.bool_()), batch.column(1)], names=["look", "spelling", "by_table", "n"])

    tokens = texts.select(F.explode(F.split(F.col(column), " ")).alias("t")).where(F.col("t").rlike(_CLEAN)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    keyed = tokens.mapInArrow(run, "look string, spelling string, by_table boolean, n bigint").groupBy("look", "spelling", "by_table").agg(F.sum("n").alias("n"))
    return keyed.groupBy("look").agg(F.min_by(F.struct("spelling", "by_table"), F.struct(-F.col("n"), "spelling")).alias("_s")).select("look", "_s.*")


_UNIFIERS: dict[tuple[str, int], Unifier] = {}


def _unifier(name: str, spellings: Iterable[str], budget: int) -> Unifier:
    """A Python worker keeps the one it used last."""
    if (name, budget) not in _UNIFIERS:
        _UNIFIERS.clear()
        _UNIFIERS[name, budget] = Unifier(spellings, budget)
    return _UNIFIERS[name, budget]


class Vocabulary:
    """Spellings as an automaton on every worker, or as a table to be joined where they are too many for that."""

    def __init__(self, spellings: DataFrame | Sequence[str], spark: SparkSession, chars: int = VOCABULARY_CHARS):
        self.name, self.shared, self.table = uuid.uuid4().hex, None, None
        if isinstance(spellings, DataFrame):
            found = collect_bounded(spellings, "spelling", chars)
            if found is None:
                spellings = spellings.where(F.when(F.spark_partition_id() >= 0, ~F.col("by_table")))
                found = collect_bounded(spellings, "spelling", chars)
            if found is None:
                self.table = spellings.select("look", "spelling")
                return
            spellings = sorted(r["spelling"] for r in found)
        self.shared = spark.sparkContext.broadcast(tuple(spellings))

    def held(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``_held``, the spellings of the table that its text could use; found by a join on the looks of each distinct text's tokens."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, looks = [], []
                for i, text in enumerate(batch.column(0).to_pylist()):
                    own = {look_key(t) for t in _BLANK.split(text.translate(_WITH_BLANK))}
                    at.extend([i] * len(own))
                    looks.extend(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(looks, pa.string())], names=["_t", "look"])

        texts = df.select(F.col(column).cast("string").alias("_t")).where("_t is not null").distinct()
        used = texts.mapInArrow(run, "_t string, look string").join(self.table, "look").groupBy("_t").agg(F.collect_set("spelling").alias("_held"))
        return df.join(used, df[column].cast("string") == used["_t"], "left").drop("_t")


def unify(df: DataFrame, column: str, out: str, spellings: Vocabulary | Sequence[str], budget: int = 0) -> DataFrame:
    """``df`` with the canonical form of ``column`` in ``out``; the form is the class of all texts of that look.

    Defined cases: null stays null; empty, blank and wholly ignorable texts become the empty
    string; blanks at the ends go, blanks within stay as many as they are, each as a space;
    case, accents and letters of other shapes stay apart; texts of any length; repeated rows
    are kept; an empty table gives none; ``out`` must not name a column of ``df``. A
    ``budget`` above 0 needs a broadcast vocabulary.
    """
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    words = spellings if isinstance(spellings, Vocabulary) else Vocabulary(spellings, df.sparkSession)
    if budget and words.table is not None:
        raise ValueError("near looks are searched in a broadcast vocabulary only")
    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    at, width, name, shared = df.columns.index(column), len(df.columns), words.name, words.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                unifier = _unifier(name, shared.value, budget)
            else:
                unifier = Unifier(sorted({s for held in batch.column(width).to_pylist() for s in held or ()}))
            forms = pa.array([unifier.text(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], forms], names=schema.names)

    return (df if words.table is None else words.held(df, column)).mapInArrow(run, schema)


def same_look_pairs(df: DataFrame, key: str, column: str, within: list[str], spellings: Vocabulary | Sequence[str]) -> DataFrame:
    """``id_a`` < ``id_b`` of rows equal in ``within`` whose texts look the same and are not the same string.

    Each text is formed once. Of two texts of one look at most one is its own form, so the
    links between different spellings come from the distinct texts that are not: each to its
    form, and those of one form to each other. Rows, read without Python, are joined to both
    ends of the links; copies of one spelling, however many, meet no row of their own.

    Defined cases: null texts and nulls in ``within`` make no pair; repeated rows pair under
    each of their ids; a row with a null id makes no pair; an empty table gives none.
    """
    group = [f"_w{i}" for i in range(len(within))]
    rows = df.select(F.col(key).alias("_id"), *[F.col(c).alias(g) for c, g in zip(within, group)], F.col(column).cast("string").alias("_text"))
    rows = rows.where(F.expr(" and ".join(f"{c} is not null" for c in rows.columns)))
    formed = unify(rows.select(*group, "_text"), "_text", "_form", spellings).where("_text <> _form").distinct()
    one, other = (formed.withColumnRenamed("_text", t) for t in ("_a", "_b"))
    links = formed.select(*group, F.col("_form").alias("_a"), F.col("_text").alias("_b")).unionByName(one.join(other, [*group, "_form"]).where("_a < _b").select(*group, "_a", "_b"))
    first = rows.withColumnsRenamed({"_id": "_id_a", "_text": "_a"}).join(links, [*group, "_a"]).select(*group, "_id_a", "_b")
    pairs = first.join(rows.withColumnsRenamed({"_id": "_id_b", "_text": "_b"}), [*group, "_b"]).where("_id_a <> _id_b")
    return pairs.select(F.least("_id_a", "_id_b").alias("id_a"), F.greatest("_id_a", "_id_b").alias("id_b"))
