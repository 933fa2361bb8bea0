"""Text functions as Column expressions: groups, items, parentheses, annotations, cells, tokens.

Every function takes a Column (or a column name) and returns a Column of built-in
expressions, so that it stays in the JVM and filters can be pushed below it. White space is
the Unicode kind unless the name says otherwise; null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Marks stripped from tokens, and the words left out of content-word sets.
TOKEN_PUNCTUATION = ':;#,."“”!?-*/+'
STOP_WORDS = "a an the of or and in for to is are was were be been being by with at on from as it its that this which who whom whose".split()


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: ColumnLike) -> Column:
    """Without the white space at both ends, of every Unicode kind."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def strip_marks(col: ColumnLike, marks: str = TOKEN_PUNCTUATION) -> Column:
    """Without the given marks at both ends."""
    return F.btrim(_c(col), F.lit(marks))


def squeeze(col: ColumnLike) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(_c(col), r"(?U)\s+", " ")


def split_groups(col: ColumnLike) -> Column:
    """Meaning groups, parted by semicolon and blank."""
    return F.split(strip(col), "; ")


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def split_items(col: ColumnLike) -> Column:
    """Items parted by commas, trimmed, without empty ones."""
    return non_empty(F.transform(F.split(_c(col), ","), strip))


def split_items_strict(col: ColumnLike) -> Column:
    """Items parted by comma and blank, as they are."""
    return F.split(_c(col), ", ")


def split_items_outside_parentheses(col: ColumnLike) -> Column:
    """Items parted by commas, unless a closing parenthesis follows with none opening before it, or one opened two characters back."""
    return F.split(_c(col), r"(?<!\([^)])\s*,(?![^(]*\))")


def strip_italic(col: ColumnLike) -> Column:
    """Without the ``(_..._)`` annotations."""
    return F.regexp_replace(_c(col), r"\(_.*?_\)", "")


def italic_annotation(col: ColumnLike) -> Column:
    """struct(text, note): the trimmed text without annotations, and these joined by comma and blank."""
    c = _c(col)
    return F.struct(strip(F.regexp_replace(c, r"\(_[^_]*_\)", "")).alias("text"), F.array_join(F.regexp_extract_all(c, F.lit(r"\(_([^_]*)_\)"), 1), ", ").alias("note"))


def annotation_map(col: ColumnLike) -> Column:
    """Map from each item (parted by comma or semicolon) to its annotation; items without one are left out, the last of equal items wins."""
    parts = F.transform(F.split(_c(col), "[,;]"), lambda p: italic_annotation(strip(p)))
    noted = F.filter(parts, lambda p: (p["text"] != "") & (p["note"] != ""))
    # The last of equal items: one that no later item equals.
    last = F.filter(noted, lambda p, i: ~F.exists(F.slice(noted, i + 2, F.greatest(F.size(noted) - i - 1, F.lit(0))), lambda q: q["text"] == p["text"]))
    return F.map_from_entries(last)


_LEADING = r"^(?:\([^_)]+\)(?U:\s)*)+"
_TRAILING = r"(?:(?U:\s)*\([^_)]+\))+$"


def expand_context(col: ColumnLike) -> Column:
    """[short, long] if optional words in parentheses lead or trail the gloss, else [gloss].

    Short leaves the words out, long takes the parentheses off; leading ones come first.
    Parentheses that hold an underscore are annotations and do not count.
    """

    def variants(c: Column) -> Column:
        full = squeeze(strip(F.regexp_replace(c, "[()]", "")))
        lead, trail = (strip(F.regexp_replace(c, p, "")) for p in (_LEADING, _TRAILING))
        forms = F.named_struct(F.lit("full"), full, F.lit("lead"), lead, F.lit("trail"), trail)  # names survive where aliases are cleaned away
        use = lambda f, short, p: c.rlike(p) & (f[short] != "") & (f["full"] != "") & (f[short] != f["full"])
        return let(forms, lambda f: F.when(use(f, "lead", _LEADING), F.array(f["lead"], f["full"])).when(use(f, "trail", _TRAILING), F.array(f["trail"], f["full"])).when(c.isNotNull(), F.array(c)))

    return F.when(F.contains(_c(col), F.lit("(")), let(_c(col), variants)).when(_c(col).isNotNull(), F.array(_c(col)))


def expand_parentheses(col: ColumnLike) -> Column:
    """[without the parts in parentheses, without the parentheses] if there are any, else [text]."""
    c = _c(col)
    reduced = F.regexp_replace(c, r"\(.*?\)", "")
    return F.when(reduced != c, F.array(strip(reduced), strip(F.regexp_replace(c, "[()]", "")))).when(c.isNotNull(), F.array(c))


def expand_items(col: ColumnLike) -> Column:
    """Comma items, each with its context expanded, in order."""
    return F.flatten(F.transform(split_items(col), expand_context))


def fold_groups(groups: Column, skip_empty: bool = True) -> Column:
    """An array of arrays as text: items by comma, groups by semicolon. Without ``skip_empty`` a leading empty group shows."""
    texts = F.transform(groups, lambda g: F.array_join(g, ", "))
    if skip_empty:
        return F.array_join(non_empty(texts), "; ")
    # Groups after an empty first one keep their separator; other empty groups leave none.
    later = F.concat(F.slice(texts, 1, 1), non_empty(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))))
    return F.array_join(later, "; ")


def gender(col: ColumnLike) -> Column:
    """The first ``<m>``, ``<f>`` or ``<n>`` marker's letter; null if there is none."""
    found = F.regexp_extract(_c(col), "<([mfn])>", 1)
    return F.nullif(found, F.lit(""))


def strip_gender(col: ColumnLike) -> Column:
    return strip(F.regexp_replace(_c(col), r"(?U)\s*<[mfn]>", ""))


def parse_cell(col: ColumnLike) -> Column:
    """Groups of struct(text, gender) of an extension cell; empty groups keep their place; null, empty and ``False`` cells have none."""
    c = strip(col)
    item = lambda x: F.struct(strip_gender(x).alias("text"), gender(x).alias("gender"))
    group = lambda g: F.filter(F.transform(F.split(g, ", "), lambda x: item(strip(x))), lambda s: s["text"] != "")
    groups = F.transform(F.split(c, "; "), group)
    return F.when((c == "") | (c == "False") | c.isNull(), F.array().cast("array<array<struct<text:string,gender:string>>>")).otherwise(groups)


def parse_cell_flat(col: ColumnLike) -> Column:
    """The items of a cell without their groups."""
    return F.flatten(parse_cell(col))


def fold_cell(groups: Column) -> Column:
    """Text of a parsed cell; the inverse of ``parse_cell`` up to blanks."""
    return fold_groups(F.transform(groups, lambda g: F.transform(g, lambda s: F.concat(s["text"], F.coalesce(F.concat(F.lit(" <"), s["gender"], F.lit(">")), F.lit(""))))))


def render_gendered(word: ColumnLike, pos: ColumnLike, tags: ColumnLike) -> Column:
    """A noun or name with the genders its tags (an array) hold, as ``word <m>/<f>``."""
    joined = F.array_join(_c(tags), "\t")
    marks = F.array_compact(F.array(*[F.when(joined.contains(name), F.lit(f"<{name[0]}>")) for name in ("masculine", "feminine", "neuter")]))
    return F.when(_c(pos).isin("noun", "name") & (F.size(marks) > 0), F.concat_ws(" ", _c(word), F.array_join(marks, "/"))).otherwise(_c(word))


def tokens_by_blank(col: ColumnLike) -> Column:
    return F.split(_c(col), " ")


def letter_tokens(col: ColumnLike) -> Column:
    """Longest runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"\p{L}+"), 0)


def spaced_tokens(col: ColumnLike) -> Column:
    """Lower-case tokens with punctuation set apart, as word aligners write them."""
    return non_empty(F.split(F.regexp_replace(F.lower(_c(col)), r"([^\p{L}\p{N}\s])", " $1 "), r"\s+"))


def content_words(col: ColumnLike) -> Column:
    """Distinct lower-case words of ASCII letters and apostrophes, without possessive endings and stop words."""
    words = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"[a-zA-Z']+"), 0)
    bare = F.transform(words, lambda w: F.when(w.endswith("'s"), F.regexp_replace(w, "['s]+$", "")).otherwise(w))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def cloze(col: ColumnLike, gap: str = "[...]") -> Column:
    """``**marked**`` spans replaced by a gap."""
    return F.regexp_replace(_c(col), r"\*\*.*?\*\*", gap)


def bold_html(col: ColumnLike) -> Column:
    """A paragraph with ``**x**`` and ``_x_`` as markup."""
    text = F.regexp_replace(F.regexp_replace(_c(col), r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"(?<![\p{L}\p{N}])_([^_]+)_(?![\p{L}\p{N}])", "<em>$1</em>")
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def labelled_lines(labels: Column, texts: Column) -> Column:
    """``**label**: text`` lines, as many as the shorter array has."""
    n = F.least(F.size(labels), F.size(texts))
    return F.array_join(F.zip_with(F.slice(labels, 1, n), F.slice(texts, 1, n), lambda a, b: F.concat(F.lit("**"), a, F.lit("**: "), b)), "\n")


def normal_tags(col: ColumnLike) -> Column:
    """Comma-and-blank lists as tags with underscores for blanks."""
    return F.split(F.replace(_c(col), F.lit(" "), F.lit("_")), ",_")


def index_terms(col: ColumnLike) -> Column:
    """Distinct search terms of a translation: groups without their prefix, items without annotations and parentheses, lower case, longer than one letter."""
    groups = F.transform(F.split(_c(col), ";"), lambda g: F.regexp_replace(g, r"^[a-z./ ]+:\s*", ""))
    items = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    clean = F.transform(items, lambda x: F.lower(strip(F.regexp_replace(F.regexp_replace(x, "_[^_]+_", ""), "[()]+", ""))))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) > 1))


def short_gloss(col: ColumnLike) -> Column:
    """The first group of a translation, without its prefix."""
    return F.regexp_replace(strip(F.split(_c(col), ";")[0]), r"^[a-z./ ]+:\s*", "")


COMPOUND = r"^-?\p{L}+(\s*\+\s*-?\p{L}+)+$"


def compound_parts(col: ColumnLike) -> Column:
    """Lower-case parts of an etymology that is purely ``a + b``, without leading hyphens; null for others."""
    c = strip(col)
    return F.when(c.rlike(COMPOUND), F.transform(F.split(c, r"\+"), lambda x: F.lower(F.regexp_replace(strip(x), "^-+", ""))))


def syllables(col: ColumnLike) -> Column:
    """Vowels in the blank-separated tokens that begin with a letter."""
    words = F.filter(F.split(F.lower(_c(col)), r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return F.length(F.regexp_replace(F.array_join(words, " "), "[^aeiou]", ""))


def key_value(extras: Iterable[ColumnLike], key: str) -> Column:
    """Value of the first ``key=value`` among several columns."""
    return F.coalesce(*[F.when(_c(c).startswith(f"{key}="), F.element_at(F.split(_c(c), "=", 2), 2)) for c in extras])


def last_value(col: ColumnLike) -> Column:
    """What stands after the last equals sign."""
    return F.element_at(F.split(_c(col), "="), -1)


def prefix_key(col: ColumnLike) -> Column:
    """Partition key of a word: its first two characters in upper case; ``single_char`` for shorter words and those with a slash there."""
    head = F.substring(_c(col), 1, 2)
    return F.when((F.length(_c(col)) < 2) | head.contains("/") | head.contains("\\"), F.lit("single_char")).otherwise(F.upper(head))


def sentences(col: ColumnLike) -> Column:
    """Sentences of a text: lines cut at full stops, trimmed, without blank ones, the stop put back."""
    parts = F.split(_c(col), r"[.\n]")
    return F.transform(non_empty(F.transform(parts, strip)), lambda s: F.concat(s, F.lit(".")))


def xml_blanks(col: ColumnLike) -> Column:
    """Words joined by the ``<b/>`` element."""
    return F.array_join(non_empty(F.split(_c(col), r"\s+")), "<b/>")


def first_match(col: ColumnLike, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(col), p, 1), F.lit("")) for p in patterns])


# Patterns of image links in pages, by page kind and in order of preference.
LINK_PATTERNS = {
    "general": [r'(?s)<td[^>]*class="infobox-image"[^>]*>.*?<a[^>]*href="([^"]+)"', r'(?s)<table[^>]*class="infobox biota"[^>]*>.*?<a[^>]*href="([^"]+)"', r'(?s)<figure[^>]*class="mw-default-size"[^>]*>.*?<a[^>]*href="([^"]+)"'],
    "biota": [r'(?s)<figure[^>]*>.*?<a[^>]*href="([^"]+)"'],
    "element": [r'(?s)<td[^>]*class="infobox-image"[^>]*>.*?<a[^>]*href="([^"]+)"'],
    "file": [r'<a[^>]*class="mw-thumbnail-link"[^>]*href="([^"]+)"', r'(?s)<div[^>]*class="mw-content-ltr fullMedia"[^>]*>.*?<a[^>]*href="([^"]+)"'],
}


def page_link(html: ColumnLike, kind: str = "general") -> Column:
    """The first image link of a page by the patterns of its kind."""
    return first_match(html, *LINK_PATTERNS[kind])


def country_map_link(html: ColumnLike) -> Column:
    """Link of the third image of a country's box, of the second if there are no three."""
    box = F.regexp_extract(_c(html), r'(?s)<table[^>]*class="infobox ib-country vcard"[^>]*>(.*?)</table>', 1)
    links = F.regexp_extract_all(box, F.lit(r'<a[^>]*href="([^"]+)"[^>]*>\s*<img'), 1)
    return F.coalesce(F.get(links, 2), F.get(links, 1))


def plain_file_name(name: ColumnLike, suffix: str) -> Column:
    """Whether a name is small letters and underscores with the suffix, and so safe to serve."""
    return _c(name).rlike(r"^[a-z_]+\Q." + suffix + r"\E\z")


def emphasise_phrase(text: ColumnLike, phrase: ColumnLike) -> Column:
    """Every whole-word occurrence of a phrase between ``**``, whatever its case."""
    pattern = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])(\Q"), _c(phrase), F.lit(r"\E)(?![\p{L}\p{N}])"))
    return F.regexp_replace(_c(text), pattern, F.lit("**$1**"))


def emphasise_first(text: ColumnLike, phrases: ColumnLike) -> Column:
    """The first of several phrases (an array) that stands in the text, emphasised; the text as it is if none does."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    fits = F.filter(_c(phrases), lambda p: (p != "") & low.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " "), F.lit(" "))))
    return F.when(F.size(fits) > 0, emphasise_phrase(text, F.get(fits, 0))).otherwise(_c(text))
