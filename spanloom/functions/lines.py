"""Column expressions that parse one line of a word/tag annotated corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of the annotated line format.
# (?U) gives \s, \d and \w their Unicode meaning.
HEADER = r"(?U)^(?:\d{8}-\d{2}-\d{3}-\d{3}/\w+\s+|\d+\.\d+\.\d+\s+)"
CATEGORY_PREFIX = r"(?U)^(\d+)\."
ENTITY_GROUP = r"\[([^\]]+)\]([a-zA-Z.]+)"
TOKEN = r"(?U)(\S+?)/([a-zA-Z0-9_.!]+)"
LINE_ID_WORD = r"(?U)^(?:\d{8}-\d{2}-\d{3}-\d{3}|\d+\.\d+\.\d+)"
TAG_SUFFIX = r"[!^].*$"
GLUED_TOKEN = r"(?U)^(\S+?)([a-zA-Z.][a-zA-Z0-9_.]*)$"
MIN_WORDS = 3
MIN_SEGMENTS = 3
SCRIPTURE_PREFIX = "68"

# Spellings of grammatical tags and their normal form.
TAG_NORMAL_FORM = {
    "Quot": "Quot.", "Quet": "Quot.", "Obj": "Obj.", "Erg": "Erg.",
    "Dir1": "Dir1.", "Dir1,": "Dir1.", "Dir2": "Dir2.", "Loc": "Loc.", "Loc,": "Loc.",
    "Nom": "Nom.", "Fut": "Fut.", "Pfv": "Pfv.", "1sg": "1sg.", "2sg": "2sg.", "pl": "pl.",
    "mc.": "mc",
}


def strip_line(line: Column) -> Column:
    """The line without surrounding white space."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def strip_header(line: Column) -> Column:
    """The line without its leading identifier."""
    return F.regexp_replace(line, HEADER, "")


def line_id(line: Column) -> Column:
    """The leading identifier, empty when there is none."""
    return F.regexp_replace(F.regexp_extract(line, HEADER, 0), r"(?U)\s+$", "")


def line_category(line: Column) -> Column:
    """scripture / secular by the number before the first dot; unknown without one."""
    number = F.regexp_extract(line, CATEGORY_PREFIX, 1)
    return F.when(number == SCRIPTURE_PREFIX, "scripture").when(number != "", "secular").otherwise("unknown")


def expand_groups(body: Column) -> Column:
    """``[w/t w/t]T`` becomes its inner tokens."""
    return F.regexp_replace(body, ENTITY_GROUP, "$1")


def clean_tag(tag: Column) -> Column:
    """The tag up to its first ``!`` or ``^``."""
    return F.regexp_replace(tag, TAG_SUFFIX, "")


def tokenize(text: Column) -> Column:
    """All word/tag pairs as ``array<struct<word,tag>>``, tags uncleaned."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    tags = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(2))
    return F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))


def clean_tokens(tokens: Column) -> Column:
    """Drop tokens that are line identifiers and clean the remaining tags."""
    kept = F.filter(tokens, lambda p: ~p["word"].rlike(LINE_ID_WORD))
    return F.transform(kept, lambda p: F.struct(p["word"].alias("word"), clean_tag(p["tag"]).alias("tag")))


def recover_tokens(body: Column) -> Column:
    """Per white-space segment: a leading word/tag pair, else trailing letters as the tag."""
    segments = F.filter(F.split(strip_line(body), r"(?U)\s+"), lambda s: s != "")

    def one(seg: Column) -> Column:
        anchored = TOKEN.replace("(?U)", "(?U)^")
        paired = seg.rlike(anchored)
        word = F.when(paired, F.regexp_extract(seg, anchored, 1)).otherwise(F.regexp_extract(seg, GLUED_TOKEN, 1))
        tag = F.when(paired, F.regexp_extract(seg, anchored, 2)).otherwise(F.regexp_extract(seg, GLUED_TOKEN, 2))
        return F.struct(word.alias("word"), clean_tag(tag).alias("tag"))

    return F.filter(F.transform(segments, one), lambda p: p["word"] != "")


def parse_tokens(line: Column) -> Column:
    """Full parse of a stripped line into ``array<struct<word,tag>>``."""
    body = strip_header(line)
    parsed = clean_tokens(tokenize(expand_groups(body)))
    segments = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda s: s != ""))
    recovered = recover_tokens(body)
    poor = (F.size(parsed) < MIN_WORDS) & (segments > MIN_SEGMENTS)
    return F.when(poor & (F.size(recovered) > 0), recovered).otherwise(parsed)


def normalize_tag(tag: Column) -> Column:
    """The normal form of a tag; NULL for blank and ``?`` tags."""
    trimmed = strip_line(tag)
    table = F.create_map(*[F.lit(x) for pair in TAG_NORMAL_FORM.items() for x in pair])
    return F.when(~trimmed.isin("", "?"), F.coalesce(F.try_element_at(table, trimmed), trimmed))


def normalize_tokens(tokens: Column) -> Column:
    """Normalize the tags of ``array<struct<word,tag>>``; tokens without a tag are dropped."""
    mapped = F.transform(tokens, lambda p: F.struct(p["word"].alias("word"), normalize_tag(p["tag"]).alias("tag")))
    return F.filter(mapped, lambda p: p["tag"].isNotNull())
