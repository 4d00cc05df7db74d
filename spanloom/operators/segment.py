"""Segmentation by maximum matching, tagging by modal tag, and constrained decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrays import fold_out
from spanloom.functions.labels import BIES, LEGAL_END, LEGAL_NEXT, LEGAL_START, words_to_bies
from spanloom.operators import match
from spanloom.operators.lattice import Lexicon, lattice
from spanloom.operators.vocab import UNSEEN_TAG
from spanloom.plans.scale import lookup_join

# Fixed value: characters every dictionary accepts as words of their own.
FALLBACK_SINGLES = "0123456789abcdefghijklmnopqrstuvwxyz"
MODES = ("fmm", "bmm", "bidirectional")
SOURCES = ("corpus", "predefined", "combined")
IMPOSSIBLE = -1e9
#: Tags that are named in a broadcast list.
MOST_TAGS = 10_000


def dictionary_words(source: str, corpus: DataFrame | None, predefined: DataFrame | None) -> DataFrame:
    """Words of one dictionary source, each with ``in_source`` (false for the single-character fallbacks)."""
    if source not in SOURCES:
        raise ValueError(f"unknown dictionary source {source!r}, choose from {SOURCES}")
    parts = {"corpus": [corpus], "predefined": [predefined], "combined": [corpus, predefined]}[source]
    words = parts[0].select("word")
    for p in parts[1:]:
        words = words.union(p.select("word"))
    singles = words.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in FALLBACK_SINGLES])).alias("word"))
    both = words.select("word", F.lit(True).alias("in_source")).union(singles.select("word", F.lit(False)))
    return both.groupBy("word").agg(F.max("in_source").alias("in_source"))


def max_word_length(dictionary: DataFrame) -> DataFrame:
    """One row: longest word of the source itself; the fallbacks are added after it is taken."""
    return dictionary.where("in_source").agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("max_len"))


def reach(sent: DataFrame, lex: Lexicon, valid: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Per sentence: array of (pos, fwd, bwd, known) by position.

    ``fwd``/``bwd`` are the longest match starting/ending at the position (1 without one),
    ``known`` tells whether the single character is a word. ``valid`` restricts the matches.
    """
    matches = lattice(sent, lex, keep=keep, every_position=True)
    ok = F.coalesce(F.col("found") if valid is None else F.col("found") & valid, F.lit(False))
    ends = matches.select(
        "sid", "len", ok.alias("ok"),
        F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(True).alias("begins")),
                          F.struct((F.col("stop") - 1).alias("pos"), F.lit(False).alias("begins")))).alias("e"))
    usable = F.col("ok") | (F.col("len") == 1)
    per_pos = ends.groupBy("sid", F.col("e.pos").alias("pos")).agg(
        F.max(F.when(usable & F.col("e.begins"), F.col("len")).otherwise(1)).alias("fwd"),
        F.max(F.when(usable & ~F.col("e.begins"), F.col("len")).otherwise(1)).alias("bwd"),
        F.max(F.col("ok") & (F.col("len") == 1)).alias("known"))
    return per_pos.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "fwd", "bwd", "known"))).alias("at"))


_SPANS = "array<struct<start:int,len:int,known:boolean>>"


def forward_spans(at: Column) -> Column:
    """Greedy longest match from the left: a fold over positions that jumps by the chosen length."""
    def step(acc: Column, p: Column) -> Column:
        span = F.struct(p["pos"].alias("start"), p["fwd"].alias("len"), p["known"].alias("known"))
        return F.when(p["pos"] == acc["next"], F.struct(
            (p["pos"] + p["fwd"]).alias("next"), F.concat(acc["out"], F.array(span)).alias("out"))).otherwise(acc)

    return fold_out(at, F.lit(0), F.array().cast(_SPANS), step)


def backward_spans(at: Column) -> Column:
    """The mirror image: longest match ending at each boundary, from the right."""
    def step(acc: Column, p: Column) -> Column:
        span = F.struct((p["pos"] - p["bwd"] + 1).alias("start"), p["bwd"].alias("len"), p["known"].alias("known"))
        return F.when(p["pos"] == acc["next"], F.struct(
            (p["pos"] - p["bwd"]).alias("next"), F.concat(acc["out"], F.array(span)).alias("out"))).otherwise(acc)

    return F.reverse(fold_out(F.reverse(at), F.size(at) - 1, F.array().cast(_SPANS), step))


def unknown_words(spans: Column) -> Column:
    """Words outside the dictionary: only single characters can be."""
    return F.size(F.filter(spans, lambda x: (x["len"] == 1) & ~x["known"]))


def choose(forward: Column, backward: Column) -> Column:
    """Fewer unknown words win, then more words, then the forward result."""
    f = F.struct(unknown_words(forward).alias("u"), (-F.size(forward)).alias("n"))
    b = F.struct(unknown_words(backward).alias("u"), (-F.size(backward)).alias("n"))
    return F.when(f <= b, forward).otherwise(backward)


def span_words(s: Column, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.substring(s, x["start"] + 1, x["len"]))


def max_match(sent: DataFrame, lex: Lexicon, modes: Sequence[str] = ("bidirectional",), valid: Column | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """(sid, one array column of words per mode). One lattice serves all modes; sentences are cut in their rows unless
    ``valid`` restricts the matches or the words are too many."""
    if valid is None and not keep and match.fits(lex.size):
        rows = sent.where((F.length("s") > 0) & F.col("sid").isNotNull())
        return match.segment_rows(rows, match.broadcast_words(lex.words), modes)
    folded = reach(sent, lex, valid, keep).select(
        "sid", forward_spans(F.col("at")).alias("_f"), backward_spans(F.col("at")).alias("_b"))
    both = folded.join(sent.select("sid", "s"), "sid")
    spans = {"fmm": F.col("_f"), "bmm": F.col("_b"), "bidirectional": choose(F.col("_f"), F.col("_b"))}
    return both.select("sid", *[span_words(F.col("s"), spans[m]).alias(m) for m in modes])


def tag_words(pred: DataFrame, modal: DataFrame, words: str, fits: bool) -> DataFrame:
    """(sid, idx, word, tag): the modal tag of every predicted word, ``x`` for unseen words."""
    rows = pred.select("sid", F.posexplode(words).alias("idx", "word"))
    joined = lookup_join(rows, modal.select("word", "tag"), ["word"], "left", small_fits=fits)
    return joined.select("sid", "idx", "word", F.coalesce("tag", F.lit(UNSEEN_TAG)).alias("tag"))


def tag_arrays(pred: DataFrame, modal: DataFrame, words: str, name: str = "pred_tags") -> DataFrame | None:
    """``pred`` with ``name``: the modal tags of the array ``words``, ``x`` for unseen words, made in the row; None if ``modal`` is too large
    for that or names more than ``MOST_TAGS`` tags."""
    if not match.fits(modal.count(), 1):
        return None
    tags = [r["tag"] for r in modal.select("tag").distinct().limit(MOST_TAGS + 1).collect()]
    if len(tags) > MOST_TAGS:
        return None
    named = sorted(tags, key=lambda t: (t is None, t))
    place = F.array_position(F.array(*[F.lit(t) for t in named if t is not None]).cast("array<string>"), F.col("tag")) - 1
    known = match.broadcast_words(modal.where(F.col("tag").isNotNull()), place)
    return match.tag_rows(pred, words, known, [t for t in named if t is not None], UNSEEN_TAG, name)


def transition_counts(sent: DataFrame, words: str = "words", labels: Column | None = None) -> DataFrame:
    """(kind, a, b, cnt): start, inner and end transitions, formed inside the row; of ``labels`` if given."""
    y = words_to_bies(F.col(words)) if labels is None else labels
    labels = sent.where(F.size(words) > 0).select(y.alias("y"))
    n = F.size("y")
    inner = F.zip_with(F.slice("y", F.lit(1), n - 1), F.slice("y", F.lit(2), n - 1),
                       lambda a, b: F.struct(F.lit("next").alias("kind"), a.alias("a"), b.alias("b")))
    ends = F.array(
        F.struct(F.lit("start").alias("kind"), F.lit("").alias("a"), F.element_at("y", 1).alias("b")),
        F.struct(F.lit("end").alias("kind"), F.element_at("y", -1).alias("a"), F.lit("").alias("b")))
    rows = labels.select(F.explode(F.concat(ends, inner)).alias("t"))
    return rows.groupBy("t.kind", "t.a", "t.b").agg(F.count(F.lit(1)).alias("cnt"))


def viterbi(scores: Column, start: Sequence[Column], trans: Sequence[Sequence[Column]], end: Sequence[Column]) -> Column:
    """Best legal label sequence for an array of per-character score arrays (order B, I, E, S).

    One fold over the characters. The accumulator holds, per label, the best score and the
    labels leading to it as text; every label has exactly two legal predecessors. Ties take
    the lowest label index.
    """
    index = {x: i for i, x in enumerate(BIES)}
    before = {y: [x for x in BIES if y in LEGAL_NEXT[x]] for y in BIES}

    def state(score: dict[str, Column], path: dict[str, Column]) -> Column:
        return F.struct(*[score[x].alias(f"s{x}") for x in BIES], *[path[x].alias(f"p{x}") for x in BIES])

    def step(acc: Column, e: Column) -> Column:
        score, path = {}, {}
        for y in BIES:
            low, high = before[y]
            via_low = acc[f"s{low}"] + trans[index[low]][index[y]]
            via_high = acc[f"s{high}"] + trans[index[high]][index[y]]
            score[y] = F.greatest(via_low, via_high) + F.element_at(e, index[y] + 1)
            path[y] = F.concat(F.when(via_low >= via_high, acc[f"p{low}"]).otherwise(acc[f"p{high}"]), F.lit(y))
        return state(score, path)

    first = F.element_at(scores, 1)
    opening = {x: (start[index[x]] if x in LEGAL_START else F.lit(IMPOSSIBLE)) + F.element_at(first, index[x] + 1) for x in BIES}

    def finish(acc: Column) -> Column:
        low, high = LEGAL_END
        best = F.when(acc[f"s{low}"] + end[index[low]] >= acc[f"s{high}"] + end[index[high]], acc[f"p{low}"]).otherwise(acc[f"p{high}"])
        return F.regexp_extract_all(best, F.lit("([BIES])"), F.lit(1))

    rest = F.slice(scores, F.lit(2), F.greatest(F.size(scores) - 1, F.lit(0)))
    folded = F.aggregate(rest, state(opening, {x: F.lit(x) for x in BIES}), step, finish)
    return F.when(F.size(scores) > 0, folded)


def rescale_embeddings(vectors: DataFrame, wanted: DataFrame, key: str, vec: str, target_std: float) -> DataFrame:
    """(key, scaled) for the wanted keys that have a vector: x target_std / (population std of all values + 1e-8)."""
    flat = vectors.select(F.explode(vec).alias("x"))
    std = flat.agg(F.stddev_pop("x").alias("sd")).scalar()
    scale = F.lit(target_std) / (std + 1e-8)
    return (
        wanted.select(key).join(vectors.withColumn("_scale", scale), key)
        .select(key, F.transform(F.col(vec), lambda x: x.cast("double") * F.col("_scale")).alias("scaled"))
    )


def embedding_coverage(vectors: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: wanted keys with and without a vector."""
    both = wanted.select(key).join(vectors.select(key, F.lit(True).alias("got")), key, "left")
    return both.agg(F.count("got").alias("covered"), (F.count(F.lit(1)) - F.count("got")).alias("missing"),
                    F.try_divide(F.count("got"), F.count(F.lit(1))).alias("coverage"))
