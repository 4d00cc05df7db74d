"""Matching every lexicon word at every position of every sentence, and what is counted from it.

The lattice is an equi-join of candidate substrings with the lexicon. Candidates are not
all substrings: words shorter than a stem are tried by their own lengths, longer ones
only where the next characters are the stem of some word, and then only in the lengths
such words have. (A stem has four characters, six in a large lexicon.) Every position copies the next
``NEAR`` characters at most. Words longer than that are found by their first ``NEAR`` characters; only where these
occur is the sentence's text met again and cut. This is exact for words of any length, emits a few candidates per
position and takes memory linear in the sentence, however long the longest word is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.script import length_bin
from spanloom.operators import match
from spanloom.plans.scale import fits_broadcast, lookup_join
from spanloom.session import as_table

STEM, LONG_STEM, MANY_WORDS = 4, 6, 20_000
BLOCK = 256
#: Longest word that is read off a position's own copy of the text.
NEAR = 128
KAPPA = 5
BINS = ("2", "3", "4", "5P")


@dataclass(frozen=True)
class Lexicon:
    """A word list (one row per word, any attribute columns) with the facts the join needs."""

    words: DataFrame
    stems: DataFrame
    far: DataFrame
    short_lengths: tuple[int, ...]
    max_len: int
    stem: int
    near: int
    fits: bool
    size: int = 0

    @staticmethod
    def build(words: DataFrame) -> "Lexicon":
        words = as_table(words, "lexicon")
        facts = words.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.length("word")).alias("max_len"),
            F.collect_set(F.when(F.length("word") < LONG_STEM, F.length("word"))).alias("short"),
        ).first()
        stem = STEM if facts["n"] <= MANY_WORDS else LONG_STEM
        short = tuple(sorted(n for n in facts["short"] or () if n < stem))
        near = max(stem, NEAR)

        def begun(part: DataFrame, size: int, name: str) -> DataFrame:
            return part.groupBy(F.substring("word", 1, size).alias(name)).agg(F.collect_set(F.length("word")).alias("lengths"))

        stems = begun(words.where(F.length("word").between(stem, near)), stem, "stem")
        far = begun(words.where(F.length("word") > near), near, "ahead")
        return Lexicon(words, stems, far, short, facts["max_len"] or 0, stem, near, fits_broadcast(words), facts["n"])

    def extended(self, words: DataFrame) -> "Lexicon":
        """The same words with more columns, so that a match brings them along without another join."""
        table = as_table(words, "lexicon")
        return replace(self, words=table, fits=fits_broadcast(table))


def gold_lengths(words: Column) -> Column:
    """Per character: the length of the gold word starting there, 0 inside a word."""
    return F.flatten(F.transform(words, lambda w: F.concat(
        F.array(F.length(w)), F.array_repeat(F.lit(0), F.length(w) - 1))))


def positions(sent: DataFrame, max_len: int, keep: Sequence[str] = (), gold: str | None = None) -> DataFrame:
    """One row per character: (sid, keep..., start, ahead, gold_len).

    ``ahead`` holds the next ``max_len`` characters. Taking a substring costs time in its
    offset, so text is cut into overlapping blocks first; a sentence of usual length is one block.
    """
    reach = BLOCK + max_len - 1
    # The outer explodes and the coalesced text keep the optimizer from adding null and size
    # filters, which would evaluate the same array or substring a second time.
    text = F.coalesce(F.col("s"), F.lit(""))
    blocks = sent.where(F.length("s") > 0).select(
        "sid", *keep, text.alias("s"), *([gold_lengths(F.col(gold)).alias("_gold")] if gold else []),
        F.explode_outer(F.sequence(F.lit(0), F.length("s") - 1, F.lit(BLOCK))).alias("_from"))
    blocks = blocks.select(
        "sid", *keep, "_from", F.coalesce(F.substring(F.col("s"), F.col("_from") + 1, F.lit(reach)), F.lit("")).alias("_text"),
        *([F.slice("_gold", F.col("_from") + 1, F.lit(BLOCK)).alias("_gold")] if gold else []))
    if gold:
        rows = blocks.select("sid", *keep, "_from", "_text", F.posexplode_outer("_gold").alias("_off", "gold_len"))
    else:
        offsets = F.sequence(F.lit(0), F.least(F.length("_text"), F.lit(BLOCK)) - 1)
        rows = blocks.select("sid", *keep, "_from", "_text", F.explode_outer(offsets).alias("_off")).withColumn(
            "gold_len", F.lit(None).cast("int"))
    ahead = F.substring(F.col("_text"), F.col("_off") + 1, F.lit(max_len))
    return rows.select("sid", *keep, (F.col("_from") + F.col("_off")).alias("start"),
                       F.coalesce(ahead, F.lit("")).alias("ahead"), "gold_len")


def far_candidates(spots: DataFrame, sent: DataFrame, lex: Lexicon, keep: Sequence[str]) -> DataFrame:
    """Candidates longer than ``lex.near``, where the first characters of such a word occur.

    Only place and length go to the sentence; its text is met once and cut candidate by candidate.
    """
    begun = lookup_join(spots.where(F.length("ahead") == lex.near), lex.far, ["ahead"], "inner", small_fits=lex.fits)
    place = begun.select(F.struct("sid", *keep).alias("_at"), F.struct("start", "gold_len", "lengths").alias("_c"))
    cuts = place.groupBy("_at").agg(F.collect_list("_c").alias("_cuts"))
    met = sent.select("sid", *keep, "s").join(cuts, F.struct("sid", *keep).eqNullSafe(F.col("_at")))
    each = met.select("sid", *keep, "s", F.explode("_cuts").alias("_c")).select(
        "sid", *keep, "s", "_c.start", "_c.gold_len", F.explode("_c.lengths").alias("len"))
    return each.where(F.col("start") + F.col("len") <= F.length("s")).select(
        "sid", *keep, "start", "gold_len", "len", F.substring(F.col("s"), F.col("start") + 1, F.col("len")).alias("word"))


def lattice(sent: DataFrame, lex: Lexicon, keep: Sequence[str] = (), gold: str | None = None,
            every_position: bool = False) -> DataFrame:
    """All lexicon matches: (sid, keep..., start, stop, len, word, is_gold, lexicon columns).

    With ``every_position`` each character also yields its own one-character row, found
    or not (see ``found``): aggregates by position then need no second join to get the
    positions without a match.
    """
    stem = lex.stem
    spots = rows = positions(sent, min(max(lex.max_len, 1), lex.near), keep, gold)
    short = sorted(set(lex.short_lengths) | ({1} if every_position else set()))
    direct = F.array(*[F.lit(n) for n in short]) if short else F.array().cast("array<int>")
    if lex.max_len >= stem:
        rows = lookup_join(rows.withColumn("stem", F.substring("ahead", 1, stem)), lex.stems, ["stem"], "left",
                          small_fits=lex.fits)
        lengths = F.when(F.col("lengths").isNull(), direct).otherwise(F.concat(direct, F.col("lengths")))
    else:
        lengths = direct
    cand = (
        rows.select("sid", *keep, "start", "gold_len", "ahead", F.explode(lengths).alias("len"))
        .where(F.col("len") <= F.length("ahead"))
        .select("sid", *keep, "start", "gold_len", "len",
                F.coalesce(F.substring(F.col("ahead"), F.lit(1), F.col("len")), F.lit("")).alias("word"))
    )
    if lex.max_len > lex.near:
        cand = cand.unionByName(far_candidates(spots, sent, lex, keep))
    words = lex.words.withColumn("found", F.lit(True))
    attributes = [c for c in words.columns if c not in ("word", "len")]
    hits = lookup_join(cand, words.select("word", *attributes), ["word"], "left" if every_position else "inner",
                      small_fits=lex.fits)
    if every_position:
        hits = hits.where(F.col("found") | (F.col("len") == 1))
    return hits.select(
        "sid", *keep, "start", (F.col("start") + F.col("len")).alias("stop"), "len", "word",
        (F.col("gold_len") == F.col("len")).alias("is_gold"), *attributes)


def sentence_spans(sent: DataFrame, lex: Lexicon) -> DataFrame:
    """(sid, spans): all matches of each sentence that has any, as ``array<struct<start,stop>>`` in order."""
    if match.fits(lex.size):
        return match.span_rows(sent, match.broadcast_words(lex.words))
    return lattice(sent, lex).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def occ_hit(sent: DataFrame, lex: Lexicon, by: Sequence[str] = ()) -> DataFrame:
    """Per word: matches, and matches that equal a gold word. Gold spans are read off the
    sentence row itself, so the count is a map and one pre-aggregated shuffle by word."""
    if match.fits(lex.size) and len(by) < 2:
        rows = match.count_rows(sent, match.broadcast_words(lex.words), by)
        return rows.groupBy("word", length_bin(F.length("word")).alias("bin"), *by).agg(F.sum("occ").alias("occ"), F.sum("hit").alias("hit"))
    found = lattice(sent, lex, keep=by, gold="words")
    return found.groupBy("word", "bin", *by).agg(
        F.count(F.lit(1)).alias("occ"), F.sum(F.col("is_gold").cast("bigint")).alias("hit"))


def class_priors(counts: DataFrame) -> DataFrame:
    """(bin, p_g): smoothed share of hits per length bin; all four bins, always."""
    sums = counts.agg(*[
        F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(c))), F.lit(0)).alias(f"{c}_{b}")
        for b in BINS for c in ("hit", "occ")])
    per_bin = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bin"), ((F.col(f"hit_{b}") + 1) / (F.col(f"occ_{b}") + 2)).alias("p_g")) for b in BINS]))
    return sums.select(per_bin.alias("p")).select("p.bin", "p.p_g")


def smoothed(hit: Column, occ: Column, prior: Column, kappa: int = KAPPA) -> Column:
    return (hit + kappa * prior) / (occ + kappa)


def reliability(counts: DataFrame, kappa: int = KAPPA) -> DataFrame:
    """rel(word, occ, hit, p_g, value). The priors are four rows by construction."""
    return counts.join(F.broadcast(class_priors(counts)), "bin").select(
        "word", "occ", "hit", "p_g", smoothed(F.col("hit"), F.col("occ"), F.col("p_g"), kappa).alias("value"))


def reliability_of(words: DataFrame, counts: DataFrame, kappa: int = KAPPA) -> DataFrame:
    """Reliability of any words: the prior of the length bin (0.5 without one) for words never matched."""
    known = counts.select("word", "occ", "hit")
    return (
        words.select("word", length_bin(F.length("word")).alias("bin"))
        .join(known, "word", "left").join(F.broadcast(class_priors(counts)), "bin", "left")
        .select("word", F.coalesce("occ", F.lit(0)).alias("occ"), F.coalesce("hit", F.lit(0)).alias("hit"),
                F.coalesce("p_g", F.lit(0.5)).alias("p_g"), F.col("occ").isNotNull().alias("observed"))
        .withColumn("value", F.when(F.col("observed"), smoothed(F.col("hit"), F.col("occ"), F.col("p_g"), kappa))
                    .otherwise(F.col("p_g")))
    )


def internal_words(tok: DataFrame, external: DataFrame) -> DataFrame:
    """Multi-character words of the corpus that the external lexicon lacks."""
    own = tok.where(F.length("word") >= 2).select("word").distinct()
    return own.join(external.select("word"), "word", "left_anti").withColumn("bin", length_bin(F.length("word")))


def merged_words(first: DataFrame, second: DataFrame, vocab_chars: DataFrame, min_len: int = 2,
                 max_len: int = 4) -> DataFrame:
    """Words of both sources with a length in range whose characters all are in the vocabulary."""
    both = first.select("word").unionByName(second.select("word")).where(
        F.length("word").between(min_len, max_len)).distinct()
    spelled = both.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("ch"))
    # one row per character: Unicode bounds what is broadcast
    unknown = spelled.join(F.broadcast(vocab_chars.select("ch")), "ch", "left_anti").select("word").distinct()
    return both.join(unknown, "word", "left_anti").withColumn("bin", length_bin(F.length("word")))
