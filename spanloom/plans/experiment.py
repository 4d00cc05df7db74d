"""The experiment grid: dictionary segmenters x cross-validation runs, in one plan.

Every run has its own training words, but not its own scan: a word is stored once with
an array telling in which runs it may be used, each sentence is tested in exactly one
run, and so a single lattice and a single scoring pass serve all runs of a method.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import evaluate as ev
from spanloom.operators import match
from spanloom.operators.lattice import Lexicon
from spanloom.operators.segment import FALLBACK_SINGLES, max_match
from spanloom.operators.vocab import UNSEEN_TAG
from spanloom.operators.splits import FOLDS, has_own_ids
from spanloom.plans.tagger_grid import LEVELS
from spanloom.session import as_table

# Method names of the grid and what each stands for.
METHODS = {
    "fmm_corpus": ("fmm", "corpus"), "bmm_corpus": ("bmm", "corpus"), "dict_corpus": ("bidirectional", "corpus"),
    "dict_predefined": ("bidirectional", "predefined"), "dict_combined": ("bidirectional", "combined"),
}


#: Every method of the grid, the tagger levels included.
ALL_METHODS = (*METHODS, *LEVELS)


def method_table(spark, names: Sequence[str]) -> DataFrame:
    """(method, known) for a list of requested names; a list the user types, hence small."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("method")).distinct()
    return wanted.select("method", F.col("method").isin(*ALL_METHODS).alias("known"))


def run_words(sent_roles: DataFrame, k: int = FOLDS) -> DataFrame:
    """(word, in_run[k], tag_run[k]): whether a word is in the training part of a run, and its
    modal tag there (first seen wins a tie). Two map-side reduced aggregates, no per-run scan."""
    words = F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag")))
    rows = sent_roles.select("sid", "in_train", words.alias("idx", "w"))
    uses = [F.element_at("in_train", i + 1) for i in range(k)]
    per_tag = rows.groupBy(F.col("w.word").alias("word"), F.col("w.tag").alias("tag")).agg(*[
        F.struct(F.sum(u.cast("bigint")).alias("cnt"),
                 F.min(F.when(u, F.struct("sid", "idx"))).alias("at")).alias(f"r{i}") for i, u in enumerate(uses)])
    best = [F.max_by("tag", F.when(F.col(f"r{i}.cnt") > 0, F.struct(
        F.col(f"r{i}.cnt"), -F.col(f"r{i}.at.sid"), -F.col(f"r{i}.at.idx")))) for i in range(k)]
    return per_tag.groupBy("word").agg(
        F.array(*[F.max(F.col(f"r{i}.cnt") > 0) for i in range(k)]).alias("in_run"), F.array(*best).alias("tag_run"))


def run_dictionary(words: DataFrame, predefined: DataFrame | None, source: str, k: int = FOLDS) -> DataFrame:
    """(word, in_run[k]) of one dictionary source; fallback characters and external words hold in every run."""
    always = F.array_repeat(F.lit(True), k)
    singles = words.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in FALLBACK_SINGLES])).alias("word"), always.alias("in_run"))
    parts = [singles]
    if source in ("corpus", "combined"):
        parts.append(words.select("word", "in_run"))
    if source in ("predefined", "combined"):
        parts.append(predefined.select("word", always.alias("in_run")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("word").agg(F.array(*[F.max(F.element_at("in_run", i + 1)) for i in range(k)]).alias("in_run"))


def cv_scores(sent_roles: DataFrame, predefined: DataFrame, names: Sequence[str] = tuple(METHODS),
              k: int = FOLDS, taggers: DataFrame | None = None) -> DataFrame:
    """(method, fold, category, counts and metrics), ``ALL`` rows included; unknown names are left out.

    ``names`` are dictionary methods; ``taggers`` are counts of tagger levels, from ``tagger_grid.tagger_counts``.
    """
    sent_roles = sent_roles.persist(StorageLevel.MEMORY_AND_DISK)
    words, unique = as_table(run_words(sent_roles, k), "run-words"), has_own_ids(sent_roles)
    counted = [] if taggers is None else [taggers]
    for source in dict.fromkeys(METHODS[n][1] for n in names if n in METHODS):
        methods = {n: METHODS[n][0] for n in names if n in METHODS and METHODS[n][1] == source}
        lex = Lexicon.build(run_dictionary(words, predefined, source, k))
        kinds, gold = tuple(dict.fromkeys(methods.values())), ("sid", "fold", "category", "words", "tags")
        if unique and match.fits(lex.size, k):
            shared = match.broadcast_words(lex.words, *[F.element_at("in_run", i + 1) for i in range(k)])
            joined = match.segment_rows(sent_roles.where(F.length("s") > 0), shared, kinds, True, gold)
        else:
            pred = max_match(sent_roles, lex, kinds, valid=F.element_at("in_run", F.col("fold") + 1), keep=("fold",))
            joined = sent_roles.select(*gold).join(pred, "sid")
        # All modes of a source are scored in one pass over the sentences.
        modes = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(m).alias("pred_words"))
                                    for n, m in methods.items()]))
        pairs = joined.select("fold", "category", "words", "tags", modes.alias("m")).select(
            F.col("m.method").alias("method"), "fold", "category", "words", "tags",
            F.col("m.pred_words").alias("pred_words"), F.array().cast("array<string>").alias("pred_tags"))
        counted.append(as_table(ev.scored_words(pairs, ("method", "fold", "category")), "cv-words"))
    counts = counted[0]
    for c in counted[1:]:
        counts = counts.unionByName(c)
    # Words are counted before they meet the vocabulary, so a frequent word is a few rows here.
    marked = counts.join(words, "word", "left").withColumn(
        "iv", F.coalesce(F.element_at("in_run", F.col("fold") + 1), F.lit(False))).withColumn(
        "tag_ok", F.when(F.coalesce(F.element_at("tag_run", F.col("fold") + 1), F.lit(UNSEEN_TAG)) == F.col("tag"),
                         F.col("correct")).otherwise(0))
    return as_table(ev.metrics(ev.totals(marked, ("method", "fold"), "category")), "cv-scores")


def grid(scores: DataFrame) -> DataFrame:
    """metrics(method, category, fold, metric, value)."""
    return ev.to_long(scores, ("method", "category", "fold"))
