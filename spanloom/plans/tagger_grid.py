"""The tagger levels of the experiment grid: all levels in all cross-validation runs, fitted and scored together.

A run learns only from its own training sentences, and inside it a sentence gets its dictionary features from counts
that leave out its inner fold. Counts are taken once: one number per word, run and inner fold. The lexicon then carries one
value per slot (a run without one inner fold, or the whole run), of which a match picks that of its sentence. All models
are optimised in step, see ``spanloom.operators.crf``; every sentence is tested in one run, by all levels in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.labels import BIES, LEGAL_END, LEGAL_NEXT, LEGAL_START, bies_to_words, words_to_bies
from spanloom.functions.script import characters, length_bin
from spanloom.operators import crf
from spanloom.operators import evaluate as ev
from spanloom.operators import features as fe
from spanloom.operators import match
from spanloom.operators.lattice import BINS, Lexicon, lattice, smoothed
from spanloom.operators.ngrams import NgramStats
from spanloom.operators.splits import FOLDS, SEED, has_own_ids, inner_folds, per_fold
from spanloom.plans.scale import BROADCAST_BYTES, exact_rank, seeded_hash
from spanloom.session import as_table

# The levels of the grid as (dictionary level, gap level).
LEVELS = {"crf0": (0, 0), "crf1": (1, 0), "crf2": (2, 0), "crf3": (3, 0), "crf4": (4, 0), "crf5": (5, 0),
          "crf6": (5, 1), "crf7": (5, 2), "crf8": (5, 3), "crf9": (5, 4)}


def numeric_features(names: Sequence[str]) -> list[tuple[str, ...]]:
    """Per level the numeric features it may use."""
    return [tuple(fe.DICT_LEVELS[LEVELS[n][0]]) + tuple(fe.GAP_LEVELS[LEVELS[n][1]]) for n in names]


def run_counts(dealt: DataFrame, lex: Lexicon, k: int = FOLDS) -> DataFrame:
    """(word, bin, occ, hit): arrays by run of arrays by inner fold, over the training sentences of each run."""
    def sums(value: Column) -> Column:
        return F.array(*[per_fold(F.when(F.element_at("in_train", r + 1), value), F.col("inner"), k) for r in range(k)])

    if match.fits(lex.size):
        # counted in the row by inner fold and runs, the latter as bits
        code = sum((F.when(F.element_at("in_train", r + 1), 1 << r).otherwise(0) for r in range(k)), F.col("inner") * (1 << k))
        found = match.count_rows(dealt.select("s", "words", code.cast("int").alias("code")), match.broadcast_words(lex.words), ("code",))
        found = found.groupBy("word", "code").agg(F.sum("occ").alias("occ"), F.sum("hit").alias("hit")).select(
            "word", length_bin(F.length("word")).alias("bin"), "occ", "hit", F.floor(F.col("code") / (1 << k)).cast("int").alias("inner"),
            F.array(*[F.col("code").bitwiseAND(1 << r) != 0 for r in range(k)]).alias("in_train"))
        return found.groupBy("word", "bin").agg(sums(F.col("occ")).alias("occ"), sums(F.col("hit")).alias("hit"))
    found = lattice(dealt, lex, keep=("in_train", "inner"), gold="words")
    return found.groupBy("word", "bin").agg(sums(F.lit(1).cast("bigint")).alias("occ"), sums(F.col("is_gold").cast("bigint")).alias("hit"))


def left_out(counts: Column, run: int, inner: int, k: int = FOLDS) -> Column:
    """Counts of a run without one inner fold; of the whole run for ``inner`` = k. A word without counts has none."""
    own = F.element_at(counts, run + 1)
    total = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(total if inner == k else total - F.element_at(own, inner + 1), F.lit(0).cast("bigint"))


def slot_values(words: DataFrame, counts: DataFrame, k: int = FOLDS) -> DataFrame:
    """``words`` with ``by_slot``: (seen, value) for each run and what it leaves out; slot = run * (k + 1) + inner fold."""
    slots = [(r, g) for r in range(k) for g in range(k + 1)]
    sums = {r["bin"]: r for r in counts.groupBy("bin").agg(*[
        F.array(*[F.sum(left_out(F.col(c), r, g, k)) for r, g in slots]).alias(c) for c in ("occ", "hit")]).collect()}  # a row per length bin
    none = {"occ": [0] * len(slots), "hit": [0] * len(slots)}
    by_bin = {b: sums.get(b, none) for b in BINS}
    total = [sum(by_bin[b]["occ"][i] for b in BINS) for i in range(len(slots))]
    priors = F.create_map(*[x for b in BINS for x in (F.lit(b), F.array(*[
        F.lit((h + 1) / (o + 2)) for o, h in zip(by_bin[b]["occ"], by_bin[b]["hit"])]))])
    known = words.join(counts.select("word", F.col("occ").alias("_occ"), F.col("hit").alias("_hit")), "word", "left").withColumn("_p", priors[F.col("bin")])

    def at(i: int, r: int, g: int) -> Column:
        occ, hit, prior = left_out(F.col("_occ"), r, g, k), left_out(F.col("_hit"), r, g, k), F.element_at("_p", i + 1)
        value = F.when(occ > 0, smoothed(hit, occ, prior)).otherwise(prior) if total[i] else F.lit(0.0)
        return F.struct((occ > 0).alias("seen"), value.alias("value"))

    return known.select(*words.columns, F.array(*[at(i, r, g) for i, (r, g) in enumerate(slots)]).alias("by_slot"))


def grid_rows(dealt: DataFrame, max_rows: int | None = None, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """One row per sentence to test, and one per run and sentence to learn from: (sid, run, slot, learn, category, words, tags, s).

    ``dealt`` has fold, in_train and inner. ``sid`` is new: the sentence's times (k + 1), plus run + 1 where it is learnt from.
    A run learns from all its training sentences, unless the caller bounds them by ``max_rows``.
    """
    used = dealt.select("sid", "inner", "category", "words", "tags", "s", F.posexplode("in_train").alias("run", "used")).where("used")
    if max_rows is not None:
        ranked = exact_rank(used.select("sid", "run", seeded_hash(seed, "run", "sid").alias("digest")), "digest", "sid", by=("run",))
        used = used.join(ranked.where(F.col("rank") < max_rows).select("sid", "run"), ["sid", "run"], "left_semi")
    rest = ["category", "words", "tags", "s"]
    learn = used.select((F.col("sid") * (k + 1) + F.col("run") + 1).alias("sid"), "run", (F.col("run") * (k + 1) + F.col("inner")).alias("slot"),
                        F.lit(True).alias("learn"), *rest)
    test = dealt.select((F.col("sid") * (k + 1)).alias("sid"), F.col("fold").alias("run"), (F.col("fold") * (k + 1) + k).alias("slot"),
                        F.lit(False).alias("learn"), *rest)
    return learn.unionByName(test)


def run_singles(sent_roles: DataFrame, k: int = FOLDS) -> DataFrame:
    """(ch, in_run): one-character words and in whose training parts they stand; bounded by Unicode."""
    rows = sent_roles.select("in_train", F.explode("words").alias("ch")).where(F.length("ch") == 1)
    return rows.groupBy("ch").agg(F.array(*[F.max(F.element_at("in_train", r + 1)) for r in range(k)]).alias("in_run"))


def grid_features(rows: DataFrame, lex: Lexicon, counts: DataFrame, stats: NgramStats, k: int = FOLDS) -> DataFrame:
    """(sid, pos, 20 dictionary and 8 gap columns) of grid_rows()."""
    matches = lattice(rows.select("sid", "slot", "s"), lex.extended(slot_values(lex.words, counts, k)), keep=("slot",), every_position=True)
    own = F.element_at("by_slot", F.col("slot") + 1)
    known = fe.all_dict_columns(matches.withColumn("seen", own["seen"]).withColumn("value", own["value"]))
    return known.join(fe.gap_features(rows.select("sid", "s"), stats), ["sid", "pos"])


def label_numbers() -> Column:
    label = F.array(*[F.lit(b) for b in BIES])
    return F.transform(words_to_bies(F.col("words")), lambda v: (F.array_position(label, v) - 1).cast("int"))


def legal_scores() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of inner, start and end transitions: 0 or impossible."""
    barred = lambda ok: np.where(np.array(ok), 0.0, crf.IMPOSSIBLE)
    return (barred([[b in LEGAL_NEXT[a] for b in BIES] for a in BIES]), barred([b in LEGAL_START for b in BIES]), barred([b in LEGAL_END for b in BIES]))


def paired_rows(rows: DataFrame, singles: DataFrame, lex: Lexicon, counts: DataFrame, stats: NgramStats, names: Sequence[str], k: int,
                max_iter: int) -> DataFrame | None:
    """(method, fold, category, words, tags, pred_words, pred_tags) of the sentences to test of grid_rows(), fitted and cut in their rows; None
    if the words, the pairs or the weights are too many for arrays."""
    levels = numeric_features(names)
    numeric = [n for n in (*fe.DICT_FEATURES, *fe.GAP_FEATURES) if any(n in level for level in levels)]
    valued = lambda: as_table(slot_values(lex.words, counts, k), "grid-words")
    numbers = fe.feature_numbers(numeric, lex, None, stats, (valued, "by_slot", k * (k + 1)))
    if numbers is None:
        return None
    known = [(r["ch"], r["in_run"]) for r in singles.collect()]  # Unicode bounds them
    rows = rows.withColumnRenamed("slot", "fold")
    blocks, index, window = crf.training_blocks(rows.where("learn"), label_numbers(), [[ch for ch, used in known if used[r]] for r in range(k)],
                                                numbers, numeric, keep=("fold",))
    theta = crf.fit_theta(blocks, index, k, numeric, levels, len(BIES), max_iter=max_iter)
    if theta.nbytes > BROADCAST_BYTES:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(crf.RowTagger.of(window, theta, len(numeric), *legal_scores()))
    starts = [BIES.index(b) for b in LEGAL_START]
    keep = ["run", "category", "words", "tags"]

    def cut(batches):
        for batch in match.steps(batches, "s"):
            text = match.Text(batch["s"])
            columns = numbers(text, batch) if numeric else []
            dense = np.stack(columns, 1) if columns else np.zeros((text.n, 0))
            labels = shared.value.labels(text, dense, batch["run"].to_numpy().astype(np.int64))
            # paths are legal, so words begin where B or S stands
            words = [match._segments(text, np.isin(labels[:, i], starts)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *words], [*keep, *names])

    test = rows.where("NOT learn").select(*keep, "s", "fold")
    schema = T.StructType([test.schema[c] for c in keep] + [T.StructField(n, T.ArrayType(T.StringType())) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("pred_words")) for n in names]))
    return test.mapInArrow(cut, schema).select(F.col("run").alias("fold"), "category", "words", "tags", each.alias("m")).select(
        "m.method", "fold", "category", "words", "tags", "m.pred_words", F.array().cast("array<string>").alias("pred_tags"))


def tagger_counts(sent_roles: DataFrame, lex: Lexicon, stats: NgramStats, names: Sequence[str] = tuple(LEVELS), k: int = FOLDS,
                  max_rows: int | None = None, max_iter: int = crf.MAX_ITER) -> DataFrame:
    """Counts per method, fold, category and gold word, as ``evaluate.scored_words`` gives them; ``sent_roles`` has fold and in_train."""
    inner = inner_folds(sent_roles, k).select("sid", F.col("fold").alias("inner"))
    dealt = as_table(sent_roles.join(inner, "sid").select("sid", "category", "words", "tags", "s", "fold", "in_train", "inner"), "grid-dealt")
    counts = as_table(run_counts(dealt, lex, k), "grid-counts")
    rows = as_table(grid_rows(dealt, max_rows, k), "grid-rows")
    singles = as_table(run_singles(sent_roles, k), "grid-singles")
    if has_own_ids(dealt):
        pairs = paired_rows(rows, singles, lex, counts, stats, names, k, max_iter)
        if pairs is not None:
            return as_table(ev.scored_words(pairs, ("method", "fold", "category")), "grid-words")
    extra = as_table(grid_features(rows, lex, counts, stats, k), "grid-features")
    levels = numeric_features(names)
    numeric = [n for n in (*fe.DICT_FEATURES, *fe.GAP_FEATURES) if any(n in level for level in levels)]
    extra = extra.select("sid", "pos", *numeric)
    label, y = F.array(*[F.lit(b) for b in BIES]), label_numbers()
    learn = rows.where("learn")
    table, index = crf.training_table(learn, singles, y, extra.join(learn.select("sid"), "sid", "left_semi"), numeric, runs=k)
    theta = crf.fit_theta(table, index, k, numeric, levels, len(BIES), max_iter=max_iter)

    test = rows.where("NOT learn")
    known = extra.join(test.select("sid"), "sid", "left_semi")
    legal, *ends = legal_scores()
    if theta.nbytes <= BROADCAST_BYTES:
        coded = crf.encoded(test.select("sid", "run", "s"), singles, index, known, numeric).join(test.select("sid", "run"), "sid")
        paths = crf.decode_encoded(coded, theta, legal, *ends)
    else:
        scored = crf.emissions(test.select("sid", "run", "s"), singles, known, numeric, crf.weight_table(theta, index, numeric),
                               len(names) * len(BIES), by_run=True)
        paths = crf.decode(scored.join(test.select("sid", "run"), "sid"), crf.transitions_of(theta) + legal, *ends)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.element_at("paths", i + 1).alias("path")) for i, n in enumerate(names)]))
    joined = test.join(as_table(paths, "grid-paths"), "sid", "left").select("run", "category", "words", "tags", "s", each.alias("m"))
    labels = F.transform(F.coalesce("m.path", F.array().cast("array<int>")), lambda i: F.element_at(label, i + 1))
    pairs = joined.select(F.col("m.method").alias("method"), F.col("run").alias("fold"), "category", "words", "tags",
                          bies_to_words(characters(F.col("s")), labels).alias("pred_words"), F.array().cast("array<string>").alias("pred_tags"))
    return as_table(ev.scored_words(pairs, ("method", "fold", "category")), "grid-words")
