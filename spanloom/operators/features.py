"""Character features from the lattice, from unlabelled statistics and from the character window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.script import characters, length_bin
from spanloom.operators import match
from spanloom.operators.lattice import BINS, Lexicon, class_priors, lattice, smoothed
from spanloom.operators.ngrams import NgramStats
from spanloom.operators.splits import FOLDS, inner_folds, others, per_fold
from spanloom.operators.vocab import sentence_share
from spanloom.plans.scale import fits_broadcast, lookup_join
from spanloom.session import as_table

# Feature order, which the ablation levels index.
BIE_FEATURES = ("B2", "B3", "B4", "B5P", "I3", "I4", "I5P", "E2", "E3", "E4", "E5P")
REL_FEATURES = ("rel_seen_B", "rel_seen_I", "rel_seen_E", "rel_unseen_B", "rel_unseen_I", "rel_unseen_E")
META_FEATURES = ("has_yi", "has_yin", "has_book_title")
DICT_FEATURES = BIE_FEATURES + REL_FEATURES + META_FEATURES
GAP_FEATURES = ("L_freq", "L_assoc", "L_ent_prev", "L_ent_cur", "R_freq", "R_assoc", "R_ent_cur", "R_ent_next")

DICT_LEVELS = {
    0: (), 1: BIE_FEATURES, 2: DICT_FEATURES[:14], 3: DICT_FEATURES[:17],
    4: BIE_FEATURES + META_FEATURES, 5: DICT_FEATURES,
}
GAP_LEVELS = {
    0: (), 1: ("L_freq", "R_freq"), 2: ("L_freq", "L_assoc", "R_freq", "R_assoc"), 3: GAP_FEATURES,
    4: ("L_freq", "L_ent_prev", "L_ent_cur", "R_freq", "R_ent_cur", "R_ent_next"),
}


def cumulative_dict_level(level: int) -> int:
    """Level of the cumulative scheme: 0-3 as they are, all features from 4 on."""
    return level if level <= 3 else 5


def feature_slice(features: DataFrame, names: Sequence[str], keys: Sequence[str] = ("sid", "pos")) -> DataFrame:
    """The columns of one ablation level; unused columns are pruned from the whole plan."""
    return features.select(*keys, *names)


def covered(matches: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per match and covered position, with its place in the word."""
    place = F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos")
    rows = matches.select("sid", "start", "stop", "len", *keep, place)
    return rows.select(
        "sid", "pos", "len", *keep,
        (F.col("pos") == F.col("start")).alias("first"), (F.col("pos") == F.col("stop") - 1).alias("last"))


# Place x length and metadata marks are collected as one bit mask, a single integer
# aggregate, and unpacked once per character.
_BIT = {name: 1 << i for i, name in enumerate(BIE_FEATURES + META_FEATURES)}


def _bie_bits() -> Column:
    def by_bin(place: str) -> Column:
        out = F.lit(0)
        for name in BIE_FEATURES:
            if name[0] == place:
                out = F.when(F.col("bin") == name[1:], F.lit(_BIT[name])).otherwise(out)
        return out

    inner = F.when(F.col("first") | F.col("last"), 0).otherwise(by_bin("I"))
    return F.when(F.col("first"), by_bin("B")).otherwise(0).bitwiseOR(
        F.when(F.col("last"), by_bin("E")).otherwise(0)).bitwiseOR(inner)


def _meta_bits() -> Column:
    out = F.lit(0)
    for name in META_FEATURES:
        out = out.bitwiseOR(F.when(F.col(name), F.lit(_BIT[name])).otherwise(0))
    return out


def _mask(found: Column, bits: Column) -> Column:
    return F.bit_or(F.when(found, bits).otherwise(0)).alias("_mask")


def _unpack(names: Sequence[str]) -> list[Column]:
    return [F.when(F.col("_mask").bitwiseAND(F.lit(_BIT[n])) != 0, 1.0).otherwise(0.0).alias(n) for n in names]


def _rel_columns(found: Column) -> list[Column]:
    """Best value per seen/unseen x begin/cover/end; I stands for every covered position."""
    where = {"B": F.col("first"), "I": F.lit(True), "E": F.col("last")}
    out = []
    for kind, cond in (("seen", F.col("seen")), ("unseen", ~F.col("seen"))):
        for part in "BIE":
            value = F.when(found & cond & where[part], F.col("value"))
            out.append(F.coalesce(F.max(value), F.lit(0.0)).alias(f"rel_{kind}_{part}"))
    return out


def merged(rows: DataFrame, unique: bool) -> DataFrame:
    """One row per (sid, pos): of sentences that share an id, the largest values. ``unique``: no two do."""
    names = [c for c in rows.columns if c not in ("sid", "pos")]
    return rows if unique else rows.groupBy("sid", "pos").agg(*[F.max(n).alias(n) for n in names])


def _dict_numbers(names: Sequence[str], fold: bool):
    """The dictionary features of a batch; a word's values are its three flags, then (seen, value), of each fold with ``fold``."""
    flags = len(META_FEATURES)

    def numbers(text, begin, size, values, batch):
        own = values[:, flags:]
        if fold:
            own = match.by_fold(text, begin, own, batch, 2)
        out = []
        for n in names:
            if n in META_FEATURES:
                out.append(match.covers(text.n, begin, size, values[:, META_FEATURES.index(n)] != 0))
            elif n in REL_FEATURES:
                of = (own[:, 0] != 0) == n.startswith("rel_seen")
                out.append(match.best(n[-1], text.n, begin[of], size[of], own[of, 1]))
            else:
                out.append(match.marks(n, text.n, begin, size))
        return out

    return numbers


def _truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _made(sent: DataFrame, names: Sequence[str], numbers, keep: Sequence[str], unique: bool, sums: str | None) -> DataFrame:
    """Rows by position, those of sentences that share an id merged; or their ``sums``, made where the numbers are."""
    if sums and unique:
        return match.character_rows(sent, names, numbers, keep, sums)
    return _summed(merged(match.character_rows(sent, names, numbers, keep), unique), names, sums)


def _summed(rows: DataFrame, names: Sequence[str], sums: str | None) -> DataFrame:
    """Rows by position summed as ``match.character_rows`` does."""
    if sums == "place":
        return rows.groupBy("sid").agg(*[F.sum(F.col(n) * (F.col("pos") + 1)).alias(n) for n in names])
    if sums == "all":
        return rows.agg(*[F.sum(n).alias(n) for n in names], *[F.count_if(F.col(n) != 0).alias(f"n:{n}") for n in names])
    return rows


def bie_features(sent: DataFrame, lex: Lexicon, unique: bool = False, sums: str | None = None) -> DataFrame:
    """(sid, pos, 11 columns) multi-hot place x length, zero rows included. ``unique``: every ``sid`` stands once.

    Here and below: with ``sums`` (see ``match.character_rows``) the columns are summed per sentence or over all characters, in
    the sentence's row where every ``sid`` stands once, so that no row per character is made."""
    if match.fits(lex.size):
        shared = match.broadcast_words(lex.words)
        return _made(sent, BIE_FEATURES, match.matched(shared, _dict_numbers(BIE_FEATURES, False)), (), unique, sums)
    rows = covered(lattice(sent, lex, every_position=True), ("bin", "found"))
    masks = rows.groupBy("sid", "pos").agg(_mask(F.coalesce("found", F.lit(False)), _bie_bits()))
    return _summed(masks.select("sid", "pos", *_unpack(BIE_FEATURES)), BIE_FEATURES, sums)


def meta_features(sent: DataFrame, lex: Lexicon, unique: bool = False, sums: str | None = None) -> DataFrame:
    if match.fits(lex.size, len(META_FEATURES)):
        shared = match.broadcast_words(lex.words, *map(_truth, META_FEATURES))
        return _made(sent, META_FEATURES, match.matched(shared, _dict_numbers(META_FEATURES, False)), (), unique, sums)
    rows = covered(lattice(sent, lex, every_position=True), (*META_FEATURES, "found"))
    masks = rows.groupBy("sid", "pos").agg(_mask(F.coalesce("found", F.lit(False)), _meta_bits()))
    return _summed(masks.select("sid", "pos", *_unpack(META_FEATURES)), META_FEATURES, sums)


def valued_words(lex: Lexicon, counts: DataFrame | None) -> DataFrame:
    """The words with (seen, value) from ``counts``: a word is valued once, not once per match."""
    words = lex.words
    if counts is None:
        return words.select("*", F.lit(True).alias("seen"), F.lit(0.0).alias("value"))
    any_seen = counts.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    known = words.join(counts.select("word", "occ", "hit"), "word", "left").join(
        F.broadcast(class_priors(counts)), "bin", "left")
    seen = F.coalesce(F.col("occ") > 0, F.lit(False))
    value = F.when(seen, smoothed(F.col("hit"), F.col("occ"), F.col("p_g"))).otherwise(F.coalesce("p_g", F.lit(0.5)))
    return known.select(*words.columns, seen.alias("seen"), F.when(any_seen, value).otherwise(0.0).alias("value"))


def broadcast_valued(valued: DataFrame):
    """The broadcast words of ``valued_words`` as ``_dict_numbers`` expects them."""
    return match.broadcast_words(valued, *map(_truth, META_FEATURES), F.col("seen"), F.col("value"))


def dict_features(sent: DataFrame, lex: Lexicon, counts: DataFrame | None, names: Sequence[str] = DICT_FEATURES, unique: bool = False,
                  sums: str | None = None) -> DataFrame:
    """(sid, pos, 20 columns, or ``names`` of them). ``counts`` is ``occ_hit`` of the training sentences; without it,
    or when it is empty, the six reliability columns are 0.
    """
    valued = valued_words(lex, counts)
    if match.fits(lex.size, len(META_FEATURES) + 2):
        return _made(sent, names, match.matched(broadcast_valued(valued), _dict_numbers(names, False)), (), unique, sums)
    return _summed(all_dict_columns(lattice(sent, lex.extended(valued), every_position=True)).select("sid", "pos", *names), names, sums)


def all_dict_columns(valued: DataFrame) -> DataFrame:
    """(sid, pos, 20 columns) from matches at every position that carry ``seen`` and ``value``."""
    rows = covered(valued, ("bin", "found", "seen", "value", *META_FEATURES))
    found = F.coalesce("found", F.lit(False))
    both = rows.groupBy("sid", "pos").agg(_mask(found, _bie_bits().bitwiseOR(_meta_bits())), *_rel_columns(found))
    return both.select("sid", "pos", *_unpack(BIE_FEATURES), *REL_FEATURES, *_unpack(META_FEATURES))


def fold_counts(sent: DataFrame, lex: Lexicon, k: int = FOLDS) -> DataFrame:
    """(word, bin, occ[k], hit[k]) over sentences with a ``fold`` column: one pass for all folds."""
    if match.fits(lex.size):
        rows = match.count_rows(sent, match.broadcast_words(lex.words), ("fold",))
        return rows.groupBy("word", length_bin(F.length("word")).alias("bin")).agg(
            per_fold(F.col("occ"), F.col("fold"), k).alias("occ_f"), per_fold(F.col("hit"), F.col("fold"), k).alias("hit_f"))
    found = lattice(sent, lex, keep=("fold",), gold="words")
    return found.groupBy("word", "bin").agg(
        per_fold(F.lit(1).cast("bigint"), F.col("fold"), k).alias("occ_f"),
        per_fold(F.col("is_gold").cast("bigint"), F.col("fold"), k).alias("hit_f"))


def fold_priors(counts: DataFrame, k: int = FOLDS) -> DataFrame:
    """(bin, fold, p_g, n_occ): priors from all folds but one; 4 x k rows by construction."""
    per_bin = counts.groupBy("bin").agg(*[
        F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(k)]).alias(c) for c in ("occ_f", "hit_f")])
    bins = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in BINS])).alias("bin"))
    rows = bins.join(per_bin, "bin", "left").select(
        "bin", "occ_f", "hit_f", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold")).select(
        "bin", "fold", *[F.coalesce(others(F.col(f"{c}_f"), F.col("fold")), F.lit(0)).alias(c) for c in ("occ", "hit")])
    return rows.select("bin", "fold", ((F.col("hit") + 1) / (F.col("occ") + 2)).alias("p_g"),
                       F.sum("occ").over(Window.partitionBy("fold")).alias("n_occ"))


def oof_dict_features(sent: DataFrame, lex: Lexicon, k: int = FOLDS, folds: DataFrame | None = None,
                      only: DataFrame | None = None, unique: bool = False, sums: str | None = None) -> DataFrame:
    """(sid, pos, 20 columns) where a sentence never sees counts from its own fold.

    All sentences are counted; with ``only`` (sid), features are made of those sentences alone.

    Counts per word hold one number per fold; what the other folds saw is total minus own.
    The lexicon carries one value per fold, of which a match picks that of its sentence.
    """
    dealt = sent.join(folds if folds is not None else inner_folds(sent, k), "sid")
    valued = oof_words(dealt, lex, k)
    wanted = dealt if only is None else dealt.join(only.select("sid"), "sid", "left_semi")
    if match.fits(lex.size, len(META_FEATURES) + 2 * k):
        return _made(wanted, DICT_FEATURES, match.matched(broadcast_slots(valued, "by_fold", k), _dict_numbers(DICT_FEATURES, True)), ("fold",), unique, sums)
    matches = lattice(wanted, lex.extended(valued), keep=("fold",), every_position=True)
    own = F.element_at("by_fold", F.col("fold") + 1)
    return _summed(all_dict_columns(matches.withColumn("seen", own["seen"]).withColumn("value", own["value"])), DICT_FEATURES, sums)


def oof_words(dealt: DataFrame, lex: Lexicon, k: int = FOLDS) -> DataFrame:
    """The words with ``by_fold``: (seen, value) of each fold, from the sentences of the others; ``dealt`` has ``fold``."""
    counts = as_table(fold_counts(dealt, lex, k), "fold-counts")
    priors = fold_priors(counts, k).groupBy("bin").agg(
        F.array_sort(F.collect_list(F.struct("fold", "p_g", "n_occ"))).alias("prior_f"))
    words = lex.words
    known = words.join(counts.select("word", "occ_f", "hit_f"), "word", "left").join(F.broadcast(priors), "bin", "left")

    def at(i: int) -> Column:
        occ, hit = (F.coalesce(others(F.col(c), F.lit(i)), F.lit(0)) for c in ("occ_f", "hit_f"))
        prior = F.element_at("prior_f", i + 1)
        value = F.when(occ > 0, smoothed(hit, occ, prior["p_g"])).otherwise(prior["p_g"])
        return F.struct((occ > 0).alias("seen"), F.when(prior["n_occ"] > 0, value).otherwise(0.0).alias("value"))

    return known.select(*words.columns, F.array(*[at(i) for i in range(k)]).alias("by_fold"))


def broadcast_slots(valued: DataFrame, slots: str, n: int):
    """The broadcast words with (seen, value) of each of ``n`` slots, as ``_dict_numbers`` expects them by fold."""
    own = [F.element_at(slots, i + 1)[c] for i in range(n) for c in ("seen", "value")]
    return match.broadcast_words(valued, *map(_truth, META_FEATURES), *own)


def word_folds(tok: DataFrame, k: int = FOLDS) -> DataFrame:
    """(word, n_f[k]): occurrences of multi-character words per fold."""
    return tok.where(F.length("word") >= 2).groupBy("word").agg(
        per_fold(F.lit(1).cast("bigint"), F.col("fold"), k).alias("n_f"))


def oof_internal_features(sent_folds: DataFrame, internal: Lexicon, unique: bool = False, sums: str | None = None) -> DataFrame:
    """(sid, pos, 11 columns): internal words count only if some other fold contains them.

    ``internal`` carries ``n_f``; ``sent_folds`` carries ``fold``.
    """
    if match.fits(internal.size, FOLDS):
        def numbers(text, begin, size, values, batch):
            ok = match.by_fold(text, begin, values, batch, 1)[:, 0] != 0
            return [match.marks(n, text.n, begin[ok], size[ok]) for n in BIE_FEATURES]

        shared = match.broadcast_words(internal.words, *[others(F.col("n_f"), F.lit(i)) > 0 for i in range(FOLDS)])
        return _made(sent_folds, BIE_FEATURES, match.matched(shared, numbers), ("fold",), unique, sums)
    matches = lattice(sent_folds, internal, keep=("fold",), every_position=True)
    valid = F.coalesce(F.col("found"), F.lit(False)) & (others(F.col("n_f"), F.col("fold")) > 0)
    rows = covered(matches.withColumn("ok", F.coalesce(valid, F.lit(False))), ("bin", "ok"))
    masks = rows.groupBy("sid", "pos").agg(_mask(F.col("ok"), _bie_bits()))
    return _summed(masks.select("sid", "pos", *_unpack(BIE_FEATURES)), BIE_FEATURES, sums)


def domain_vectors(matches: DataFrame, in_a: Column) -> DataFrame:
    """(sid, pos, share_a, share_b): mean share of the covering matches.

    ``matches`` has ``valid`` (a match that counts), ``share_a``/``share_b`` (NULL when the
    word has none) and the columns of ``in_a``; positions without a match and words without
    a share take the certain share of the sentence.
    """
    own_a, own_b = sentence_share(in_a)
    valid = F.col("valid")
    filled = matches.select(
        "sid", "start", "stop", "len", "valid", own_a.alias("own"),
        F.when(valid, F.coalesce("share_a", own_a)).alias("a"), F.when(valid, F.coalesce("share_b", own_b)).alias("b"))
    rows = covered(filled, ("a", "b", "own"))
    sums = rows.groupBy("sid", "pos").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.max("own").alias("own"))
    return sums.select("sid", "pos", F.coalesce("a", "own").alias("share_a"), F.coalesce("b", 1.0 - F.col("own")).alias("share_b"))


#: Shares are summed in whole units of 1e-9, so that the order of summation cannot show.
SHARE_UNITS = 1e9


def _domain_sums(vectors: DataFrame, sums: str | None) -> DataFrame:
    if sums != "place":
        return vectors
    place = F.col("pos") + 1
    return vectors.groupBy("sid").agg(*[
        F.sum(F.round(F.col(x) * SHARE_UNITS, 0).cast("bigint") * place).alias(x) for x in ("share_a", "share_b")])


def _domain_rows(sent: DataFrame, shared, in_a: Column, fold: bool, sums: str | None) -> DataFrame:
    """As ``domain_vectors``, inside the sentence; a word's values are (valid, share_a, share_b), of each fold with ``fold``."""
    def numbers(text, begin, size, values, batch):
        if fold:
            values = match.by_fold(text, begin, values, batch, 3)
        own_a, own_b = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("own_a", "own_b"))
        ok = values[:, 0] == 1
        begin, size, values = begin[ok], size[ok], values[ok]
        row, of, out = text.rows(), np.searchsorted(text.stops, begin, "right"), []
        for own, share, rest in ((own_a, values[:, 1], own_a), (own_b, values[:, 2], 1.0 - own_a)):
            seen = match.mean(text.n, begin, size, np.where(np.isnan(share), own[of], share))
            out.append(np.where(np.isnan(seen), rest[row], seen))
        return out

    own_a, own_b = sentence_share(in_a)
    rows = sent.withColumns({"own_a": own_a, "own_b": own_b})
    return match.position_rows(rows, shared, ("share_a", "share_b"), numbers, ("own_a", "own_b", *(["fold"] if fold else [])),
                               sums, SHARE_UNITS if sums else None)


def domain_features(sent: DataFrame, words: Lexicon, in_a: Column, unique: bool = False, sums: str | None = None) -> DataFrame:
    """Domain vectors over one joint lexicon (external and internal words, with their shares); ``sums`` = "place": in whole units, see SHARE_UNITS."""
    if unique and match.fits(words.size, 3):
        return _domain_rows(sent, match.broadcast_words(words.words, F.lit(1), F.col("share_a"), F.col("share_b")), in_a, False, sums)
    matches = lattice(sent, words, keep=("category",), every_position=True)
    return _domain_sums(domain_vectors(matches.withColumn("valid", F.coalesce("found", F.lit(False))), in_a), sums)


def oof_domain_features(sent_folds: DataFrame, words: Lexicon, in_a: Column, unique: bool = False, sums: str | None = None) -> DataFrame:
    """As ``domain_features`` with shares from the other folds. ``words`` carries ``external``
    and the per-fold counts ``a_f`` and ``b_f`` (NULL for words the corpus lacks)."""
    if unique and match.fits(words.size, 3 * FOLDS):
        values = []
        for i in range(FOLDS):
            n_a, n_b = (F.coalesce(others(F.col(c), F.lit(i)), F.lit(0)) for c in ("a_f", "b_f"))
            valid = F.coalesce(F.col("external") | (n_a + n_b > 0), F.lit(False))
            values += [valid, F.try_divide(n_a, n_a + n_b), F.try_divide(n_b, n_a + n_b)]
        return _domain_rows(sent_folds, match.broadcast_words(words.words, *values), in_a, True, sums)
    matches = lattice(sent_folds, words, keep=("category", "fold"), every_position=True)
    a, b = others(F.col("a_f"), F.col("fold")), others(F.col("b_f"), F.col("fold"))
    shared = (
        matches.withColumn("_a", F.coalesce(a, F.lit(0))).withColumn("_n", F.col("_a") + F.coalesce(b, F.lit(0)))
        .withColumn("valid", F.coalesce(F.col("found") & (F.col("external") | (F.col("_n") > 0)), F.lit(False)))
        .withColumn("share_a", F.try_divide("_a", "_n"))
        .withColumn("share_b", F.try_divide(F.col("_n") - F.col("_a"), F.col("_n")))
    )
    return _domain_sums(domain_vectors(shared, in_a), sums)


def broadcast_gaps(stats: NgramStats):
    """The pairs and the entropies broadcast as arrays; None if they are too many."""
    if not match.fits(stats.bi.count(), 2):
        return None
    pairs = stats.pairs.select("a", "b", "logfreq", "assoc").toArrow()
    return stats.bi.sparkSession.sparkContext.broadcast(match.Pairs(pairs, stats.entropy.select("ch", "h_left", "h_right").toArrow()))


def gap_numbers(shared, names: Sequence[str] = GAP_FEATURES):
    """The gap features of a batch: a gap is valued once, as the right gap of its left character and the left gap of the next one."""
    def numbers(text, batch):
        pairs, single = shared.value.of(text.codes)
        last = np.zeros(text.n, bool)
        last[text.stops[text.sizes > 0] - 1] = True
        ahead = [*pairs, single["h_right"], np.append(single["h_left"][1:], 0.0)]
        right = [np.where(last, 0.0, v) for v in ahead]
        left = [np.append(0.0, v[:-1]) for v in right]  # nothing follows the last character of the text before
        known = dict(zip(GAP_FEATURES, [*left, *right]))
        return [known[n] for n in names]

    return numbers


def feature_numbers(names: Sequence[str], lex: Lexicon | None, counts: DataFrame | None, stats: NgramStats | None,
                    slots: tuple[Callable[[], DataFrame], str, int] | None = None):
    """A function that makes the dictionary and gap features ``names`` of a batch; None if the words or the pairs are too many for arrays.

    ``slots``: a function that makes the words with (seen, value) by slot instead, the name of that column and the number of slots; a
    sentence then takes those of its ``fold``.
    """
    known = [n for n in names if n in DICT_FEATURES]
    gaps = [n for n in names if n in GAP_FEATURES]
    if known and not match.fits(lex.size, len(META_FEATURES) + 2 * (slots[2] if slots else 1)):
        return None
    shared = broadcast_gaps(stats) if gaps else None
    if gaps and shared is None:
        return None
    words = lambda: broadcast_slots(slots[0](), *slots[1:]) if slots else broadcast_valued(valued_words(lex, counts))
    parts = [(known, match.matched(words(), _dict_numbers(known, slots is not None)))] if known else []
    parts += [(gaps, gap_numbers(shared, gaps))] if gaps else []

    def numbers(text, batch):
        made = {n: c for own, make in parts for n, c in zip(own, make(text, batch))}
        return [made[n] for n in names]

    return numbers


def gap_features(sent: DataFrame, stats: NgramStats, unique: bool = False, sums: str | None = None) -> DataFrame:
    """(sid, pos, 8 columns) describing the gaps left and right of each character.

    Where every ``sid`` stands once (``unique``), both gaps are looked up in the sentence's row, in broadcast arrays; if the pairs are too
    many for that, by joins of characters that carry their neighbours. Else a gap is looked up once, as the right gap of its left
    character; the left gap of the next character is the same row seen through ``lag`` over the sentence.
    """
    if unique:
        shared = broadcast_gaps(stats)
        if shared is not None:
            return match.character_rows(sent, GAP_FEATURES, gap_numbers(shared), (), sums)
        return _summed(_gaps_in_row(sent, stats), GAP_FEATURES, sums)
    chars = characters(F.col("s"))
    n = F.size(chars)
    pairs = F.arrays_zip(chars.alias("ch"), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("nxt"))
    rows = sent.where(F.length("s") > 0).select("sid", F.posexplode(pairs).alias("pos", "c")).select(
        "sid", "pos", F.col("c.ch").alias("a"), F.col("c.nxt").alias("b"))
    bi = stats.pairs.select("a", "b", F.col("logfreq").alias("R_freq"), F.col("assoc").alias("R_assoc"))
    looked = lookup_join(rows, bi, ["a", "b"], "left", small_fits=fits_broadcast(stats.bi))
    # Entropy tables have one row per character, so Unicode bounds them.
    ent = stats.entropy
    looked = looked.join(F.broadcast(ent.select(F.col("ch").alias("a"), F.col("h_right").alias("R_ent_cur"))), "a", "left")
    looked = looked.join(F.broadcast(ent.select(F.col("ch").alias("b"), F.col("h_left").alias("R_ent_next"))), "b", "left")
    in_text = F.col("b").isNotNull()
    right = ("R_freq", "R_assoc", "R_ent_cur", "R_ent_next")
    filled = looked.select("sid", "pos", *[
        F.when(in_text, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c) for c in right])
    w = Window.partitionBy("sid").orderBy("pos")
    left = [F.coalesce(F.lag(c).over(w), F.lit(0.0)).alias(name) for c, name in zip(right, GAP_FEATURES[:4])]
    return _summed(filled.select("sid", "pos", *left, *right), GAP_FEATURES, sums)


def _gaps_in_row(sent: DataFrame, stats: NgramStats) -> DataFrame:
    chars = characters(F.col("s"))
    n, none = F.size(chars), F.array(F.lit(None).cast("string"))
    around = F.arrays_zip(F.concat(none, F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("prv"), chars.alias("ch"),
                          F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("nxt"))
    rows = sent.where(F.length("s") > 0).select("sid", F.posexplode(around).alias("pos", "c")).select("sid", "pos", "c.prv", "c.ch", "c.nxt")
    small, ent = fits_broadcast(stats.bi), as_table(stats.entropy, "gap-entropy")
    pairs = as_table(stats.pairs.select("a", "b", "logfreq", "assoc"), "gap-pairs")
    for a, b, side, names in (("prv", "ch", "L", GAP_FEATURES[:4]), ("ch", "nxt", "R", GAP_FEATURES[4:])):
        freq, assoc, first, second = names
        rows = lookup_join(rows, pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.col("logfreq").alias(freq), F.col("assoc").alias(assoc)),
                           [a, b], "left", small_fits=small)
        # entropy tables have one row per character, so Unicode bounds them
        rows = rows.join(F.broadcast(ent.select(F.col("ch").alias(a), F.col("h_right").alias(first))), a, "left")
        rows = rows.join(F.broadcast(ent.select(F.col("ch").alias(b), F.col("h_left").alias(second))), b, "left")
    inside = {**{c: F.col("prv").isNotNull() for c in GAP_FEATURES[:4]}, **{c: F.col("nxt").isNotNull() for c in GAP_FEATURES[4:]}}
    return rows.select("sid", "pos", *[F.when(inside[c], F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c) for c in GAP_FEATURES])


# Symbols for places outside the sentence.
OUTSIDE = {-1: "<BOS>", 1: "<EOS>", -2: "<BOS2>", 2: "<EOS2>"}
WINDOW_FEATURES = ("c0", "c-1", "c+1", "c-2", "c+2", "c-1_c0", "c0_c+1", "is_digit", "is_alpha", "is_punct", "in_dict")


def character_flags(c: Column) -> tuple[Column, Column, Column]:
    """Whether a character is a digit, a letter, punctuation."""
    return c.rlike(r"^\p{Nd}$"), c.rlike(r"^\p{L}$"), ~c.rlike(r"^[\p{L}\p{N}]$") & ~c.rlike(r"(?U)^\s$")


def window_features(sent: DataFrame, single_words: DataFrame, label: Column | None = None, by_run: bool = False) -> DataFrame:
    """(sid, pos, 11 string columns): characters -2..+2, two bigrams, character kind, and
    whether the character is itself a training word. Neighbours are read inside the row.

    ``single_words(ch)`` holds one-character words: bounded by Unicode, hence broadcast.
    ``label``, an array with one entry per character, is added as column ``y``. With ``by_run`` a sentence has a
    ``run``, which is kept, and ``single_words`` an array ``in_run`` telling in which runs the word is known.
    """
    chars = characters(F.col("s"))
    run = ["run"] if by_run else []
    extra = ["y"] if label is not None else []
    packed = sent.where(F.length("s") > 0).select("sid", *run, chars.alias("_c"), *([label.alias("_y")] if extra else []))
    around = {d: F.coalesce(F.try_element_at("_c", F.col("pos") + 1 + d), F.lit(OUTSIDE[d])) if d > 0 else
              F.when(F.col("pos") + d >= 0, F.try_element_at("_c", F.greatest(F.col("pos") + 1 + d, F.lit(1))))
              .otherwise(OUTSIDE[d]) for d in OUTSIDE}
    rows = packed.select("sid", *run, "_c", *(["_y"] if extra else []), F.posexplode("_c").alias("pos", "ch")).select(
        "sid", *run, "pos", "ch", *[c.alias(f"c{d:+d}") for d, c in around.items()],
        *([F.element_at("_y", F.col("pos") + 1).alias("y")] if extra else []))
    known = single_words.select("ch", *(["in_run"] if by_run else []), F.lit("True").alias("in_dict"))
    joined = rows.join(F.broadcast(known), "ch", "left")
    if by_run:
        joined = joined.withColumn("in_dict", F.when(F.element_at("in_run", F.col("run") + 1), F.col("in_dict")))
    c = F.col("ch")

    def flag(cond: Column) -> Column:
        return F.when(cond, "True").otherwise("False")

    return joined.select(
        "sid", *run, "pos", *extra, c.alias("c0"), F.col("`c-1`"), F.col("`c+1`"), F.col("`c-2`"), F.col("`c+2`"),
        F.when(F.col("`c-1`") != OUTSIDE[-1], F.concat("`c-1`", c)).alias("c-1_c0"),
        F.when(F.col("`c+1`") != OUTSIDE[1], F.concat(c, "`c+1`")).alias("c0_c+1"),
        *[flag(x).alias(n) for x, n in zip(character_flags(c), ("is_digit", "is_alpha", "is_punct"))],
        F.coalesce("in_dict", F.lit("False")).alias("in_dict"))


def nonzero_features(features: DataFrame, names: Sequence[str], prefix: str, summed: bool = False) -> DataFrame:
    """Long form (sid, pos, feature, value) of the non-zero columns, named ``prefix:name``; of ``summed`` features
    (feature, n, value): how many are not zero, and their sum."""
    if summed:
        items = F.array(*[F.struct(F.lit(f"{prefix}:{n}").alias("feature"), F.col(f"`n:{n}`").alias("n"), F.col(n).alias("value")) for n in names])
        return features.select(F.explode(F.filter(items, lambda x: x["n"] > 0)).alias("f")).select("f.*")
    items = F.array(*[F.struct(F.lit(f"{prefix}:{n}").alias("feature"), F.col(n).alias("value")) for n in names])
    return features.select("sid", "pos", F.explode(F.filter(items, lambda x: x["value"] != 0)).alias("f")).select(
        "sid", "pos", "f.feature", "f.value")
