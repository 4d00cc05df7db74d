"""Queries: splits, folds, out-of-fold features."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.catalog.lattice_queries import bie_sql, covered_sql, domain_sql, rel_sql, with_zero_rows, META_SQL
from spanloom.catalog.registry import query, weighted
from spanloom.catalog.relations import define
from spanloom.catalog.vocab_queries import in_a, words_of
from spanloom.operators import features as fe
from spanloom.operators import lattice as la
from spanloom.operators import splits as sp
from spanloom.plans.scale import fits_broadcast, seeded_hash
from spanloom.session import as_table
from spanloom.sources.corpus import Corpus


def split_of(c: Corpus) -> DataFrame:
    if not hasattr(c, "_split"):
        c._split = as_table(sp.stratified_split(c.sent), "split")
    return c._split


def part(c: Corpus, name: str) -> DataFrame:
    """The sentences of one part of the stratified split: a part is a range of (digest, sid) in its category, so that with ids
    of their own sentences are compared with two bounds in their rows instead of meeting the split."""
    if c.unique:
        if not hasattr(c, "_bounds"):
            at = F.struct(seeded_hash(sp.SEED, "sid").alias("h"), F.col("sid").alias("sid"))
            c._bounds = as_table(split_of(c).groupBy("category").agg(*[
                F.max(F.when(F.col("split").isin(*parts), at)).alias(n) for n, parts in (("_train", ["train"]), ("_dev", ["train", "dev"]))]), "split-bounds")
        if fits_broadcast(c._bounds):
            bounds = c._bounds.withColumnRenamed("category", "_category")
            at = F.struct(seeded_hash(sp.SEED, "sid").alias("h"), F.col("sid").alias("sid"))
            inside = {"train": at <= F.col("_train"), "dev": (at > F.col("_train")) & (at <= F.col("_dev")), "test": at > F.col("_dev")}[name]
            return c.sent.join(F.broadcast(bounds), F.col("category").eqNullSafe(F.col("_category")) & inside).select(*c.sent.columns)
    return c.sent.join(split_of(c).where(F.col("split") == name).select("sid"), "sid")


@query("o66_random_split", """
    SELECT sid, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM (
        SELECT sid, row_number() OVER (ORDER BY md5('42|' || sid), sid) - 1 AS r, count(*) OVER () AS n FROM sent)""")
def o66(c: Corpus) -> DataFrame:
    return sp.random_split(c.sent)


@query("o67_stratified_split", "SELECT sid, category, split FROM splits")
def o67(c: Corpus) -> DataFrame:
    return sp.stratified_split(c.sent)


@query("o68_kfold", """
    SELECT sid, ((r >= round_even(n * 1.0::DOUBLE / 5, 0))::INT + (r >= round_even(n * 2.0::DOUBLE / 5, 0))::INT
        + (r >= round_even(n * 3.0::DOUBLE / 5, 0))::INT + (r >= round_even(n * 4.0::DOUBLE / 5, 0))::INT)::INT AS fold FROM (
        SELECT sid, row_number() OVER (ORDER BY md5('42|' || sid), sid) - 1 AS r, count(*) OVER () AS n FROM sent)""")
def o68(c: Corpus) -> DataFrame:
    return sp.kfold(c.sent)


@query("o69_stratified_kfold", "SELECT sid, run::INT AS run, role FROM roles")
def o69(c: Corpus) -> DataFrame:
    return sp.fold_roles(sp.stratified_kfold(c.sent))


@query("o70_group_split", """
    SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || conv_id), conv_id) <= 5 THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT DISTINCT conv_id FROM conversations)""")
def o70(c: Corpus) -> DataFrame:
    return sp.group_split(c.table("conversations"), "conv_id")


# --- out-of-fold features ----------------------------------------------------------------
define("gold_fold", "SELECT * FROM gold_hit JOIN inner_fold USING (sid)")
define("oh_fold", """SELECT word, bin, f.fold AS fold, count(*) AS occ, count(*) FILTER (is_gold) AS hit
    FROM gold_fold g, (SELECT unnest(range(0, 5)) AS fold) f WHERE g.fold <> f.fold GROUP BY word, bin, f.fold""")
define("prior_fold", """SELECT b.bin AS bin, f.fold AS fold, (coalesce(sum(hit), 0) + 1) / (coalesce(sum(occ), 0) + 2) AS p_g
    FROM (SELECT unnest(['2', '3', '4', '5P']) AS bin) b, (SELECT unnest(range(0, 5)) AS fold) f
    LEFT JOIN oh_fold o ON o.bin = b.bin AND o.fold = f.fold GROUP BY b.bin, f.fold""")
define("oof_valued", """SELECT g.*, occ IS NOT NULL AS seen, CASE WHEN occ IS NOT NULL THEN (hit + 5 * p_g) / (occ + 5) ELSE p_g END AS value
    FROM gold_fold g JOIN prior_fold USING (bin, fold) LEFT JOIN (SELECT word, fold, occ, hit FROM oh_fold) o USING (word, fold)""")
define("oof_cov", covered_sql("oof_valued"), False)
define("oof_feat", f"SELECT sid, pos, {bie_sql()}, {rel_sql()}, {META_SQL} FROM oof_cov GROUP BY sid, pos")


def dealt(c: Corpus) -> DataFrame:
    """Sentences with their inner fold; kept, because counting and matching both read it."""
    if not hasattr(c, "_dealt"):
        c._dealt = c.sent.select("sid", "category", "words", "s").join(sp.inner_folds(c.sent), "sid").persist(StorageLevel.MEMORY_AND_DISK)
    return c._dealt


def fold_words(c: Corpus) -> DataFrame:
    return dealt(c).select("category", "fold", F.explode("words").alias("word"))


@query("o71_oof_dict_features", with_zero_rows(fe.DICT_FEATURES, "oof_feat"))
def o71(c: Corpus) -> DataFrame:
    folds = dealt(c).select("sid", "fold")
    return weighted(c.by_sid(fe.oof_dict_features(c.sent.select("sid", "words", "s"), c.lex, folds=folds, unique=c.unique, sums="place")), fe.DICT_FEATURES)


define("word_fold", "SELECT word, category, fold FROM tok JOIN inner_fold USING (sid) WHERE length(word) >= 2")
define("word_folds", "SELECT word, min(fold) AS lo, max(fold) AS hi FROM word_fold GROUP BY word")
define("oof_int_lat", """SELECT i.* FROM int_lat i JOIN inner_fold f USING (sid) JOIN word_folds w USING (word)
    WHERE w.lo <> w.hi OR w.lo <> f.fold""")
define("oof_int_cov", covered_sql("oof_int_lat"), False)
define("oof_int_feat", f"SELECT sid, pos, {bie_sql()} FROM oof_int_cov GROUP BY sid, pos")


@query("o72_oof_internal_features", with_zero_rows(fe.BIE_FEATURES, "oof_int_feat"))
def o72(c: Corpus) -> DataFrame:
    internal = la.internal_words(words_of(c), c.lex.words).join(fe.word_folds(fold_words(c)), "word")
    return weighted(c.by_sid(fe.oof_internal_features(dealt(c), la.Lexicon.build(internal), c.unique, "place")), fe.BIE_FEATURES)


define("share_fold", """SELECT word, f.fold AS fold, count(*) FILTER (category = 'en') / count(*) AS share_a, count(*) FILTER (category <> 'en') / count(*) AS share_b
    FROM word_fold w, (SELECT unnest(range(0, 5)) AS fold) f WHERE w.fold <> f.fold GROUP BY word, f.fold""")
define("oof_dom_pos", """SELECT sid, pos, avg(coalesce(share_a, own_a)) AS share_a, avg(coalesce(share_b, 1 - own_a)) AS share_b FROM (
    SELECT sid, unnest(range(start, stop)) AS pos, share_a, share_b, CASE WHEN category = 'en' THEN 1.0::DOUBLE ELSE 0.0 END AS own_a
    FROM (SELECT sid, start, stop, word FROM lat UNION ALL SELECT sid, start, stop, word FROM oof_int_lat) JOIN inner_fold USING (sid)
    LEFT JOIN share_fold USING (word, fold) JOIN (SELECT sid, category FROM sent) USING (sid)) GROUP BY sid, pos""")


@query("o73_oof_domain_vectors", domain_sql("oof_dom_pos"))
def o73(c: Corpus) -> DataFrame:
    inside, one = in_a(), F.lit(1).cast("bigint")
    counts = fold_words(c).where(F.length("word") >= 2).groupBy("word").agg(
        sp.per_fold(F.when(inside, one), F.col("fold")).alias("a_f"), sp.per_fold(F.when(~inside, one), F.col("fold")).alias("b_f"))
    both = c.lex.words.select("word", F.lit(True).alias("external")).union(
        la.internal_words(words_of(c), c.lex.words).select("word", F.lit(False)))
    words = la.Lexicon.build(both.join(counts, "word", "left"))
    return c.by_sid(fe.oof_domain_features(dealt(c), words, inside, c.unique, "place"))


