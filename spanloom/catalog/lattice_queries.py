"""Queries: the lattice, reliability, and character features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.catalog.registry import query, r6, weighted, weighted_sql
from spanloom.catalog.relations import LONG_BIN, define
from spanloom.catalog.vocab_queries import in_a, stats_of, words_of
from spanloom.operators import features as fe
from spanloom.operators import lattice as la
from spanloom.operators import splits as sp
from spanloom.operators import vocab as vo
from spanloom.session import as_table
from spanloom.sources.corpus import Corpus

PACKED_SQL = "SELECT sid, count(*)::BIGINT AS n, string_agg(start || ':' || stop, ' ' ORDER BY start, stop) AS spans FROM {} GROUP BY sid"


def packed_spans(matches: DataFrame) -> DataFrame:
    """One row per sentence with all its spans in order: compact, and complete."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("start", "stop"))),
                       lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string")))
    return matches.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.array_join(text, " ").alias("spans"))


@query("o51_lattice_match", PACKED_SQL.format("lat"))
def o51(c: Corpus) -> DataFrame:
    if not c.unique:
        return packed_spans(la.lattice(c.sent, c.lex))
    text = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string")))
    return la.sentence_spans(c.sent, c.lex).select("sid", F.size("spans").cast("bigint").alias("n"), F.array_join(text, " ").alias("spans"))


# The vocabulary covers the training groups only, so that validation text may hold unknown characters.
define("groups", """SELECT conv_id AS grp, CASE WHEN row_number() OVER (ORDER BY md5('42|' || conv_id), conv_id) <= 5 THEN 'valid' ELSE 'train' END AS part
    FROM (SELECT DISTINCT conv_id FROM conversations)""")
define("pt_vocab", """SELECT ch, row_number() OVER (ORDER BY ch) + 4 AS id FROM (
        SELECT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM chunks JOIN groups USING (grp) WHERE part = 'train')
        UNION SELECT substr(word, 1, 1) FROM lex)
    UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[MASK]', '[CLS]', '[SEP]']), unnest([0, 1, 2, 3, 4])""")
define("merged_base", "SELECT word FROM lex WHERE length(word) BETWEEN 2 AND 4 UNION SELECT word FROM lex2")
define("merged", """SELECT word FROM merged_base WHERE word NOT IN (
    SELECT word FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM merged_base) WHERE ch NOT IN (SELECT ch FROM pt_vocab))""")


def vocab_of(c: Corpus) -> DataFrame:
    if not hasattr(c, "_pt_vocab"):
        groups = sp.group_split(c.table("conversations"), "conv_id").where(F.col("split") == "train")
        train = c.chunks.join(groups.select(F.col("conv_id").alias("grp")), "grp", "left_semi")
        chars = vo.distinct_chars(train, "text")
        heads = c.lex.words.select(F.substring("word", 1, 1).alias("ch"))
        c._pt_vocab = as_table(vo.char_ids_specials_first(chars, heads), "pretrain-vocab")
    return c._pt_vocab


def merged_of(c: Corpus) -> la.Lexicon:
    """Words of both sources spelled with the characters of the pre-training vocabulary."""
    if not hasattr(c, "_merged"):
        c._merged = la.Lexicon.build(la.merged_words(c.lex.words, c.lex2_words, vocab_of(c).select("ch")))
    return c._merged


define("run_cand", "SELECT rid AS sid, p AS start, p + l AS stop, substr(run, p + 1, l) AS word FROM (SELECT rid, run, unnest(range(0, length(run))) AS p FROM runs), (SELECT unnest([2, 3, 4]) AS l) WHERE p + l <= length(run)")
define("merged_lat", "SELECT sid, start, stop FROM run_cand JOIN merged USING (word)")


@query("o52_first_char_match", PACKED_SQL.format("merged_lat"))
def o52(c: Corpus) -> DataFrame:
    runs = c.runs.select(F.col("rid").alias("sid"), F.col("run").alias("s"))
    return packed_spans(la.lattice(runs, merged_of(c)))


def counts_of(c: Corpus) -> DataFrame:
    """occ/hit per lexicon word; one row per matched word, kept because several queries read it twice."""
    if not hasattr(c, "_counts"):
        c._counts = as_table(la.occ_hit(c.sent, c.lex), "occ-hit")
    return c._counts


@query("o53_occ_hit", "SELECT word, occ::BIGINT AS occ, hit::BIGINT AS hit FROM oh")
def o53(c: Corpus) -> DataFrame:
    return la.occ_hit(c.sent, c.lex).select("word", "occ", "hit")


@query("o54_class_prior", "SELECT bin, round(p_g, 6) AS p_g FROM prior")
def o54(c: Corpus) -> DataFrame:
    return la.class_priors(counts_of(c)).select("bin", r6("p_g").alias("p_g"))


@query("o55_reliability", f"""
    SELECT word, coalesce(occ, 0)::BIGINT AS occ, coalesce(hit, 0)::BIGINT AS hit, round(prior.p_g, 6) AS p_g, occ IS NOT NULL AS observed,
        round(CASE WHEN occ IS NOT NULL THEN (hit + 5 * prior.p_g) / (occ + 5) ELSE prior.p_g END, 6) AS value
    FROM (SELECT word, {LONG_BIN} AS bin FROM lex) JOIN prior USING (bin) LEFT JOIN (SELECT word, occ, hit FROM oh) USING (word)""")
def o55(c: Corpus) -> DataFrame:
    rel = la.reliability_of(c.lex.words, counts_of(c))
    return rel.select("word", "occ", "hit", "observed", r6("p_g").alias("p_g"), r6("value").alias("value"))


# --- features by position: each feature is summed per sentence with weight position + 1 ----


def covered_sql(source: str) -> str:
    return f"SELECT *, pos = start AS first, pos = stop - 1 AS last FROM (SELECT *, unnest(range(start, stop)) AS pos FROM {source})"


def bie_sql(valid: str = "true") -> str:
    where = {"B": "first", "I": "NOT first AND NOT last", "E": "last"}
    return ", ".join(f"max(CASE WHEN ({valid}) AND ({where[n[0]]}) AND bin = '{n[1:]}' THEN 1.0::DOUBLE ELSE 0.0 END) AS \"{n}\"" for n in fe.BIE_FEATURES)


def rel_sql() -> str:
    where = {"B": "first", "I": "true", "E": "last"}
    return ", ".join(f"coalesce(max(value) FILTER ({'seen' if k == 'seen' else 'NOT seen'} AND {where[p]}), 0.0::DOUBLE) AS rel_{k}_{p}"
                     for k in ("seen", "unseen") for p in "BIE")


META_SQL = ", ".join(f"max({n}::INT)::DOUBLE AS {n}" for n in fe.META_FEATURES)
# Sentences without any match have features, all of them zero.
ZERO = "SELECT sid FROM sent"


def with_zero_rows(names, source: str) -> str:
    cols = ", ".join(f'coalesce(w."{n.lower()}", 0.0::DOUBLE) AS "{n.lower()}"' for n in names)
    return f"WITH w AS ({weighted_sql(names, source)}) SELECT sent.sid AS sid, {cols} FROM sent LEFT JOIN w USING (sid)"


define("lat_cov", covered_sql("lat"), False)
define("bie_feat", f"SELECT sid, pos, {bie_sql()} FROM lat_cov GROUP BY sid, pos")


@query("o56_bie_features", with_zero_rows(fe.BIE_FEATURES, "bie_feat"))
def o56(c: Corpus) -> DataFrame:
    return weighted(c.by_sid(fe.bie_features(c.sent, c.lex, c.unique, "place")), fe.BIE_FEATURES)


# Reliability learned on the training part of the stratified split; the rest may hold unseen words.
define("oh_train", "SELECT word, bin, count(*) AS occ, count(*) FILTER (is_gold) AS hit FROM gold_hit JOIN splits USING (sid) WHERE split = 'train' GROUP BY word, bin")
define("prior_train", """SELECT b.bin AS bin, (coalesce(sum(hit), 0) + 1) / (coalesce(sum(occ), 0) + 2) AS p_g
    FROM (SELECT unnest(['2', '3', '4', '5P']) AS bin) b LEFT JOIN oh_train USING (bin) GROUP BY b.bin""")
define("lat_valued", """SELECT lat.*, occ IS NOT NULL AS seen, CASE WHEN occ IS NOT NULL THEN (hit + 5 * p_g) / (occ + 5) ELSE p_g END AS value
    FROM lat JOIN prior_train USING (bin) LEFT JOIN (SELECT word, occ, hit FROM oh_train) o USING (word)""")
define("val_cov", covered_sql("lat_valued"), False)
define("dict_feat", f"SELECT sid, pos, {bie_sql()}, {rel_sql()}, {META_SQL} FROM val_cov GROUP BY sid, pos")


def train_counts(c: Corpus) -> DataFrame:
    """occ/hit over the training sentences only."""
    from spanloom.catalog.split_queries import part

    if not hasattr(c, "_train_counts"):
        c._train_counts = as_table(la.occ_hit(part(c, "train").where("sid IS NOT NULL"), c.lex), "occ-hit-train")
    return c._train_counts


@query("o57_reliability_features", with_zero_rows(fe.REL_FEATURES, "dict_feat"))
def o57(c: Corpus) -> DataFrame:
    return weighted(c.by_sid(fe.dict_features(c.sent, c.lex, train_counts(c), fe.REL_FEATURES, c.unique, "place")), fe.REL_FEATURES)


@query("o58_metadata_features", with_zero_rows(fe.META_FEATURES, "dict_feat"))
def o58(c: Corpus) -> DataFrame:
    return weighted(c.by_sid(fe.meta_features(c.sent, c.lex, c.unique, "place")), fe.META_FEATURES)


@query("o59_dict_features", with_zero_rows(fe.DICT_FEATURES, "dict_feat"))
def o59(c: Corpus) -> DataFrame:
    return weighted(c.by_sid(fe.dict_features(c.sent, c.lex, train_counts(c), unique=c.unique, sums="place")), fe.DICT_FEATURES)


define("internal", f"SELECT word, {LONG_BIN} AS bin FROM (SELECT DISTINCT word FROM tok WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM lex))")


@query("o60_internal_lexicon", "SELECT word, bin FROM internal")
def o60(c: Corpus) -> DataFrame:
    return la.internal_words(words_of(c), c.lex.words)


# Lengths no internal word has cannot match, so only existing lengths are tried.
define("long_cand", """SELECT sid, start, start + l AS stop, substr(s, start + 1, l) AS word
    FROM spots, (SELECT DISTINCT length(word) AS l FROM tok WHERE length(word) >= 2) WHERE start + l <= length(s)""", False)
define("int_lat", "SELECT sid, start, stop, word, bin FROM long_cand JOIN internal USING (word)")
define("int_cov", covered_sql("int_lat"), False)
define("int_feat", f"SELECT sid, pos, {bie_sql()} FROM int_cov GROUP BY sid, pos")


@query("o61_internal_features", with_zero_rows(fe.BIE_FEATURES, "int_feat"))
def o61(c: Corpus) -> DataFrame:
    internal = la.Lexicon.build(la.internal_words(words_of(c), c.lex.words))
    return weighted(c.by_sid(fe.bie_features(c.sent, internal, c.unique, "place")), fe.BIE_FEATURES)


define("dom_lat", """SELECT sid, start, stop, word FROM lat UNION ALL SELECT sid, start, stop, word FROM int_lat""")
define("dom_pos", """SELECT sid, pos, avg(coalesce(share_a, own_a)) AS share_a, avg(coalesce(share_b, 1 - own_a)) AS share_b FROM (
    SELECT sid, unnest(range(start, stop)) AS pos, share_a, share_b, CASE WHEN category = 'en' THEN 1.0::DOUBLE ELSE 0.0 END AS own_a
    FROM dom_lat LEFT JOIN shares USING (word) JOIN (SELECT sid, category FROM sent) USING (sid)) GROUP BY sid, pos""")


# Shares are taken per position in units of 1e-9, so that the order of summation cannot show.
def domain_sql(source: str) -> str:
    return f"""SELECT sid, sum(round(coalesce(share_a, own_a) * 1e9, 0)::BIGINT * (pos + 1))::BIGINT AS share_a,
        sum(round(coalesce(share_b, 1 - own_a) * 1e9, 0)::BIGINT * (pos + 1))::BIGINT AS share_b FROM (
        SELECT sid, CASE WHEN category = 'en' THEN 1.0::DOUBLE ELSE 0.0 END AS own_a, unnest(range(0, length(s))) AS pos FROM sent)
        LEFT JOIN {source} USING (sid, pos) GROUP BY sid"""


@query("o62_domain_vectors", domain_sql("dom_pos"))
def o62(c: Corpus) -> DataFrame:
    tok = words_of(c)
    both = c.lex.words.select("word").union(la.internal_words(tok, c.lex.words).select("word"))
    words = la.Lexicon.build(both.join(vo.domain_shares(tok, in_a()), "word", "left"))
    return c.by_sid(fe.domain_features(c.sent, words, in_a(), c.unique, "place"))


define("gaps", """SELECT c.sid, c.pos, coalesce(p.logfreq, 0.0) AS "R_freq", coalesce(p.assoc, 0.0) AS "R_assoc",
        CASE WHEN nxt IS NULL THEN 0.0 ELSE coalesce(e1.h_right, 0.0) END AS "R_ent_cur", CASE WHEN nxt IS NULL THEN 0.0 ELSE coalesce(e2.h_left, 0.0) END AS "R_ent_next"
    FROM (SELECT *, lead(ch) OVER (PARTITION BY sid ORDER BY pos) AS nxt FROM chrs) c
    LEFT JOIN pairs p ON p.a = c.ch AND p.b = c.nxt LEFT JOIN ent e1 ON e1.ch = c.ch LEFT JOIN ent e2 ON e2.ch = c.nxt""", False)
define("gap_feat", """SELECT sid, pos, "R_freq", "R_assoc", "R_ent_cur", "R_ent_next",
        coalesce(lag("R_freq") OVER w, 0.0) AS "L_freq", coalesce(lag("R_assoc") OVER w, 0.0) AS "L_assoc",
        coalesce(lag("R_ent_cur") OVER w, 0.0) AS "L_ent_prev", coalesce(lag("R_ent_next") OVER w, 0.0) AS "L_ent_cur"
    FROM gaps WINDOW w AS (PARTITION BY sid ORDER BY pos)""")


def gap_sql(names) -> str:
    return "SELECT sid, " + ", ".join(f'round(sum("{n}" * (pos + 1))::DOUBLE, 4) + 0.0 AS "{n.lower()}"' for n in names) + " FROM gap_feat GROUP BY sid"


def gap_sums(features: DataFrame, names) -> DataFrame:
    return features.select("sid", *[(F.round(F.col(n), 4) + F.lit(0.0)).alias(n.lower()) for n in names])


@query("o63_gap_features", gap_sql(fe.GAP_FEATURES))
def o63(c: Corpus) -> DataFrame:
    return gap_sums(c.by_sid(fe.gap_features(c.sent, stats_of(c), c.unique, "place")), fe.GAP_FEATURES)


def ablation_sql() -> str:
    parts = []
    for level, names in fe.DICT_LEVELS.items():
        total = " + ".join(f'"{n}"' for n in names) or "0.0"
        parts.append(f"SELECT 'dict' AS family, {level} AS level, {len(names)}::BIGINT AS n_columns, round(coalesce(sum(({total})::DOUBLE), 0), 3) AS total FROM dict_feat")
    for level, names in fe.GAP_LEVELS.items():
        total = " + ".join(f'"{n}"' for n in names) or "0.0"
        parts.append(f"SELECT 'gap', {level}, {len(names)}::BIGINT, round(coalesce(sum(({total})::DOUBLE), 0), 3) FROM gap_feat")
    return " UNION ALL ".join(parts)


@query("o64_ablation_slice", ablation_sql())
def o64(c: Corpus) -> DataFrame:
    """Every ablation level of both families; the features are computed once per family."""
    def levels(features: DataFrame, family: str, table: dict) -> DataFrame:
        whole = features.agg(*[F.sum(F.col(n)).alias(n) for n in dict.fromkeys(n for names in table.values() for n in names)])
        rows = [F.struct(F.lit(family).alias("family"), F.lit(level).alias("level"), F.lit(len(names)).cast("bigint").alias("n_columns"),
                         F.round(sum((F.col(n) for n in names), F.lit(0.0)), 3).alias("total")) for level, names in table.items()]
        return whole.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

    dicts = fe.feature_slice(fe.dict_features(c.sent, c.lex, train_counts(c), unique=c.unique, sums="all"), fe.DICT_LEVELS[fe.cumulative_dict_level(5)], ())
    gaps = fe.feature_slice(fe.gap_features(c.sent, stats_of(c), c.unique, "all"), fe.GAP_LEVELS[3], ())
    return levels(dicts, "dict", fe.DICT_LEVELS).unionByName(levels(gaps, "gap", fe.GAP_LEVELS))


def window_sql() -> str:
    return """
    WITH c AS (SELECT sid, pos, ch, lag(ch) OVER w AS p1, lag(ch, 2) OVER w AS p2, lead(ch) OVER w AS n1, lead(ch, 2) OVER w AS n2
        FROM chrs WINDOW w AS (PARTITION BY sid ORDER BY pos)),
    single AS (SELECT DISTINCT word FROM tok WHERE length(word) = 1),
    long AS (
        SELECT 'c0' AS feature, ch AS value FROM c UNION ALL SELECT 'c-1', coalesce(p1, '<BOS>') FROM c UNION ALL SELECT 'c-2', coalesce(p2, '<BOS2>') FROM c
        UNION ALL SELECT 'c+1', coalesce(n1, '<EOS>') FROM c UNION ALL SELECT 'c+2', coalesce(n2, '<EOS2>') FROM c
        UNION ALL SELECT 'c-1_c0', p1 || ch FROM c WHERE p1 IS NOT NULL UNION ALL SELECT 'c0_c+1', ch || n1 FROM c WHERE n1 IS NOT NULL
        UNION ALL SELECT 'is_digit', CASE WHEN regexp_matches(ch, '^\\p{Nd}$') THEN 'True' ELSE 'False' END FROM c
        UNION ALL SELECT 'is_alpha', CASE WHEN regexp_matches(ch, '^\\p{L}$') THEN 'True' ELSE 'False' END FROM c
        UNION ALL SELECT 'is_punct', CASE WHEN regexp_matches(ch, '^[\\p{L}\\p{N}]$') THEN 'False' ELSE 'True' END FROM c
        UNION ALL SELECT 'in_dict', CASE WHEN ch IN (SELECT word FROM single) THEN 'True' ELSE 'False' END FROM c)
    SELECT feature, value, count(*)::BIGINT AS n, 0.0::DOUBLE AS total FROM long GROUP BY feature, value UNION ALL """.replace("\\\\", "\\") + " UNION ALL ".join(
        f"SELECT '{p}:{n}', '', count(*) FILTER (\"{n}\" <> 0)::BIGINT, round(sum(\"{n}\")::DOUBLE, 3) FROM {t} HAVING count(*) FILTER (\"{n}\" <> 0) > 0"
        for p, t, names in (("dict", "dict_feat", fe.DICT_FEATURES), ("gap", "gap_feat", fe.GAP_FEATURES)) for n in names)


@query("o65_window_features", window_sql())
def o65(c: Corpus) -> DataFrame:
    """The template over every character, as counts per feature value and sums of the numeric features."""
    single = words_of(c).where(F.length("word") == 1).select(F.col("word").alias("ch")).distinct()
    rows = fe.window_features(c.sent, single)
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in fe.WINDOW_FEATURES])
    strings = rows.select(F.explode(items).alias("f")).where(F.col("f.value").isNotNull()).groupBy(
        F.col("f.feature").alias("feature"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(0.0))

    def numbers(features: DataFrame, names, prefix: str) -> DataFrame:
        return fe.nonzero_features(features, names, prefix, True).groupBy("feature").agg(
            F.sum("n").alias("n"), F.round(F.sum("value"), 3).alias("total")).select("feature", F.lit("").alias("value"), "n", "total")

    dicts = numbers(fe.dict_features(c.sent, c.lex, train_counts(c), unique=c.unique, sums="all"), fe.DICT_FEATURES, "dict")
    gaps = numbers(fe.gap_features(c.sent, stats_of(c), c.unique, "all"), fe.GAP_FEATURES, "gap")
    return strings.unionByName(dicts).unionByName(gaps)
