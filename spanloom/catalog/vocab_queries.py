"""Queries: vocabularies, corpus statistics, statistics of unlabelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.catalog.registry import query, r6
from spanloom.catalog.relations import define
from spanloom.functions.script import characters
from spanloom.operators import ngrams as ng
from spanloom.operators import vocab as vo
from spanloom.session import scratch_path
from spanloom.sources.corpus import Corpus


def in_a():
    """Made on demand: a column needs a session, reading the list of queries does not."""
    return F.col("category") == "en"


def words_of(c: Corpus, tags: bool = False) -> DataFrame:
    """(sid, category, idx, word) without offsets, with the tag only where it is asked for."""
    if not tags:
        return c.sent.select("sid", "category", F.posexplode("words").alias("idx", "word"))
    pairs = F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"))
    return c.sent.select("sid", "category", F.posexplode(pairs).alias("idx", "w")).select(
        "sid", "category", "idx", F.col("w.word").alias("word"), F.col("w.tag").alias("tag"))


def freq_of(c: Corpus) -> DataFrame:
    return vo.word_freq(words_of(c))


def char_counts(c: Corpus) -> DataFrame:
    return c.sent.select(F.explode(characters(F.col("s"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))


define("freq", "SELECT word, count(*) AS freq FROM tok GROUP BY word")
define("chr_cnt", "SELECT ch, count(*) AS cnt FROM chrs GROUP BY ch")
define("run_set", "SELECT ch FROM uni")
define("lex_set", "SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM lex")


@query("o27_word_freq", "SELECT word, freq::BIGINT AS freq FROM freq")
def o27(c: Corpus) -> DataFrame:
    return freq_of(c)


@query("o28_char_ids_by_appearance", """
    SELECT ch, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT ch, min(sid * 100000::HUGEINT + pos) AS first FROM chrs GROUP BY ch)""")
def o28(c: Corpus) -> DataFrame:
    return vo.char_ids_by_appearance(words_of(c))


@query("o29_char_ids_sorted", """
    SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT ch FROM chrs UNION SELECT unnest(['<PAD>', '<UNK>']))""")
def o29(c: Corpus) -> DataFrame:
    return vo.char_ids_sorted(vo.distinct_chars(words_of(c)))


@query("o30_char_ids_specials_first", """
    SELECT ch, row_number() OVER (ORDER BY ch) + 4 AS id FROM (
        SELECT substr(word, 1, 1) AS ch FROM lex UNION SELECT ch FROM lex_set UNION SELECT ch FROM run_set)
    UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[MASK]', '[CLS]', '[SEP]']), unnest([0, 1, 2, 3, 4])""")
def o30(c: Corpus) -> DataFrame:
    heads = c.lex.words.select(F.substring("word", 1, 1).alias("ch"))
    return vo.char_ids_specials_first(heads, vo.distinct_chars(c.lex.words), vo.distinct_chars(c.runs, "run"))


@query("o31_top_words", "SELECT word, freq::BIGINT AS freq FROM freq ORDER BY freq DESC, word LIMIT 50")
def o31(c: Corpus) -> DataFrame:
    return vo.top_words(freq_of(c), 50)


@query("o32_word_lookup", """
    SELECT word, coalesce(freq, 0)::BIGINT AS freq, freq IS NOT NULL AS known FROM conv_words LEFT JOIN freq USING (word)""")
def o32(c: Corpus) -> DataFrame:
    asked = c._conversation_tokens().select(F.explode("words").alias("word")).distinct()
    return vo.lookup(asked, freq_of(c))


@query("o33_corpus_summary", """
    SELECT (SELECT count(*) FROM sent)::BIGINT AS num_sentences, count(*)::BIGINT AS num_tokens, sum(length(word))::BIGINT AS num_chars,
        count(DISTINCT word)::BIGINT AS unique_words, (SELECT count(*) FROM chr_cnt)::BIGINT AS unique_chars,
        round(count(*) / (SELECT count(*) FROM sent), 6) AS avg_sentence_len_tokens,
        round(sum(length(word)) / (SELECT count(*) FROM sent), 6) AS avg_sentence_len_chars FROM tok""")
def o33(c: Corpus) -> DataFrame:
    s = vo.corpus_summary(c.sent)
    return s.select(*s.columns[:5], *[r6(x).alias(x) for x in s.columns[5:]])


@query("o34_category_distribution", "SELECT category, count(*)::BIGINT AS n_sents FROM sent GROUP BY category")
def o34(c: Corpus) -> DataFrame:
    return vo.category_distribution(c.sent)


define("modal", """SELECT word, arg_max(tag, k) AS tag FROM (
    SELECT word, tag, struct_pack(n := count(*), s := -min(sid * 100000::HUGEINT + idx)) AS k FROM tok GROUP BY word, tag) GROUP BY word""")


@query("o35_modal_tag", "SELECT word, tag FROM modal")
def o35(c: Corpus) -> DataFrame:
    return vo.modal_tag(words_of(c, tags=True))


@query("o36_tag_statistics", """
    WITH wt AS (SELECT word, tag, count(*) AS n FROM tok GROUP BY word, tag), k AS (SELECT word, count(*) AS tags FROM wt GROUP BY word)
    SELECT tag, sum(n)::BIGINT AS "count", count(*)::BIGINT AS word_types, count(*) FILTER (tags > 1)::BIGINT AS ambiguous_words
    FROM wt JOIN k USING (word) GROUP BY tag""")
def o36(c: Corpus) -> DataFrame:
    return vo.tag_statistics(words_of(c, tags=True))


define("shares", """SELECT word, count(*) FILTER (category = 'en') / count(*) AS share_a, count(*) FILTER (category <> 'en') / count(*) AS share_b
    FROM tok WHERE length(word) >= 2 GROUP BY word""")


@query("o37_word_domain", "SELECT word, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b FROM shares")
def o37(c: Corpus) -> DataFrame:
    return vo.domain_shares(words_of(c), in_a()).select("word", r6("share_a").alias("share_a"), r6("share_b").alias("share_b"))


@query("o38_domain_fallback", """
    SELECT category, CASE WHEN category = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS own_a, CASE WHEN category = 'en' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS own_b,
        (SELECT round(count(*) FILTER (category = 'en') / count(*), 6) FROM sent) AS global_a,
        (SELECT round(count(*) FILTER (category <> 'en') / count(*), 6) FROM sent) AS global_b, count(*)::BIGINT AS n_sents FROM sent GROUP BY category""")
def o38(c: Corpus) -> DataFrame:
    a, b = vo.sentence_share(in_a())
    whole = vo.global_share(c.sent, in_a())
    return c.sent.groupBy("category").agg(F.count(F.lit(1)).alias("n_sents")).select(
        "category", a.alias("own_a"), b.alias("own_b"),
        r6(whole.select("share_a").scalar()).alias("global_a"), r6(whole.select("share_b").scalar()).alias("global_b"), "n_sents")


@query("o39_type_token_coverage", """
    SELECT 'types' AS kind, '' AS key, (SELECT count(*) FROM lex_set)::DOUBLE AS a, count(*)::DOUBLE AS b,
        round(count(*) FILTER (ch IN (SELECT ch FROM lex_set)) / count(*), 6) AS c FROM chr_cnt
    UNION ALL SELECT 'tokens', '', sum(cnt)::DOUBLE, (sum(cnt) FILTER (ch IN (SELECT ch FROM lex_set)))::DOUBLE,
        round(sum(cnt) FILTER (ch IN (SELECT ch FROM lex_set)) / sum(cnt), 6) FROM chr_cnt
    UNION ALL (SELECT 'missing', ch, 0, 0, 0 FROM chr_cnt WHERE ch NOT IN (SELECT ch FROM lex_set) ORDER BY ch LIMIT 20)
    UNION ALL (SELECT 'top', ch, cnt, 0, 0 FROM chr_cnt WHERE ch NOT IN (SELECT ch FROM lex_set) ORDER BY cnt DESC, ch LIMIT 10)""")
def o39(c: Corpus) -> DataFrame:
    have, counts = vo.distinct_chars(c.lex.words), char_counts(c)
    zero = F.lit(0.0)
    types = vo.type_coverage(have, counts).select(
        F.lit("types").alias("kind"), F.lit("").alias("key"), F.col("have_chars").cast("double").alias("a"),
        F.col("want_chars").cast("double").alias("b"), r6("type_coverage").alias("c"))
    tokens = vo.token_coverage(counts, have).select(
        F.lit("tokens"), F.lit(""), F.col("total_tokens").cast("double"), F.col("covered_tokens").cast("double"), r6("token_coverage"))
    missing = vo.missing_sample(have, counts).select(F.lit("missing"), "ch", zero, zero, zero)
    top = vo.top_missing(counts, have, counts).select(F.lit("top"), "ch", F.col("cnt").cast("double"), zero, zero)
    return types.union(tokens).union(missing).union(top)


@query("o40_lexicon_coverage", """
    SELECT count(*)::BIGINT AS types, count(*) FILTER (word IN (SELECT word FROM lex))::BIGINT AS covered_types, sum(freq)::BIGINT AS tokens,
        sum(freq) FILTER (word IN (SELECT word FROM lex))::BIGINT AS covered_tokens,
        round(count(*) FILTER (word IN (SELECT word FROM lex)) / count(*), 6) AS type_coverage,
        round(sum(freq) FILTER (word IN (SELECT word FROM lex)) / sum(freq), 6) AS token_coverage FROM freq""")
def o40(c: Corpus) -> DataFrame:
    s = vo.lexicon_coverage(freq_of(c), c.lex.words)
    return s.select(*s.columns[:4], *[r6(x).alias(x) for x in s.columns[4:]])


# --- unlabelled statistics ---------------------------------------------------------------


def stats_of(c: Corpus, metric: str = "dpmi") -> ng.NgramStats:
    if not hasattr(c, "_ngram_counts"):
        c._ngram_counts = ng.NgramStats.count(c.runs)
    return ng.NgramStats(c._ngram_counts.uni, c._ngram_counts.bi, metric)


@query("o41_unigrams", "SELECT ch, cnt::BIGINT AS cnt FROM uni")
def o41(c: Corpus) -> DataFrame:
    return ng.unigrams(c.runs)


@query("o42_bigrams", "SELECT a, b, cnt::BIGINT AS cnt, (SELECT sum(cnt) FROM bi)::BIGINT AS n FROM bi")
def o42(c: Corpus) -> DataFrame:
    bi = ng.bigrams(c.runs)
    return bi.withColumn("n", bi.agg(F.sum("cnt").alias("n")).scalar())


@query("o43_adjacency", """
    SELECT a, b, cnt::BIGINT AS cnt, round(cnt / sum(cnt) OVER (PARTITION BY a), 6) AS p_next, round(cnt / sum(cnt) OVER (PARTITION BY b), 6) AS p_prev FROM bi""")
def o43(c: Corpus) -> DataFrame:
    return ng.adjacency(stats_of(c).bi).select("a", "b", "cnt", r6("p_next").alias("p_next"), r6("p_prev").alias("p_prev"))


@query("o44_log_freq", "SELECT a, b, round(ln(1 + cnt), 6) AS logfreq FROM bi")
def o44(c: Corpus) -> DataFrame:
    return stats_of(c).pairs.select("a", "b", r6("logfreq").alias("logfreq"))


@query("o45_dpmi", "SELECT a, b, round(greatest(0.0::DOUBLE, ln(cnt - 0.5) - ln(c_a) - ln(c_b) + ln(n)), 6) + 0.0 AS assoc FROM margins")
def o45(c: Corpus) -> DataFrame:
    return stats_of(c, "dpmi").pairs.select("a", "b", r6("assoc").alias("assoc"))


@query("o46_dice", "SELECT a, b, round(2.0::DOUBLE * cnt / (c_a + c_b), 6) AS assoc FROM margins")
def o46(c: Corpus) -> DataFrame:
    return stats_of(c, "dice").pairs.select("a", "b", r6("assoc").alias("assoc"))


@query("o47_t_score", "SELECT a, b, round((cnt - c_a::DOUBLE * c_b / n) / sqrt(cnt), 6) + 0.0 AS assoc FROM margins")
def o47(c: Corpus) -> DataFrame:
    return stats_of(c, "t_score").pairs.select("a", "b", r6("assoc").alias("assoc"))


@query("o48_adjacency_entropy", "SELECT ch, round(h_left, 6) + 0.0 AS h_left, round(h_right, 6) + 0.0 AS h_right FROM ent")
def o48(c: Corpus) -> DataFrame:
    return stats_of(c).entropy.select("ch", r6("h_left").alias("h_left"), r6("h_right").alias("h_right"))


SUMMARY_SQL = """
    SELECT (SELECT count(*) FROM uni)::BIGINT AS uni_types, (SELECT sum(cnt) FROM uni)::BIGINT AS uni_tokens,
        count(*)::BIGINT AS bi_types, sum(cnt)::BIGINT AS bi_tokens,
        round(min(logfreq), 6) AS logfreq_min, round(max(logfreq), 6) AS logfreq_max, round(avg(logfreq), 6) AS logfreq_mean,
        round(min(assoc), 6) AS assoc_min, round(max(assoc), 6) AS assoc_max, round(avg(assoc), 6) AS assoc_mean,
        round(count(*) FILTER (assoc <= 0) / count(*), 6) AS assoc_zero,
        (SELECT round(min(h_left), 6) + 0.0 FROM ent) AS h_left_min, (SELECT round(max(h_left), 6) FROM ent) AS h_left_max, (SELECT round(avg(h_left), 6) FROM ent) AS h_left_mean,
        (SELECT round(min(h_right), 6) + 0.0 FROM ent) AS h_right_min, (SELECT round(max(h_right), 6) FROM ent) AS h_right_max, (SELECT round(avg(h_right), 6) FROM ent) AS h_right_mean
    FROM pairs"""


def summary_row(stats: ng.NgramStats) -> DataFrame:
    s = ng.stats_summary(stats)
    counts = ("uni_types", "uni_tokens", "bi_types", "bi_tokens")
    return s.select(*counts, *[r6(x).alias(x) for x in s.columns if x not in counts])


@query("o49_stats_summary", SUMMARY_SQL)
def o49(c: Corpus) -> DataFrame:
    return summary_row(stats_of(c))


@query("o50_stats_save_restore", SUMMARY_SQL)
def o50(c: Corpus) -> DataFrame:
    path = scratch_path(c.spark, "ngram-stats")
    stats_of(c).save(path)
    return summary_row(ng.NgramStats.load(c.spark, path))


@query("o50_stats_grow", SUMMARY_SQL)
def o50_grow(c: Corpus) -> DataFrame:
    """Statistics saved in two batches, the second given twice: those of all runs together."""
    path = scratch_path(c.spark, "grown-stats")
    half = F.pmod(F.xxhash64("run"), F.lit(2))
    for batch in (0, 1, 1):
        ng.NgramStats.count(c.runs.where(half == batch)).add_to(path, f"half-{batch}")
    return summary_row(ng.NgramStats.load(c.spark, path))
