"""Vocabularies and corpus statistics.

Numbering characters may end in one task because Unicode bounds their number
(1,114,112 code points); nothing here numbers words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.script import characters

# Fixed values.
SPECIALS_SORTED = ("<PAD>", "<UNK>")
SPECIALS_FIRST = ("[PAD]", "[UNK]", "[MASK]", "[CLS]", "[SEP]")
UNSEEN_TAG = "x"


def word_freq(tok: DataFrame) -> DataFrame:
    return tok.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def char_ids_by_appearance(tok: DataFrame) -> DataFrame:
    """(ch, id): ids in order of the first occurrence in (sid, word index, offset) order."""
    seen = tok.select("sid", "idx", F.posexplode(characters(F.col("word"))).alias("off", "ch"))
    # the first sentence is a number, which is kept by hash; only its characters are compared by place
    sentence = seen.groupBy(F.col("ch").alias("_ch")).agg(F.min("sid").alias("_sid"))
    inside = seen.join(F.broadcast(sentence), (F.col("ch") == F.col("_ch")) & F.col("sid").eqNullSafe(F.col("_sid")))
    first = inside.groupBy("ch").agg(F.min(F.struct("sid", "idx", "off")).alias("at"))
    return first.select("ch", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("id"))


def distinct_chars(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct characters; repeated words cost one pass each, so they are reduced first."""
    return words.select(word).distinct().select(F.explode(characters(F.col(word))).alias("ch")).distinct()


def char_ids_sorted(chars: DataFrame) -> DataFrame:
    """(ch, id): the two special symbols take part in the code point order."""
    special = chars.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in SPECIALS_SORTED])).alias("ch"))
    both = chars.select("ch").union(special).distinct()
    return both.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("bigint").alias("id"))


def char_ids_specials_first(*sources: DataFrame) -> DataFrame:
    """(ch, id): five special symbols, then the characters of all sources in code point order."""
    chars = sources[0].select("ch")
    for other in sources[1:]:
        chars = chars.union(other.select("ch"))
    ranked = chars.distinct().select(
        "ch", (F.row_number().over(Window.orderBy("ch")) - 1 + len(SPECIALS_FIRST)).cast("bigint").alias("id"))
    special = chars.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in SPECIALS_FIRST])).alias("id", "ch")
    ).select("ch", F.col("id").cast("bigint").alias("id"))
    return special.unionByName(ranked)


def top_words(freq: DataFrame, n: int = 50) -> DataFrame:
    return freq.orderBy(F.desc("freq"), "word").limit(n)


def lookup(words: DataFrame, freq: DataFrame) -> DataFrame:
    """(word, freq, known) for any list of distinct words; absent words count 0."""
    return words.select("word").join(freq, "word", "left").select(
        "word", F.coalesce("freq", F.lit(0)).alias("freq"), F.col("freq").isNotNull().alias("known"))


def corpus_summary(sent: DataFrame) -> DataFrame:
    """One row: sentences, tokens, characters, distinct words and characters, mean lengths."""
    sizes = sent.agg(F.count(F.lit(1)).alias("num_sentences"), F.sum(F.size("words")).alias("num_tokens"),
                     F.sum(F.length("s")).alias("num_chars"))
    words = sent.select(F.explode("words").alias("word")).distinct()
    n_words = words.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_chars = distinct_chars(words).agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.greatest(F.col("num_sentences"), F.lit(1))
    return sizes.select(
        "num_sentences", F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"),
        F.coalesce("num_chars", F.lit(0)).alias("num_chars"),
        n_words.alias("unique_words"), n_chars.alias("unique_chars"),
        (F.coalesce("num_tokens", F.lit(0)) / n).alias("avg_sentence_len_tokens"),
        (F.coalesce("num_chars", F.lit(0)) / n).alias("avg_sentence_len_chars"))


def category_distribution(sent: DataFrame) -> DataFrame:
    return sent.groupBy("category").agg(F.count(F.lit(1)).alias("n_sents")).orderBy(F.desc("n_sents"), "category")


def tag_counts(tok: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """(word, tag, cnt, at): counts and the place of the first occurrence, sid and idx as one number, so that all tokens are
    reduced by hash and none is sorted."""
    place = F.col("sid").cast("decimal(20,0)") * F.lit(10 ** 10).cast("decimal(11,0)") + F.col("idx").cast("decimal(10,0)")
    return tok.groupBy("word", "tag").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(place.cast("decimal(38,0)")).alias("at"), *(extra or []))


def modal_tag(tok: DataFrame) -> DataFrame:
    """(word, tag): the most frequent tag, the one seen first on a tie. An aggregate, so a
    hot word is reduced on the map side instead of being sorted in one window partition."""
    best = F.max_by("tag", F.struct("cnt", -F.col("at")))
    return tag_counts(tok).groupBy("word").agg(best.alias("tag"))


def tag_statistics(tok: DataFrame) -> DataFrame:
    """Per tag: tokens, word types, and word types that also occur with another tag."""
    pairs = tok.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("cnt"))
    per_word = pairs.groupBy("word").agg(F.collect_list(F.struct("tag", "cnt")).alias("tags"))
    spread = per_word.select((F.size("tags") > 1).alias("several"), F.explode("tags").alias("t"))
    return spread.groupBy(F.col("t.tag").alias("tag")).agg(
        F.sum("t.cnt").alias("count"), F.count(F.lit(1)).alias("word_types"),
        F.sum(F.col("several").cast("bigint")).alias("ambiguous_words"))


def domain_counts(tok: DataFrame, in_a: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(word, a_cnt, b_cnt) of multi-character words, inside category A and elsewhere."""
    return tok.where(F.length("word") >= 2).groupBy("word", *by).agg(
        F.sum(in_a.cast("bigint")).alias("a_cnt"), F.sum((~in_a).cast("bigint")).alias("b_cnt"))


def domain_shares(tok: DataFrame, in_a: Column) -> DataFrame:
    total = F.col("a_cnt") + F.col("b_cnt")
    return domain_counts(tok, in_a).select("word", (F.col("a_cnt") / total).alias("share_a"),
                                           (F.col("b_cnt") / total).alias("share_b"))


def global_share(sent: DataFrame, in_a: Column) -> DataFrame:
    """One row: share of sentences inside category A and elsewhere; (0, 0) for no sentences."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    a = F.coalesce(F.sum(in_a.cast("bigint")), F.lit(0))
    b = F.coalesce(F.sum((~in_a).cast("bigint")), F.lit(0))
    return sent.agg((a / n).alias("share_a"), (b / n).alias("share_b"))


def sentence_share(in_a: Column) -> tuple[Column, Column]:
    """The certain share of one sentence: (1, 0) inside category A, (0, 1) elsewhere."""
    return F.when(in_a, 1.0).otherwise(0.0), F.when(in_a, 0.0).otherwise(1.0)


def category_weight(category: Column, chosen: str, weight: float) -> Column:
    """Sample weight of a sentence; NULL throughout when the weight changes nothing."""
    if weight == 1.0:
        return F.lit(None).cast("double")
    return F.when(category == chosen, F.lit(float(weight))).otherwise(F.lit(1.0))


def type_coverage(have: DataFrame, want: DataFrame) -> DataFrame:
    """One row: sizes of both character sets, their intersection, and the covered share of ``want``."""
    both = want.select("ch").join(have.select("ch").withColumn("got", F.lit(True)), "ch", "left")
    n_have = have.agg(F.count(F.lit(1)).alias("n")).scalar()
    return both.agg(F.count(F.lit(1)).alias("want_chars"), F.count("got").alias("covered_chars")).select(
        n_have.alias("have_chars"), "want_chars", "covered_chars",
        (F.col("want_chars") - F.col("covered_chars")).alias("missing_count"),
        (F.col("covered_chars") / F.greatest(F.col("want_chars"), F.lit(1))).alias("type_coverage"))


def missing_sample(have: DataFrame, want: DataFrame, n: int = 20) -> DataFrame:
    return want.select("ch").join(have.select("ch"), "ch", "left_anti").orderBy("ch").limit(n)


def token_coverage(counts: DataFrame, have: DataFrame) -> DataFrame:
    """Share of character tokens covered; ``counts`` is (ch, cnt)."""
    both = counts.join(have.select("ch").withColumn("got", F.lit(True)), "ch", "left")
    total = F.coalesce(F.sum("cnt"), F.lit(0))
    covered = F.coalesce(F.sum(F.when(F.col("got"), F.col("cnt"))), F.lit(0))
    return both.agg(total.alias("total_tokens"), covered.alias("covered_tokens"),
                    (covered / F.greatest(total, F.lit(1))).alias("token_coverage"))


def top_missing(counts: DataFrame, have: DataFrame, want: DataFrame, n: int = 10) -> DataFrame:
    gone = want.select("ch").join(have.select("ch"), "ch", "left_anti")
    return gone.join(counts, "ch", "left").select("ch", F.coalesce("cnt", F.lit(0)).alias("cnt")).orderBy(
        F.desc("cnt"), "ch").limit(n)


def lexicon_coverage(freq: DataFrame, lex_words: DataFrame) -> DataFrame:
    """One row: share of word types and of word tokens found in the lexicon."""
    both = freq.join(lex_words.select("word").withColumn("got", F.lit(True)), "word", "left")
    got = F.coalesce("got", F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("types"), F.sum(got.cast("bigint")).alias("covered_types"),
        F.sum("freq").alias("tokens"), F.coalesce(F.sum(F.when(got, F.col("freq"))), F.lit(0)).alias("covered_tokens"),
    ).select("*", F.try_divide("covered_types", "types").alias("type_coverage"),
             F.try_divide("covered_tokens", "tokens").alias("token_coverage"))
