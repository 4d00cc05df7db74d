"""Readers for annotated text, nested JSON dictionaries and unlabelled records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import lines

# Field names and marks of the dictionary format.
MEANING_TYPE, SOUND_TYPE, BOOK_MARK = "義", "音", "书名"

LEXICON_SCHEMA = """
    unicode STRING, xixia_character STRING, pron ARRAY<STRING>,
    shiyi ARRAY<STRUCT<part: ARRAY<STRING>, shiyi: STRING>>,
    term_list ARRAY<STRUCT<
        term_character: STRING, info: STRING, pron: ARRAY<STRING>,
        shiyi: ARRAY<STRUCT<type: STRING, shiyi: STRING, `说明`: ARRAY<STRING>>>>>
"""
RECORD_SCHEMA = """
    uuid STRING, title STRING, collectionCountry STRING, originalText STRING,
    readableId STRING, translationId STRING
"""
SECOND_SOURCE_SCHEMA = "`同音重校本` STRUCT<`词`: STRING>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, block, at): text lines with keys that restore their order within a file."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def parse_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    """Add line_id, category, words and tags; drop blank lines and lines without a word."""
    stripped = rows.withColumn(line, lines.strip_line(F.col(line))).where(F.col(line) != "")
    parsed = stripped.withColumn("_t", lines.parse_tokens(F.col(line))).where(F.size("_t") > 0)
    return parsed.select(
        *rows.columns, lines.line_id(F.col(line)).alias("line_id"), lines.line_category(F.col(line)).alias("category"),
        F.col("_t.word").alias("words"), F.col("_t.tag").alias("tags"))


def read_tagged_corpus(spark: SparkSession, path: str, max_sentences: int | None = None) -> DataFrame:
    """Annotated sentences; optionally the first ``max_sentences`` in file and line order."""
    parsed = parse_lines(read_lines(spark, path))
    if max_sentences:
        parsed = parsed.orderBy("file", "block", "at").limit(max_sentences)
    return parsed.select("file", "block", "at", "line_id", "category", "words", "tags")


def read_lexicon_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw dictionary entries, with ``seq`` giving their order. A JSON array needs
    ``multi_line``; at scale use one entry per line, which can be split."""
    raw = spark.read.schema(LEXICON_SCHEMA).option("multiLine", multi_line).json(path)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.withColumn("seq", order)


def term_flags(term: Column) -> list[Column]:
    """The three flags of a dictionary term."""
    notes = F.coalesce(term["shiyi"], F.array())
    return [
        F.coalesce(F.exists(notes, lambda x: x["type"] == MEANING_TYPE), F.lit(False)).alias("has_yi"),
        F.coalesce(F.exists(notes, lambda x: x["type"] == SOUND_TYPE), F.lit(False)).alias("has_yin"),
        F.coalesce(F.exists(notes, lambda x: x["shiyi"].contains(BOOK_MARK)), F.lit(False)).alias("has_book_title"),
    ]


def lexicon_terms(entries: DataFrame) -> DataFrame:
    """(word, has_yi, has_yin, has_book_title): multi-character terms; the last duplicate gives the flags."""
    terms = entries.select("seq", F.posexplode("term_list").alias("at", "t"))
    rows = terms.select("seq", "at", F.trim("t.term_character").alias("word"), *term_flags(F.col("t")))
    last = F.max_by(F.struct("has_yi", "has_yin", "has_book_title"), F.struct("seq", "at"))
    return rows.where(F.length("word") >= 2).groupBy("word").agg(last.alias("f")).select("word", "f.*")


def lexicon_vocabulary(entries: DataFrame) -> DataFrame:
    """(word): head characters and multi-character terms, distinct."""
    heads = entries.select(F.trim("xixia_character").alias("word")).where(F.col("word") != "")
    terms = entries.select(F.explode("term_list").alias("t")).select(F.trim("t.term_character").alias("word")).where(
        F.length("word") > 1)
    return heads.union(terms).distinct()


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Unlabelled records with text."""
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.where(F.coalesce("originalText", F.lit("")) != "")


def read_second_source(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(word): words of the second dictionary, distinct."""
    raw = spark.read.schema(SECOND_SOURCE_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(F.trim(F.col("`同音重校本`.`词`")).alias("word")).where(F.col("word") != "").distinct()
