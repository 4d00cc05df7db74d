"""The relations every operator works on, built from the text tables.

``sent`` is the gold corpus: word tokens of a document, lower-cased and cut into
sentences of twelve, with the boundaries hidden in ``s``. It is read off the documents wherever it is
used, neither shuffled nor kept: work on a sentence is done in its row, and what a query does not use is never made.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.arrays import running_sum
from spanloom.functions.script import chunk_runs, length_bin
from spanloom.operators.lattice import Lexicon
from spanloom.plans.scale import fits_broadcast, lookup_join

SENTENCE_TOKENS = 12
SID_STRIDE = 10_000_000
#: Largest table that is dealt out anew to keep all cores busy.
SPREAD_BYTES = 1 << 27
LEX_MIN = 2
LEX2_MIN, LEX2_MAX = 2, 4
SEPARATORS = r"[^\p{L}\p{N}]+"


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits, in order (splitting is faster than extracting)."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def surrogate_tag(raw: Column) -> Column:
    """A part-of-speech stand-in read off the original spelling of a token."""
    return (
        F.when(raw.rlike(r"^\p{Nd}"), "m").when(raw.rlike(r"^\p{Lu}"), "nh")
        .when(F.length(raw) <= 3, "u").otherwise("n")
    )


def cut_tokens(rows: DataFrame, tokens: str, size: int = SENTENCE_TOKENS) -> DataFrame:
    """Replace the array column ``tokens`` by (k, part): its consecutive pieces of ``size``; an empty array gives none.

    ``tokens`` must be a column, not an expression, or it would be evaluated once per piece. All pieces are made before they
    are dealt out, so that no row but the first carries the whole array.
    """
    keep = [c for c in rows.columns if c != tokens]
    col = F.col(tokens)
    starts = F.when(F.size(col) > 0, F.sequence(F.lit(1), F.size(col), F.lit(size)))
    return rows.select(*keep, F.posexplode(F.transform(starts, lambda i: F.slice(col, i, F.lit(size)))).alias("k", "part"))


def read_spread(spark: SparkSession, path: str, key: str, *columns: str) -> DataFrame:
    """Read a parquet table; spread it by ``key`` only where that is cheap or cannot be helped: up to ``SPREAD_BYTES`` if its scan has
    fewer splits with rows than would keep the cores busy, and any size if it would leave more than half of them idle, as with
    one row group for all rows. Else a table is never shuffled here, however often it is read."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    # rows are counted by the footers; a split within a row group of another has none
    met = df.select(F.spark_partition_id().alias("split"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    met = met.groupBy("split", "file").agg(F.max("size").alias("size")).groupBy("file").agg(
        F.collect_set("split").alias("splits"), F.max("size").alias("size"))
    splits, size = met.agg(F.size(F.array_distinct(F.flatten(F.collect_list("splits")))), F.sum("size")).first()
    wanted = 2 * cores
    few = splits < wanted and (size or 0) <= SPREAD_BYTES or 2 * splits < cores
    rows = df.select(*columns)
    return rows.repartition(wanted, key) if few else rows


def word_spans(sent: DataFrame, words: str = "words", tags: str | None = "tags") -> DataFrame:
    """One row per word with its half-open character span: (sid, idx, word, tag, start, stop).

    The running offset is taken inside the row: ``ends`` is the cumulative word length.
    """
    ends = running_sum(F.transform(F.col(words), lambda w: F.length(w)))
    tag = F.col(tags) if tags else F.transform(F.col(words), lambda _: F.lit(None).cast("string"))
    keep = [c for c in sent.columns if c not in (words, tags)]
    zipped = F.arrays_zip(F.col(words).alias("word"), tag.alias("tag"), ends.alias("stop"))
    return (
        sent.select(*keep, F.posexplode(zipped).alias("idx", "w"))
        .select(*keep, "idx", F.col("w.word").alias("word"), F.col("w.tag").alias("tag"),
                (F.col("w.stop") - F.length("w.word")).alias("start"), F.col("w.stop").alias("stop"))
    )


class Corpus:
    """Lazily built relations over one directory of tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _spread(self, name: str, key: str, *columns: str) -> DataFrame:
        return read_spread(self.spark, f"{self.path}/{name}.parquet", key, *columns)

    @cached_property
    def sent(self) -> DataFrame:
        docs = self._spread("documents", "doc_id", "doc_id", "text", "lang", "source")
        raw = docs.select("doc_id", "lang", "source", raw_tokens(F.col("text")).alias("raw"))
        cut = cut_tokens(raw, "raw").withColumnRenamed("part", "raw").withColumn("words", F.transform("raw", F.lower))
        return cut.select(
            (F.col("doc_id") * SID_STRIDE + F.col("k")).alias("sid"), "doc_id", "k",
            F.col("lang").alias("category"), F.col("source").alias("grp"),
            "words", F.transform("raw", surrogate_tag).alias("tags"), F.array_join("words", "").alias("s"),
        )

    @cached_property
    def unique(self) -> bool:
        """Whether every document, and so every sentence, has an id of its own; a null is an id here."""
        ids = self.table("documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return ids.isEmpty()

    @cached_property
    def keyed(self) -> bool:
        """Whether every sentence has an id of its own and none has a null for one, which all sentences of its document would share."""
        return self.unique and self.table("documents").where("doc_id IS NULL").isEmpty()

    def by_sid(self, sums: DataFrame) -> DataFrame:
        """One row per sid of sums made sentence by sentence: as they are, unless sentences share a null."""
        return sums if self.keyed else sums.groupBy("sid").agg(*[F.sum(x).alias(x) for x in sums.columns if x != "sid"])

    @cached_property
    def tok(self) -> DataFrame:
        return word_spans(self.sent.select("sid", "category", "words", "tags"))

    @cached_property
    def chars(self) -> DataFrame:
        return self.sent.select("sid", F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("pos", "ch"))

    def _conversation_tokens(self) -> DataFrame:
        conv = self._spread("conversations", "conv_id", "conv_id", "turn", "text")
        return conv.select("conv_id", "turn", F.transform(raw_tokens(F.col("text")), F.lower).alias("words"))

    @cached_property
    def lex_words(self) -> DataFrame:
        """External lexicon with three flags; one row per word."""
        words = (
            self.table("benchmark").select(F.explode(raw_tokens(F.lower("text"))).alias("word"))
            .where(F.length("word") >= LEX_MIN).distinct()
        )
        labelled = self.table("labels").groupBy("doc_id").agg(
            F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
        # a row per labelled document: the texts stay where they are
        docs = lookup_join(self._spread("documents", "doc_id", "doc_id", "text"), labelled, ["doc_id"], "inner", small_fits=fits_broadcast(labelled))
        seen_in = (
            docs.select("good", "bad", F.explode(F.transform(raw_tokens(F.col("text")), F.lower)).alias("word"))
            .groupBy("word").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
        )
        spoken = self._conversation_tokens().select(F.explode("words").alias("word")).distinct().withColumn(
            "spoken", F.lit(True))
        return (
            words.join(seen_in, "word", "left").join(spoken, "word", "left")
            .select("word", F.length("word").alias("len"), length_bin(F.length("word")).alias("bin"),
                    F.coalesce("good", F.lit(False)).alias("has_yi"),
                    F.coalesce("bad", F.lit(False)).alias("has_yin"),
                    F.coalesce("spoken", F.lit(False)).alias("has_book_title"))
        )

    @cached_property
    def lex(self) -> Lexicon:
        return Lexicon.build(self.lex_words)

    @cached_property
    def lex2_words(self) -> DataFrame:
        return (
            self._conversation_tokens().select(F.explode("words").alias("word"))
            .where(F.length("word").between(LEX2_MIN, LEX2_MAX)).distinct()
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Unlabelled text: conversation turns cut and joined like sentences, without boundaries."""
        cut = cut_tokens(self._conversation_tokens(), "words")
        rid = F.concat_ws(":", *[F.col(x).cast("string") for x in ("conv_id", "turn", "k")])
        return (
            cut.select(rid.alias("rid"), "conv_id", F.array_join("part", "").alias("run"))
            .repartition(self.partitions, "rid").persist(StorageLevel.MEMORY_AND_DISK)
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Pre-training chunks (cid, grp, text), partitioned by ``cid`` like sentences by ``sid``.
        Ids are text (conversation:turn:run:piece): no number of turns or pieces can overflow them."""
        pieces = chunk_runs(self.runs.select("rid", "conv_id", "run"), "run")
        chunks = pieces.select(F.concat_ws(":", "rid", F.col("piece").cast("string")).alias("cid"),
                               F.col("conv_id").alias("grp"), F.col("chunk").alias("text"))
        return chunks.repartition(self.partitions, "cid").persist(StorageLevel.MEMORY_AND_DISK)


_OPEN: dict[tuple[str, str], Corpus] = {}


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    """The corpus at ``path``, shared by all queries of one application."""
    key = (spark.sparkContext.applicationId, path.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Corpus(spark, path)
    return _OPEN[key]
