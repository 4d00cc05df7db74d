"""Boundary labels B/I/E/S and their joint form with part-of-speech tags, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label order (also the label index) and the transitions that keep words whole.
BIES = ("B", "I", "E", "S")
LEGAL_NEXT = {"B": ("I", "E"), "I": ("I", "E"), "E": ("B", "S"), "S": ("B", "S")}
LEGAL_START = ("B", "S")
LEGAL_END = ("E", "S")


def word_labels(word: Column) -> Column:
    """Labels of one word: S, or B I* E."""
    n = F.length(word)
    inner = F.array_repeat(F.lit("I"), F.greatest(n - 2, F.lit(0)))
    return F.when(n == 1, F.array(F.lit("S"))).otherwise(F.concat(F.array(F.lit("B")), inner, F.array(F.lit("E"))))


def words_to_bies(words: Column) -> Column:
    return F.flatten(F.transform(words, word_labels))


def words_tags_to_joint(words: Column, tags: Column) -> Column:
    """Labels ``X-tag``; NULL words or tags of unequal number raise an error."""
    same = F.when(F.size(words) == F.size(tags), True).otherwise(
        F.raise_error(F.lit("words and tags differ in number")).cast("boolean"))
    joint = F.flatten(F.zip_with(words, tags, lambda w, t: F.transform(
        word_labels(w), lambda x: F.concat(x, F.lit("-"), t))))
    return F.when(same, joint)


def bies_to_words(chars: Column, labels: Column) -> Column:
    """Tolerant decode: B and S close an open word, a lone E is a word, I opens one if none is open."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("words"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        ch, lab, buf, words = x["ch"], x["lab"], acc["buf"], acc["words"]
        flushed = F.when(buf != "", F.concat(words, F.array(buf))).otherwise(words)
        return (
            F.when(lab == "S", F.struct(F.concat(flushed, F.array(ch)).alias("words"), F.lit("").alias("buf")))
            .when(lab == "B", F.struct(flushed.alias("words"), ch.alias("buf")))
            .when(lab == "I", F.struct(words.alias("words"), F.concat(buf, ch).alias("buf")))
            .when(lab == "E", F.struct(F.concat(words, F.array(F.concat(buf, ch))).alias("words"),
                                       F.lit("").alias("buf")))
            .otherwise(acc)
        )

    def done(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.concat(acc["words"], F.array(acc["buf"]))).otherwise(acc["words"])

    return F.aggregate(_zipped(chars, labels), start, step, done)


def joint_to_words_tags(chars: Column, labels: Column) -> Column:
    """Strict decode into ``array<struct<word,tag>>``.

    S does not close an open word and B discards it; the tag is that of E, or of B for
    a word still open at the end.
    """
    empty = F.array().cast("array<struct<word:string,tag:string>>")
    start = F.struct(empty.alias("out"), F.lit("").alias("buf"), F.lit("").alias("tag"))

    def put(out: Column, word: Column, tag: Column) -> Column:
        return F.concat(out, F.array(F.struct(word.alias("word"), tag.alias("tag"))))

    def step(acc: Column, x: Column) -> Column:
        ch, kind = x["ch"], F.substring_index(x["lab"], "-", 1)
        tag = F.substring(x["lab"], F.length(kind) + 2, F.length(x["lab"]))
        out, buf, open_tag = acc["out"], acc["buf"], acc["tag"]

        def state(o: Column, b: Column, t: Column) -> Column:
            return F.struct(o.alias("out"), b.alias("buf"), t.alias("tag"))

        return (
            F.when(kind == "S", state(put(out, ch, tag), buf, open_tag))
            .when(kind == "B", state(out, ch, tag))
            .when(kind == "I", state(out, F.concat(buf, ch), open_tag))
            .when(kind == "E", state(put(out, F.concat(buf, ch), tag), F.lit(""), open_tag))
            .otherwise(acc)
        )

    def done(acc: Column) -> Column:
        return F.when(acc["buf"] != "", put(acc["out"], acc["buf"], acc["tag"])).otherwise(acc["out"])

    return F.aggregate(_zipped(chars, labels), start, step, done)


def joint_label_index(tags: DataFrame) -> DataFrame:
    """Dense ids of all B/I/E/S x tag labels, label order first, then tag order.

    ``tags`` has one column ``tag``. A tag set is an annotation scheme: its distinct
    values are few, so the final numbering may run in one task.
    """
    distinct = tags.select("tag").distinct()
    labels = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("lab")) for i, x in enumerate(BIES)]))
    joint = distinct.select("tag", labels.alias("b")).select(
        F.concat("b.lab", F.lit("-"), "tag").alias("label"), F.col("b.ord").alias("ord"), "tag")
    order = Window.orderBy("ord", "tag")
    return joint.select("label", (F.row_number().over(order) - 1).cast("bigint").alias("id"))


def illegal_transitions(labels: Column) -> Column:
    """Number of start, inner and end transitions of a label array that are not allowed."""
    n = F.size(labels)
    pairs = F.zip_with(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(labels, F.lit(2), n),
                       lambda a, b: F.concat(a, b))
    legal = [a + b for a in BIES for b in LEGAL_NEXT[a]]
    inner = F.size(F.filter(pairs, lambda p: ~p.isin(*legal)))
    first = (~F.try_element_at(labels, F.lit(1)).isin(*LEGAL_START)).cast("int")
    last = (~F.try_element_at(labels, F.lit(-1)).isin(*LEGAL_END)).cast("int")
    return F.when(n > 0, inner + first + last).otherwise(F.lit(0))


def _zipped(chars: Column, labels: Column) -> Column:
    """Pairs of characters and labels, cut to the shorter of the two."""
    n = F.least(F.size(chars), F.size(labels))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(labels, F.lit(1), n),
                      lambda c, x: F.struct(c.alias("ch"), x.alias("lab")))
