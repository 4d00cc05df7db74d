"""Queries: readers, parsing, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.catalog.registry import joined, query
from spanloom.catalog.relations import LONG_BIN, define
from spanloom.functions import labels as lab
from spanloom.functions import lines as ln
from spanloom.functions.script import (SCRIPT_RANGES_PRETRAIN, SCRIPT_RANGES_STATS, characters, chunk_runs, in_script,
                                       length_bin, script_class, script_runs)
from spanloom.operators.vocab import category_weight
from spanloom.session import scratch_path
from spanloom.sources import readers
from spanloom.sources.corpus import Corpus

# --- readers -----------------------------------------------------------------------------


def corpus_lines(c: Corpus) -> DataFrame:
    """(sid, line): every sentence written as an annotated line."""
    pairs = F.zip_with("words", "tags", lambda w, t: F.concat(w, F.lit("/"), t))
    head = F.concat(F.when(F.col("k") % 3 == 0, "68").otherwise((F.col("k") % 100).cast("string")), F.lit(".1."),
                    F.col("sid").cast("string"))
    return c.sent.select("sid", F.concat(head, F.lit(" "), F.array_join(pairs, "  ")).alias("line"))


@query("o01_tagged_corpus_reader", """
    SELECT (CASE WHEN k % 3 = 0 THEN '68' ELSE (k % 100)::VARCHAR END) || '.1.' || sid AS line_id,
        CASE WHEN k % 3 = 0 OR k % 100 = 68 THEN 'scripture' ELSE 'secular' END AS category,
        array_to_string(words, ' ') AS words, array_to_string(tags, ' ') AS tags FROM sent""")
def o01(c: Corpus) -> DataFrame:
    path = scratch_path(c.spark, "tagged-lines")
    corpus_lines(c).select("line").write.text(path)
    read = readers.read_tagged_corpus(c.spark, path)
    return read.select("line_id", "category", joined("words").alias("words"), joined("tags").alias("tags"))


def lexicon_file(c: Corpus) -> str:
    """The lexicon as nested JSON, one entry per line: head character, a stale duplicate, the term, a short term."""
    path = scratch_path(c.spark, "lexicon-json")
    none = F.lit(None).cast("array<string>")

    def note(kind, text):
        return F.struct(kind.alias("type"), text.alias("shiyi"), none.alias("说明"))

    def term(word, notes):
        return F.struct(word.alias("term_character"), F.lit("").alias("info"), none.alias("pron"), notes.alias("shiyi"))

    notes = F.array(note(F.when(F.col("has_yi"), "義").otherwise("他"), F.lit("")),
                    note(F.when(F.col("has_yin"), "音").otherwise("他"), F.when(F.col("has_book_title"), "见书名表").otherwise("")))
    stale = F.array(note(F.lit("義"), F.lit("书名")), note(F.lit("音"), F.lit("")))
    word = F.col("word")
    c.lex.words.select(
        F.substring(word, 1, 1).alias("xixia_character"),
        F.array(term(F.concat(F.lit(" "), word), stale), term(F.concat(word, F.lit(" ")), notes),
                term(F.substring(word, 1, 1), stale)).alias("term_list"),
    ).write.json(path)
    return path


@query("o02_lexicon_terms", "SELECT word, has_yi, has_yin, has_book_title FROM lex")
def o02(c: Corpus) -> DataFrame:
    return readers.lexicon_terms(readers.read_lexicon_json(c.spark, lexicon_file(c), multi_line=False))


@query("o03_lexicon_vocabulary", "SELECT word FROM lex UNION SELECT substr(word, 1, 1) FROM lex")
def o03(c: Corpus) -> DataFrame:
    return readers.lexicon_vocabulary(readers.read_lexicon_json(c.spark, lexicon_file(c), multi_line=False))


@query("o04_term_flags", """
    SELECT has_yi, has_yin, has_book_title, count(*)::BIGINT AS n FROM (
        SELECT has_yi, has_yin, has_book_title FROM lex
        UNION ALL SELECT true, true, true FROM lex UNION ALL SELECT true, true, true FROM lex) GROUP BY ALL""")
def o04(c: Corpus) -> DataFrame:
    entries = readers.read_lexicon_json(c.spark, lexicon_file(c), multi_line=False)
    terms = entries.select(F.explode("term_list").alias("t"))
    flags = ("has_yi", "has_yin", "has_book_title")
    return terms.select(*readers.term_flags(F.col("t"))).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("o05_unlabelled_records", """
    SELECT conv_id::VARCHAR AS uuid, turn::VARCHAR AS readable_id, length(text)::BIGINT AS n_chars, md5(text) AS digest
    FROM conversations WHERE text <> ''""")
def o05(c: Corpus) -> DataFrame:
    path = scratch_path(c.spark, "records")
    conv = c.table("conversations")
    rows = conv.select(F.col("conv_id").cast("string").alias("uuid"), F.col("turn").cast("string").alias("readableId"),
                       F.col("text").alias("originalText"))
    blank = rows.where("readableId = '0'").withColumn("originalText", F.lit(""))  # added, for the filter to drop
    rows.unionByName(blank).write.json(path)
    read = readers.read_records(c.spark, path, multi_line=False)
    return read.select("uuid", F.col("readableId").alias("readable_id"),
                       F.length("originalText").cast("bigint").alias("n_chars"), F.md5("originalText").alias("digest"))


# --- line grammar ------------------------------------------------------------------------
# Every sentence becomes one of six line shapes: plain, newspaper header, entity group,
# tag suffix, glued tokens, no header.

define("line_in", """
    SELECT sid, CASE sid % 6
        WHEN 0 THEN '68.1.' || sid || ' ' || array_to_string(wt, '  ')
        WHEN 1 THEN '19980101-01-001-001/m  ' || array_to_string(wt, '  ')
        WHEN 2 THEN '3.2.1 [' || array_to_string(wt[1:2], ' ') || ']nz  ' || array_to_string(wt[3:], '  ')
        WHEN 3 THEN '68.2.2 ' || array_to_string(list_transform(wt, lambda x: x || '!2'), '  ')
        WHEN 4 THEN '7.7.7 ' || array_to_string(list_transform(wt[2:], lambda x: replace(x, '/', '')), ' ') || ' ' || wt[1]
        ELSE array_to_string(wt, '  ') || '  1.2.3/m' END AS line
    FROM (SELECT sid, list_transform(range(1, len(words) + 1), lambda i: words[i] || '/' || tags[i]) AS wt FROM sent)""")
HEADER_SQL = r"^(\d{8}-\d{2}-\d{3}-\d{3}/\w+\s+|\d+\.\d+\.\d+\s+)"
define("line_body", rf"SELECT sid, line, regexp_replace(line, '{HEADER_SQL}', '') AS body FROM line_in")
define("line_expanded", r"SELECT sid, line, body, regexp_replace(body, '\[([^\]]+)\]([a-zA-Z.]+)', '\1', 'g') AS expanded FROM line_body")
define("line_tokens", r"""SELECT sid, body, regexp_extract_all(expanded, '(\S+?)/([a-zA-Z0-9_.!]+)', 1) AS w,
    regexp_extract_all(expanded, '(\S+?)/([a-zA-Z0-9_.!]+)', 2) AS t FROM line_expanded""")
define("line_clean", r"""SELECT sid, body,
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT regexp_matches(w[i], '^(\d{8}-\d{2}-\d{3}-\d{3}|\d+\.\d+\.\d+)')),
        lambda i: struct_pack(w := w[i], t := regexp_replace(t[i], '[!^].*$', ''))) AS p FROM line_tokens""")
define("line_recovered", r"""SELECT sid, body, p, segs,
    list_filter(list_transform(segs, lambda g: CASE WHEN regexp_matches(g, '^(\S+?)/([a-zA-Z0-9_.!]+)')
        THEN struct_pack(w := regexp_extract(g, '^(\S+?)/([a-zA-Z0-9_.!]+)', 1),
                         t := regexp_replace(regexp_extract(g, '^(\S+?)/([a-zA-Z0-9_.!]+)', 2), '[!^].*$', ''))
        ELSE struct_pack(w := regexp_extract(g, '^(\S+?)([a-zA-Z.][a-zA-Z0-9_.]*)$', 1),
                         t := regexp_extract(g, '^(\S+?)([a-zA-Z.][a-zA-Z0-9_.]*)$', 2)) END), lambda x: x.w <> '') AS q
    FROM (SELECT *, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS segs FROM line_clean)""")
define("line_parsed", """SELECT sid, CASE WHEN len(p) < 3 AND len(segs) > 3 AND len(q) > 0 THEN q ELSE p END AS p FROM line_recovered""")


def line_shapes(c: Corpus) -> DataFrame:
    wt = F.zip_with("words", "tags", lambda w, t: F.concat(w, F.lit("/"), t))
    rows = c.sent.select("sid", wt.alias("wt"))
    n = F.size("wt")

    def text(sep, arr):
        return F.array_join(arr, sep)

    kind = F.col("sid") % 6
    line = (
        F.when(kind == 0, F.concat(F.lit("68.1."), F.col("sid").cast("string"), F.lit(" "), text("  ", "wt")))
        .when(kind == 1, F.concat(F.lit("19980101-01-001-001/m  "), text("  ", "wt")))
        .when(kind == 2, F.concat(F.lit("3.2.1 ["), text(" ", F.slice("wt", 1, 2)), F.lit("]nz  "), text("  ", F.slice("wt", F.lit(3), n))))
        .when(kind == 3, F.concat(F.lit("68.2.2 "), text("  ", F.transform("wt", lambda x: F.concat(x, F.lit("!2"))))))
        .when(kind == 4, F.concat(
            F.lit("7.7.7 "), text(" ", F.transform(F.slice("wt", F.lit(2), n), lambda x: F.replace(x, F.lit("/"), F.lit("")))),
            F.lit(" "), F.element_at("wt", 1)))
        .otherwise(F.concat(text("  ", "wt"), F.lit("  1.2.3/m")))
    )
    return rows.select("sid", line.alias("line"))


def packed(tokens):
    return F.array_join(F.transform(tokens, lambda p: F.concat(p["word"], F.lit("|"), p["tag"])), " ")


PACKED_SQL = "array_to_string(list_transform(p, lambda x: x.w || '|' || x.t), ' ')"


@query("o08_header_strip", "SELECT sid, body FROM line_body")
def o08(c: Corpus) -> DataFrame:
    return line_shapes(c).select("sid", ln.strip_header(F.col("line")).alias("body"))


@query("o09_header_category", r"""
    SELECT sid, CASE regexp_extract(line, '^(\d+)\.', 1) WHEN '68' THEN 'scripture' WHEN '' THEN 'unknown' ELSE 'secular' END AS category
    FROM line_in""")
def o09(c: Corpus) -> DataFrame:
    return line_shapes(c).select("sid", ln.line_category(F.col("line")).alias("category"))


@query("o10_entity_groups", "SELECT sid, expanded FROM line_expanded")
def o10(c: Corpus) -> DataFrame:
    return line_shapes(c).select("sid", ln.expand_groups(ln.strip_header(F.col("line"))).alias("expanded"))


@query("o11_tokenize", "SELECT sid, array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || '|' || t[i]), ' ') AS tokens FROM line_tokens")
def o11(c: Corpus) -> DataFrame:
    body = ln.expand_groups(ln.strip_header(F.col("line")))
    return line_shapes(c).select("sid", packed(ln.tokenize(body)).alias("tokens"))


@query("o12_clean_tokens", f"SELECT sid, {PACKED_SQL} AS tokens FROM line_clean")
def o12(c: Corpus) -> DataFrame:
    body = ln.expand_groups(ln.strip_header(F.col("line")))
    return line_shapes(c).select("sid", packed(ln.clean_tokens(ln.tokenize(body))).alias("tokens"))


@query("o13_token_recovery", f"SELECT sid, {PACKED_SQL} AS tokens FROM line_parsed")
def o13(c: Corpus) -> DataFrame:
    return line_shapes(c).select("sid", packed(ln.parse_tokens(F.col("line"))).alias("tokens"))


# Tags of the corpus are mapped to spellings that need normalising.
@query("o14_tag_normalization", """
    SELECT sid, coalesce(array_to_string(list_filter(list_transform(range(1, len(words) + 1), lambda i:
        CASE tags[i] WHEN 'm' THEN words[i] || '|mc' WHEN 'nh' THEN words[i] || '|Quot.' WHEN 'u' THEN NULL ELSE words[i] || '|n' END),
        lambda x: x IS NOT NULL), ' '), '') AS tokens FROM sent""")
def o14(c: Corpus) -> DataFrame:
    raw = F.zip_with("words", "tags", lambda w, t: F.struct(w.alias("word"), F.when(t == "m", "mc.").when(t == "nh", " Quet ").when(
        t == "u", "?").otherwise(t).alias("tag")))
    return c.sent.select("sid", packed(ln.normalize_tokens(raw)).alias("tokens"))


# --- characters, runs, chunks -------------------------------------------------------------
LATIN_A, LATIN_B = ((0x61, 0x7A), (0xE0, 0xEF)), ((0x61, 0x7A), (0xE0, 0xFF))


@query("o15_script_predicate", """
    SELECT ch, count(*)::BIGINT AS n, regexp_matches(ch, '^[a-z\\x{E0}-\\x{EF}]$') AS in_a, regexp_matches(ch, '^[a-z\\x{E0}-\\x{FF}]$') AS in_b,
        unicode(ch) BETWEEN 94208 AND 100343 OR unicode(ch) BETWEEN 100352 AND 101119 OR unicode(ch) BETWEEN 101632 AND 101775 AS in_stats,
        unicode(ch) BETWEEN 94208 AND 100351 OR unicode(ch) BETWEEN 100352 AND 101119 OR unicode(ch) BETWEEN 101632 AND 101775 AS in_pretrain
    FROM chrs GROUP BY ch""".replace("\\\\", "\\"))
def o15(c: Corpus) -> DataFrame:
    counts = c.sent.select(F.explode(characters(F.col("s"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    ch = F.col("ch")
    return counts.select("ch", "n", in_script(ch, script_class(LATIN_A)).alias("in_a"), in_script(ch, script_class(LATIN_B)).alias("in_b"),
                         in_script(ch, script_class(SCRIPT_RANGES_STATS)).alias("in_stats"),
                         in_script(ch, script_class(SCRIPT_RANGES_PRETRAIN)).alias("in_pretrain"))


@query("o16_script_runs", r"""
    SELECT length(run)::BIGINT AS len, count(*)::BIGINT AS n, count(DISTINCT run)::BIGINT AS n_distinct FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z\x{E0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1""")
def o16(c: Corpus) -> DataFrame:
    docs = c._spread("documents", "doc_id", "doc_id", "text")
    runs = docs.select(F.explode(script_runs(F.lower("text"), script_class(LATIN_B))).alias("run"))
    # Equal runs are merged before the distinct count, which then needs no expansion.
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.length("run").cast("bigint").alias("len")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("o17_chunking", r"""
    SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(length(chunk))::BIGINT AS chars, min(length(chunk))::BIGINT AS shortest, min(chunk) AS first, max(chunk) AS last FROM (
        SELECT doc_id, substr(run, i + 1, 128) AS chunk FROM (
            SELECT doc_id, run, unnest(range(0, length(run), 128)) AS i FROM (
                SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N} ,;]+')) AS run FROM documents) WHERE length(run) >= 4))
    WHERE length(chunk) >= 4 GROUP BY doc_id""")
def o17(c: Corpus) -> DataFrame:
    docs = c._spread("documents", "doc_id", "doc_id", "text")
    runs = docs.select("doc_id", F.explode(script_runs(F.col("text"), r"[\p{L}\p{N} ,;]")).alias("run"))
    size = F.length("chunk").cast("bigint")
    return chunk_runs(runs, "run").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(size).alias("chars"), F.min(size).alias("shortest"),
        F.min("chunk").alias("first"), F.max("chunk").alias("last"))


@query("o18_length_bin", f"SELECT {LONG_BIN} AS bin, count(*)::BIGINT AS n FROM tok GROUP BY 1")
def o18(c: Corpus) -> DataFrame:
    words = c.sent.select(F.explode("words").alias("word"))
    return words.groupBy(length_bin(F.length("word")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("o19_sentence_text", "SELECT sid, s, length(s)::BIGINT AS n_chars FROM sent")
def o19(c: Corpus) -> DataFrame:
    return c.sent.select("sid", F.array_join("words", "").alias("s"), F.length("s").cast("bigint").alias("n_chars"))


@query("o20_category_weight", """
    SELECT category, CASE WHEN category = 'en' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, NULL::DOUBLE AS unweighted, count(*)::BIGINT AS n
    FROM sent GROUP BY category""")
def o20(c: Corpus) -> DataFrame:
    rows = c.sent.select("category", category_weight(F.col("category"), "en", 2.5).alias("weight"),
                         category_weight(F.col("category"), "en", 1.0).alias("unweighted"))
    return rows.groupBy("category", "weight", "unweighted").agg(F.count(F.lit(1)).alias("n"))


# --- labels ------------------------------------------------------------------------------
define("bies", """SELECT sid, s, flatten(list_transform(words, lambda w: CASE WHEN length(w) = 1 THEN ['S']
    ELSE ['B'] || list_transform(range(length(w) - 2), lambda i: 'I') || ['E'] END)) AS y FROM sent""")
define("joint", """SELECT sid, s, flatten(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN length(words[i]) = 1 THEN ['S-' || tags[i]]
    ELSE ['B-' || tags[i]] || list_transform(range(length(words[i]) - 2), lambda j: 'I-' || tags[i]) || ['E-' || tags[i]] END)) AS y FROM sent""")


@query("o21_words_to_bies", "SELECT sid, array_to_string(y, '') AS labels FROM bies")
def o21(c: Corpus) -> DataFrame:
    return c.sent.select("sid", joined(lab.words_to_bies(F.col("words")), "").alias("labels"))


# Reversed label rows are full of sequences no word list produces.
define("bies_rev", """SELECT sid, pos, ch, y, lag(y) OVER (PARTITION BY sid ORDER BY pos) AS prev FROM (
    SELECT sid, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS ch, unnest(list_reverse(y)) AS y FROM bies)""")


@query("o22_bies_to_words", """
    SELECT sid, string_agg(w, ' ' ORDER BY g) AS words FROM (
        SELECT sid, g, string_agg(ch, '' ORDER BY pos) AS w FROM (
            SELECT *, sum((prev IS NULL OR y IN ('S', 'B') OR prev IN ('S', 'E'))::INT) OVER (PARTITION BY sid ORDER BY pos) AS g FROM bies_rev)
        GROUP BY sid, g) GROUP BY sid""")
def o22(c: Corpus) -> DataFrame:
    y = F.reverse(lab.words_to_bies(F.col("words")))
    return c.sent.select("sid", joined(lab.bies_to_words(characters(F.col("s")), y)).alias("words"))


@query("o23_words_to_joint", "SELECT sid, array_to_string(y, ' ') AS labels FROM joint")
def o23(c: Corpus) -> DataFrame:
    return c.sent.select("sid", joined(lab.words_tags_to_joint(F.col("words"), F.col("tags"))).alias("labels"))


define("joint_rev", """SELECT *, sum((k = 'B')::INT) OVER w + sum((coalesce(prev, '') = 'E')::INT) OVER w AS g FROM (
    SELECT *, y[1] AS k, substr(y, 3) AS t, lag(y[1]) OVER (PARTITION BY sid ORDER BY pos) AS prev FROM (
        SELECT sid, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS ch, unnest(list_reverse(y)) AS y FROM joint))
    WINDOW w AS (PARTITION BY sid ORDER BY pos)""")


@query("o24_joint_to_words", """
    WITH last_b AS (SELECT sid, arg_max(t, pos) AS bt FROM joint_rev WHERE k = 'B' GROUP BY sid),
    seg AS (SELECT sid, g, string_agg(ch, '' ORDER BY pos) FILTER (k <> 'S') AS w, max(pos) FILTER (k = 'E') AS e,
            max(t) FILTER (k = 'E') AS et FROM joint_rev GROUP BY sid, g),
    top AS (SELECT sid, max(g) AS g FROM joint_rev GROUP BY sid),
    items AS (
        SELECT sid, pos, ch AS w, t FROM joint_rev WHERE k = 'S'
        UNION ALL SELECT sid, e, w, et FROM seg WHERE e IS NOT NULL
        UNION ALL SELECT seg.sid, 1000000, w, coalesce(bt, '') FROM seg JOIN top USING (sid, g) LEFT JOIN last_b ON last_b.sid = seg.sid
            WHERE e IS NULL AND w IS NOT NULL)
    SELECT sent.sid, coalesce(string_agg(w || '|' || t, ' ' ORDER BY pos), '') AS tokens FROM sent LEFT JOIN items ON items.sid = sent.sid GROUP BY sent.sid""")
def o24(c: Corpus) -> DataFrame:
    y = F.reverse(lab.words_tags_to_joint(F.col("words"), F.col("tags")))
    return c.sent.select("sid", packed(lab.joint_to_words_tags(characters(F.col("s")), y)).alias("tokens"))


@query("o25_joint_label_index", """
    SELECT lab || '-' || tag AS label, row_number() OVER (ORDER BY ord, tag) - 1 AS id FROM
        (SELECT DISTINCT tag FROM tok), (SELECT unnest(['B', 'I', 'E', 'S']) AS lab, unnest([0, 1, 2, 3]) AS ord)""")
def o25(c: Corpus) -> DataFrame:
    return lab.joint_label_index(c.sent.select(F.explode("tags").alias("tag")))


@query("o26_legal_transitions", """
    WITH y AS (SELECT sid, false AS reversed, array_to_string(y, '') AS y FROM bies
        UNION ALL SELECT sid, true, array_to_string(list_reverse(y), '') FROM bies),
    bad AS (SELECT sid, reversed, len(list_filter(range(1, length(y)), lambda i: substr(y, i, 2) NOT IN ('BI', 'BE', 'II', 'IE', 'EB', 'ES', 'SB', 'SS')))
        + (y[1] NOT IN ('B', 'S'))::INT + (y[-1] NOT IN ('E', 'S'))::INT AS n FROM y)
    SELECT category, reversed, sum(n)::BIGINT AS violations, count(*) FILTER (n > 0)::BIGINT AS bad_sents
    FROM bad JOIN sent USING (sid) GROUP BY category, reversed""")
def o26(c: Corpus) -> DataFrame:
    y = lab.words_to_bies(F.col("words"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("reversed"), y.alias("y")),
                             F.struct(F.lit(True).alias("reversed"), F.reverse(y).alias("y"))))
    rows = c.sent.select("category", both.alias("v")).select(
        "category", F.col("v.reversed").alias("reversed"), lab.illegal_transitions(F.col("v.y")).alias("n"))
    return rows.groupBy("category", "reversed").agg(
        F.sum("n").cast("bigint").alias("violations"), F.sum((F.col("n") > 0).cast("bigint")).alias("bad_sents"))
