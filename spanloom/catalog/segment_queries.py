"""Queries: segmenters, evaluation, cross-validation, reports, model contract."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.api import DictionarySegmenter, DictionarySegmenterModel, JointSegmenter, TaggerSegmenter, with_predictions
from spanloom.catalog.registry import joined, query, r6
from spanloom.catalog.relations import define
from spanloom.catalog.split_queries import part
from spanloom.catalog.vocab_queries import stats_of

from spanloom.functions.labels import BIES, illegal_transitions, words_to_bies
from spanloom.functions.script import characters
from spanloom.operators import embed
from spanloom.operators import evaluate as ev
from spanloom.operators import match
from spanloom.operators import segment as sg
from spanloom.operators import splits as sp
from spanloom.operators.crf import decode_characters
from spanloom.operators.joint import illegal_joint
from spanloom.operators.lattice import Lexicon
from spanloom.operators.tagger import log_probabilities
from spanloom.operators.vocab import modal_tag
from spanloom.plans import experiment as ex
from spanloom.plans import tagger_grid as tg
from spanloom.plans.scale import fits_broadcast
from spanloom.session import as_table, scratch_path
from spanloom.sources import sinks
from spanloom.sources.corpus import Corpus
from spanloom.streaming.vocabulary import incremental_word_freq, stream_words

SINGLES_SQL = f"SELECT unnest(string_split('{sg.FALLBACK_SINGLES}', ''))"


def define_matching(p: str, dictionary: str, sents: str) -> None:
    """SQL relations of maximum matching: ``dictionary`` gives (src, run, word), ``sents`` (sid, run, s)."""
    define(f"{p}_dict", dictionary)
    define(f"{p}_sents", sents)
    define(f"{p}_m", f"""SELECT d.src, c.sid, c.start, c.l FROM (
            SELECT sid, run, start, l, substr(s, start + 1, l) AS word FROM (SELECT sid, run, s, unnest(range(0, length(s))) AS start FROM {p}_sents),
                (SELECT DISTINCT length(word) AS l FROM {p}_dict) WHERE start + l <= length(s)) c
        JOIN {p}_dict d ON d.word = c.word AND d.run = c.run""")
    define(f"{p}_at", f"""SELECT src, sid, pos, max(f) AS fwd, max(b) AS bwd, max(k) AS known FROM (
            SELECT src, sid, unnest(range(0, length(s))) AS pos, 1 AS f, 1 AS b, 0 AS k FROM {p}_sents, (SELECT DISTINCT src FROM {p}_dict)
            UNION ALL SELECT src, sid, start, l, 1, (l = 1)::INT FROM {p}_m UNION ALL SELECT src, sid, start + l - 1, 1, l, 0 FROM {p}_m)
        GROUP BY src, sid, pos""")
    define(f"{p}_fw0", f"""/*recursive*/ SELECT src, sid, pos AS start, fwd AS len, known FROM {p}_at WHERE pos = 0
        UNION ALL SELECT a.src, a.sid, a.pos, a.fwd, a.known FROM {p}_fw0 w JOIN {p}_at a ON a.src = w.src AND a.sid = w.sid AND a.pos = w.start + w.len""", False)
    define(f"{p}_fw", f"SELECT * FROM {p}_fw0")
    define(f"{p}_bw0", f"""/*recursive*/ SELECT src, sid, pos + 1 - bwd AS start, bwd AS len, known FROM (
            SELECT *, max(pos) OVER (PARTITION BY src, sid) AS top FROM {p}_at) WHERE pos = top
        UNION ALL SELECT a.src, a.sid, a.pos + 1 - a.bwd, a.bwd, a.known FROM {p}_bw0 w JOIN {p}_at a ON a.src = w.src AND a.sid = w.sid AND a.pos = w.start - 1""", False)
    define(f"{p}_bw", f"SELECT * FROM {p}_bw0")
    define(f"{p}_pick", f"""SELECT f.src, f.sid, f.u < b.u OR (f.u = b.u AND f.n >= b.n) AS forward FROM
        (SELECT src, sid, count(*) FILTER (len = 1 AND known = 0) AS u, count(*) AS n FROM {p}_fw GROUP BY src, sid) f JOIN
        (SELECT src, sid, count(*) FILTER (len = 1 AND known = 0) AS u, count(*) AS n FROM {p}_bw GROUP BY src, sid) b USING (src, sid)""")
    define(f"{p}_seg", f"""SELECT 'fmm' AS mode, src, sid, start, start + len AS stop FROM {p}_fw UNION ALL SELECT 'bmm', src, sid, start, start + len FROM {p}_bw
        UNION ALL SELECT 'bidirectional', src, sid, start, start + len FROM {p}_fw JOIN {p}_pick USING (src, sid) WHERE forward
        UNION ALL SELECT 'bidirectional', src, sid, start, start + len FROM {p}_bw JOIN {p}_pick USING (src, sid) WHERE NOT forward""")
    define(f"{p}_words", f"""SELECT mode, src, sid, string_agg(substr(s, start + 1, stop - start), ' ' ORDER BY start) AS words
        FROM {p}_seg JOIN sent USING (sid) GROUP BY mode, src, sid""", False)


define("train_tok", "SELECT tok.* FROM tok JOIN splits USING (sid) WHERE split = 'train'")
define("train_words", "SELECT DISTINCT word FROM train_tok")
define_matching("mm", f"SELECT DISTINCT 'combined' AS src, 0 AS run, word FROM (SELECT word FROM train_words UNION SELECT word FROM lex UNION {SINGLES_SQL})",
                "SELECT sid, 0 AS run, s FROM sent")


def train_words(c: Corpus) -> DataFrame:
    if not hasattr(c, "_train_words"):
        c._train_words = as_table(part(c, "train").select(F.explode("words").alias("word")).distinct(), "train-words")
    return c._train_words


def combined_dictionary(c: Corpus) -> Lexicon:
    if not hasattr(c, "_combined"):
        c._combined = Lexicon.build(sg.dictionary_words("combined", train_words(c), c.lex.words).select("word"))
    return c._combined


@query("o74_dictionary_build", f"""
    WITH d AS (SELECT 'corpus' AS source, word, true AS in_source FROM train_words UNION ALL SELECT 'predefined', word, true FROM lex
        UNION ALL SELECT 'combined', word, true FROM (SELECT word FROM train_words UNION SELECT word FROM lex)),
    s AS (SELECT source, word, false AS in_source FROM (SELECT unnest(['corpus', 'predefined', 'combined']) AS source), ({SINGLES_SQL} AS word))
    SELECT source, word, bool_or(in_source) AS in_source, (SELECT max(length(word)) FROM d d2 WHERE d2.source = u.source)::BIGINT AS max_len
    FROM (SELECT * FROM d UNION ALL SELECT * FROM s) u GROUP BY source, word""")
def o74(c: Corpus) -> DataFrame:
    out = None
    for source in sg.SOURCES:
        words = sg.dictionary_words(source, train_words(c), c.lex.words)
        longest = sg.max_word_length(words).select(F.col("max_len").cast("bigint")).scalar()
        rows = words.select(F.lit(source).alias("source"), "word", "in_source", longest.alias("max_len"))
        out = rows if out is None else out.unionByName(rows)
    return out


def matched(c: Corpus, modes=sg.MODES, sent: DataFrame | None = None) -> DataFrame:
    """(sid, fmm, bmm, bidirectional) over all sentences, or those of ``modes``."""
    return sg.max_match(c.sent if sent is None else sent, combined_dictionary(c), modes)


@query("o75_forward_match", "SELECT sid, words FROM mm_words WHERE mode = 'fmm'")
def o75(c: Corpus) -> DataFrame:
    return matched(c, ("fmm",)).select("sid", joined("fmm").alias("words"))


@query("o76_backward_match", "SELECT sid, words FROM mm_words WHERE mode = 'bmm'")
def o76(c: Corpus) -> DataFrame:
    return matched(c, ("bmm",)).select("sid", joined("bmm").alias("words"))


@query("o77_bidirectional_match", "SELECT sid, words FROM mm_words WHERE mode = 'bidirectional'")
def o77(c: Corpus) -> DataFrame:
    return matched(c, ("bidirectional",)).select("sid", joined("bidirectional").alias("words"))


define("modal_train", """SELECT word, arg_max(tag, k) AS tag FROM (
    SELECT word, tag, struct_pack(n := count(*), s := -min(sid * 100000::HUGEINT + idx)) AS k FROM train_tok GROUP BY word, tag) GROUP BY word""")
define("pred", """SELECT p.sid, start, stop, substr(s, start + 1, stop - start) AS word, coalesce(m.tag, 'x') AS tag
    FROM mm_seg p JOIN sent ON sent.sid = p.sid LEFT JOIN modal_train m ON m.word = substr(s, start + 1, stop - start) WHERE mode = 'bidirectional'""")
TAGGED_SQL = "SELECT sid, string_agg(word || '|' || tag, ' ' ORDER BY start) AS tokens FROM {} GROUP BY sid"


def train_modal(c: Corpus) -> DataFrame:
    if not hasattr(c, "_train_modal"):
        tok = part(c, "train").select("sid", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"))).alias("idx", "w"))
        c._train_modal = as_table(modal_tag(tok.select("sid", "idx", "w.word", "w.tag")), "train-modal")
    return c._train_modal


def tagged(c: Corpus) -> DataFrame:
    """(sid, pred_words, pred_tags) of the bidirectional segmentation."""
    if c.unique:
        rows = sg.tag_arrays(matched(c, ("bidirectional",)), train_modal(c), "bidirectional")
        if rows is not None:
            return rows.withColumnRenamed("bidirectional", "pred_words")
    rows = sg.tag_words(matched(c), train_modal(c), "bidirectional", fits_broadcast(train_modal(c)))
    both = F.array_sort(F.collect_list(F.struct("idx", "word", "tag")))
    return rows.groupBy("sid").agg(both.alias("t")).select(
        "sid", F.transform("t", lambda x: x["word"]).alias("pred_words"), F.transform("t", lambda x: x["tag"]).alias("pred_tags"))


def tokens(words: str, tags: str):
    return F.array_join(F.zip_with(words, tags, lambda w, t: F.concat(w, F.lit("|"), t)), " ")


@query("o78_modal_tagging", TAGGED_SQL.format("pred"))
def o78(c: Corpus) -> DataFrame:
    return tagged(c).select("sid", tokens("pred_words", "pred_tags").alias("tokens"))


# A fitted model has no SQL form, but its decoding has exact invariants: one row per sentence, words that spell it, legal labels.
@query("o79_character_tagger", """SELECT sid, s AS spelled, length(s)::BIGINT AS labels, 0::BIGINT AS illegal, true AS tagged
    FROM sent JOIN (SELECT sid FROM splits WHERE split = 'test') USING (sid)""")
def o79(c: Corpus) -> DataFrame:
    """Fit on the training part with all features, decode the test part."""
    model = TaggerSegmenter(c.lex, stats_of(c)).fit(part(c, "train"))
    test = part(c, "test")
    labels = as_table(model.labels(test), "tagger-labels")
    out = sg.tag_arrays(labels, model.tags, "pred_words") if c.unique else None
    if out is None:
        out = with_predictions(labels.select("sid", "labels"), labels.select("sid", "pred_words"), model.tags, model.tags_fit)
    return out.select(
        "sid", joined("pred_words", "").alias("spelled"), (F.size("pred_words") == F.size("pred_tags")).alias("tagged"),
        F.size("labels").cast("bigint").alias("labels"), illegal_transitions(F.col("labels")).cast("bigint").alias("illegal"))


@query("o80_char2vec", f"""SELECT ch, {embed.VECTOR_SIZE}::BIGINT AS dims, true AS finite
    FROM (SELECT DISTINCT unnest(string_split(run, '')) AS ch FROM runs WHERE length(run) >= 2)""")
def o80(c: Corpus) -> DataFrame:
    vectors = embed.char_vectors(embed.char2vec(c.runs))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("ch", F.size("vector").cast("bigint").alias("dims"), finite.alias("finite"))


TARGET_STD = 0.02


@query("o81_embedding_rescale", f"""
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    sc AS (SELECT {TARGET_STD}::DOUBLE / (stddev_pop(v) + 1e-8) AS k FROM x)
    SELECT doc_id AS vec_id, round(sum(v * k * i), 6) + 0.0 AS weighted_sum, count(*)::BIGINT AS dims,
        (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))::BIGINT AS covered,
        (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))::BIGINT AS missing
    FROM documents JOIN x ON x.vec_id = doc_id, sc GROUP BY doc_id""")
def o81(c: Corpus) -> DataFrame:
    vectors = c.table("embeddings").select("vec_id", "embedding")
    wanted = c.table("documents").select(F.col("doc_id").alias("vec_id"))
    scaled = sg.rescale_embeddings(vectors, wanted, "vec_id", "embedding", TARGET_STD)
    cover = sg.embedding_coverage(vectors, wanted, "vec_id")
    weighted = F.aggregate(F.transform("scaled", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return scaled.select("vec_id", r6(weighted).alias("weighted_sum"), F.size("scaled").cast("bigint").alias("dims"),
                         cover.select("covered").scalar().alias("covered"), cover.select("missing").scalar().alias("missing"))


define("label_pos", """SELECT sid, pos, y, lag(y) OVER (PARTITION BY sid ORDER BY pos) AS prev, lead(y) OVER (PARTITION BY sid ORDER BY pos) AS nxt
    FROM (SELECT sid, unnest(range(0, len(y))) AS pos, unnest(y) AS y FROM bies)""")
define("trans_cnt", """SELECT 'next' AS kind, prev AS a, y AS b, count(*) AS cnt FROM label_pos WHERE prev IS NOT NULL GROUP BY prev, y
    UNION ALL SELECT 'start', '', y, count(*) FROM label_pos WHERE prev IS NULL GROUP BY y UNION ALL SELECT 'end', y, '', count(*) FROM label_pos WHERE nxt IS NULL GROUP BY y""")


@query("o82_transition_counts", "SELECT kind, a, b, cnt::BIGINT AS cnt FROM trans_cnt")
def o82(c: Corpus) -> DataFrame:
    return sg.transition_counts(c.sent)


# Decoding with add-one smoothed log-probabilities, rounded so that both engines use the same numbers.
define("emission", """SELECT ch, max(v) FILTER (y = 'B') AS b, max(v) FILTER (y = 'I') AS i, max(v) FILTER (y = 'E') AS e, max(v) FILTER (y = 'S') AS s FROM (
    SELECT k.ch, k.y, round(ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY k.ch) + 4)), 6) AS v FROM
        (SELECT ch, y FROM (SELECT DISTINCT ch FROM chrs), (SELECT unnest(['B', 'I', 'E', 'S']) AS y)) k
        LEFT JOIN (SELECT ch, y, count(*) AS n FROM chrs JOIN label_pos USING (sid, pos) GROUP BY ch, y) USING (ch, y)) GROUP BY ch""")
define("log_t", """SELECT k.kind, k.a, k.b, round(ln((coalesce(cnt, 0) + 1) / (sum(coalesce(cnt, 0)) OVER (PARTITION BY k.kind, CASE WHEN k.kind = 'next' THEN k.a END) + 4)), 6) AS v
    FROM (SELECT 'next' AS kind, a, b FROM (SELECT unnest(['B', 'I', 'E', 'S']) AS a), (SELECT unnest(['B', 'I', 'E', 'S']) AS b)
        UNION ALL SELECT 'start', '', unnest(['B', 'I', 'E', 'S']) UNION ALL SELECT 'end', unnest(['B', 'I', 'E', 'S']), '') k
    LEFT JOIN trans_cnt t ON t.kind = k.kind AND t.a = k.a AND t.b = k.b""")
define("log_w", "SELECT " + ", ".join(
    [f"max(v) FILTER (kind = 'next' AND a = '{a}' AND b = '{b}') AS t{a}{b}" for a, b in ("BI", "BE", "II", "IE", "EB", "ES", "SB", "SS")]
    + [f"max(v) FILTER (kind = 'start' AND b = '{b}') AS st{b}" for b in "BS"] + [f"max(v) FILTER (kind = 'end' AND a = '{a}') AS en{a}" for a in "ES"]) + " FROM log_t")
define("em_pos", "SELECT sid, pos, b, i, e, s FROM chrs JOIN emission USING (ch)")
define("vit0", """/*recursive*/ SELECT sid, pos, stB + b AS b, -1e9::DOUBLE + i AS i, -1e9::DOUBLE + e AS e, stS + s AS s, 'B' AS pb, 'I' AS pi, 'E' AS pe, 'S' AS ps
        FROM em_pos, log_w WHERE pos = 0
    UNION ALL SELECT v.sid, x.pos,
        CASE WHEN v.e + tEB >= v.s + tSB THEN v.e + tEB ELSE v.s + tSB END + x.b, CASE WHEN v.b + tBI >= v.i + tII THEN v.b + tBI ELSE v.i + tII END + x.i,
        CASE WHEN v.b + tBE >= v.i + tIE THEN v.b + tBE ELSE v.i + tIE END + x.e, CASE WHEN v.e + tES >= v.s + tSS THEN v.e + tES ELSE v.s + tSS END + x.s,
        CASE WHEN v.e + tEB >= v.s + tSB THEN pe ELSE ps END || 'B', CASE WHEN v.b + tBI >= v.i + tII THEN pb ELSE pi END || 'I',
        CASE WHEN v.b + tBE >= v.i + tIE THEN pb ELSE pi END || 'E', CASE WHEN v.e + tES >= v.s + tSS THEN pe ELSE ps END || 'S'
    FROM vit0 v JOIN em_pos x ON x.sid = v.sid AND x.pos = v.pos + 1, log_w""", False)


@query("o83_viterbi", """
    SELECT sid, CASE WHEN e + enE >= vit0.s + enS THEN pe ELSE ps END AS labels FROM vit0, log_w, (SELECT sid AS id, length(s) AS n FROM sent)
    WHERE id = sid AND pos = n - 1""")
def o83(c: Corpus) -> DataFrame:
    labels = F.arrays_zip(characters(F.col("s")).alias("ch"), words_to_bies(F.col("words")).alias("y"))
    counts = c.sent.select(F.explode(labels).alias("x")).groupBy(F.col("x.ch").alias("ch")).agg(
        *[F.sum((F.col("x.y") == b).cast("bigint")).alias(b) for b in BIES])
    total = sum((F.col(b) for b in BIES), F.lit(len(BIES)))
    scores = counts.select("ch", F.array(*[F.round(F.log((F.col(b) + 1) / total), 6) for b in BIES]).alias("e"))
    t = log_probabilities(sg.transition_counts(c.sent))
    places = {k: [round(v, 6) for v in t[k]] for k in ("start", "end")}
    return decode_characters(c.sent.select("sid", "s"), scores, places["start"], [[round(v, 6) for v in row] for row in t["trans"]], places["end"])


# --- evaluation on the test part ----------------------------------------------------------
@query("o84_word_spans", "SELECT sid, string_agg(start || ':' || stop || ':' || word, ' ' ORDER BY idx) AS spans FROM tok GROUP BY sid")
def o84(c: Corpus) -> DataFrame:
    both = F.zip_with(ev.spans_of(F.col("words")), "words", lambda s, w: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"), w))
    return c.sent.select("sid", joined(both).alias("spans"))


def pairs_of(c: Corpus) -> DataFrame:
    """Gold and predicted words and tags of the test sentences."""
    if c.unique and match.fits(combined_dictionary(c).size):
        keep = ("sid", "category", "words", "tags")
        pred = match.segment_rows(part(c, "test"), match.broadcast_words(combined_dictionary(c).words), ("bidirectional",), keep=keep)
        rows = sg.tag_arrays(pred, train_modal(c), "bidirectional")
        if rows is not None:
            return rows.withColumnRenamed("bidirectional", "pred_words")
    if not hasattr(c, "_pairs"):
        gold = part(c, "test").select("sid", "category", "words", "tags")
        pred = tagged(c).join(gold.select("sid"), "sid", "left_semi")
        c._pairs = ev.pair_up(gold, pred).persist(StorageLevel.MEMORY_AND_DISK)
    return c._pairs


define("test_tok", """SELECT t.*, p.sid IS NOT NULL AS correct, coalesce(p.tag = t.tag, false) AS tag_ok, t.word IN (SELECT word FROM train_words) AS iv
    FROM tok t JOIN splits USING (sid) LEFT JOIN pred p ON p.sid = t.sid AND p.start = t.start AND p.stop = t.stop WHERE split = 'test'""")
define("test_pred", "SELECT pred.*, category FROM pred JOIN splits USING (sid) WHERE split = 'test'")
COUNTS = "count(*) AS g, count(*) FILTER (correct) AS c, count(*) FILTER (correct AND tag_ok) AS t, count(*) FILTER (NOT iv) AS ot, count(*) FILTER (NOT iv AND correct) AS oc, count(*) FILTER (iv) AS it, count(*) FILTER (iv AND correct) AS ic, count(DISTINCT sid) AS n"
define("test_sums", f"""SELECT g.*, p FROM (SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE coalesce(category, 'none') END AS category, {COUNTS} FROM test_tok GROUP BY GROUPING SETS ((category), ())) g
    JOIN (SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE coalesce(category, 'none') END AS category, count(*) AS p FROM test_pred GROUP BY GROUPING SETS ((category), ())) USING (category)""")


def ratio_sql(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0), 0.0)::DOUBLE"


METRIC_SQL = {
    "P": ratio_sql("c", "p"), "R": ratio_sql("c", "g"),
    "F1": f"coalesce(2 * {ratio_sql('c', 'p')} * {ratio_sql('c', 'g')} / nullif({ratio_sql('c', 'p')} + {ratio_sql('c', 'g')}, 0), 0.0)::DOUBLE",
    "OOV-R": ratio_sql("oc", "ot"), "IV-R": ratio_sql("ic", "it"), "OOV%": ratio_sql("ot", "g"), "POS-Acc": ratio_sql("t", "c"),
}


def metrics_sql(*names: str) -> str:
    return ", ".join(f'round({METRIC_SQL[n]}, 6) AS "{n}"' for n in names)


def rounded(scores: DataFrame, keys, counts, names) -> DataFrame:
    return scores.select(*keys, *counts, *[r6(f"`{n}`").alias(n) for n in names])


@query("o85_precision_recall", f"SELECT c::BIGINT AS num_correct, p::BIGINT AS num_pred, g::BIGINT AS num_gold, {metrics_sql('P', 'R', 'F1')} FROM test_sums WHERE category = 'ALL'")
def o85(c: Corpus) -> DataFrame:
    return rounded(ev.evaluate(pairs_of(c)), (), ("num_correct", "num_pred", "num_gold"), ("P", "R", "F1"))


@query("o86_oov_recall", f"""SELECT ot::BIGINT AS oov_total, oc::BIGINT AS oov_correct, it::BIGINT AS iv_total, ic::BIGINT AS iv_correct,
    {metrics_sql('OOV-R', 'IV-R', 'OOV%')} FROM test_sums WHERE category = 'ALL'""")
def o86(c: Corpus) -> DataFrame:
    return rounded(ev.evaluate(pairs_of(c), train_words(c)), (), ("oov_total", "oov_correct", "iv_total", "iv_correct"), ("OOV-R", "IV-R", "OOV%"))


@query("o87_tag_accuracy", f"SELECT c::BIGINT AS num_correct, t::BIGINT AS num_tag_ok, {metrics_sql('POS-Acc')} FROM test_sums WHERE category = 'ALL'")
def o87(c: Corpus) -> DataFrame:
    return rounded(ev.evaluate(pairs_of(c)), (), ("num_correct", "num_tag_ok"), ("POS-Acc",))


@query("o88_error_listing", """
    WITH fp AS (SELECT p.sid, p.start, p.word FROM test_pred p LEFT JOIN tok t ON t.sid = p.sid AND t.start = p.start AND t.stop = p.stop WHERE t.sid IS NULL),
    fn AS (SELECT sid, start, word FROM test_tok WHERE NOT correct),
    bad AS (SELECT DISTINCT sid FROM (SELECT sid FROM fp UNION ALL SELECT sid FROM fn))
    SELECT bad.sid, s AS sentence, array_to_string(words, ' ') AS gold, (SELECT string_agg(word, ' ' ORDER BY start) FROM test_pred p WHERE p.sid = bad.sid) AS pred,
        coalesce((SELECT string_agg(word, ' ' ORDER BY start) FROM fp WHERE fp.sid = bad.sid), '') AS fp,
        coalesce((SELECT string_agg(word, ' ' ORDER BY start) FROM fn WHERE fn.sid = bad.sid), '') AS fn, (SELECT count(*) FROM bad)::BIGINT AS num_error_sents
    FROM bad JOIN sent USING (sid) ORDER BY bad.sid LIMIT 5""")
def o88(c: Corpus) -> DataFrame:
    rows = ev.error_listing(pairs_of(c), 5)
    return rows.select("sid", "sentence", *[joined(x).alias(x) for x in ("gold", "pred", "fp", "fn")], "num_error_sents")


@query("o89_category_metrics", f"SELECT category, n::BIGINT AS n_sents, {metrics_sql(*METRIC_SQL)} FROM test_sums")
def o89(c: Corpus) -> DataFrame:
    return rounded(ev.evaluate(pairs_of(c), train_words(c), category="category"), ("category",), ("n_sents",), ev.METRICS)


# --- joint boundaries and tags ----------------------------------------------------------
def joint_of(c: Corpus) -> DataFrame:
    """(sid, labels, pred_words, pred_tags) of the test part by a joint tagger with all features, fitted as the one of ``o79``."""
    if not hasattr(c, "_joint"):
        model = JointSegmenter(c.lex, stats_of(c)).fit(part(c, "train"))
        c._joint = as_table(model.labels(part(c, "test")), "joint-labels")
    return c._joint


# As for o79: exact invariants of the decoding.
@query("joint_tagger", """SELECT sid, s AS spelled, length(s)::BIGINT AS labels, 0::BIGINT AS illegal, true AS tagged
    FROM sent JOIN (SELECT sid FROM splits WHERE split = 'test') USING (sid)""")
def joint_tagger(c: Corpus) -> DataFrame:
    return joint_of(c).select(
        "sid", joined("pred_words", "").alias("spelled"), (F.size("pred_words") == F.size("pred_tags")).alias("tagged"),
        F.size("labels").cast("bigint").alias("labels"), illegal_joint(F.col("labels")).cast("bigint").alias("illegal"))


# The gold side is exact; of the fitted side, that every count and metric is within its bounds.
@query("joint_experiment", """SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE coalesce(category, 'none') END AS category, count(*)::BIGINT AS num_gold,
        count(DISTINCT sid)::BIGINT AS n_sents, count(*) FILTER (NOT iv)::BIGINT AS oov_total, true AS bounded
    FROM (SELECT *, word IN (SELECT word FROM train_words) AS iv FROM tok JOIN splits USING (sid) WHERE split = 'test') GROUP BY GROUPING SETS ((category), ())""")
def joint_experiment(c: Corpus) -> DataFrame:
    """Scores of the joint tagger by category, POS-Acc with its own tags."""
    scores = ev.evaluate(ev.pair_up(part(c, "test").select("sid", "category", "words", "tags"), joint_of(c)), train_words(c), category="category")
    within = [F.col(f"`{m}`").between(0, 1) for m in ev.METRICS] + [
        F.col("num_correct") <= F.least("num_gold", "num_pred"), F.col("num_tag_ok") <= F.col("num_correct"),
        F.col("oov_correct") + F.col("iv_correct") == F.col("num_correct")]
    bounded = within[0]
    for x in within[1:]:
        bounded &= x
    return scores.select("category", "num_gold", "n_sents", "oov_total", bounded.alias("bounded"))


# --- cross-validation ---------------------------------------------------------------------
define("cv_tok", "SELECT t.*, fold AS run FROM tok t JOIN (SELECT sid, fold FROM folds) USING (sid)")
define("cv_train", "SELECT t.*, run FROM tok t JOIN roles USING (sid) WHERE role = 'train'")
define("cv_vocab", "SELECT DISTINCT run, word FROM cv_train")
define("cv_modal", """SELECT run, word, arg_max(tag, k) AS tag FROM (
    SELECT run, word, tag, struct_pack(n := count(*), s := -min(sid * 100000::HUGEINT + idx)) AS k FROM cv_train GROUP BY run, word, tag) GROUP BY run, word""")
define_matching("cv", f"""WITH every AS (SELECT unnest(range(0, 5)) AS run), pre AS (SELECT run, word FROM every, lex), one AS (SELECT run, word FROM every, ({SINGLES_SQL} AS word))
    SELECT 'corpus' AS src, run, word FROM (SELECT * FROM cv_vocab UNION SELECT * FROM one) UNION ALL
    SELECT 'predefined', run, word FROM (SELECT * FROM pre UNION SELECT * FROM one) UNION ALL
    SELECT 'combined', run, word FROM (SELECT * FROM cv_vocab UNION SELECT * FROM pre UNION SELECT * FROM one)""",
                "SELECT sid, fold AS run, s FROM sent JOIN (SELECT sid, fold FROM folds) USING (sid)")
define("cv_methods", "SELECT unnest({}) AS method, unnest({}) AS mode, unnest({}) AS src".format(
    *[str([x for x in col]) for col in zip(*[(n, m, s) for n, (m, s) in ex.METHODS.items()])]))
define("cv_pred", "SELECT method, p.sid, run, category, p.start, p.stop FROM cv_seg p JOIN cv_methods USING (mode, src) JOIN (SELECT sid, category, fold AS run FROM folds) USING (sid)")
define("cv_gold", """SELECT m.method, t.sid, t.run, t.category, p.sid IS NOT NULL AS correct, coalesce(md.tag, 'x') = t.tag AS tag_ok, v.word IS NOT NULL AS iv
    FROM cv_tok t, cv_methods m""".replace("FROM cv_tok t, cv_methods m", "FROM cv_tok t CROSS JOIN cv_methods m") + """
    LEFT JOIN cv_pred p ON p.method = m.method AND p.sid = t.sid AND p.start = t.start AND p.stop = t.stop
    LEFT JOIN cv_vocab v ON v.run = t.run AND v.word = t.word LEFT JOIN cv_modal md ON md.run = t.run AND md.word = t.word""")
define("cv_sums", f"""SELECT g.*, p FROM (SELECT method, run, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE coalesce(category, 'none') END AS category, {COUNTS} FROM cv_gold GROUP BY GROUPING SETS ((method, run, category), (method, run))) g
    JOIN (SELECT method, run, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE coalesce(category, 'none') END AS category, count(*) AS p FROM cv_pred GROUP BY GROUPING SETS ((method, run, category), (method, run))) USING (method, run, category)""")
# The tagger levels are fitted, so SQL knows their rows, counts and OOV%; their other metrics count as -1 where they are within 0 and 1.
define("cv_levels", "SELECT unnest({}) AS method, unnest({}) AS config".format(*[list(x) for x in zip(*[(n, f"dict {d}/gap {g}") for n, (d, g) in tg.LEVELS.items()])]))
define("cv_long", " UNION ALL ".join(
    [f"SELECT method, category, run AS fold, '{n}' AS metric, {e} AS value, n FROM cv_sums" for n, e in METRIC_SQL.items()]
    + [f"SELECT l.method, category, run, '{n}', {e if n == 'OOV%' else '-1.0::DOUBLE'}, n FROM cv_sums CROSS JOIN cv_levels l WHERE cv_sums.method = 'fmm_corpus'"
       for n, e in METRIC_SQL.items()]))


def scores_of(c: Corpus) -> DataFrame:
    """Scores of the whole grid, tagger levels included: methods x folds x categories rows, kept for the report queries."""
    if not hasattr(c, "_cv"):
        roles = sp.with_fold_roles(c.sent)
        c._cv = ex.cv_scores(roles, c.lex.words, taggers=tg.tagger_counts(roles, c.lex, stats_of(c)))
    return c._cv


def cv_of(c: Corpus) -> DataFrame:
    """The scores as SQL can know them: a fitted metric within its bounds is -1."""
    fitted = F.col("method").isin(*tg.LEVELS)
    return scores_of(c).withColumns({m: F.when(fitted & F.col(f"`{m}`").between(0, 1), -1.0).otherwise(F.col(f"`{m}`"))
                                     for m in ev.METRICS if m != "OOV%"})


@query("crf_grid")
def crf_grid(c: Corpus) -> DataFrame:
    """Fitted scores of the tagger levels by fold and category; no SQL can know them."""
    keys, counts = ("method", "fold", "category"), ("n_sents", "num_gold", "num_pred", "num_correct", "oov_total", "oov_correct")
    return rounded(scores_of(c).where(F.col("method").isin(*tg.LEVELS)), keys, counts, ev.METRICS)


def overall(c: Corpus) -> DataFrame:
    return cv_of(c).where(F.col("category") == ev.ALL)


VALUES_SQL = "string_agg(printf('%.6f', round(value, 6)), ' ' ORDER BY fold)"


def values_text(col: str):
    return F.array_join(F.transform(col, lambda v: F.format_string("%.6f", F.round(v, 6))), " ")


@query("o90_cv_aggregate", f"""SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, {VALUES_SQL} AS "values"
    FROM cv_long WHERE category = 'ALL' GROUP BY method, metric""")
def o90(c: Corpus) -> DataFrame:
    agg = ev.cv_aggregate(ex.grid(overall(c)))
    return agg.select("method", "metric", r6("mean").alias("mean"), r6("std").alias("std"), values_text("values").alias("values"))


@query("o91_cv_category_aggregate", f"""SELECT method, category, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, {VALUES_SQL} AS "values", sum(n)::BIGINT AS n_sents
    FROM cv_long WHERE category <> 'ALL' GROUP BY method, category, metric""")
def o91(c: Corpus) -> DataFrame:
    scores = cv_of(c).where(F.col("category") != ev.ALL)
    agg = ev.cv_category_aggregate(ex.grid(scores), scores)
    return agg.select("method", "category", "metric", r6("mean").alias("mean"), r6("std").alias("std"), values_text("values").alias("values"), "n_sents")


def report_sql() -> str:
    cols = ", ".join(f"max(t) FILTER (metric = '{n}') AS \"{n}\"" for n in METRIC_SQL)
    return f"SELECT method, category, {cols} FROM (SELECT method, category, metric, printf('%.4f±%.4f', round(avg(value), 4), round(stddev_pop(value), 4)) AS t FROM cv_long GROUP BY method, category, metric) GROUP BY method, category"


@query("o92_report_rows", report_sql())
def o92(c: Corpus) -> DataFrame:
    return ev.cv_report_rows(ev.cv_aggregate(ex.grid(cv_of(c)), ("method", "category")), ("method", "category"))


@query("o93_experiment_grid", """
    SELECT method, category, fold::INT AS fold, metric, round(value, 6) AS value FROM cv_long
    UNION ALL SELECT 'hmm', 'unknown method', -1, '', NULL""")
def o93(c: Corpus) -> DataFrame:
    names = ex.method_table(c.spark, [*ex.ALL_METHODS, "hmm"])
    unknown = names.where(~F.col("known")).select(
        "method", F.lit("unknown method").alias("category"), F.lit(-1).alias("fold"), F.lit("").alias("metric"), F.lit(None).cast("double").alias("value"))
    return ex.grid(cv_of(c)).select("method", "category", "fold", "metric", r6("value").alias("value")).unionByName(unknown)


def level_metrics_sql(digits: int) -> str:
    return ", ".join(f'round({e}, {digits}) AS "{n}"' if n == "OOV%" else f'-1.0::DOUBLE AS "{n}"' for n, e in METRIC_SQL.items())


FOLDS_SQL = f"""SELECT method, run::INT AS fold, category, {metrics_sql(*METRIC_SQL)} FROM cv_sums
    UNION ALL SELECT l.method, run::INT, category, {level_metrics_sql(6)} FROM cv_sums CROSS JOIN cv_levels l WHERE cv_sums.method = 'fmm_corpus'"""


@query("o06_results_sink", FOLDS_SQL)
def o06(c: Corpus) -> DataFrame:
    path = scratch_path(c.spark, "results")
    keys = ("method", "fold", "category")
    sinks.save_results(cv_of(c), path, keys)
    schema = "method STRING, fold INT, category STRING, " + ", ".join(f"`{m}` DOUBLE" for m in ev.METRICS)
    return rounded(c.spark.read.schema(schema).json(path), keys, (), ev.METRICS)


@query("o07_run_log", "SELECT m.method, 'documents/' || run AS corpus, 1::BIGINT AS runs, mode || '/' || src AS config, " + ", ".join(
    f'round({e}, 4) AS "{n}"' for n, e in METRIC_SQL.items()) + f""" FROM cv_sums JOIN cv_methods m USING (method) WHERE category = 'ALL'
    UNION ALL SELECT l.method, 'documents/' || run, 1::BIGINT, config, {level_metrics_sql(4)} FROM cv_sums CROSS JOIN cv_levels l
    WHERE cv_sums.method = 'fmm_corpus' AND category = 'ALL'""")
def o07(c: Corpus) -> DataFrame:
    """Every fold is appended as a run; the log is read back and unpacked per method."""
    path = scratch_path(c.spark, "run-log")
    settings = [(n, f"{m}/{s}") for n, (m, s) in ex.METHODS.items()] + [(n, f"dict {d}/gap {g}") for n, (d, g) in tg.LEVELS.items()]
    config = c.spark.createDataFrame(settings, "method string, config string")
    for fold in range(ex.FOLDS):
        record = sinks.run_record(overall(c).where(F.col("fold") == fold), f"documents/{fold}", config, None, 1.234)
        sinks.append_run_log(record, path)
    inner = ", ".join(f"`{m}`: DOUBLE" for m in ev.METRICS)
    log = c.spark.read.schema(f"""timestamp STRING, corpus STRING, max_sentences INT, elapsed_seconds DOUBLE,
        methods_config ARRAY<STRUCT<method: STRING, config: STRING>>, results ARRAY<STRUCT<method: STRING, r: STRUCT<{inner}>>>""").json(path)
    rows = log.select("corpus", F.explode(F.arrays_zip("results", "methods_config")).alias("x")).select(
        "corpus", F.col("x.results.method").alias("method"), F.col("x.methods_config.config").alias("config"), "x.results.r.*")
    return rows.groupBy("method", "corpus", "config", *[F.col(f"`{m}`") for m in ev.METRICS]).agg(F.count(F.lit(1)).alias("runs"))


# --- streaming and the model contract -----------------------------------------------------
@query("o101_incremental_vocabulary", "SELECT word, freq::BIGINT AS freq FROM freq")
def o101(c: Corpus) -> DataFrame:
    schema = c.table("documents").schema
    return incremental_word_freq(stream_words(c.spark, c.path, "documents.parquet", schema))


@query("o102_fit_transform", TAGGED_SQL.format("pred"))
def o102(c: Corpus) -> DataFrame:
    model = DictionarySegmenter("bidirectional", "combined", c.lex.words).fit(part(c, "train"))
    out = model.transform(c.sent.select("sid", "s"))
    return out.select("sid", tokens("pred_words", "pred_tags").alias("tokens"))


define_matching("full", f"SELECT DISTINCT 'corpus' AS src, 0 AS run, word FROM (SELECT word FROM tok UNION {SINGLES_SQL})",
                "SELECT sid, 0 AS run, s FROM sent")
define("full_pred", """SELECT p.sid, start, substr(s, start + 1, stop - start) AS word, coalesce(m.tag, 'x') AS tag
    FROM full_seg p JOIN sent ON sent.sid = p.sid LEFT JOIN modal m ON m.word = substr(s, start + 1, stop - start) WHERE mode = 'bidirectional'""")


@query("o103_retrain_and_persist", TAGGED_SQL.format("full_pred"))
def o103(c: Corpus) -> DataFrame:
    """Fit on all sentences, save, load, and segment every sentence with what was loaded."""
    path = scratch_path(c.spark, "segmenter")
    DictionarySegmenter("bidirectional", "corpus").fit(c.sent).save(path)
    out = DictionarySegmenterModel.load(c.spark, path).transform(c.sent.select("sid", "s"))
    return out.select("sid", tokens("pred_words", "pred_tags").alias("tokens"))


