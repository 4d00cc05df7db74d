"""The fixed relations in SQL, as common table expressions that name what they need."""

from __future__ import annotations

import re

STRIDE = 10_000_000
LONG_BIN = "CASE WHEN length(word) <= 2 THEN '2' WHEN length(word) = 3 THEN '3' WHEN length(word) = 4 THEN '4' ELSE '5P' END"
TOKENS = r"[\p{L}\p{N}]+"


def bucket(expr: str) -> str:
    """The first 8 hex digits of a digest as a number."""
    return f"('0x' || substr({expr}, 1, 8))::BIGINT"


RELATIONS: dict[str, str] = {
    "raw_doc": f"SELECT doc_id, lang, source, regexp_extract_all(text, '{TOKENS}') AS r FROM documents",
    "cut_doc": """SELECT doc_id, lang, source, unnest(list_transform(range(0, len(r), 12),
        lambda i: struct_pack(k := i // 12, w := r[i + 1:i + 12]))) AS c FROM raw_doc WHERE len(r) > 0""",
    "sent": rf"""SELECT doc_id * {STRIDE} + c.k AS sid, doc_id, c.k AS k, lang AS category, source AS grp,
        list_transform(c.w, lambda x: lower(x)) AS words,
        list_transform(c.w, lambda x: CASE WHEN regexp_matches(x, '^\p{{Nd}}') THEN 'm'
            WHEN regexp_matches(x, '^\p{{Lu}}') THEN 'nh' WHEN length(x) <= 3 THEN 'u' ELSE 'n' END) AS tags,
        array_to_string(list_transform(c.w, lambda x: lower(x)), '') AS s FROM cut_doc""",
    "tok": """SELECT sid, category, idx, word, tag, stop - length(word) AS start, stop FROM (
        SELECT *, sum(length(word)) OVER (PARTITION BY sid ORDER BY idx)::BIGINT AS stop FROM (
            SELECT sid, category, unnest(range(0, len(words))) AS idx, unnest(words) AS word, unnest(tags) AS tag FROM sent))""",
    "chrs": "SELECT sid, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS ch FROM sent",
    "conv_tok": f"""SELECT conv_id, turn, list_transform(regexp_extract_all(text, '{TOKENS}'), lambda x: lower(x)) AS w
        FROM conversations""",
    "conv_words": "SELECT DISTINCT unnest(w) AS word FROM conv_tok",
    "doc_words": f"""SELECT d.doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{TOKENS}'), lambda x: lower(x)))) AS word
        FROM documents d""",
    "lab": "SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id",
    "lab_words": """SELECT word, bool_or(good) AS good, bool_or(bad) AS bad FROM doc_words JOIN lab USING (doc_id) GROUP BY word""",
    "lex_base": f"""SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS word FROM benchmark)
        WHERE length(word) >= 2""",
    "lex": f"""SELECT word, {LONG_BIN} AS bin, coalesce(good, false) AS has_yi, coalesce(bad, false) AS has_yin,
        word IN (SELECT word FROM conv_words) AS has_book_title FROM lex_base LEFT JOIN lab_words USING (word)""",
    "lex2": "SELECT word FROM conv_words WHERE length(word) BETWEEN 2 AND 4",
    "runs": """SELECT concat_ws(':', conv_id, turn, c.k) AS rid, conv_id, array_to_string(c.w, '') AS run FROM (
        SELECT conv_id, turn, unnest(list_transform(range(0, len(w), 12), lambda i: struct_pack(k := i // 12, w := w[i + 1:i + 12]))) AS c
        FROM conv_tok WHERE len(w) > 0)""",
    "run_chr": "SELECT rid, unnest(range(0, length(run))) AS pos, unnest(string_split(run, '')) AS ch FROM runs",
    "uni": "SELECT ch, count(*) AS cnt FROM run_chr GROUP BY ch",
    "bi": """SELECT a, b, count(*) AS cnt FROM (SELECT ch AS a, lead(ch) OVER (PARTITION BY rid ORDER BY pos) AS b FROM run_chr)
        WHERE b IS NOT NULL GROUP BY a, b""",
    "margins": """SELECT a, b, bi.cnt AS cnt, ua.cnt AS c_a, ub.cnt AS c_b, (SELECT sum(cnt) FROM bi)::DOUBLE AS n
        FROM bi JOIN uni ua ON ua.ch = a JOIN uni ub ON ub.ch = b""",
    "pairs": """SELECT a, b, cnt, ln(1 + cnt) AS logfreq,
        greatest(0.0, ln(cnt - 0.5) - ln(c_a) - ln(c_b) + ln(n)) AS assoc FROM margins""",
    "ent": """SELECT ch, h_left, h_right FROM (
        SELECT b AS ch, -sum(p * ln(p)) + 0.0 AS h_left FROM (SELECT b, cnt / sum(cnt) OVER (PARTITION BY b) AS p FROM bi) GROUP BY b)
        FULL JOIN (SELECT a AS ch, -sum(p * ln(p)) + 0.0 AS h_right FROM (SELECT a, cnt / sum(cnt) OVER (PARTITION BY a) AS p FROM bi) GROUP BY a)
        USING (ch)""",
    "spots": "SELECT sid, s, unnest(range(0, length(s))) AS start FROM sent",
    "cand": """SELECT sid, start, l AS len, start + l AS stop, substr(s, start + 1, l) AS word
        FROM spots, (SELECT DISTINCT length(word) AS l FROM lex_base) WHERE start + l <= length(s)""",
    "lat": "SELECT sid, start, stop, cand.len AS len, word, bin, has_yi, has_yin, has_book_title FROM cand JOIN lex USING (word)",
    "gold_hit": """SELECT l.*, t.sid IS NOT NULL AS is_gold FROM lat l
        LEFT JOIN tok t ON t.sid = l.sid AND t.start = l.start AND t.stop = l.stop""",
    "oh": "SELECT word, bin, count(*) AS occ, count(*) FILTER (is_gold) AS hit FROM gold_hit GROUP BY word, bin",
    "prior": """SELECT b.bin, (coalesce(sum(hit), 0) + 1) / (coalesce(sum(occ), 0) + 2) AS p_g
        FROM (SELECT unnest(['2', '3', '4', '5P']) AS bin) b LEFT JOIN oh USING (bin) GROUP BY b.bin""",
    "rel": "SELECT word, occ, hit, p_g, (hit + 5 * p_g) / (occ + 5) AS value FROM oh JOIN prior USING (bin)",
    # Splits and folds.
    "strat_rank": """SELECT sid, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || sid), sid) - 1 AS r,
        count(*) OVER (PARTITION BY category) AS n FROM sent""",
    "splits": """SELECT sid, category, CASE WHEN n - tr - dv < 1 OR r < tr THEN 'train' WHEN r < tr + dv THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS tr, greatest(1, floor(n * 0.1::DOUBLE)) AS dv FROM strat_rank)""",
    "folds": """SELECT sid, category, ((r >= round_even(n * 1.0::DOUBLE / 5, 0))::INT + (r >= round_even(n * 2.0::DOUBLE / 5, 0))::INT
        + (r >= round_even(n * 3.0::DOUBLE / 5, 0))::INT + (r >= round_even(n * 4.0::DOUBLE / 5, 0))::INT) AS fold FROM strat_rank""",
    "fold_pool": """SELECT sid, run, row_number() OVER (PARTITION BY run ORDER BY md5((1042 + run) || '|' || sid), sid) - 1 AS r,
        count(*) OVER (PARTITION BY run) AS n FROM folds, (SELECT unnest(range(0, 5)) AS run) WHERE run <> fold""",
    "roles": """SELECT sid, fold AS run, 'test' AS role FROM folds UNION ALL
        SELECT sid, run, CASE WHEN r < greatest(1, floor(n * 0.111::DOUBLE)) THEN 'dev' ELSE 'train' END FROM fold_pool""",
    "inner_fold": """SELECT sid, (row_number() OVER (ORDER BY md5('42|' || sid), sid) - 1) % 5 AS fold FROM sent""",
    # Pre-training chunks.
    "chunks": """SELECT concat_ws(':', rid, i // 128) AS cid, conv_id AS grp, substr(run, i + 1, 128) AS text FROM (
        SELECT rid, conv_id, run, unnest(range(0, length(run), 128)) AS i FROM runs WHERE length(run) >= 4)
        WHERE length(substr(run, i + 1, 128)) >= 4""",
}

_MATERIALIZED = {"sent", "tok", "lat", "oh", "lex", "bi", "chrs", "runs", "chunks", "splits", "folds", "uni", "ent", "pairs",
                 "gold_hit", "rel", "strat_rank", "inner_fold", "cut_doc"}


def define(name: str, sql: str, materialized: bool = True) -> None:
    RELATIONS[name] = sql
    if materialized:
        _MATERIALIZED.add(name)


def compose(sql: str) -> str:
    """Put the definitions of all relations ``sql`` mentions in front of it, in order of need.

    ``sql`` may begin with its own WITH list.
    """
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in RELATIONS and word not in order and word not in open_ and RELATIONS[word] != text:
                open_.add(word)
                visit(RELATIONS[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({RELATIONS[n]})" for n in order)
    recursive = "RECURSIVE " if re.search(r"\bRECURSIVE\b", sql) or any("/*recursive*/" in RELATIONS[n] for n in order) else ""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    if body != sql:
        return f"WITH {recursive}{ctes}, {body}"
    return f"WITH {recursive}{ctes} {sql}"
