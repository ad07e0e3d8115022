"""The operators' queries over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import chat_format, decontaminate, html_extract, jaccard_join, lm_score, packing, pii, quality_rules, substring_dedup, url_filter
from seqloom.session import read_table

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EXTRA_TURNS = [(-7, 0, role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    extra = extra.selectExpr("conv_id", "if(role = 'user', 0L, 1L) AS turn", "role", "text")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(turns))


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '<next', '\lnext')) AS chars,
    length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n')) AS role_chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN 6 + role_chars + 2 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (opens) AS n_blocks
FROM t GROUP BY conv_id
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
t AS (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS v FROM d WHERE len(words) > 0),
c AS (
  SELECT *, lag(v) OVER w AS u, count(*) OVER (PARTITION BY doc_id) AS nd, count(*) OVER (PARTITION BY doc_id, v) AS own,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, CAST(good AS INT) AS g, lag(own) OVER (PARTITION BY doc_id ORDER BY i) AS own_u, count(*) OVER (PARTITION BY doc_id, u, v) AS own_uv FROM c),
uni AS (SELECT v, count(*) AS b, count(*) FILTER (good) AS t FROM k GROUP BY v),
bi AS (SELECT u, v, count(*) AS b, count(*) FILTER (good) AS t FROM k WHERE u IS NOT NULL GROUP BY u, v),
n AS (SELECT count(*) AS b, count(*) FILTER (good) AS t FROM k),
p AS (
  SELECT k.*, x.b / n.b AS pb, (x.t - g * own + 1000 * (x.b / n.b)) / (n.t - g * nd + 1000) AS pt, y.b AS yb, y.t AS yt, bi.b AS bb, bi.t AS bt
  FROM k CROSS JOIN n JOIN uni x ON x.v = k.v LEFT JOIN uni y ON y.v = k.u LEFT JOIN bi ON bi.u = k.u AND bi.v = k.v),
g AS (
  SELECT doc_id, CASE WHEN u IS NULL THEN pt ELSE (bt - g * own_uv + 5 * pt) / (yt - g * own_u + 5) END AS gt,
    CASE WHEN u IS NULL THEN pb ELSE (bb - own_uv + 5 * pb) / (yb - own_u + 5) END AS gb
  FROM p),
s AS (SELECT doc_id, avg(-ln(gt)) AS t, avg(-ln(gb)) AS b FROM g GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS score
FROM d LEFT JOIN s USING (doc_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS gram
  FROM d, unnest(range(1, greatest(len(words) - 48, 1))) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) < doc_id AS later FROM w),
c AS (SELECT DISTINCT doc_id, i + k AS at FROM f, range(50) AS v(k) WHERE later),
k AS (SELECT d.doc_id, string_agg(words[p], ' ' ORDER BY p) AS kept, count(*) AS n
  FROM d, unnest(range(1, len(words) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.at = p)
  GROUP BY d.doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).drop("text", "lang", "source")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT doc_id, lang, source, words, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM l),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM m, unnest(range(1, greatest(len(words) - 1, 1))) AS u(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
e AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(floor(n_symbols * 1000 / greatest(word_chars, 1)) AS BIGINT) AS symbols_pm,
    CAST(floor(n_dup_lines * 1000 / greatest(n_lines, 1)) AS BIGINT) AS dup_lines_pm,
    CAST(floor(word_chars * 100 / greatest(n_words, 1)) AS BIGINT) AS word_len_pc
  FROM m LEFT JOIN r USING (doc_id)),
k AS (
  SELECT lang, source, quantile_disc(symbols_pm, [0.25, 0.75]) AS qs, quantile_disc(dup_lines_pm, [0.25, 0.75]) AS qd,
    quantile_disc(word_len_pc, [0.25, 0.75]) AS qw FROM e GROUP BY lang, source),
f AS (
  SELECT e.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    symbols_pm <= qs[2] + 3 * greatest(qs[2] - qs[1], 10) AND dup_lines_pm <= qd[2] + 3 * greatest(qd[2] - qd[1], 150)
    AND word_len_pc BETWEEN qw[1] - 3 * greatest(qw[2] - qw[1], 50) AND qw[2] + 3 * greatest(qw[2] - qw[1], 50) AS inside
  FROM e JOIN k ON e.lang IS NOT DISTINCT FROM k.lang AND e.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, symbols_pm, dup_lines_pm, word_len_pc,
  base_failed, NOT base_failed AND inside AS kept FROM f
"""

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
j AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, v DESC, h || p DESC) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1
"""



def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(read_table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM d, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS copy FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links, count(*) FILTER (copy) AS n_copies FROM l GROUP BY a)
SELECT c.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) + 1 AS n_copies FROM c LEFT JOIN k ON k.a = c.a
"""


def tokenizer_files() -> dict[str, str]:
    """Where the public vocabulary files are."""
    import public_tokenizers

    return {
        "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), **tokenizer_files())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


#: Items as question and answer, BM25 of every passage of two segments of the item's band, overlap of shingles where most words agree.
OP10_SQL = r"""
WITH i AS (
  SELECT item_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[\p{L}\p{N}_]')) AS lines,
    regexp_extract(text, '(?s)^(.*[.!?]\s+)(\S.*)$', 1) AS head, regexp_extract(text, '(?s)^(.*[.!?]\s+)(\S.*)$', 2) AS tail
  FROM benchmark WHERE text IS NOT NULL),
j AS (
  SELECT item_id, CASE WHEN len(lines) > 1 THEN array_to_string(lines[1:len(lines) - 1], chr(10)) WHEN two THEN head ELSE text END AS q,
    CASE WHEN len(lines) > 1 THEN lines[len(lines)] WHEN two THEN tail ELSE '' END AS a
  FROM (SELECT *, regexp_matches(head, '[\p{L}\p{N}_]') AND regexp_matches(tail, '[\p{L}\p{N}_]') AS two FROM i)),
v AS (
  SELECT row_number() OVER () AS n, item_id, regexp_extract_all(lower(q), '[\p{L}\p{N}_]+') AS q, regexp_extract_all(lower(a), '[\p{L}\p{N}_]+') AS a FROM j),
w AS (
  SELECT n, item_id, len(q) + len(a) AS size, CASE WHEN len(q) + len(a) < 5 THEN list_concat(q, a) ELSE q END AS q,
    CASE WHEN len(q) + len(a) < 5 THEN [] ELSE a END AS a FROM v),
items AS (SELECT *, CAST(greatest(16, pow(2, ceil(log2(size)))) AS BIGINT) AS seg FROM w WHERE size > 0),
parts AS (
  SELECT n, item_id, list_concat(q, a) AS words, size, seg, least(5, len(q)) AS wq, least(5, len(a)) AS wa,
    list_distinct(list_transform(range(1, len(q) - least(5, len(q)) + 2), lambda k: array_to_string(q[k:k + least(5, len(q)) - 1], ' '))) AS sq,
    CASE WHEN len(a) > 0 THEN list_distinct(list_transform(range(1, len(a) - least(5, len(a)) + 2), lambda k: array_to_string(a[k:k + least(5, len(a)) - 1], ' '))) ELSE [] END AS sa
  FROM items),
stats AS (SELECT count(*) AS n_items, avg(size) AS mean FROM items),
bands AS (SELECT DISTINCT seg FROM items),
tf AS (SELECT n, size, seg, t, count(*) AS f FROM (SELECT n, size, seg, unnest(words) AS t FROM parts) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
impact AS (
  SELECT n, seg, t, ln(1 + (n_items - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) AS s, count(*) OVER (PARTITION BY n) AS terms
  FROM tf JOIN df USING (t) CROSS JOIN stats),
docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
passages AS (
  SELECT d, doc_id, seg, k, words[k * seg + 1:(k + 2) * seg] AS words
  FROM docs CROSS JOIN bands, unnest(range(greatest(CAST(ceil(len(words) / seg) AS BIGINT) - 1, 1))) AS u(k) WHERE len(words) > 0),
terms AS (SELECT DISTINCT d, seg, k, unnest(words) AS t FROM passages),
scored AS (SELECT d, seg, k, n, sum(s) AS score FROM terms JOIN impact USING (t, seg) GROUP BY d, seg, k, n, terms HAVING 2 * count(*) >= terms),
held AS (
  SELECT d, doc_id, item_id, n, score, sq, sa,
    list_transform(range(1, len(p.words) - wq + 2), lambda k: array_to_string(p.words[k:k + wq - 1], ' ')) AS pq,
    list_transform(range(1, len(p.words) - wa + 2), lambda k: array_to_string(p.words[k:k + wa - 1], ' ')) AS pa
  FROM scored JOIN passages p USING (d, seg, k) JOIN parts USING (n)),
judged AS (
  SELECT d, doc_id, item_id, n, score, len(list_filter(sq, lambda x: list_contains(pq, x))) / len(sq) AS oq,
    CASE WHEN len(sa) = 0 THEN 1.0 ELSE len(list_filter(sa, lambda x: list_contains(pa, x))) / len(sa) END AS oa
  FROM held),
best AS (SELECT d, doc_id, item_id, n, max({'s': score, 'q': oq, 'a': oa}) AS m FROM judged WHERE oq >= 0.8 - 1e-9 AND oa >= 0.8 - 1e-9 GROUP BY d, doc_id, item_id, n)
SELECT doc_id, item_id, round(m.s, 6) AS score, round(m.q, 6) AS question_overlap, round(CAST(m.a AS DOUBLE), 6) AS answer_overlap FROM best
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_score": op2_lm_score,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extract": op5_html_extract,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_lm_score": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
}
