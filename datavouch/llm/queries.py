"""The queries of this subpackage, on whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from datavouch.llm import audit, bpe, collocations, decontaminate, exactdedup, fingerprint, html, licences, quality, simhash, substrings, urls, warc
from datavouch.llm.common import table

# The URL rules (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
# End of the fixed values.


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_copies(table(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (op1_license_scan, op2_simhash, op3_byte_bpe, op4_url_filter, op5_html_text, op6_substring_dedup, op7_decontamination, op8_warc, op9_quality, op10_fingerprint)
    return {f.__name__: f for f in (*every, op11_filter_audit, op12_collocations, op13_exact_dedup)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licence_sql() -> str:
    kinds, grams = licences.postings()
    names = ", ".join(f"({t}, {_quoted(name)}, {b}, {least})" for t, name, b, least, _ in kinds)
    index = ", ".join(f"({_quoted(g)}, {t})" for g, t, _ in grams)
    other = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH kinds(tid, licence, size, least) AS (VALUES {names}), postings(gram, tid) AS (VALUES {index}),
docs AS (SELECT row_number() OVER () AS d, doc_id, string_split(trim(regexp_replace({_LOWER.format("text")}, '{other}', ' ', 'g'), ' '), ' ') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
pairs AS (SELECT d, doc_id, unnest(range(len(w) - 1)) AS p, w FROM docs WHERE len(w) > 1),
hits AS (SELECT d, doc_id, tid, p, gram, count(*) OVER (PARTITION BY d, tid) AS hits FROM (SELECT d, doc_id, p, w[p + 1] || ' ' || w[p + 2] AS gram FROM pairs) JOIN postings USING (gram)),
likely AS (SELECT * FROM hits JOIN kinds USING (tid) WHERE hits >= least),
seen AS (SELECT *, lag(p) OVER (PARTITION BY d, tid, gram ORDER BY p) AS prev FROM likely),
spans AS (SELECT a.d, a.doc_id, a.tid, a.licence, a.size, a.p AS start, b.p AS stop, count(*) OVER o AS hits, sum((b.prev IS NULL OR b.prev < a.p)::INT) OVER o AS s
  FROM seen a JOIN seen b ON a.d = b.d AND a.tid = b.tid AND b.p >= a.p WINDOW o AS (PARTITION BY a.d, a.tid, a.p ORDER BY b.p ROWS UNBOUNDED PRECEDING)),
places AS (SELECT d, doc_id, licence, size, s, start, stop, s + stop - start + 1 - hits AS a FROM spans
  QUALIFY row_number() OVER (PARTITION BY d, tid ORDER BY 1200 * s - 800 * (stop - start + 1 - hits) DESC, stop, start) = 1),
matches AS (SELECT *, 2.0::DOUBLE * s / (a + size) AS dice FROM places WHERE 2000 * s >= 800 * (a + size)),
kept AS (SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.d = m.d AND o.licence <> m.licence AND o.start <= m.stop AND m.start <= o.stop AND (o.dice > m.dice OR o.dice = m.dice AND (o.size > m.size OR o.size = m.size AND o.licence < m.licence))))
SELECT doc_id, licence, dice, start::BIGINT AS first_word, (stop - start + 2)::BIGINT AS n_words FROM kept
QUALIFY row_number() OVER (PARTITION BY d, licence ORDER BY dice DESC, size DESC, start, stop DESC) = 1"""


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in RULES)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
rest AS (SELECT page_id, row_number() OVER () AS row_no, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, row_no, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC, rule_host || rule_path DESC) = 1"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f"""

_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(words[start : start + 19], ' ') AS win FROM w),
r AS (SELECT doc_id, start FROM h QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1),
s AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM r),
g AS (SELECT doc_id, list(pos) AS gone FROM s GROUP BY doc_id),
k AS (SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k"""


_CUT = f"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_BENCHMARK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, coalesce({_CUT}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_CUT} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT d, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win FROM (SELECT d, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT d, n, s, item_id FROM dw JOIN win USING (n, win)),
pos AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT d, n, s FROM hit)) GROUP BY d),
own AS (SELECT d, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT d, item_id FROM hit) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (d) LEFT JOIN own USING (d)"""


_AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT w.doc_id, part, concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS failed FROM w),
cells AS (SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
seen AS (SELECT part, filter_order, step, failed, good, toxic, n, substr(filter_order, step, 1) AS own,
    contains(failed, substr(filter_order, step, 1)) AS here, failed <> '' AND regexp_matches(failed, '[' || substr(filter_order, 1, step - 1) || '_]') AS gone FROM cells, steps),
done AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
    coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0) AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM done"""

_PHRASES_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, w[i : i + m - 1] AS words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 10),
cut AS (SELECT c.lang, c.m, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.f * c.f) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[1 : k], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[k + 1 : c.m], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.m > x.m AND x.phrase IN (array_to_string(y.words[1:2], ' '), array_to_string(y.words[2:3], ' ')) AND 100 * y.f >= 50 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

_COPIES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_no = first_value(row_no) OVER o AS kept, sha AS text_sha256
FROM d WINDOW o AS (PARTITION BY sha ORDER BY n_chars DESC, doc_id NULLS LAST, row_no)"""


def oracle_sql() -> dict[str, str]:
    found = {"op11_filter_audit": _AUDIT_SQL, "op12_collocations": _PHRASES_SQL, "op13_exact_dedup": _COPIES_SQL}
    return found | {"op1_license_scan": _licence_sql(), "op4_url_filter": _url_sql(), "op6_substring_dedup": _REPEATS_SQL, "op7_decontamination": _BENCHMARK_SQL, "op8_warc": _WARC_SQL}
