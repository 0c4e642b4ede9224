"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolens.llm import context_tree, decontaminate, fill_middle, fingerprint, html_text, line_dedup, near_dedup, packing, prefix_trie, quality, token_files, toxicity, warc
from convolens.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of the whole pages table."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of the whole documents table."""
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the whole documents table and of its edited texts."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of the whole documents table."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, host and path posteriors of the whole documents table."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the whole documents table."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of a crawl made of the whole pages table, resolved."""
    return warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table as token-id files, reported from the files read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in the whole documents table."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hits", "items")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole documents table."""
    return near_dedup.find_groups(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole documents table."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with a middle moved to the end."""
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the whole conversations table."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_context_tree_scores, op3_fingerprints, op4_line_dedup, op5_best_fit_packing, op6_quality_classifier, op7_warc_revisits, op8_token_files, op9_decontamination, op10_minhash_near_dedup, op11_toxicity, op12_fill_in_middle, op13_prefix_trie, pipeline)}

ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k),
flagged AS (SELECT l.*, coalesce(l.doc_id > f.first_doc, false) AS gone FROM lines l LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
    "op9_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS width, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words CROSS JOIN (SELECT DISTINCT width FROM item_windows) WHERE len(w) >= width)),
found AS (SELECT d.doc_id, d.width, d.i, b.item_id FROM doc_windows d JOIN item_windows b ON d.width = b.width AND d.g = b.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN owned USING (doc_id)
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM word_lists WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM shingles GROUP BY doc_id),
classes AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k),
own AS (SELECT rep, g FROM shingles JOIN classes ON rep = doc_id),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT rep AS node, rep AS least FROM classes UNION SELECT e.b, r.least FROM reached r JOIN edges e ON e.a = r.node WHERE r.least < e.b),
components AS (SELECT node, min(least) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN classes t ON t.k = s.k LEFT JOIN components c ON c.node = t.rep
""",
    "op7_warc_revisits": r"""
WITH base AS (
  SELECT page_id AS n, url, '"' || md5(coalesce(html, '')) || '"' AS etag, 'day ' || (page_id % 365) AS modified, CAST(length(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
raw AS (
  SELECT n * 2 AS record_id, true AS full_response, url, n * 10 AS time, etag, modified, size, NULL AS day FROM base
  UNION ALL
  SELECT n * 2 + 1, false,
    CASE n % 4 WHEN 0 THEN regexp_replace(url, '^https?://', 'HTTP://WWW.') WHEN 1 THEN url || '#part' WHEN 2 THEN regexp_replace(url, '^https?://([^/?#]*)', 'https://\1:443') ELSE url END,
    n * 10 + CASE WHEN n % 3 = 0 THEN -5 ELSE 1005 END,
    CASE n % 5 WHEN 0 THEN etag WHEN 1 THEN 'W/' || etag WHEN 2 THEN '"stale"' END,
    CASE WHEN n % 5 = 3 THEN modified END, NULL, CASE WHEN n % 5 = 4 THEN modified END FROM base),
bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS b FROM raw),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM bare),
rec AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM parts),
best AS (
  SELECT v.record_id, max_by(r.record_id, r.time * 1000000000 + r.record_id) AS rid
  FROM rec v JOIN rec r ON v.canonical_url = r.canonical_url AND r.full_response AND NOT v.full_response AND r.time < v.time GROUP BY v.record_id),
judged AS (
  SELECT v.record_id, v.url, v.canonical_url, v.time, r.record_id AS rid, v.etag AS ve, v.day, r.etag AS re, r.modified AS rm, r.size,
    CASE WHEN r.record_id IS NULL THEN 'missing'
      WHEN v.etag IS NOT NULL THEN CASE WHEN regexp_replace(v.etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = r.modified THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unverified' END AS status
  FROM rec v LEFT JOIN best USING (record_id) LEFT JOIN rec r ON r.record_id = best.rid WHERE NOT v.full_response)
SELECT record_id, url, canonical_url, time, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN rid END AS response_id,
  CASE WHEN status IN ('resolved', 'unverified') THEN
    'age: 0' || chr(10) || 'cache-control: max-age=120' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
    || CASE WHEN day IS NULL THEN '' ELSE 'date: ' || day || chr(10) END || 'etag: ' || coalesce(ve, re) || chr(10) || 'last-modified: ' || rm END AS headers
FROM judged
""",
    "op12_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS s FROM documents),
drawn AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CAST(concat('0x', s[1:8]) AS BIGINT) AS h1, CAST(concat('0x', s[9:16]) AS BIGINT) AS h2,
    CAST(concat('0x', s[17:24]) AS BIGINT) AS h3, CAST(concat('0x', s[25:32]) AS BIGINT) AS h4 FROM cut),
parts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
texts AS (SELECT doc_id, n, form, text, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM texts
""",
    "op13_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, k) AS l FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, l, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda acc, byte: list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(acc, byte)), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN c.h = 0 OR g.l IS NULL THEN [] ELSE g.l[1:c.h] END, c.l[c.h + 1:]) AS s FROM heads c LEFT JOIN own g ON g.conv_id = c.conv_id - c.conv_id % 5),
paths AS (SELECT conv_id, len(s) AS n, list_transform(s, lambda x: x.k) AS ks, list_transform(s, lambda x: x.b) AS bs FROM rebuilt),
prefixes AS (SELECT conv_id, n, d, ks[1:d] AS p, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM paths)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.p),
below AS (
  SELECT p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM full_nodes v JOIN below w ON w.p = v.p LEFT JOIN full_nodes u ON v.d > 0 AND u.p = v.p[1:v.d - 1]
""",
}
