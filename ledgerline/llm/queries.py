"""One query per corpus operator, over whole tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    group_matrix_join,
    learned_ann,
    near_dedup,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    sharding,
    suffix_dedup,
    token_alignment,
    url_filter,
    warc,
)
from ledgerline.llm.stages import table

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [
    url_filter.Rule.parse("allow", "org/"), url_filter.Rule.parse("block", "example.org/es/"),
    url_filter.Rule.parse("block", "example.org/en/1"), url_filter.Rule.parse("allow", "com/fr/"),
    url_filter.Rule.parse("block", "com/de/"),
]
# hosts whose pages are listed as blocked URLs
LISTED_HOSTS = "casino|poker|lottery|(^|[.-])bets?([.-]|$)|adult|porn|xxx|pills|viagra"


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark, sf_dir):
    """Every page written to WARC, indexed, looked up in the index and read back."""
    pages = table(spark, sf_dir, "pages")
    index, captures = warc.archive_pages(spark, pages)
    return warc.fetch(spark, index, captures).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


@query
def op3_sharding(spark, sf_dir):
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_learned_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return learned_ann.search(rows, rows.where("vec_id % 20 = 0"), 20)


@query
def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    held = quality_classifier.held_out()
    return quality_classifier.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_packing(spark, sf_dir):
    out = packing.pack_documents(spark, table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.withColumn("length", F.col("length").cast("long"))


@query
def op8_url_filter(spark, sf_dir):
    """The list: canonical URLs of all pages on hosts that advertise what nobody trains on."""
    pages = table(spark, sf_dir, "pages")
    url = F.coalesce("url", F.lit(""))
    bad = pages.where(url_filter.url_host(url).rlike(LISTED_HOSTS))
    listed = bad.select(url_filter.canonical_url(url).alias("canonical"))
    return url_filter.judge_urls(spark, pages, listed, URL_RULES)


@query
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


@query
def op10_sentencepiece(spark, sf_dir):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), model)


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


@query
def op12_token_alignment(spark, sf_dir):
    with open(BYTE_BPE) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.align_documents(table(spark, sf_dir, "documents"), a.read(), b.read())


@query
def op13_group_matrix_join(spark, sf_dir):
    return group_matrix_join.similarity_join(table(spark, sf_dir, "documents"), 3, 90)


def _linked_sets_sql(percent: int) -> str:
    """doc_id, number of shingles and smallest document reached, for sets of three-word shingles."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y
      ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION
    SELECT r.doc_id, b FROM reach r JOIN both_ways ON a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


# CRC-32 of a decimal number: its characters, each followed by eight shifts
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

LLM_ORACLES: dict[str, str] = {
    "op13_group_matrix_join": _linked_sets_sql(90),
    "op11_prefix_trie": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM t),
c AS (SELECT conv_id, {_CRC32_SQL} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, id, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
    UNION ALL SELECT c.conv_id, pos, id, words FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r),
p AS (SELECT conv_id, d, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM s
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends FROM l GROUP BY prefix, d),
up AS (SELECT n.prefix, p.prefix AS above FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT above AS prefix, count(*) AS kids FROM up GROUP BY above),
sums AS (SELECT p.prefix, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves
    FROM n LEFT JOIN kids k ON k.prefix = n.prefix JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.prefix)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, leaves AS n_leaves,
    saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN sums USING (prefix) LEFT JOIN kids k USING (prefix) LEFT JOIN up USING (prefix) LEFT JOIN n a ON a.prefix = up.above""",
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y
      ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION
    SELECT r.doc_id, b FROM reach r JOIN both_ways ON a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
w AS (SELECT digest, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM p LEFT JOIN w USING (digest)""",
    "op8_url_filter": f"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(r, '^[^?#]*\\?([^#]*)', 1) AS query FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':(80|443)$', '') AS h,
    regexp_replace(path, '/+$', '') AS p,
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))), '&') AS q FROM b),
d AS (SELECT *, CASE WHEN h = '' THEN '' ELSE h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM d WHERE canonical <> '' AND regexp_matches(host, '{LISTED_HOSTS}')),
e AS (SELECT d.*, canonical IN (SELECT canonical FROM l) AS listed, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed
FROM e""",
}
