"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import table


def _public_tokenizers():
    return importlib.import_module("public_tokenizers")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rotation_codes import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE proper AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM proper a JOIN proper b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.low < e.b
), degree AS (
  SELECT a, count(*) AS n FROM both_ways GROUP BY 1
)
SELECT r.node AS vec_id, coalesce(max(d.n), 0) AS n_links, min(r.low) AS component_id, min(r.low) = r.node AS kept
FROM reach r LEFT JOIN degree d ON d.a = r.node GROUP BY r.node
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import new_folder, read_shards, write_shards

    path = new_folder(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, _public_tokenizers().path("byte_bpe_50k.json"))
    return read_shards(spark, path)


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels whose remainder is not 1, so that the others measure it."""
    from .site_quality import site_quality
    from .toxicity import remainder

    judged = site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder("doc_id") != 1)
    return judged.withColumn("held_out", remainder("doc_id") == 1)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import decode, encode

    ranks, pattern = _public_tokenizers().path("byte_bpe_50k.tiktoken"), _public_tokenizers().PATTERN
    done = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


#: (verdict, host, path): fixed by the query's contract.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS place FROM parts
), named AS (
  SELECT page_id, translate(regexp_extract(place, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(place, '/') THEN substr(place, strpos(place, '/')) ELSE '' END AS path
  FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT n.page_id, n.host, n.path, r_host || r_path AS rule, r_verdict AS verdict,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules ON ('.' || n.host) LIKE ('%.' || r_host) AND starts_with(n.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.low < e.b
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.low) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""

def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c, digest, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY c ORDER BY turn ASC NULLS FIRST, digest) AS pos FROM given
), lengths AS (
  SELECT c, max(pos) AS n FROM turns GROUP BY c
), plans AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda v, b: list_reduce(list_prepend(xor(v, b), CAST([8, 7, 6, 5, 4, 3, 2, 1] AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM lengths
), rebuilt AS (
  SELECT p.c, t.pos AS depth, t.digest, t.bytes FROM plans p JOIN turns t ON t.c = p.base AND t.pos <= p.h
  UNION ALL
  SELECT p.c, least(p.h, coalesce(l.n, 0)) + t.pos - p.h, t.digest, t.bytes
  FROM plans p JOIN turns t ON t.c = p.c AND t.pos > p.h LEFT JOIN lengths l ON l.c = p.base
), named AS (
  SELECT c, depth, bytes, depth || md5(string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM rebuilt
), paths AS (
  SELECT c, depth, bytes, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), 'root') AS up FROM named
  UNION ALL
  SELECT c, 0, 0, 'root', NULL FROM lengths
), ends AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, depth) AS node FROM paths GROUP BY c) GROUP BY node
), nodes AS (
  SELECT node, min(depth) AS depth, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM paths GROUP BY node
), children AS (
  SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT p.node, sum((n.n_convs - 1) * n.bytes) AS saved, sum(CASE WHEN k.up IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth LEFT JOIN children k ON k.up = n.node GROUP BY p.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.up LEFT JOIN children k ON k.up = n.node LEFT JOIN ends e ON e.node = n.node
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), lengths AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), items AS (
  SELECT item_id, term, count(*) AS k
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM postings, corpus GROUP BY term, docs
), impacts AS (
  SELECT p.r, p.term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact
  FROM postings p JOIN lengths l ON l.r = p.r JOIN weights w ON w.term = p.term CROSS JOIN corpus
), scores AS (
  SELECT item_id, r, CAST(sum(k * impact) AS BIGINT) AS score FROM impacts JOIN items USING (term) GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scores JOIN lengths USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_rotation_codes": op2_rotation_codes,
    "op3_toxicity": op3_toxicity,
    "op4_token_shards": op4_token_shards,
    "op5_site_quality": op5_site_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_text": op7_html_text,
    "op8_url_rules": op8_url_rules,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_rotation_codes": OP2_SQL, "op8_url_rules": OP8_SQL, "op9_ngram_join": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_ranked_search": OP13_SQL}
