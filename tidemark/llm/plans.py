"""The operators' registered queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, htmltext, language, licenses, neardup, negatives, pii, quality, quotes, trie, urlfilter, vectors
from tidemark.llm.common import table
from tidemark.llm.stages import NEAR, RANKS, WINDOW


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat turns have no quotes of their own, so they are sent as quoting mails first."""
    return quotes.link(quotes.quoted_replies(table(spark, sf_dir, "conversations")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, digest=True)


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def near_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op6_decontaminate``, whose columns its SQL fixes, with the items met nearly in further columns."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW, NEAR)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near_items"),
                        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"), (F.size("near_items") > 0).alias("near"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets the next label first."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.select("vec_id", "embedding", label.alias("label")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quotes, op2_bpe, op3_urlfilter, op4_htmltext, op5_licenses, op6_decontaminate, near_decontaminate, op7_quality, op8_neardup, op9_language, op10_vectors, op11_trie, op12_negatives, op13_pii)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_urlfilter": r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
b AS (SELECT page_id, translate(CASE WHEN strpos(r, '/') > 0 THEN substr(r, 1, strpos(r, '/') - 1) ELSE r END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM a),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT b.page_id, b.host, b.path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
 FROM b LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_full_match(host || path, '(?s)ads\..*|[^/]*\.ads\..*|adserver\..*|track\..*|.*/wp-login[^/]*|.*/login|.*/login/.*|.*/cart/.*|.*/checkout/.*|.*\.exe|.*\.zip') THEN 'block' ELSE 'allow' END) AS verdict FROM f""",
    "op6_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, i, dp.k, item_id FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[i:i + dp.k - 1], ' ') = g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_neardup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY 1, 2) x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc, min(c) AS c FROM r GROUP BY 1) m ON m.doc = d.doc_id""",
    "op10_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r(vec, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec, l.b FROM r JOIN l ON l.a = r.c)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, m.c = v.vec_id AS kept FROM v JOIN (SELECT vec, min(c) AS c FROM r GROUP BY 1) m ON m.vec = v.vec_id""",
    # crc32 is folded bit by bit; the places in the tour follow from the order of the prefixes' members
    "op11_trie": r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS i,
 md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.i AS p, m, words FROM c JOIN t ON t.conv_id = base AND t.i <= h UNION ALL SELECT c.conv_id, 1000000000 + t.i, m, words FROM c JOIN t USING (conv_id) WHERE t.i > h),
s AS (SELECT conv_id, list(m ORDER BY p) AS ms, list(words ORDER BY p) AS ws FROM r GROUP BY 1),
f AS (SELECT conv_id, coalesce(ms, []) AS ms, ws FROM c LEFT JOIN s USING (conv_id)),
e AS (SELECT conv_id, ms, ws, unnest(range(0, len(ms) + 1)) AS depth FROM f),
g AS (SELECT conv_id, depth, array_to_string(ms[1:depth], '') AS k, array_to_string(ms[1:depth - 1], '') AS up, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words, depth = len(ms) AS ends FROM e),
n AS (SELECT k, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM g GROUP BY k, depth),
ch AS (SELECT up AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
d AS (SELECT a.k, unnest(range(0, a.depth + 1)) AS l, n_children, own FROM a),
u AS (SELECT substr(k, 1, 32 * l) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved_tokens, count(*) AS size FROM d GROUP BY 1),
w AS (SELECT a.*, n_leaves, saved_tokens, size FROM a JOIN u USING (k)),
o AS (SELECT w.k, w.up, w.depth, coalesce(sum(2 * size) OVER (PARTITION BY w.up, w.depth ORDER BY w.conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, size FROM w),
pos(k, enter_at, size) AS (SELECT k, CAST(0 AS HUGEINT), size FROM o WHERE depth = 0 UNION ALL SELECT o.k, pos.enter_at + 1 + o.off, o.size FROM o JOIN pos ON o.up = pos.k AND o.depth > 0)
SELECT w.conv_id, w.depth, pa.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256,
 CAST(pos.enter_at AS BIGINT) AS enter_at, CAST(pos.enter_at + 2 * pos.size - 1 AS BIGINT) AS exit_at
FROM w JOIN pos USING (k) LEFT JOIN w pa ON w.depth > 0 AND pa.k = w.up AND pa.depth = w.depth - 1""",
    "op12_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
}
