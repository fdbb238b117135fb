"""The numbered queries of the training-data operators and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, html_extraction, language_id, maxscore, mixing, ngram_join, packing, permutation_index, prefix_trie, quality, sharding, url_filter

# fixed values: the site rules of op6
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file: in $TOKENIZER_DIR if that is set, else where the installed package has it."""
    if at := os.environ.get("TOKENIZER_DIR"):
        return f"{at}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: str, of: int):
    """crc32 of the key as text, modulo `of`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out)
    known = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", "quality")
    return quality.classify(docs, known, keep=("held_out",))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 5) == 0).alias("held_out"))
    return language_id.identify(docs, docs.where("not held_out"), keep=("held_out",))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), rules=RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), weights=[1.0] * 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns), turns.select("conv_id").distinct())


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, sha256(t) AS text_sha256, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS r,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM n
"""


def term_sql(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def url_sql() -> str:
    """Rules from the longest on; then one strict term or two distinct soft ones."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in rules)
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in rules)
    strict = " OR ".join(map(term_sql, url_filter.STRICT_TERMS))
    soft = " + ".join(f"CAST({term_sql(t)} AS INT)" for t in url_filter.SOFT_TERMS)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS u, {lower.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {strict} OR {soft} >= 2 THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(z) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p) WHERE rank <= 5
"""
#: CRC-32 of a decimal number, bit by bit
CRC = "xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)), lambda a, x: list_reduce(range(8), lambda b, i: xor(b // 2, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)), 4294967295), 4294967295)"
OP12_SQL = f"""
WITH s AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i FROM s),
n AS (SELECT c, c - c % 100 AS b, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM s)),
z AS (SELECT c, count(*) AS turns FROM o GROUP BY c),
m AS (SELECT n.c, n.b, n.h, least(n.h, coalesce(z.turns, 0)) AS t FROM n LEFT JOIN z ON z.c = n.b),
r AS (SELECT m.c, i AS d, role, text FROM m JOIN o ON o.c = m.b WHERE i <= t UNION ALL SELECT m.c, i - h + t, role, text FROM m JOIN o ON o.c = m.c WHERE i > h),
p AS (SELECT c, d, length(text) AS chars, list(role || chr(0) || text) OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM n),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
u AS (SELECT path, any_value(d) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM p GROUP BY path),
e AS (SELECT path, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN l ON p.c = l.c AND p.d = l.d GROUP BY path),
k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM u LEFT JOIN k ON k.path = u.path),
a AS (SELECT above, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT n_children, saved, unnest(list_transform(range(depth + 1), lambda i: path[:i])) AS above FROM w) GROUP BY above)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN a ON a.above = w.path LEFT JOIN e ON e.path = w.path LEFT JOIN u q ON w.depth > 0 AND q.path = w.path[:-2]
"""
OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM f),
q AS (SELECT DISTINCT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM f GROUP BY lang, term)),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(o.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""


NUMBERED = (op1_quality, op2_language_id, op3_mixing, op4_exact_dedup, op5_permutation_index, op6_url_filter, op7_packing, op8_html_extraction, op9_sharding, op10_ngram_join, op11_maxscore, op12_prefix_trie, op13_divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in NUMBERED} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_url_filter": url_sql(), "op10_ngram_join": OP10_SQL, "op11_maxscore": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_divergence": OP13_SQL}
