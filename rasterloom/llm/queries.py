"""The corpus queries and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import alignment, ann, bpe, decontam, hard_negatives, html_text, near_dup, pii, quality, secret_scan, token_counts, toxicity, url_filter
from rasterloom.llm.common import fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, w[i : i + 12] AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
places AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
n_hit AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def predictions(scored: DataFrame, score: str, modulus: int, held: int) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learnt())
    return predictions(quality.score(docs, model), "quality_score", 3, 1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnt())
    return predictions(toxicity.score(docs, model), "toxicity", 5, 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and how many values of each kind were replaced in it.

    The key is the session's; where it has none, one is drawn for this run, and pseudonyms of other runs don't match.
    """
    key = spark.conf.get(pii.KEY_SETTING, None) or secrets.token_hex(16)
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), key=key)
    counts = [F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "text", *counts)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only labelled outcomes in the tables are those of labels, taken for the page of the same id."""
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id, max(CAST(quality > 0 AS INTEGER)) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, CAST(count(o.good) AS DOUBLE) AS n, CAST(coalesce(sum(o.good), 0) AS DOUBLE) AS good FROM p LEFT JOIN o ON o.doc_id = p.page_id GROUP BY host),
named AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM h),
parts AS (SELECT host, n, good, array_to_string(labels[-2:], '.') AS two, array_to_string(labels[-3:], '.') AS three, array_to_string(labels[-1:], '.') AS one FROM named),
hosts AS (SELECT host, n, good, CASE WHEN two IN TWO_LABELS THEN three ELSE two END AS domain, CASE WHEN two IN TWO_LABELS THEN two ELSE one END AS suffix FROM parts),
every AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
bd AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
bs AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM bd, every GROUP BY suffix),
ks AS (SELECT STRENGTH AS k FROM bs WHERE n > 0),
s AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM bs, ks),
d0 AS (SELECT bd.*, s.m FROM bd JOIN s USING (suffix)),
kd AS (SELECT STRENGTH AS k FROM d0 WHERE n > 0),
d AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d0, kd),
h0 AS (SELECT hosts.*, d.m FROM hosts JOIN d USING (domain)),
kh AS (SELECT STRENGTH AS k FROM h0 WHERE n > 0),
ab AS (SELECT host, k * m + good AS a, k * (1 - m) + n - good AS b FROM h0, kh),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS low FROM ab),
f AS (SELECT p.*, low, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low >= 0.5 THEN 'allow' ELSE 'block' END AS verdict FROM f
""".replace("TWO_LABELS", str(url_filter.TWO_LABELS)).replace(
    "STRENGTH",
    """1 / least(greatest(coalesce((sum(n * pow(good / n - m, 2)) - (count(*) - 1) * (sum(n * m * (1 - m)) / sum(n)))
    / nullif((sum(n) - sum(n * n) / nullif(sum(n), 0) - (count(*) - 1)) * (sum(n * m * (1 - m)) / sum(n)), 0), 0), 1.0 / 1001), 1.0 / 2) - 1""",
)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the masked text, how many candidates it had and how many of them are secrets."""
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "text", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT reach.a, sides.y FROM reach JOIN sides ON sides.x = reach.z),
least AS (SELECT a AS doc_id, min(z) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = alignment.align(table(spark, sf_dir, "documents"), groups="digest")
    return documents.withColumnRenamed("groups", "groups_sha256")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(own.select("vec_id", "embedding", moved.alias("label")))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS positive, list_reduce(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE positive QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.positive AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality": op2_quality,
        "op4_pii": op4_pii,
        "op5_toxicity": op5_toxicity,
        "op6_url_filter": op6_url_filter,
        "op7_secret_scan": op7_secret_scan,
        "op8_near_duplicates": op8_near_duplicates,
        "op3_token_counts": op3_token_counts,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_token_alignment": op11_token_alignment,
        "op12_html_text": op12_html_text,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL.strip(), "op6_url_filter": OP6_SQL.strip(), "op8_near_duplicates": OP8_SQL.strip(), "op10_nearest_neighbours": OP10_SQL.strip(), "op13_hard_negatives": OP13_SQL.strip()}
