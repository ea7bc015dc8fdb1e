"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, digests, extraction, middles, mixing, nearest, repeats, search, sharding, simhash, token_files, toxicity
from .common import documents, tokenizer_path


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(documents(spark, sf_dir), "doc_id", "text", shards=40)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(documents(spark, sf_dir))


def op4_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.neighbours(documents(spark, sf_dir))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = search.more_like_search(docs, docs.where("doc_id % 20 = 0"))
    return found.withColumn("score", F.round("score", 6))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.fair_mix(documents(spark, sf_dir), columns=["doc_id"])
    return mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def op11_streamed_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.digests(documents(spark, sf_dir))


def op12_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (op1_rendezvous_sharding, op2_token_files, op3_suffix_repeats, op4_quartile_digests, op5_kneser_ney_toxicity, op6_host_paths, op7_simhash_components, op8_prefix_bpe, op9_block_max_wand, op10_fair_mix, op11_streamed_middles, op12_filter_orders, op13_learned_partitions)}

SQL: dict[str, str] = {
    "op9_block_max_wand": """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
each AS (SELECT doc_id, unnest(ws) AS term FROM docs),
tfs AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM each GROUP BY ALL),
lens AS (SELECT doc_id, len(ws)::DOUBLE AS dl FROM docs),
n AS (SELECT count(*)::DOUBLE AS docs, sum(dl) / count(*) AS mean FROM lens),
idf AS (SELECT term, ln(1.0 + ((SELECT docs FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM tfs GROUP BY term),
asked AS (SELECT doc_id AS query_id, term, w FROM tfs JOIN idf USING (term) WHERE doc_id % 20 = 0),
scored AS (
  SELECT query_id, t.doc_id, sum(w * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM n))) ORDER BY asked.term) AS score
  FROM asked JOIN tfs t USING (term) JOIN lens USING (doc_id) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score
FROM scored QUALIFY rank <= 10
""",
    "op10_fair_mix": """
WITH docs AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src, md5(doc_id::VARCHAR) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sized AS (SELECT src, sum(size)::BIGINT AS source_size FROM docs GROUP BY src),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS budget
  FROM sized),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE cap / w >= level),
goal AS (
  SELECT src, source_size, budget, CASE WHEN (SELECT level FROM final) IS NULL THEN cap ELSE least(cap, (SELECT level FROM final) * w) END AS target
  FROM levels),
placed AS (
  SELECT d.*, source_size, budget, target,
         sum(size) OVER (PARTITION BY d.src ORDER BY ('0x' || substr(h, 1, 3))::INT % 1024, h, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM docs d JOIN goal USING (src)),
turns AS (
  SELECT doc_id, src, h, size, e, upto, budget, (source_size * e + upto) / target AS vt
  FROM placed, (VALUES (0), (1), (2)) AS t(e) WHERE target > 0 AND size > 0),
spent AS (SELECT *, sum(size) OVER (ORDER BY vt, src, h, doc_id::VARCHAR, e, upto ROWS UNBOUNDED PRECEDING) AS spent FROM turns),
served AS (SELECT doc_id, count(*) AS epochs FROM spent WHERE spent <= budget + 1e-6 GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (size * coalesce(epochs, 0))::BIGINT AS taken
FROM placed LEFT JOIN served USING (doc_id)
""",
    "op11_streamed_middles": """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
draws AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
pieces AS (
  SELECT *, least(a, b) AS low, greatest(a, b) - least(a, b) AS mid, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
         substr(t, greatest(a, b) + 1) AS s
  FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN mid END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
""",
    "op12_filter_orders": """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
  FROM docs LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (
  SELECT part, good, toxic, f, filter_order, step, f[ascii(substr(filter_order, step, 1)) - 64] AS failing,
         coalesce(list_min(list_transform(list_filter([1, 2, 3, 4, 5], lambda k: f[ascii(substr(filter_order, k, 1)) - 64]), lambda k: k)), 6) AS first,
         len(list_filter(f, lambda x: x)) AS failures
  FROM flags, orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
sums AS (
  SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (failing AND first < step) AS redundant,
         count(*) FILTER (failing AND failures = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM sums
""",
}
