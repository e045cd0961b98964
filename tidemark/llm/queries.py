"""The registered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    collision_ann, context_tree, curriculum, hard_negatives, html_density, license_scan, minimax_shards, phrase_index, simhash_gph, spelling_variants, token_files,
    toxic_neighbours, trusted_ratio,
)
from tidemark.llm.rows import table, tuned
from tidemark.llm.stages import TOKENIZER
from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tuned(configure(spark)), sf_dir)
    return fn


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.license_digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op2_token_files(spark, sf_dir):
    return token_files.token_digest(table(spark, sf_dir, "documents"), token_files.Settings(TOKENIZER))


@query
def op4_curriculum_mix(spark, sf_dir):
    return curriculum.mix_digest(table(spark, sf_dir, "documents"))


SQL["op4_curriculum_mix"] = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
u AS (SELECT doc_id, source, size, count(*) AS copies, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM r GROUP BY doc_id, source, size),
s AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size FROM u GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
l AS (SELECT *, source_size * 3.0::DOUBLE AS lim FROM w),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        sum(lim) OVER fill - lim AS before, sum(weight) OVER () - sum(weight) OVER fill + weight AS remaining
      FROM l WINDOW fill AS (ORDER BY lim / weight, source COLLATE "C" NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, (total - before) / remaining AS level FROM f),
x AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= lim THEN 0 ELSE 1 END, lim / weight, source COLLATE "C" NULLS LAST) AS final FROM v),
t AS (SELECT source, source_size, least(final * weight, lim) AS target FROM x),
c AS (SELECT u.*, t.source_size, t.target,
        CAST(sum(size * copies) OVER (PARTITION BY u.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size * copies AS start
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 AND target > start THEN ceil((target - start) / source_size) ELSE 0 END AS BIGINT) * size AS taken
FROM c, generate_series(1, copies)"""


@query
def op8_minimax_shards(spark, sf_dir):
    return minimax_shards.shard_digest(table(spark, sf_dir, "documents"))


@query
def op6_simhash_gph(spark, sf_dir):
    return simhash_gph.simhash_digest(table(spark, sf_dir, "documents"))


@query
def op10_phrase_index(spark, sf_dir):
    return phrase_index.passage_digest(phrase_index.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL["op10_phrase_index"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, runs.n FROM runs JOIN win USING (phrase, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id"""


@query
def op7_toxic_neighbours(spark, sf_dir):
    return toxic_neighbours.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_html_density(spark, sf_dir):
    return html_density.extract_text(table(spark, sf_dir, "pages"))


@query
def op5_context_tree(spark, sf_dir):
    return context_tree.language_scores(table(spark, sf_dir, "documents"))


@query
def op9_collision_ann(spark, sf_dir):
    return collision_ann.search(table(spark, sf_dir, "embeddings"))


@query
def op11_rotated_negatives(spark, sf_dir):
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=hard_negatives.shifted_label())


SQL["op11_rotated_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query
def op12_trusted_ratio(spark, sf_dir):
    return trusted_ratio.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"), misspell=199)
