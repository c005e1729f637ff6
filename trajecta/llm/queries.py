"""The queries of this subpackage over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import bpe, decontaminate, language, media, negatives, pieces, projection, quality, records, runs, simhash, substrings, toxicity
from trajecta.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces_of(spark, sf_dir)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of(spark, sf_dir)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents"))


#: Words are what stays between ASCII white space; a window is 50 of them as one string.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(len(words) - 49)) AS s FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(words[s + 1 : s + 50], ' ')) AS h FROM w),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS positions FROM (SELECT h.doc_id, h.s FROM h JOIN f USING (h) WHERE h.doc_id > f.first) GROUP BY doc_id),
k AS (SELECT d.doc_id, words, coalesce(positions, []) AS positions FROM d LEFT JOIN gone USING (doc_id)),
m AS (SELECT doc_id, unnest(range(len(words))) AS p, unnest(words) AS word FROM k),
g AS (SELECT doc_id, unnest(positions) AS p FROM k),
t AS (SELECT m.doc_id, string_agg(word, ' ' ORDER BY m.p) AS kept, count(*) AS n FROM m ANTI JOIN g ON m.doc_id = g.doc_id AND m.p = g.p GROUP BY m.doc_id)
SELECT k.doc_id, len(words)::BIGINT AS n_words, len(positions)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN t USING (doc_id)
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(spark, sf_dir)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, sf_dir)


#: All item-sized windows that begin or end at a shared shingle, by plain text.
OP10_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM dw),
ds AS (SELECT * FROM (SELECT doc_id, p, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v || ' ' || lead(x, 3) OVER v || ' ' || lead(x, 4) OVER v AS h FROM dp WINDOW v AS (PARTITION BY doc_id ORDER BY p)) WHERE h IS NOT NULL),
items AS (SELECT min(item_id) AS item_id, w, len(w) - 4 AS n FROM iw WHERE len(w) >= 5 GROUP BY w),
sh AS (SELECT item_id, n, unnest(list_transform(range(n), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS h FROM items),
ic AS (SELECT item_id, n, h, count(*) AS c FROM sh GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, p, h FROM ds JOIN (SELECT DISTINCT item_id, n, h FROM ic) USING (h)),
enough AS (SELECT doc_id, item_id FROM hits GROUP BY ALL HAVING count(*) >= ceil(1.6 / 1.8 * any_value(n) - 1e-9)),
starts AS (SELECT DISTINCT doc_id, item_id, n, unnest([p, p - n + 1]) AS s FROM hits SEMI JOIN enough USING (doc_id, item_id)),
sizes AS (SELECT doc_id, len(w) - 4 AS size FROM dw),
ok AS (SELECT starts.* FROM starts JOIN sizes USING (doc_id) WHERE s >= 0 AND s + n <= size),
wc AS (SELECT ok.doc_id, ok.item_id, ok.n, ok.s, x.h, count(*) AS c FROM ok JOIN hits x ON x.doc_id = ok.doc_id AND x.item_id = ok.item_id AND x.p >= ok.s AND x.p < ok.s + ok.n GROUP BY ALL),
o AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.s, sum(least(wc.c, ic.c)) AS shared FROM wc JOIN ic ON ic.item_id = wc.item_id AND ic.h = wc.h GROUP BY ALL),
r AS (SELECT doc_id, item_id, s, shared / (2 * n - shared) AS similarity FROM o WHERE shared / (2 * n - shared) >= 0.8 - 1e-9),
b AS (SELECT doc_id, item_id, s, similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS rn FROM r)
SELECT doc_id, item_id, s::INTEGER AS start, round(similarity::DOUBLE, 6) AS similarity FROM b WHERE rn = 1
UNION ALL SELECT doc_id, i.item_id, 0, 1.0::DOUBLE FROM dw JOIN (SELECT w, min(item_id) AS item_id FROM iw WHERE len(w) BETWEEN 1 AND 4 GROUP BY w) i USING (w)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_digest(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"), runs.planted)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_token_counts, op4_language_id, op5_token_records, op6_media_columns, op7_substring_dedup, op8_simhash_near_dedup, op9_toxicity, op10_decontamination, op11_hard_negatives, op12_periodic_runs, op13_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": OP7_SQL, "op10_decontamination": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_embedding_near_dedup": OP13_SQL}
