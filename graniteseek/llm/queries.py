"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import CLUSTERS, ROUNDS, SCALE, SEED, WIDTH, cluster_vectors
from .decontaminate import contamination
from .embedding_dedup import embedding_components
from .html_wrapper import extract_main_text
from .language_id import PpmOptions, calibrated_limit, fit_language_model, keep_identified, predict_language
from .license_scan import PHRASES, TEMPLATES, THRESHOLD, license_labels
from .mixing import mix_sources
from .order_minhash import near_duplicates
from .packing import pack_documents
from .shared import bounded_batches, table
from .token_count import recount, scrub_edits
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import LISTED_HOSTS, RULES, judge_urls
from .whitening import whiten


def held_out(doc_id: str = "doc_id"):
    """Documents that are only predicted: the id's CRC-32 leaves 1 modulo 3; a null id isn't one."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def fitted_language_model(docs: DataFrame, options: PpmOptions = PpmOptions()):
    """The model of all labelled documents that aren't held out."""
    return fit_language_model(docs, ~held_out(), options=options)


def keep_known_languages(docs: DataFrame, options: PpmOptions = PpmOptions()) -> DataFrame:
    """The documents that a language explains; the limit is calibrated on all held-out ones."""
    model = fitted_language_model(docs, options)
    return keep_identified(docs, model, calibrated_limit(docs, held_out(), model, options=options), options=options)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, fitted_language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recount(table(spark, sf_dir, "documents"), scrub_edits)
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded")


def unlabelled(doc_id: str = "doc_id"):
    """Documents whose toxicity labels aren't learnt: the id's CRC-32 leaves 0 modulo 5; a null id isn't one."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), ~unlabelled()))
    return found.select("doc_id", unlabelled().alias("held_out"), "score", "predicted", "n_clauses")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def _bounded(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (
    op1_mix_sources, op2_embedding_dedup, op3_decontaminate, op4_order_minhash, op5_license_scan,
    op6_pack_tokens, op7_url_filter, op8_language_id, op9_html_text, op10_token_counts,
    op11_toxicity, op12_centroids, op13_whitening)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
pieces AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM pieces),
spots AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, k, pieces.size, item_id FROM spots JOIN pieces ON spots.phrase = pieces.phrase AND spots.size = pieces.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.able AND b.able AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = vec_id
"""

_OP7 = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, verdict) AS (VALUES {rules}),
best AS (
  SELECT page_id, max(length(rule)) AS size, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM p JOIN r ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT p.page_id, host, path, best.rule,
  coalesce(best.verdict, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""

_OP5 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {words} AS w FROM d),
phrases(phrase, label) AS (VALUES {phrases}),
ph AS (SELECT string_split(phrase, ' ') AS p, label FROM phrases),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
places AS (SELECT doc_id, k - 1 AS spot, label FROM spots JOIN ph ON w[k] = p[1] WHERE w[k : k + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
templates(label, body) AS (VALUES {templates}),
t AS (
  SELECT tid, label, list_distinct(tw) AS tw, floor(len(tw) / {threshold} + 1e-9)::BIGINT AS reach, ceil({threshold} * len(list_distinct(tw)) - 1e-9) AS need
  FROM (SELECT row_number() OVER () AS tid, label, {template_words} AS tw FROM templates)),
candidates AS (SELECT doc_id, tid, w, tw, reach, need FROM w JOIN t ON len(list_intersect(list_distinct(w), tw)) >= need),
ends AS (SELECT * FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM candidates) WHERE list_contains(tw, w[k])),
runs AS (SELECT doc_id, tid, tw, need, k, w[greatest(1, k - reach + 1) : k] AS run FROM ends),
hits AS (
  SELECT doc_id, tid, k AS last, k - len(run) + list_position(list_transform(run, lambda x: list_contains(tw, x)), true) AS first, len(list_intersect(list_distinct(run), tw)) / len(tw)::DOUBLE AS c
  FROM runs WHERE len(list_intersect(list_distinct(run), tw)) >= need),
wider AS (SELECT a.tid AS narrow, b.tid AS wide FROM t a JOIN t b ON len(a.tw) < len(b.tw) AND len(list_intersect(a.tw, b.tw)) = len(a.tw)),
links AS (
  SELECT doc_id, label, c FROM hits h JOIN t USING (tid)
  WHERE NOT EXISTS (SELECT 1 FROM hits b JOIN wider ON wide = b.tid WHERE narrow = h.tid AND b.doc_id = h.doc_id AND b.first <= h.last AND b.last >= h.first)),
both_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM links) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(c) FROM links l WHERE l.doc_id = w.doc_id), 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN both_labels USING (doc_id)
"""


def _op12() -> str:
    """A chain of tables: the distances and the centroids of each round."""
    parts = [f"""
v AS (
  SELECT rid, vec_id, unnest(range(1, {WIDTH + 1})) AS i, unnest(x) AS x
  FROM (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)),
c0 AS (
  SELECT c, i, x FROM v JOIN (
    SELECT rid, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT rid, sha256('{SEED}:' || vec_id) AS h FROM v WHERE i = 1 ORDER BY h LIMIT {CLUSTERS})) USING (rid))"""]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT rid, c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN c{r} k USING (i) GROUP BY rid, c)")
        parts.append(f"a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (rid) GROUP BY c, i))")
            parts.append(f"c{r + 1} AS (SELECT k.c, k.i, coalesce(m{r}.x, k.x) AS x FROM c{r} k LEFT JOIN m{r} ON m{r}.c = k.c AND m{r}.i = k.i)")
    parts.append(f"keys AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN (SELECT rid, vec_id FROM v WHERE i = 1) USING (rid) JOIN keys USING (c)
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


ORACLE_SQL = {
    "op2_embedding_dedup": _OP2,
    "op3_decontaminate": _OP3,
    "op5_license_scan": _OP5.format(words=_WORDS, phrases=_values(PHRASES), templates=_values(TEMPLATES), template_words=_WORDS.replace("(text,", "(body,"), threshold=THRESHOLD),
    "op12_centroids": _op12(),
    "op7_url_filter": _OP7.format(rules=_values(RULES), listed=" OR ".join(f"('.' || host) LIKE '%.{k.rstrip('/')}'" for k in LISTED_HOSTS)),
}
