"""One query for each operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, divergence, langid, lmscore, mixing, neardup_vectors, packing, prefixtrie, quality, sharding, simhash, warc

N_SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lmscore.stupid_backoff(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.round("log10_score", 4).alias("log10_score"), "backed_off")


def op3_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of four fifths of the conversations teach the model; all are parsed."""
    raw = chat.raw_transcripts(_table(spark, sf_dir, "conversations"))
    model = chat.fit(chat.lines_of(raw.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0), role_col="role"))
    return chat.parse(raw, model)


def op4_spherical_kmeans_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup_vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), N_SHARDS)
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.col("text").cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).withColumnRenamed("id", "doc_id")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return out.select(F.col("id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "source_digest", "source_header", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), byte_bpe_path()).withColumnRenamed("id", "doc_id")


def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("score", "anomaly_score")


def op11_radix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefixtrie.trie(_table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), byte_bpe_path())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


_OPERATORS = (
    op1_simhash_neardup, op2_stupid_backoff, op3_transcript_hmm, op4_spherical_kmeans_neardup, op5_hypergeometric_shards, op6_ppm_language_id, op7_warc_derivatives,
    op8_bpe_automaton, op9_hash_threshold_mix, op10_isolation_forest_quality, op11_radix_divergence, op12_prefix_fingerprints, op13_vector_best_fit,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: Targets by the water level of sources ordered by cap / weight; thresholds by a running sum in hash order.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, 'none')), 1, 15)) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM src WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (
  SELECT *, level * w < cap AS free,
         arg_min(level, cap / w) FILTER (WHERE level * w < cap) OVER () AS water
  FROM lev),
goal AS (
  SELECT source, source_size, CASE WHEN free THEN water * w ELSE cap END AS target FROM fin),
part AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS reps FROM goal),
runs AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.reps,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (reps + CASE WHEN run <= target - reps * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.d FROM reach r JOIN l ON r.seen = l.s),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
deg AS (SELECT s, count(*) AS n FROM l GROUP BY s)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON e.vec_id = node LEFT JOIN deg ON e.vec_id = s
"""

#: N-grams as strings; a document's own counts are taken off those of all rows.
BACKOFF_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT r, i, w1, lag(w1) OVER o || ' ' || w1 AS w2, lag(w1, 2) OVER o || ' ' || lag(w1) OVER o || ' ' || w1 AS w3
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (
  SELECT r, i, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY r, w1) AS r1,
         count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY r, w2) AS r2,
         count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY r, w3) AS r3
  FROM g),
x AS (SELECT *, lag(r1) OVER o AS before1, lag(r2) OVER o AS before2 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT sum(len(w)) AS total FROM d),
z AS (
  SELECT x.r, i, greatest(1, total - len(d.w)) AS others, r1, r2, r3, before1, before2,
         CASE WHEN i > 2 AND r3 > 0 THEN 0 WHEN i > 1 AND r2 > 0 THEN least(i, 3) - 2 WHEN r1 > 0 THEN least(i, 3) - 1 ELSE least(i, 3) END AS level
  FROM x JOIN d ON d.r = x.r CROSS JOIN n),
s AS (
  SELECT r, sum(level * log10(0.4) + CASE WHEN i > 2 AND r3 > 0 THEN log10(r3 / greatest(before2, r3))
         WHEN i > 1 AND r2 > 0 THEN log10(r2 / greatest(before1, r2)) WHEN r1 > 0 THEN log10(r1 / others) ELSE -log10(others) END) AS score,
         count(*) FILTER (WHERE level > 0) AS backed
  FROM z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) + 0.0 AS log10_score, CAST(coalesce(backed, 0) AS BIGINT) AS backed_off
FROM d LEFT JOIN s ON d.r = s.r
"""

#: Rates of every kept term in every group; pairs and terms are compared in full.
DIVERGENCE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
lt AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ((coalesce(c.n, 0) + 2)::HUGEINT * 1000000000) // (coalesce(gt.total, 0) + 2 * lt.v)::HUGEINT AS p,
         1 + ((k.n + 2)::HUGEINT * 1000000000) // (lt.total + 2 * lt.v)::HUGEINT AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN lt ON lt.lang = g.lang
  LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM x WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS k
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 10
"""

#: CRC-32 bit by bit; nodes by whole prefixes as lists, subtrees by prefixes of prefixes.
_CRC_STEP = "list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
TRIE_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         struct_pack(r := coalesce(role, ''), b := coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY i) AS w FROM t GROUP BY c),
crc AS (
  SELECT c, w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
         lambda a, s: {_CRC_STEP.replace("(x,", "(xor(a, s),")})) % 6 AS h
  FROM own),
built AS (SELECT a.c, CASE WHEN a.c = a.c - a.c % 100 THEN a.w ELSE list_concat(coalesce(r.w[1:a.h], []), a.w[a.h + 1:]) END AS w FROM crc a LEFT JOIN own r ON r.c = a.c - a.c % 100),
prefix AS (SELECT c, CAST(d AS BIGINT) AS depth, w[1:d] AS p, d = len(w) AS ends FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM built)),
node AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefix GROUP BY p, depth),
tree AS (
  SELECT n.*, m.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.p[n.depth].b) ELSE 0 END AS saved,
         (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children
  FROM node n LEFT JOIN node m ON m.depth = n.depth - 1 AND n.p[1:n.depth - 1] = m.p)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, u.n_children, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves,
       CAST(sum(v.saved) AS BIGINT) AS saved_tokens, u.ends_sha256
FROM tree u JOIN tree v ON v.depth >= u.depth AND v.p[1:u.depth] = u.p
GROUP BY ALL
"""

ORACLE = {"op2_stupid_backoff": BACKOFF_SQL, "op4_spherical_kmeans_neardup": VECTORS_SQL, "op9_hash_threshold_mix": MIX_SQL, "op11_radix_divergence": DIVERGENCE_SQL, "op12_prefix_fingerprints": TRIE_SQL}
