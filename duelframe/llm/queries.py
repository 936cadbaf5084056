"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (exact_dedup, filter_audit, hard_negatives, language_model, mixing, near_dedup, packing, pseudonyms, quality_model,
               sharding, target_rules, url_reputation, warc)
from .base import table
from .registry import CHECKS, QUERIES, query  # noqa: F401

DUCK_WORD = r"[^\x20\x09-\x0D]+"
DUCK_BLANKS = r"[\x20\x09-\x0D]"



@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
 CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> kept THEN kept END AS refers_to FROM k"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(spark, table(spark, sf_dir, "pages"))


OP3_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{DUCK_WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 8)
   AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents),
sources AS (SELECT source IS NULL AS no_source, coalesce(source, '') AS name, CAST(sum(size) AS BIGINT) AS source_size
  FROM sized GROUP BY ALL),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY no_source, name) - 1) % 3] AS w, 3 * source_size AS cap
  FROM sources),
sums AS (SELECT *, CAST(cap AS DOUBLE) / w AS r, CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
   / CAST((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS rest FROM ranked
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, no_source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, CASE WHEN r < (SELECT max(rest) FROM sums WHERE rest <= r) THEN CAST(cap AS DOUBLE)
   ELSE w * (SELECT max(rest) FROM sums WHERE rest <= r) END AS target FROM sums),
rated AS (SELECT doc_id, size, source_size, target, u,
   CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON (source IS NULL) = no_source AND coalesce(source, '') = name)
SELECT doc_id, size, source_size, target,
 size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated"""


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).alias("taken"))


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_reputation.UPPER}',
   '{url_reputation.LOWER}'), '{DUCK_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
   ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

_STRENGTH = """SELECT mu, CASE WHEN share > 0 THEN least(1000.0, greatest(2.0, (1 - share) / share)) ELSE 1000.0 END AS m
  FROM (SELECT *, CASE WHEN room > 0 THEN (Q - 2 * mu * K + mu * mu * N - mu * (1 - mu) * (G - 1)) / room ELSE 0 END AS share
   FROM (SELECT *, mu * (1 - mu) * (N - S / greatest(N, 1.0) - (G - 1)) AS room FROM (SELECT *, (K + 1) / (N + 2) AS mu
    FROM (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS N, CAST(coalesce(sum(k), 0) AS DOUBLE) AS K, CAST(count(*) AS DOUBLE) AS G,
     coalesce(sum(CAST(k * k AS DOUBLE) / n), 0) AS Q, CAST(coalesce(sum(n * n), 0) AS DOUBLE) AS S FROM {0} WHERE n > 0))))"""

OP4_SQL = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{url_reputation.PARTS}', 1), ''),
   '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
  coalesce(regexp_extract(url, '{url_reputation.PARTS}', 2), '') AS path FROM pages),
hosts AS (SELECT host, count(quality) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS k, split_part(host, '.', -1) AS suffix,
  CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain
  FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
domains AS (SELECT suffix, domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM domains GROUP BY ALL),
s1 AS ({_STRENGTH.format('suffixes')}), s2 AS ({_STRENGTH.format('domains')}), s3 AS ({_STRENGTH.format('hosts')}),
a1 AS (SELECT suffix, (m * mu + k) / (m + n) AS above FROM suffixes, s1),
a2 AS (SELECT domain, (m * above + k) / (m + n) AS above FROM domains JOIN a1 USING (suffix), s2),
a3 AS (SELECT host, (m * above + k) / (m + n) AS mean, m + n AS total FROM hosts JOIN a2 USING (domain), s3),
b AS (SELECT host, mean + {url_reputation.Z} * sqrt(mean * (1 - mean) / (total + 1)) AS upper FROM a3),
j AS (SELECT *, '.' || host AS h FROM p JOIN b USING (host))
SELECT page_id, host, path,
 CASE WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/' WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule,
 CASE WHEN h LIKE '%.example.org' AND (path LIKE '/en/1%' OR path LIKE '/es/%') THEN 'block'
  WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'allow' WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'block'
  WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'allow' WHEN upper < (SELECT mu FROM s1) THEN 'block' ELSE 'allow' END AS verdict
FROM j"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '{DUCK_BLANKS}', '', 'g')) AS h FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
 doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)"""


@query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_url_reputation", OP4_SQL)
def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality labels that share a page's id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as of good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query("op10_target_rules")
def op10_target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return target_rules.judge(docs, trusted_ids(spark, sf_dir)).select(
        "doc_id", *target_rules.BASE, "base_failed", "kept", "llr", "errors")


@query("op5_near_dedup", OP5_SQL)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.components(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.with_scores(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op8_pseudonyms")
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with pseudonyms in place of personal data, and how many values were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonyms.pseudonymise(docs)
    return done.select("doc_id", "text", F.coalesce(F.size("finds"), F.lit(0)).cast("long").alias("n_replaced"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id AS id, a.rid = b.rid AS own, a.label = b.label AS alike,
  CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0),
p AS (SELECT arid, anchor_id, id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY arid ORDER BY score DESC, id) AS slot FROM s WHERE alike AND NOT own QUALIFY slot <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.arid, p.slot ORDER BY s.score DESC, s.id) AS r
 FROM p JOIN s ON s.arid = p.arid AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
 QUALIFY r <= 3)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{DUCK_WORD}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
 FROM w LEFT JOIN flags USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(range(5)) AS k),
o AS (SELECT chr(CAST(65 + k AS INTEGER)) AS filter_order, 1 << k AS used, 0 AS before, 1 AS step, k, [0] AS befores, [k] AS ks FROM f
 UNION ALL SELECT o.filter_order || chr(CAST(65 + f.k AS INTEGER)), o.used | (1 << f.k), o.used, o.step + 1, f.k,
  list_append(o.befores, o.used), list_append(o.ks, f.k) FROM o JOIN f ON o.used & (1 << f.k) = 0),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step, unnest(befores) AS before, 1 << unnest(ks) AS own FROM o WHERE o.step = 5),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
 FROM c, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
 CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_lm_scores")
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
