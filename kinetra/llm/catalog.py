"""The operators of this package as named queries over the test tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetra.llm import (bm25, centroids, chat, exact_dedup, fill_in_middle, importance, line_dedup, mixing, ngram_join, packing, pii, sharding,
                         url_filter)

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SOURCE_WEIGHTS = (5, 2, 1)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@_query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), width=3, keep=(90, 100))


@_query("op2_url_filter", rf"""
WITH r(h, p, v) AS (VALUES {_RULE_ROWS}),
a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
n AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
d AS (SELECT DISTINCT host, path FROM n),
f AS (SELECT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM n LEFT JOIN f ON n.host = f.host AND n.path = f.path AND f.k = 1""")
def op2_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@_query("op3_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, (size, -doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)""")
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


@_query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, RANKS, limit=2048, columns=(F.crc32("ids").alias("ids_crc32"),))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query("op5_importance_resampling")
def op5_importance_resampling(spark, sf_dir):
    drawn = importance.resample_by_importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_weight", "gumbel_key")


@_query("op6_bm25_top_k", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY doc_id, term),
s AS (SELECT count(*) AS n, CAST(sum(len(words)) AS DOUBLE) / count(*) AS mean FROM w),
i AS (SELECT term, ln(CAST(1 AS DOUBLE) + ((SELECT n FROM s) - count(*) + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE))) AS idf FROM p GROUP BY term),
d AS (SELECT p.doc_id, p.term, p.tf * CAST(2.2 AS DOUBLE)
             / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(w.words) / (SELECT mean FROM s))) AS part
      FROM p JOIN w USING (doc_id)),
q AS (SELECT p.doc_id AS query_id, p.term, i.idf * p.tf AS weight FROM p JOIN i USING (term) WHERE p.doc_id % 20 = 0),
f AS (SELECT query_id, d.doc_id, sum(CAST(floor(weight * part * 1000000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS score FROM q JOIN d USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM f WHERE score >= 1)
SELECT query_id, CAST(k AS INTEGER) AS rank, doc_id, CAST(score AS DOUBLE) / CAST(1000000 AS DOUBLE) AS score FROM r WHERE k <= 10""")
def op6_bm25_top_k(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return bm25.top_documents(docs, docs.where(F.col("doc_id") % 20 == 0), k=10)


_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"


@_query("op7_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS n, {_WEIGHT} AS w FROM d GROUP BY source),
f AS (SELECT *, n * CAST(2 AS DOUBLE) AS fill FROM s),
l AS (SELECT *, ((SELECT sum(n) FROM f) * CAST(1.5 AS DOUBLE)
                 - coalesce(sum(fill) OVER (ORDER BY fill / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)))
                / sum(w) OVER (ORDER BY fill / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM f),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size,
             coalesce(least(fill, (SELECT arg_min(lv, fill / w) FROM l WHERE fill > lv * w) * w), fill) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT doc_id, key, source, upto, count(*) FILTER (CAST(nth * source_size + upto AS DOUBLE) / target * target - size / CAST(2 AS DOUBLE) <= target) * size AS taken
      FROM c, (VALUES (0), (1)) AS v(nth) WHERE size > 0 GROUP BY doc_id, key, source, upto, size)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.upto = k.upto AND c.size > 0""")
def op7_mix_sources(spark, sf_dir):
    return (mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=SOURCE_WEIGHTS)
            .select("doc_id", "size", "source_size", "target", "taken"))


@_query("op8_chat_perspectives", r"""
WITH t AS (SELECT conv_id, turn, coalesce(CAST(floor(turn / 256) AS BIGINT), -1) AS part,
                  regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '\s', '_', 'g') AS role,
                  replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, p.perspective, part, turn, role, text, role = p.perspective AS own,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = p.perspective THEN 'assistant' ELSE 'user name=' || role END
             || chr(10) AS head, text || '<|im_end|>' AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS pos FROM r
      WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY turn, role, o.text) AS text,
       coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY turn, role, o.text) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS mask_chars
FROM o GROUP BY conv_id, perspective, part""")
def op8_chat_perspectives(spark, sf_dir):
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


@_query("op9_bootstrapped_pii")
def op9_bootstrapped_pii(spark, sf_dir):
    return pii.span_report(pii.personal_data(_table(spark, sf_dir, "documents")))


@_query("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), keep=(80, 100))


@_query("op11_balanced_shards")
def op11_balanced_shards(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def _rounds_sql(k: int, rounds: int, seed: int, width: int, scale: int) -> str:
    """All rounds of centroid clustering, one after the other, every vector against every centroid."""
    parts = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), e) - 1 AS j, e AS c FROM v
  QUALIFY j < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, e, CAST(min(d * 64 + j) AS BIGINT) % 64 AS j, CAST(min(d * 64 + j) AS BIGINT) // 64 AS d FROM (
  SELECT vec_id, e, j, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r}) GROUP BY vec_id, e)""")
        if r < rounds:
            parts.append(f"""p{r} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(e) AS x, unnest(range({width})) AS i FROM a{r}) GROUP BY j, i)""")
            parts.append(f"""m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM p{r} GROUP BY j)""")
            parts.append(f"""c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    joined = ",\n".join(parts)
    return f"""WITH {joined}
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


@_query("op12_centroid_clusters", _rounds_sql(40, 5, 2, 64, 256))
def op12_centroid_clusters(spark, sf_dir):
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


@_query("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3,
             CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, CAST(n AS BIGINT) AS n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS prefix,
             coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op13_fill_in_middle(spark, sf_dir):
    return fill_in_middle.fim_report(_table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
