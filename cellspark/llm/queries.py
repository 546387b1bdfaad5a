"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, merkle, minhash, ngram, packing, quality, secrets, shallot, substring, token_count, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(substring.deduplicated(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scored(_table(spark, sf_dir, "documents"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(_table(spark, sf_dir, "documents"))


def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clusters(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_substring, op4_toxicity, op5_warc, op6_ngram, op7_merkle, op8_minhash, op9_packing, op10_secrets, op11_token_count, op12_shallot, op13_alignment)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM, _WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"



def _rounds_sql(k: int, rounds: int) -> str:
    """Rounds of k-means as tables c0, a0, c1, a1, and so on: centroids (j, x) and assignments (vec_id, x, d, j)."""
    nearest = "a{r} AS MATERIALIZED (SELECT n, vec_id, x, (m).d d, (m).j j FROM (SELECT n, vec_id, v.x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), j := j)) m FROM v CROSS JOIN c{r} c GROUP BY ALL))"
    moved = """s{r} AS (SELECT j, i, SUM(e) s, COUNT(*) n FROM (SELECT j, unnest(x) e, unnest(generate_series(1, 64)) i FROM a{q}) GROUP BY j, i),
c{r} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) x FROM c{q} c LEFT JOIN (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) x FROM s{r} GROUP BY j) m USING (j))"""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () n, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 j, x FROM v QUALIFY j < {k})""", nearest.format(r=0)]
    for r in range(1, rounds + 1):
        parts += [moved.format(r=r, q=r - 1), nearest.format(r=r)]
    return "WITH " + ",\n".join(parts)


#: The same rows in DuckDB's SQL, for the queries whose whole result SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) item, w, least(10, len(w)) n FROM (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) i FROM it)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, COUNT(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
ids AS (SELECT doc_id, COUNT(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op3_substring": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) i FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, i FROM win JOIN (SELECT g, MIN(doc_id) least FROM win GROUP BY g) USING (g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) p FROM rep),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) kept, COUNT(*) n FROM (SELECT doc_id, unnest(w) x, unnest(generate_series(1, len(w))) p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) b, sha1(coalesce(html, '')) h FROM pages),
q AS (SELECT *, MIN(page_id) OVER (PARTITION BY h) f FROM p)
SELECT page_id, CAST(b AS BIGINT) payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (j // 4) AS INT) + 1, 5) AS INT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31 AS INT) + 1, 1) for j in generate_series(0, 31)], '') payload_digest,
CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> f THEN f END refers_to FROM q""",
    "op8_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) n FROM sh GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, COUNT(*) c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept FROM d JOIN (SELECT a doc_id, MIN(b) component_id FROM r GROUP BY 1) USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_shallot": f"""{_rounds_sql(40, 5)}
SELECT vec_id, CAST(j AS INT) AS "cluster", d AS distance, CAST(SUM(d) OVER (PARTITION BY j) AS BIGINT) cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) inertia, h centroid_sha256 FROM a5 JOIN (SELECT j, sha256(array_to_string(x, ',')) h FROM c5) USING (j)""",
}
