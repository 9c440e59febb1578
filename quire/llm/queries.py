"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, neighbours, pieces, pseudonyms, quality, sharding, simhash, token_counts, url_filter, vector_codes, whitening, wrappers
from quire.llm.shared import table


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op2_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.fitted(docs))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op5_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.samples(table(spark, sf_dir, "documents"), k=2)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"), pseudonyms.session_key(spark, demonstration=True))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents")))


def op10_suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_ngram_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.default_model(spark))


def op13_vantage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_wrapper_text, op2_byte_language, op3_simhash_bktree, op4_quality_machine, op5_piece_samples, op6_byte_shards, op7_pseudonyms, op8_hilbert_neighbours, op9_length_histogram, op10_suffix_matches, op11_lobpcg_whitening, op12_ngram_url_filter, op13_vantage_codes]
    return {f.__name__: f for f in own}


OP8 = """
WITH own AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), asked AS (
    SELECT vec_id, min(v) AS v FROM own WHERE vec_id % 100 = 0 GROUP BY vec_id
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           min(sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b))) AS score
    FROM asked q JOIN own c ON q.vec_id <> c.vec_id GROUP BY ALL
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP10 = r"""
WITH tokens AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS gram
    FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram
    FROM tokens, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.gram = i.gram),
words_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id
), items_hit AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hits GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM tokens t LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items_hit i USING (doc_id)
"""


_NEAREST = """assigned{k} AS (
    SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d
    FROM (SELECT a.rid, a.p, b.e, list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM parts a JOIN book{k} b USING (p))
    GROUP BY rid, p
)"""
_MOVED = """means{k} AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v
    FROM (
        SELECT a.p, a.e, u.j, sum(u.c)::BIGINT AS s, count(*) AS n FROM assigned{k} a JOIN parts USING (rid, p), LATERAL (SELECT unnest(parts.v) AS c, generate_subscripts(parts.v, 1) AS j) u
        GROUP BY a.p, a.e, u.j
    ) GROUP BY p, e
), book{next} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""
OP13 = (
    """
WITH kept AS (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(greatest(least(256 * CAST(c AS DOUBLE), 16777216), -16777216)) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (SELECT rid, p, list_slice(x, p * len(x) // 16 + 1, (p + 1) * len(x) // 16) AS v FROM kept, range(16) AS t(p)),
firsts AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, x FROM (SELECT vec_id, min(x) AS x FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 64)
), book0 AS (SELECT p, e, list_slice(x, p * len(x) // 16 + 1, (p + 1) * len(x) // 16) AS v FROM firsts, range(16) AS t(p)),
"""
    + ", ".join(_NEAREST.format(k=k) + (", " + _MOVED.format(k=k, next=k + 1) if k < 2 else "") for k in range(3))
    + """, coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM assigned2 GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""
)


def oracle_sql() -> dict[str, str]:
    """SQL can't express the other operators: learned models, XXH64 and CRC-32, tokenizers, ciphers, markup."""
    return {"op8_hilbert_neighbours": OP8, "op10_suffix_matches": OP10, "op13_vantage_codes": OP13}
