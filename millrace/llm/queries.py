"""The queries of this subpackage, each an operator applied to its whole table, and DuckDB
SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, fingerprints, forest, langid, mixing, negatives, quality, rules, sharding, simhash, suffix, warc


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_docs(spark, sf_dir, "doc_id", "text"))


def _remainder(m: int):
    """crc32 of the document's number as text, modulo m."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(5) != 0)
    got = quality.score(docs, quality.train(docs, labels))
    return got.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir, "doc_id", "text"), 8)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.suffix_dedup(_docs(spark, sf_dir, "doc_id", "text"), threshold=100)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_docs(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents whose crc32 isn't 2 modulo 4."""
    return langid.train(docs.filter(_remainder(4) != 2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang")
    got = langid.predict(docs, language_model(docs))
    return got.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and dealt out; of each copy's text its digest is told."""
    mixed = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", F.round("mix_order", 12).alias("mix_order"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rules.clean_lines(_docs(spark, sf_dir, "doc_id", "text", "source"), columns=columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), width=5, percent=75)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), width=3, radius=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("label").cast("long")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(v, anchors=F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80, scale=256)


def _codes_sql(rounds: int = 4) -> str:
    """Each round's assignment and means as two tables; distance and number in one integer."""
    out = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        p AS (SELECT vec_id, label, k AS part, x[16 * k + 1 : 16 * k + 16] AS x FROM v, range(4) r(k)),
        c0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, x AS c FROM p QUALIFY entry < 256)"""
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + entry) AS best FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL)")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT part, best % 256 AS entry, list(s ORDER BY i) AS c FROM (
                SELECT part, best, i, floor(sum(x[i]) / count(*)) AS s FROM (SELECT part, best % 256 AS best, x FROM a{r}), range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (part, entry))""")
    return f"""WITH {", ".join(out)},
        d AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
        e AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, d"""


_ORACLES = {
    "op11_vector_codes": _codes_sql(),
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
               s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        QUALIFY rank <= 5
    """,
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id WHERE 100 * both_ >= 75 * (len(sa.s) + len(sb.s) - both_)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS k, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.k)
        SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
        FROM s JOIN r ON r.k = s.doc_id GROUP BY s.doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> (15 - 5 * j)) % 32 + 1, 1), '' ORDER BY i, j)
                FROM (SELECT i, ('0x' || substr(s, 5 * i + 1, 5))::BIGINT AS v FROM range(8) r(i)), range(4) q(j)) AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM m
    """,
    "op7_mixing": """
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        t AS (SELECT sum(n)::DOUBLE AS total, sum(n ** 0.5) AS weights FROM n),
        r AS (SELECT source, n ** 0.5 / weights * total / n AS rate FROM n, t),
        d AS (SELECT doc_id, d.source, n_chars, md5(coalesce(text, '')) AS text_md5, rate,
                     ('0x' || substr(md5('7|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
              FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        g AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 24)::BIGINT)) AS k FROM r),
        f AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM g),
        c AS (SELECT doc_id, d.source, n_chars, text_md5, rate, count(*) AS copies
              FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND f.c <= d.u
              GROUP BY ALL),
        x AS (SELECT *, unnest(range(0, copies)) AS k FROM c)
        SELECT doc_id, source, n_chars, text_md5, round(rate, 9) AS mix_rate, copies::INT AS mix_copies, k::INT AS mix_copy,
               round(('0x' || substr(md5('7:order|' || doc_id || '|' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496, 12) AS mix_order
        FROM x
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
