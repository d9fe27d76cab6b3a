"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir), digests=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import round_trip

    return round_trip(_docs(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_docs(spark, sf_dir), digests=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_docs(spark, sf_dir))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import quality_classifier

    return quality_classifier(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import lm_scores

    return lm_scores(_docs(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_docs(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening

    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_best_fit_packing, op3_simhash, op4_token_output, op5_byte_bpe, op6_sharding, op7_importance_resampling, op8_masked_lm, op9_token_counts, op10_quality_rules, op11_line_dedup, op12_whitening, op13_collocations)}

ORACLES = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
        k AS (SELECT r, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        m AS (SELECT key, count(DISTINCT r) AS n FROM k WHERE key IN (SELECT key FROM c) GROUP BY key),
        o AS (SELECT r, count(*) AS n_lines, count(m.key) AS n_dropped, coalesce(string_agg(CASE WHEN m.key IS NULL THEN line END, chr(10) ORDER BY p), '') AS kept, coalesce(max(m.n), 0) AS max_docs FROM k LEFT JOIN m USING (key) GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256, max_docs FROM o JOIN d USING (r)""",
    "op13_collocations": f"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
        pc AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t)),
        pl AS (SELECT lang, w, len(w) AS m FROM pc WHERE len(w) > 0),
        g AS (SELECT lang, s, unnest(list_transform(range(1, m - s + 2), lambda i: w[i : i + s - 1])) AS p FROM pl, range(1, 6) AS z(s) WHERE m >= s),
        f AS (SELECT lang, s, p, count(*) AS a FROM g GROUP BY lang, s, p HAVING count(*) >= 100),
        n AS (SELECT lang, CAST(sum(m) AS BIGINT) AS n FROM pl GROUP BY lang),
        k AS (SELECT f.lang, f.s, f.p, f.a, k.k, f.p[1 : k.k] AS x, f.p[k.k + 1 :] AS y FROM f, range(1, 5) AS k(k) WHERE k.k < f.s),
        c AS (SELECT k.lang, k.p, k.s, k.a, k.k, x.a AS l, y.a AS r, n.n, CAST(1000::HUGEINT * k.a * n.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
              FROM k JOIN f x ON x.lang = k.lang AND x.p = k.x JOIN f y ON y.lang = k.lang AND y.p = k.y JOIN n ON n.lang = k.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM c),
        i AS (SELECT f.lang, f.p[z.i : z.i + y.m - 1] AS q, max(f.a) AS longer FROM f, range(2, 5) AS y(m), range(1, 5) AS z(i) WHERE y.m < f.s AND z.i + y.m - 1 <= f.s GROUP BY ALL),
        e AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN i ON i.lang = b.lang AND i.q = b.p WHERE b.o = 1 AND (i.longer IS NULL OR i.longer < b.a))
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM e) WHERE rank <= 2000""",
}
