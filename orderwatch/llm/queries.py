"""Registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, byte_cnn, decontaminate, hilbert, license_rules, lm, ngram_join, quality_model, quality_rules, simplex_clusters, spelling, token_index
from .shared import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_index(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "shards")
    token_index.write_shards(_table(spark, folder, "documents"), path, TOKENIZER)
    return token_index.read_documents(spark, path)


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(_table(spark, folder, "documents"), TOKENIZER), TOKENIZER))


def op3_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality_model.score(docs, quality_model.fit(docs, _table(spark, folder, "labels")))


def op4_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return byte_cnn.predict(docs, byte_cnn.fit(docs))


def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op6_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.recognise(_table(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(_table(spark, folder, "documents"))


def op8_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    rows = hilbert.shard(_table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judge(_table(spark, folder, "documents"))
    return rows.select("doc_id", *quality_rules.COUNTS, "kept")


def op11_simplex_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return simplex_clusters.cluster(_table(spark, folder, "embeddings")).drop("compared")


def op12_bottomk(spark: SparkSession, folder: str) -> DataFrame:
    return bottomk.link(_table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_index, op2_bpe, op3_quality_model, op4_byte_cnn, op5_lm, op6_license_rules, op7_ngram_join, op8_hilbert, op9_decontaminate, op10_quality_rules, op11_simplex_clusters, op12_bottomk, op13_spelling)}


def _license_sql() -> str:
    sentences = ", ".join(f"('{name}', '{sentence}')" for name, sentence in license_rules.SENTENCES.items())
    seen, tests = "seen", []
    for name, licence, names in license_rules.RULES:
        run = "".join(f" {n} " for n in names)
        tests.append((name, licence, f"contains({seen}, '{run}')"))
        seen = f"replace({seen}, '{run}', '#')"
    rules = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, _, test in tests)
    licences = ", ".join(f"CASE WHEN {test} THEN '{licence}' END" for _, licence, test in tests)
    return f"""
        WITH known(name, sentence) AS (VALUES {sentences}),
        cut AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place
                FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?;:]+[ \t\r\n]+|[.!?;:]+$|\n+') AS parts FROM documents)),
        plain AS (SELECT doc_id, place, regexp_replace(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), '^copyright .*$', 'copyright') AS sentence FROM cut),
        found AS (SELECT doc_id, string_agg(name, '  ' ORDER BY place) AS names, count(*) AS n FROM plain JOIN known USING (sentence) GROUP BY doc_id),
        every AS (SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(' ' || names || ' ', '') AS seen FROM documents d LEFT JOIN found USING (doc_id))
        SELECT doc_id, n_known, replace(trim(seen), '  ', ',') AS sentences,
               array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS rules,
               array_to_string(list_sort(list_distinct(list_filter([{licences}], lambda x: x IS NOT NULL))), ',') AS licences
        FROM every"""


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Assignments and floored means written out round by round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""apart_{n} AS MATERIALIZED (SELECT rid, cluster, sum((x - c) * (x - c)) AS d FROM parts JOIN centroid_{n} USING (place) GROUP BY rid, cluster),
        placed_{n} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(cluster, (d, cluster)) AS cluster FROM apart_{n} GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""moved_{n} AS MATERIALIZED (SELECT cluster, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
                FROM parts JOIN placed_{n} USING (rid) GROUP BY cluster, place),
            centroid_{n + 1} AS MATERIALIZED (SELECT cluster, place, coalesce(m.c, o.c) AS c FROM centroid_{n} o LEFT JOIN moved_{n} m USING (cluster, place))""")
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        parts AS MATERIALIZED (SELECT rid, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x, unnest(range(64)) AS place FROM kept),
        first AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS cluster FROM kept),
        centroid_0 AS MATERIALIZED (SELECT CAST(cluster AS INTEGER) AS cluster, place, x AS c FROM parts JOIN first USING (rid) WHERE cluster < {k}),
        {", ".join(steps)},
        signed AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM centroid_{rounds} GROUP BY cluster)
        SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM placed_{rounds} JOIN kept USING (rid) JOIN signed USING (cluster)"""


ORACLES: dict[str, str] = {"op6_license_rules": _license_sql(), "op11_simplex_clusters": _cluster_sql()}
