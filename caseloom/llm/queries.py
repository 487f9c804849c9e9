"""The subpackage's registered queries: thin contracts over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.pages import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.flac import stored_digests

    return stored_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.winnow import contamination, n_hit

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, w=6)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of some kinds), comma-joined in their order."""
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.pii import BASE, personal_data

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    found = personal_data(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[_number(base, k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op5_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from caseloom.llm.wordpiece import piece_counts

    return piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def op6_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.mixing import by_size, n_words, plan_mix, with_copies
    from caseloom.scratch import save

    sized = save(_table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size")).withColumn("odds", by_size()), "sizes")
    found = with_copies(sized, plan_mix(sized, weight_col="odds"), weight_col="odds")
    return found.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))


def op7_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.quality import held_out, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), cut=0.3)
    found = docs.select("doc_id", held_out().alias("held_out"), model.column("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.secrets import secret_spans

    base = ("assign", "access", "hex")
    spans = F.col("spans")
    found = secret_spans(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[_number(spans, k) for k in base], F.sha2(_joined(spans, base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op9_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from caseloom.llm.tokenfiles import write_tokens

    return write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0).summary()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tag_paths": op1_tag_paths,
    "op2_flac": op2_flac,
    "op3_winnowing": op3_winnowing,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_wordpiece": op5_wordpiece,
    "op6_pareto": op6_pareto,
    "op7_bradley_terry": op7_bradley_terry,
    "op8_secrets": op8_secrets,
    "op9_seekable_zstd": op9_seekable_zstd,
    "op10_simhash": op10_simhash,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_winnowing": r"""WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM rows_),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS MATERIALIZED (SELECT r, i, x.n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(w) - n + 2)) AS u(i)) AS x JOIN win ON x.n = win.n AND x.s = win.s),
words AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS u(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
