"""From raw documents to token files: quality, near copies, benchmark passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents, further columns of any name
and kind included.

Cases: a null text counts as empty.  Quality scores an empty text like any
other; equal rows have equal scores and go or stay together.  Rows without a
document id can't be named as members of a group, so near-dedup keeps them; of
equal rows one stays.  Decontamination keeps texts without words.  The mix takes
a text without words as often as its source's whole copies say; a null source
is a source.  Tokens writes a row with a null id first.  Empty tables give empty
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.mixing import by_size, n_words, plan_mix, with_copies
from caseloom.llm.quality import train
from caseloom.llm.simhash import representatives
from caseloom.llm.tokenfiles import write_tokens
from caseloom.llm.winnow import without_contaminated
from caseloom.scratch import save

#: Score from which a document is kept, as in the classifier's query.
QUALITY = 0.3
#: Words of a shingle, and Jaccard index of distinct shingles from which texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Words of the runs that fingerprints are made of, and fingerprints for each document.
WORDS, PRINTS = 2, 6


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below QUALITY go; a score of QUALITY stays."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=QUALITY)
    return docs.where(model.column("text") >= QUALITY)


def _columns(docs: DataFrame) -> list[Column]:
    """The columns, of whatever names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps have none of their own and are hashed as JSON."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(x)) if c in maps else x for c, x in zip(docs.columns, _columns(docs))])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the least id stays.

    Texts are linked if their Jaccard index on distinct shingles is SIMILAR or
    more, and links make groups.  Fingerprints propose pairs; links that they
    leave out are found by common shingles, without exception.  A row is named
    by its id and a hash of all its columns, so rows that share an id but not a
    text are told apart and reruns choose alike; of equal rows one stays.
    """
    key = F.struct("doc_id", _row_hash(docs).alias("row"))
    mark = next(x for x in ("key", *(f"key{i}" for i in range(len(docs.columns) + 1))) if x not in docs.columns)
    named = docs.where("doc_id is not null").select(key.alias("key"), "text")
    heads = save(representatives(named, SIMILAR, SHINGLE, WORDS, PRINTS).withColumnRenamed("key", mark), "heads")
    stay = docs.withColumn(mark, key).join(heads, mark, "left_semi")
    if not named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        stay = stay.dropDuplicates([mark])
    return stay.drop(mark).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; an empty benchmark rejects none."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as many times as the mix takes it; all its columns, of whatever names, go through in one."""
    rows = docs.select(F.struct(*_columns(docs)).alias("doc"), "doc_id", "source", n_words().alias("size")).withColumn("odds", by_size())
    taken = with_copies(rows, plan_mix(rows, weight_col="odds"), weight_col="odds").where("mix_copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row for each document written, read back from them."""
    import public_tokenizers

    return write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0).summary()


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The stages of learning, linking and sampling are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
