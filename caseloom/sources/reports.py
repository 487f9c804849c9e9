"""Reports: the table's schema, delimited files in either spelling, unique ids, and shapes for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.normalize import normalized_sets
from caseloom.functions.vocab import MISSING

SCHEMA = "idx bigint, report_id string, age double, sex string, seriousness string, report_day bigint, drugs array<string>, events array<string>, true_cluster_id bigint"
#: Either spelling of a column; the first that is present counts.
SPELLINGS = {"report_id": "ReportID", "age": "Age", "sex": "Sex", "seriousness": "Seriousness", "report_day": "ReportDay", "drugs": "Drugs", "events": "Events", "true_cluster_id": "TrueClusterID"}
TEMPLATE = "ReportID,Age,Sex,Seriousness,ReportDay,Drugs,Events\n1001,54,Female,Serious,120,Lipitor 20mg;aspirin,nausea;headache\n1002,55,Female,Serious,123,atorvastatin;aspirin,throwing up;head ache\n"


def read_delimited(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All columns as strings, cells that mean "missing" as null, and idx in the order of files and lines.

    line_breaks: quoted cells may hold line breaks; a file is then read whole by one task.

    idx is counted within each block of a file, then shifted by the counts of
    the blocks before it; no single task orders all rows.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_breaks).csv(path)
    names = raw.columns
    placed = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    counts = placed.groupBy("__file", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("__file", "__block", before.alias("__before"))
    row = F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__at")) - 1
    numbered = placed.withColumn("__row", row).join(shift, ["__file", "__block"])
    cells = [F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in names]
    return numbered.select((F.col("__before") + F.col("__row")).alias("idx"), *cells)


def split_terms(cell: Column) -> Column:
    """Trimmed parts between semicolons, without blank ones."""
    parts = F.transform(F.split(cell, ";"), lambda t: F.trim(t))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def _word(x: Column) -> Column:
    """First letter large, others small; blank is null."""
    t = F.trim(x)
    return F.when(t != "", F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1_000_000))))


def _whole(x: Column) -> Column:
    number = x.try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def parse(raw: DataFrame, normalize: bool = True) -> DataFrame:
    """Raw string rows with idx -> reports.  Columns are found by exact name; missing ones take defaults."""
    present = set(raw.columns)

    def cell(name: str) -> Column:
        spelling = next((s for s in (SPELLINGS[name], name) if s in present), None)
        return F.col(f"`{spelling}`") if spelling else F.lit(None)

    def terms(name: str) -> Column:
        spelling = next((s for s in (SPELLINGS[name], name) if s in present), None)
        if spelling and dict(raw.dtypes)[spelling].startswith("array"):
            own = F.transform(F.col(f"`{spelling}`").cast("array<string>"), lambda t: F.trim(t))
            return F.coalesce(F.filter(own, lambda t: t != ""), F.array().cast("array<string>"))
        return split_terms(cell(name).cast("string"))

    age = cell("age").cast("string").try_cast("double")
    has_id = SPELLINGS["report_id"] in present or "report_id" in present
    rows = raw.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.coalesce(cell("report_id").cast("string"), F.lit("nan" if has_id else "")).alias("report_id"),
        F.when(~F.isnan(age), age).alias("age"),
        _word(cell("sex").cast("string")).alias("sex"),
        _word(cell("seriousness").cast("string")).alias("seriousness"),
        F.coalesce(_whole(cell("report_day").cast("string")), F.lit(0)).cast("bigint").alias("report_day"),
        terms("drugs").alias("drugs"),
        terms("events").alias("events"),
        _whole(cell("true_cluster_id").cast("string")).alias("true_cluster_id"),
    )
    if not normalize:
        return rows.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("drugs", "events")})
    out = rows.drop("drugs", "events")
    for column, kind in (("drugs", "drug"), ("events", "event")):
        out = out.join(normalized_sets(rows, "idx", column, kind), "idx", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("drugs", "events")}).select(*[f.split()[0] for f in SCHEMA.split(", ")])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as reports with unique ids."""
    return unique_ids(parse(read_delimited(spark, path)))


def sample_reports(spark: SparkSession, path: str) -> DataFrame | None:
    """A bundled sample as reports, if the file is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return read_reports(spark, path) if there else None


def unique_ids(reports: DataFrame) -> DataFrame:
    """Later rows of a repeated id get "#2", "#3", ... in order of idx; new ids are not checked against given ones.

    Rows are numbered within ranges of idx and shifted by the counts of the ranges
    before, so an id that a third of the rows have is not numbered in one task.
    """
    ranged = reports.withColumn("__range", F.floor(F.col("idx") / (1 << 20)))
    counts = ranged.groupBy("report_id", "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("report_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("report_id").alias("__id"), F.col("__range").alias("__r"), before.alias("__before"))
    placed = ranged.join(shifts, F.col("report_id").eqNullSafe(F.col("__id")) & (F.col("__range") == F.col("__r")))
    n = F.col("__before") + F.row_number().over(Window.partitionBy("report_id", "__range").orderBy("idx"))
    marked = placed.withColumn("__n", n)
    new = F.when(F.col("__n") > 1, F.concat_ws("#", "report_id", F.col("__n").cast("string"))).otherwise(F.col("report_id"))
    return marked.withColumn("report_id", new).select(*reports.columns)


def file_shape(reports: DataFrame) -> DataFrame:
    """Columns and cells as in a delimited file; sets joined by semicolons, null words as blanks."""
    return reports.select(
        F.col("report_id").alias("ReportID"),
        F.col("age").alias("Age"),
        F.coalesce("sex", F.lit("")).alias("Sex"),
        F.coalesce("seriousness", F.lit("")).alias("Seriousness"),
        F.col("report_day").alias("ReportDay"),
        F.array_join(F.array_sort("drugs"), ";").alias("Drugs"),
        F.array_join(F.array_sort("events"), ";").alias("Events"),
        F.col("true_cluster_id").alias("TrueClusterID"),
    )


def display_shape(reports: DataFrame) -> DataFrame:
    """Columns for reading; sets joined by "; "."""
    return reports.select("report_id", "age", "sex", "seriousness", "report_day", F.array_join(F.array_sort("drugs"), "; ").alias("drugs"), F.array_join(F.array_sort("events"), "; ").alias("events"))


def preview(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first n rows by their order in the source."""
    return rows.orderBy("idx").limit(n) if "idx" in rows.columns else rows.limit(n)


def write_delimited(df: DataFrame, path: str) -> None:
    """Delimited files with a header, one for each partition of df."""
    df.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
