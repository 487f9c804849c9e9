"""Case files as nested JSON, flattened into the shape of a delimited report file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = (
    "struct<safetyreportid:string,serious:string,receiptdate:string,receivedate:string,patient:struct<patientonsetage:string,patientonsetageunit:string,"
    "patientsex:string,drug:array<struct<medicinalproduct:string,openfda:struct<generic_name:array<string>>>>,reaction:array<struct<reactionmeddrapt:string>>>>"
)
#: Day 0 of report days, a fixed value.
EPOCH = "2015-01-01"


def _named(values: Column) -> Column:
    """Trimmed distinct sorted names, without missing or empty ones."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x))))


def _age(p: str) -> Column:
    """Years: months and days are converted, other units are taken as they are; outside 0 to 120 is unknown."""
    value = F.when(F.col(f"{p}.patientonsetage") != "", F.col(f"{p}.patientonsetage").try_cast("double"))
    unit = F.coalesce(F.col(f"{p}.patientonsetageunit"), F.lit("801"))
    age = F.when(unit == "802", F.bround(value / 12.0, 1)).when(unit == "804", F.bround(value / 365.25, 1)).otherwise(value)
    return F.when(age.between(0, 120), age)


def flatten_cases(cases: DataFrame, column: str = "case") -> DataFrame:
    """One row for each case with an id, a drug and an event: the columns of a delimited report file."""
    p = f"{column}.patient"
    drugs = F.concat(
        F.coalesce(F.transform(f"{p}.drug", lambda d: d["medicinalproduct"]), F.array().cast("array<string>")),
        F.coalesce(F.flatten(F.transform(f"{p}.drug", lambda d: F.coalesce(d["openfda"]["generic_name"], F.array().cast("array<string>")))), F.array().cast("array<string>")),
    )
    date = F.coalesce(F.nullif(F.col(f"{column}.receiptdate"), F.lit("")), F.col(f"{column}.receivedate"))
    day = F.coalesce(F.date_diff(F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date"), F.lit(EPOCH).cast("date")), F.lit(0))
    rows = cases.select(
        F.col(f"{column}.safetyreportid").alias("ReportID"),
        _age(p).alias("Age"),
        F.coalesce(F.try_element_at(F.create_map(F.lit("1"), F.lit("Male"), F.lit("2"), F.lit("Female")), F.coalesce(F.col(f"{p}.patientsex"), F.lit(""))), F.lit("")).alias("Sex"),
        F.when(F.col(f"{column}.serious") == "1", "Serious").otherwise("Non-serious").alias("Seriousness"),
        day.cast("bigint").alias("ReportDay"),
        _named(drugs).alias("Drugs"),
        _named(F.transform(f"{p}.reaction", lambda r: r["reactionmeddrapt"])).alias("Events"),
    )
    kept = rows.where((F.coalesce("ReportID", F.lit("")) != "") & (F.size("Drugs") > 0) & (F.size("Events") > 0))
    return kept.withColumns({c: F.array_join(c, ";") for c in ("Drugs", "Events")})


def parse_cases(lines: DataFrame, column: str = "value") -> DataFrame:
    """(case): a JSON text of one case in each row -> structs; broken texts give empty cases."""
    return lines.select(F.from_json(column, CASE).alias("case"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case) from landed responses, each a JSON document with an array `results`."""
    return spark.read.schema(f"results array<{CASE}>").option("multiLine", True).json(path).select(F.explode("results").alias("case"))


def save_sample(cases: DataFrame, path: str) -> DataFrame:
    """Flattens cases (a column value of JSON, as a landed response or the case service gives), writes them as delimited files and reads them back."""
    from caseloom.sources.reports import read_delimited, write_delimited

    write_delimited(flatten_cases(parse_cases(cases)), path)
    return read_delimited(cases.sparkSession, path)


def fetch_sample(spark: SparkSession, url: str, path: str, search: str | None = None, limit: int = 500) -> DataFrame:
    """Asks the case service, flattens what it returns and saves it as delimited files at path."""
    register_case_service(spark)
    asked = spark.read.format("case_service").option("url", url).option("limit", str(limit))
    return save_sample((asked.option("search", search) if search else asked).load(), path)


def register_case_service(spark: SparkSession) -> None:
    """Registers the data source "case_service": option url (a query address that returns such a document) and limit (at most 1000).

    The request is made on an executor when the source is read; spark.read.format("case_service").option("url", ...).load().
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def read(self, partition):
            import json
            from urllib.parse import urlencode
            from urllib.request import urlopen

            query = {"limit": min(int(self.options.get("limit", "500")), 1000)}
            if search := self.options.get("search"):
                query["search"] = search
            with urlopen(f"{self.options['url']}?{urlencode(query)}", timeout=30) as answer:
                for case in json.load(answer).get("results", []):
                    yield (json.dumps(case),)

    class Service(DataSource):
        @classmethod
        def name(cls):
            return "case_service"

        def schema(self):
            return "value string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Service)
