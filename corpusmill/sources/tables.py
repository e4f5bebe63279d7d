"""Readers with explicit schemas, and the roles that the tables of a data folder play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The fields of a property record that are kept; everything else that a feed sends is dropped.
RECORD_FIELDS = [
    "violationid", "buildingid", "registrationid", "boro", "housenumber", "streetname", "zip", "apartment", "class", "inspectiondate",
    "approveddate", "certifieddate", "ordernumber", "novid", "novdescription", "currentstatus", "currentstatusdate", "violationstatus",
]
RECORD = StructType([StructField(f, StringType()) for f in [*RECORD_FIELDS, "_corrupt"]])

BUNDLE = "format string, pages array<struct<url:string,title:string,retrieved_at:string,html:string>>"

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def property_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON records: the kept fields as text, empty ones as null, broken lines in ``_corrupt``. No inference."""
    rows = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(*(F.nullif(F.col(f), F.lit("")).alias(f) for f in RECORD_FIELDS), "_corrupt")


def bundle_pages(bundles: DataFrame, content: str) -> DataFrame:
    """The pages in JSON bundles, those without HTML left out."""
    return bundles.select(F.inline(F.from_json(content, BUNDLE)["pages"])).filter(F.col("html").isNotNull())


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with the hash of their content as key and their media type by content, or else by name."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    head = F.hex(F.substring("content", 1, 4))
    kind = (
        F.when(head == "25504446", "application/pdf")
        .when((head == "504B0304") & F.lower("path").endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(head == "504B0304", "application/zip")
        .when(F.lower("path").rlike(r"\.(md|markdown)$"), "text/markdown")
        .when(F.lower("path").rlike(r"\.html?$"), "text/html")
        .when(F.is_valid_utf8(F.col("content").cast("string")), "text/plain")
    )
    return raw.withColumn("content_hash", F.sha2("content", 256)).withColumn("media_type", kind)


MANIFESTS = (
    "slug string, name string, source_type string, publisher string, jurisdiction string, source_url string, parser_version string, pack_id string, minimum_documents int, required_citations array<string>, query_terms array<string>"
)
CASES = ("id string, query string, question string, expected_citations array<string>, relevant_citations array<string>, category string, expected_empty boolean, filters struct<jurisdiction:string,source_type:string,source_slug:string>")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Source manifests from JSON files, one object or a list in each, with a version, no origin but core and models allowed."""
    rows = spark.read.schema(MANIFESTS).option("multiLine", True).json(path)
    return rows.withColumns({"origin": F.lit("core"), "model_use_allowed": F.lit(True), "minimum_documents": F.coalesce("minimum_documents", F.lit(1)), "required_citations": F.coalesce("required_citations", F.array().cast("array<string>"))})


def cases(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """Evaluation cases from a JSON list. An error if there are too few, ids repeat, or one has neither a query nor what is expected of it."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    expected = F.size(F.coalesce("expected_citations", "relevant_citations", F.array().cast("array<string>"))) > 0
    sound = F.col("id").isNotNull() & (F.coalesce("query", "question", F.lit("")) != "") & (expected | F.coalesce("expected_empty", F.lit(False)))
    n, ids, bad = rows.agg(F.count("*"), F.count_distinct("id"), F.count_if(~F.coalesce(sound, F.lit(False)))).first()
    if n < least or ids < n or bad:
        raise ValueError(f"The cases are refused: {n} of at least {least}, {n - ids} repeated ids, {bad} incomplete.")
    return rows


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric column."""
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def synthetic_chunks(spark: SparkSession, n: int, dimension: int = 1536) -> DataFrame:
    """n chunks with one-hot unit vectors, for measuring."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (i == F.col("id") % dimension).cast("float"))
    return spark.range(n).select(F.format_string("chunk-%06d", "id").alias("chunk_id"), F.format_string("repair heat tenant section %d", "id").alias("text"), vector.alias("embedding"))


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the role of property violations; every seventeenth has no inspection date."""
    orders, customer, nation, region = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    places = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(places, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.col("o_orderkey").alias("violation_id"),
            F.col("o_custkey").alias("building_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("class"),
            F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("inspection_date"),
            F.col("r_name").alias("borough"),
            (F.col("o_custkey") % 100).cast("string").alias("house_number"),
            F.concat("c_mktsegment", F.lit(" St")).alias("street_name"),
        )
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the role of chunks: the first line is the title, the source the citation."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("citation"), "text", "lang", "source"
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the role of a usage ledger: an attempt is a user, the amount whole cents."""
    kinds = {"view": "reserve", "error": "uncertain", "purchase": "settle", "signup": "correction"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    status = F.create_map(*(F.lit(x) for x in ("reserve", "reserved", "uncertain", "uncertain", "settle", "settled", "correction", "settled")))[kind]
    amount = F.floor(F.col("value") * 100).cast("decimal(18,8)")
    return table(spark, folder, "events").select(F.col("user_id").alias("attempt_id"), kind.alias("event_type"), "event_id", "ts", amount.alias("amount"), status.alias("status")).filter("event_type IS NOT NULL")
