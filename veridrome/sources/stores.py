"""Sources: texts, audit logs, registers and dictionaries, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = (
    "entry_id string, timestamp timestamp, event_type string, framework_id string, content_hash string, compliance_result boolean, compliance_score double, metadata map<string,string>, "
    "violations array<struct<type:string,rule_id:string,severity:string,matched_content:string,context:string>>, user_id string, session_id string, request_id string"
)
SOURCE = "id string, name string, url string, type string, country string, region string, frameworks array<string>, keywords array<string>, parser_config string, active boolean, last_checked string"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: (path, text); undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries from JSON lines or one JSON a file; the schema is given, so nothing is inferred."""
    return spark.read.schema(AUDIT).json(path)


def entry(log: DataFrame, entry_id: str) -> DataFrame:
    """Point lookup (the filter reaches the scan)."""
    return log.where(F.col("entry_id") == entry_id).limit(1)


def register(spark: SparkSession, path: str) -> DataFrame:
    """Sources from JSON configuration, with defaults filled."""
    s = spark.read.schema(SOURCE).option("multiLine", True).json(path)
    return s.withColumns({
        "type": F.coalesce("type", F.lit("web")),
        "active": F.coalesce("active", F.lit(True)),
        "frameworks": F.coalesce("frameworks", F.array().cast("array<string>")),
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
    })


def decode_lists(df: DataFrame, *columns: str) -> DataFrame:
    """JSON text columns as arrays of strings; unreadable text is null."""
    return df.withColumns({c: F.from_json(c, "array<string>") for c in columns})


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON dictionary of surfaces as (surface, id, type)."""
    return spark.read.schema("surface string, id string, type string").option("multiLine", True).json(path)


def rule_table(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """A rule table from literal rows (id, kind, severity, pattern)."""
    return spark.createDataFrame(rows, "id string, kind string, severity string, pattern string")
