"""File readers with fixed schemas. Missing optional files give empty tables; malformed roots are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARD = "id long, number string, purchase_type string, status string, subject string, customer string, customer_id long, inn string, nmck double, region string, law string, publication_date string, okpd2_name string, okpd2_code string, files array<struct<name: string, url: string>>, category string, category_reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def code_tree(spark: SparkSession, path: str, key: str = "code_to_path", value: str = "path") -> DataFrame:
    """code and path (or id) from a JSON object of objects; another root is an error."""
    tree = _whole(spark, path).select(F.from_json("value", "map<string,string>").alias("m"), F.substring(F.trim("value"), 1, 1).alias("first"))
    inner = tree.where(F.when(F.col("first") == "{", F.lit(True)).otherwise(F.raise_error(F.lit("the tree must be a JSON object")).cast("boolean")))
    return inner.select(F.explode(F.from_json(F.col("m")[key], "map<string,string>")).alias("code", value))


def eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    """description, expected_fit (clamped to 0..10) from a JSON list, or CSV with a header for any other suffix."""
    schema = "description string, expected_fit double"
    if path.lower().endswith(".json"):
        rows = spark.read.schema(schema).json(path, multiLine=True)
    else:
        rows = spark.read.schema(schema).csv(path, header=True)
    return rows.withColumn("expected_fit", F.least(F.greatest("expected_fit", F.lit(0.0)), F.lit(10.0)))


def score_file(spark: SparkSession, path: str) -> DataFrame:
    """number, score from a JSON object if the text begins with {, else from CSV; blank files give no rows."""
    head = _whole(spark, path).select(F.trim("value").alias("t")).first()
    text = head["t"] if head else ""
    if text.startswith("{"):
        return _whole(spark, path).select(F.explode(F.from_json("value", "map<string,double>")).alias("number", "score"))
    rows = spark.read.schema("number string, score double").csv(path, header=True)
    return rows.withColumn("number", F.trim("number"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The labelled cards of a dataset file; none where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CARD)
    whole = _whole(spark, path).select(F.get_json_object("value", "$.procurements").alias("p"))
    item = f"array<struct<{_struct(CARD)}>>"
    return whole.select(F.explode(F.from_json("p", item)).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    """A column list as the inside of a struct type."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def card_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path, multiLine=True)


def text_document(spark: SparkSession, path: str) -> str:
    """A text that a plan needs as a literal; blank or missing is an error."""
    row = _whole(spark, path).first() if _exists(spark, path) else None
    if row is None or not row["value"].strip():
        raise ValueError(f"{path} is missing or empty")
    return row["value"]


def yaml_settings(path: str) -> dict:
    """A YAML mapping; an empty file is an empty mapping."""
    import yaml  # optional

    with open(path, encoding="utf-8") as file:
        data = yaml.safe_load(file) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} must hold a mapping")
    return data
