"""Sources and sinks: JSON lines, whole-file lookup tables, text files, and the batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped. strict: a line that is no object fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def lookup(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file with one JSON object; value: the type of its entries."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .txt files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def strict_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of the lines that are not blank; a line that is no JSON object fails the job with its file and number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    rows = files.where(F.trim("value") != "").select("path", (F.col("n") + 1).alias("line"), "value")
    is_object = F.coalesce(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.lit(False))
    checked = F.when(is_object, F.col("value")).otherwise(F.raise_error(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object"))))
    return rows.withColumn("value", checked)


def dumps_jsonl(df: DataFrame) -> DataFrame:
    """(value): each row as a line of JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def preview(df: DataFrame, order: str, path: str, rows: int = 200) -> None:
    """The first `rows` rows as one file of JSON lines."""
    df.orderBy(order).limit(rows).coalesce(1).write.mode("errorifexists").json(path)


def extra_documents(base: DataFrame, extra: DataFrame, order: str) -> DataFrame:
    """Base and extra documents: of an id the first extra one by `order`; the base stays as it is.

    search_text falls back to clean_text. A blank id or clean_text fails the job.
    """
    clean = F.coalesce(F.trim("clean_text"), F.lit(""))
    bad = (F.coalesce(F.trim("id"), F.lit("")) == "") | (clean == "")
    text = F.coalesce(F.nullif(F.trim("search_text"), F.lit("")), clean) if "search_text" in extra.columns else clean
    checked = extra.where(F.assert_true(~bad, F.lit("an extra document lacks its id or text")).isNull()).withColumn("search_text", text)
    first = checked.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n")
    return base.unionByName(first, allowMissingColumns=True)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question) of a text file with one on each line."""
    return spark.read.text(path).select(F.trim("value").alias("question")).where("question != ''")


def index_metadata(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: documents, distinct ids, characters."""
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(key).alias("ids"), F.sum(F.length(text)).alias("characters"))
