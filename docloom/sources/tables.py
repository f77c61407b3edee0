"""Readers of documents, records and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text) of a folder of text files, each as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def described(docs: DataFrame, text: str = "text", fallback: Column | None = None) -> DataFrame:
    """docs with document_id and content_sha1 of the text, and the first `# ` heading or else the fallback as title."""
    headings = F.filter(F.split(F.col(text), "\n"), lambda x: F.rlike(F.trim(x), F.lit("^#[^#]")))
    title = F.nullif(F.trim(F.regexp_replace(F.trim(F.get(headings, F.lit(0))), "^#+[ \t]*", "")), F.lit(""))
    return docs.withColumns(
        {
            "document_id": F.concat(F.lit("doc_"), F.substring(F.sha1(text), 1, 8)),
            "content_sha1": F.sha1(text),
            "title": F.coalesce(title, fallback if fallback is not None else F.lit(None).cast("string")),
        }
    )


def blocks_from_records(records: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """One block for each record that has text: (document_id, block_id, text, position, line_start, line_end)."""
    place = F.row_number().over(Window.partitionBy(document).orderBy(order))
    spoken = records.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("position", place)
    number = F.col("position").cast("int")
    return spoken.select(
        F.col(document).cast("string").alias("document_id"),
        F.format_string("B%04d", "position").alias("block_id"),
        F.trim(F.regexp_replace(F.col(text), "[ \t\n\r]+", " ")).alias("text"),
        number.alias("position"),
        number.alias("line_start"),
        number.alias("line_end"),
    )


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the JSON column parsed by an explicit schema; what does not parse is null."""
    return df.withColumn(column, F.from_json(column, schema))
