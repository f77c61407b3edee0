"""Queries of names, slugs and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.helpers import name_key, sentences, slugify
from docloom.operators.units import paragraph_units
from docloom.sources.tables import table


def sc1_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", slugify("text").alias("slug"))


def sc2_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(name_key("text")).alias("digest"))


def tx8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").withColumn("s", sentences("text"))
    return found.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n")).alias("digest"))


def tx8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents as lines of pages: headings, bullets with and without references, plain lines, in paragraphs of one to four."""
    shapes = [("## Key Points\n", ""), ("- ", " [B0001, B0002]"), ("* ", ""), ("", "."), ("## Notes\n\n", ". [B0007]")]

    def line(x: F.Column, i: F.Column) -> F.Column:
        out = F.lit(None).cast("string")
        for k, (before, after) in enumerate(shapes):
            out = F.when(i % len(shapes) == k, F.concat(F.lit(before), F.trim(x), F.lit(after))).otherwise(out)
        return F.concat(out, F.when(i % 4 == 3, F.lit("\n\n")).otherwise(F.lit("\n")))

    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.array_join(F.transform(F.split("text", "[.]"), line), "").alias("markdown"))
    units = paragraph_units(pages)
    return units.groupBy("page_id", "section").agg(F.count("*").alias("n"), F.countDistinct("paragraph").alias("paragraphs"), F.max("weight").alias("weight"), F.sum(F.length("unit")).alias("chars"))


QUERIES = {"sc1_slugs": sc1_slugs, "sc2_name_keys": sc2_name_keys, "tx8_sentences": tx8_sentences, "tx8_units": tx8_units}

ORACLE_SQL = {
    "sc1_slugs": """
        WITH t AS (
            SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[`''"()\\[\\]{}]', '', 'g'), '[^a-z0-9가-힣]+', '-', 'g'), '-') AS s FROM documents)
        SELECT doc_id, CASE WHEN s = '' THEN 'untitled' WHEN length(s) > 255 THEN left(s, 246) || '-' || left(sha1(s), 8) ELSE s END AS slug FROM t""",
    "sc2_name_keys": """
        SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[-_\\s]+', ' ', 'g'))) AS digest FROM documents""",
}
