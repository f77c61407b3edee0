"""Queries of checks on texts: glyph encoding, personal data and secrets, links to elsewhere. No twins: tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import safety
from docloom.functions import text as tx
from docloom.sources.tables import table

C = F.col


def sc10_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a quarter of them moved down by the glyph shift."""
    shifted = F.translate("text", "".join(map(chr, range(tx.GLYPH_SHIFT + 3, 123))), "".join(map(chr, range(3, 123 - tx.GLYPH_SHIFT))))
    text = F.when(C("doc_id") % 4 == 0, shifted).otherwise(C("text"))
    shown = table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("glyphs", tx.is_glyph_encoded(C("text")))
    return shown.select("doc_id", "glyphs", tx.is_suspicious(C("text"), C("glyphs")).alias("suspicious"))


def sc12_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an address, a number and a field made from the customer of their number below, as findings by category."""
    owner = table(spark, sf_dir, "customer").select(C("c_custkey").alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("mail "), F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.lit("@example.com")), F.concat(F.lit("phone: 010-"), F.lpad(C("c_custkey") % 10000, 4, "0"), F.lit("-"), F.lpad(C("c_custkey") * 31 % 10000, 4, "0")), F.concat(F.lit("card "), F.lit("4"), F.lpad(C("c_custkey") * 7919, 15, "0"))).alias("note"))
    texts = table(spark, sf_dir, "documents").join(owner, "doc_id", "left").select("doc_id", F.concat_ws("\n", "text", "note").alias("text"))
    found = texts.select("doc_id", F.explode(safety.findings("text")).alias("f"))
    return found.groupBy("f.category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.sum(C("f.end") - C("f.start")).alias("chars"))


def sc14_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made of pages: their own address in a link, an image and brackets; addresses with an even number are kept."""
    text = F.concat(F.lit("[page]("), "url", F.lit(") ![i]("), "url", F.lit("/i.png) [here](#a) `[c]("), "url", F.lit(")`"))
    pages = table(spark, sf_dir, "pages").select("url", text.alias("text"), F.when(F.length("url") % 2 == 0, F.array("url")).alias("keep"))
    return pages.select("url", safety.neutral_links("text", "keep").alias("text"), F.array_join(safety.outside_urls("text"), " ").alias("outside"))


QUERIES = {f.__name__: f for f in (sc10_suspicious, sc12_findings, sc14_links)}
ORACLE_SQL: dict[str, str] = {}
