"""Grades of converted documents: sentences that are missing or out of order, and table rows that are lost."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags, and the signs that two conversions of one text may set differently.
TAG, SIGNS = r"</?[A-Za-z][^>]*>", r"(?U)[\s*_`#>|\\\-−–—~∼・•·]+"
HTML_ROW, HTML_CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"


def _unescaped(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [t and html.unescape(unicodedata.normalize("NFKC", t)) for t in texts], na_action="ignore")


def bare(texts: Column | str) -> Column:
    """An array of texts without markup, blanks, dashes, bullets and case."""
    return F.transform(F.pandas_udf(_unescaped, "array<string>")(texts), lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, TAG, ""), SIGNS, "")))


def table_rows(markdown: Column) -> Column:
    """The rows of a text's Markdown and HTML tables, cells joined."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    rows = F.regexp_extract_all(markdown, F.lit(HTML_ROW), F.lit(1))
    return F.concat(lines, F.transform(rows, lambda r: F.array_join(F.regexp_extract_all(r, F.lit(HTML_CELL), F.lit(1)), "")))


def conversion_grades(results: DataFrame, sentences: DataFrame, rows: DataFrame) -> DataFrame:
    """results (id, run, type, status, seconds, markdown) with what they lack of sentences (id, position, sentence) and of table rows
    (id, cells): missing, order_errors, table_errors, sentences, table_rows and ok. A result that is not completed is not ok and
    has no counts. Order errors are found neighbours whose places are reversed; a row is there if one row of the result holds its
    cells in order. A null text holds nothing."""
    key = ["id", "run"]
    done = results.filter("status = 'completed'").select(
        *key, bare(F.array(F.coalesce("markdown", F.lit(""))))[0].alias("text"), bare(table_rows(F.coalesce("markdown", F.lit("")))).alias("given")
    )
    gold = sentences.select("id", "position", bare(F.array("sentence"))[0].alias("sentence"))
    found = done.select(*key, "text").join(gold, "id").select(*key, "position", F.nullif(F.expr("locate(sentence, text)"), F.lit(0)).alias("place"))
    before = F.lag("place").over(Window.partitionBy(*key).orderBy("position"))
    turned = found.filter("place IS NOT NULL").withColumn("turned", before > F.col("place")).groupBy(*key).agg(F.count_if("turned").alias("order_errors"))
    lacking = found.groupBy(*key).agg(F.count("*").alias("sentences"), F.count_if(F.col("place").isNull()).alias("missing"))

    wanted = rows.select("id", F.filter(bare("cells"), lambda c: c != "").alias("cells"))
    in_order = "exists(given, r -> aggregate(cells, 1, (p, c) -> CASE WHEN p = 0 OR locate(c, r, p) = 0 THEN 0 ELSE locate(c, r, p) + length(c) END) > 0)"
    tables = done.select(*key, "given").join(wanted, "id").groupBy(*key).agg(F.count("*").alias("table_rows"), F.count_if(~F.expr(in_order)).alias("table_errors"))

    counts = ["missing", "order_errors", "table_errors", "sentences", "table_rows"]
    graded = done.select(*key).join(lacking, key, "left").join(turned, key, "left").join(tables, key, "left").fillna(0, counts)
    ok = (F.col("missing") + F.col("order_errors") + F.col("table_errors")) == 0
    return results.drop("markdown").join(graded, key, "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def grade_summary(grades: DataFrame) -> DataFrame:
    """Grades by type, and all together with a null type; rates are of the sentences and table rows of completed runs."""
    share = lambda lost, of: F.when(F.sum(of) > 0, F.round(1 - F.sum(lost) / F.sum(of), 4))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("missing", "order_errors", "table_errors", "sentences", "table_rows")]
    return grades.rollup("type").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("ok").alias("ok"), *sums,
        F.round(F.avg(F.when(F.col("status") == "completed", F.col("seconds"))), 1).alias("seconds"),
        share("missing", "sentences").alias("restored"), share("table_errors", "table_rows").alias("table_restored"),
    )
