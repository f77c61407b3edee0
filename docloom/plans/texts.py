"""Queries of the text functions and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.plans.common import sql_raw_tokens, sql_tokens, sql_without_particle
from docloom.sources import keyed
from docloom.sources.store import shared_dir
from docloom.sources.tables import blocks_from_records, described, table


def sc3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def sc4_query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.retrieval_query(F.col("text")).alias("retrieval_query"))


def sc5_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash"))


def sc7_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.specificity(F.col("text")), 6).alias("bonus"))


def sc8_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.array_sort(tx.number_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(numbers).alias("n_numbers"), F.array_join(numbers, " ").alias("numbers"))


def sc11_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's row count table, every third one without its rule."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "c_mktsegment", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    lines = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rule = F.when(F.col("c_nationkey") % 3 == 0, F.array()).otherwise(F.array(F.lit("|---|---|")))
    text = F.array_join(F.concat(F.array(F.lit("| segment | n |")), rule.cast("array<string>"), F.col("lines")), "\n")
    return lines.select("c_nationkey", tx.is_table(text).alias("is_table"))


def sc13_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("redacted", tx.redact_numbers(F.col("text")))
    found = F.floor((F.length("redacted") - F.length(F.replace("redacted", F.lit(tx.MASK)))) / len(tx.MASK))
    return docs.select("doc_id", found.cast("int").alias("n_masked"), F.md5("redacted").alias("digest"))


def sc6_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL parts as tags, its third one as title and the fourth as alias."""
    parts = F.split("url", "[/?=&.]")
    title, aliases = F.get(parts, F.lit(2)), F.array(F.get(parts, F.lit(3)), F.lit("COM"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tx.clean_tags(parts, title, aliases), "/").alias("tags"))


def tx10_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written after each sentence of a document, some with their document, some twice."""
    number = F.lpad((F.col("i") * 7 % 50).cast("string"), 4, "0")
    ref = F.concat(F.when(F.col("i") % 3 == 0, "d9:").otherwise(""), F.lit("B"), number)
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.]")).alias("i", "part"))
    cited = parts.select("doc_id", "i", F.concat("part", F.lit(" ["), ref, F.lit(", "), F.lit("B0001"), F.lit("]")).alias("cited"))
    texts = cited.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "cited"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["cited"]), ".")
    refs = tx.global_refs(tx.block_refs(text), F.concat(F.lit("d"), F.col("doc_id")))
    return texts.select("doc_id", F.array_join(refs, " ").alias("refs"), F.md5(tx.without_refs(text)).alias("digest"))


def tx11_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the thirtieth word in each document."""
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.get(F.split("text", "[ \n]+"), F.lit(29)), F.lit("nowhere"))
    return docs.select("doc_id", F.md5(tx.excerpt(name, F.col("text"))).alias("digest"))


def io1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n# Title "), "doc_id", F.lit("\n"), "text")).otherwise(F.col("text")))
    return described(docs, "text", F.concat(F.lit("file "), "doc_id")).select("doc_id", "document_id", "title", "content_sha1")


def io2_chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_records(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def io5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of entries by user, merged into a folder in three loads: the newest value stays, tags are united."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), e.alias("version"), "value", F.array(F.col("event_type"), F.concat(F.lit("t"), e % 5), F.lit(None).cast("string")).alias("tags"))
    path = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    for k in (2, 0, 1):
        keyed.upsert(path, rows.filter(F.col("version") % 3 == k), ["key"], "version", ("tags",), buckets=16)
    return keyed.current(spark, path).select("key", "version", "value", F.array_join("tags", ",").alias("tags"))


def io6_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' blocks, loaded whole and then a fourth of the documents anew; every tenth is empty by then."""
    blocks = blocks_from_records(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("document_id", "block_id", "text")
    number = F.col("document_id").cast("bigint")
    loaded = blocks.filter(number % 4 == 0).select("document_id").distinct()
    new = blocks.filter((number % 4 == 0) & (number % 10 != 0) & (F.col("block_id") != "B0002")).withColumn("text", F.concat(F.lit("new "), "text"))
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    keyed.replace_documents(path, blocks.select("document_id"), blocks, buckets=16)
    keyed.replace_documents(path, loaded, new, buckets=16)
    return keyed.current(spark, path).groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("chars"))


QUERIES = {
    "sc3_tokens": sc3_tokens, "sc4_query_rewrite": sc4_query_rewrite, "sc5_content_hash": sc5_content_hash, "sc6_tags": sc6_tags,
    "sc7_specificity": sc7_specificity, "sc8_numbers": sc8_numbers, "sc11_tables": sc11_tables, "sc13_redacted": sc13_redacted,
    "tx10_refs": tx10_refs, "tx11_excerpts": tx11_excerpts, "io1_documents": io1_documents, "io2_chat_blocks": io2_chat_blocks,
    "io5_upsert": io5_upsert, "io6_replace": io6_replace,
}

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_COUNT = lambda pattern, flags="": f"len(regexp_extract_all(text, '{pattern}'))"

ORACLE_SQL = {
    "sc3_tokens": f"""
        WITH t AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)
        SELECT doc_id, len(w)::int AS n_tokens, len(list_distinct(w))::int AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM t""",
    "sc4_query_rewrite": f"""
        WITH t AS (SELECT doc_id, text, list_filter(list_transform({sql_raw_tokens('text')}, lambda t: CASE WHEN regexp_matches(t, '[가-힣]') THEN {sql_without_particle('t')} ELSE t END), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS w FROM documents),
        first AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t) GROUP BY ALL),
        ranked AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM first),
        joined AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS q FROM ranked WHERE k <= 8 GROUP BY doc_id)
        SELECT doc_id, coalesce(q, text) AS retrieval_query FROM documents LEFT JOIN joined USING (doc_id)""",
    "sc5_content_hash": """
        SELECT doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) AS content_hash FROM documents""",
    "sc6_tags": """
        WITH t AS (SELECT page_id, regexp_split_to_array(url, '[/?=&.]') AS w FROM pages),
        tidy AS (
            SELECT page_id, i, trim(regexp_replace(replace(x, ',', ' '), '[ \\t\\n\\r]+', ' ', 'g')) AS tag, w
            FROM (SELECT *, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t)),
        fresh AS (
            SELECT *, row_number() OVER (PARTITION BY page_id, lower(tag) ORDER BY i) AS dup FROM tidy
            WHERE tag <> '' AND lower(tag) NOT IN (lower(trim(w[3])), coalesce(lower(trim(w[4])), ''), 'com')),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM fresh WHERE dup = 1)
        SELECT page_id, coalesce(string_agg(tag, '/' ORDER BY k) FILTER (k <= 3), '') AS tags FROM pages LEFT JOIN ranked USING (page_id) GROUP BY page_id""",
    "sc7_specificity": f"""
        SELECT doc_id, round((least(0.8, least(0.6, {_COUNT(r'\b[A-Z]\s*[:(]')} * 0.08
            + {_COUNT(r'[0-9]+(?:\.[0-9]+)?\s*[-–]\s*[0-9]+(?:\.[0-9]+)?')} * 0.08
            + {_COUNT(r'(?i)[0-9]+(?:\.[0-9]+)?\s*(?:mm|°|%|rpm|kw|v)\b')} * 0.04 + {_COUNT('[;,]')} * 0.01)
            + CASE WHEN regexp_matches(text, '(?i)\\b(example|table|수준|범위|정의|조합)\\b') THEN 0.15 ELSE 0 END))::double, 6) AS bonus FROM documents""",
    "sc8_numbers": r"""
        WITH t AS (
            SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(
                regexp_extract_all(text, '(?:^|[^A-Za-z0-9.,])((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:\s*[만천억])?)', 1),
                lambda n: regexp_replace(n, '[,\s]', '', 'g')), lambda n: length(n) > 1))) AS w FROM documents)
        SELECT doc_id, len(w)::int AS n_numbers, array_to_string(w, ' ') AS numbers FROM t""",
    "sc11_tables": """
        SELECT c_nationkey, c_nationkey % 3 <> 0 AND count(DISTINCT c_mktsegment) >= 1 AS is_table FROM customer GROUP BY c_nationkey""",
    "tx10_refs": """
        WITH parts AS (
            SELECT doc_id, i - 1 AS i, p FROM (
                SELECT doc_id, unnest(w) AS p, generate_subscripts(w, 1) AS i
                FROM (SELECT doc_id, string_split(text, '.') AS w FROM documents))),
        refs AS (
            SELECT doc_id, 2 * i AS k, CASE WHEN i % 3 = 0 THEN 'd9:' ELSE 'd' || doc_id || ':' END || 'B' || lpad((i * 7 % 50)::varchar, 4, '0') AS r FROM parts
            UNION ALL SELECT doc_id, 2 * i + 1, 'd' || doc_id || ':B0001' FROM parts),
        firsts AS (SELECT doc_id, r, min(k) AS k FROM refs GROUP BY ALL)
        SELECT doc_id, refs, md5(trim(string_agg(regexp_replace(p, '[ \\t]*$', ''), '.' ORDER BY i))) AS digest
        FROM parts JOIN (SELECT doc_id, string_agg(r, ' ' ORDER BY k) AS refs FROM firsts GROUP BY doc_id) USING (doc_id) GROUP BY ALL""",
    "tx11_excerpts": """
        WITH t AS (
            SELECT doc_id, coalesce(regexp_split_to_array(text, '[ \\n]+')[30], 'nowhere') AS name, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS flat FROM documents),
        f AS (SELECT *, CASE WHEN trim(name) <> '' THEN strpos(lower(flat), lower(trim(name))) END AS pos FROM t),
        s AS (SELECT *, greatest(length(regexp_extract(left(flat, (greatest(pos, 1) - 1)::int), '(?s)^(.*[.?!] )', 1)), pos - 151) AS start FROM f)
        SELECT doc_id, md5(CASE WHEN pos > 0 THEN trim(substring(flat, start + 1, 300)) ELSE left(flat, 300) END) AS digest FROM s""",
    "io1_documents": """
        WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'intro' || chr(10) || '# Title ' || doc_id || chr(10) || text ELSE text END AS t FROM documents)
        SELECT doc_id, 'doc_' || left(sha1(t), 8) AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' ELSE 'file ' END || doc_id AS title, sha1(t) AS content_sha1 FROM t""",
    "io2_chat_blocks": """
        WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::int AS position FROM conversations WHERE trim(coalesce(text, '')) <> '')
        SELECT conv_id::varchar AS document_id, printf('B%04d', position) AS block_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text,
               position, position AS line_start, position AS line_end FROM t""",
    "io5_upsert": """
        WITH t AS (SELECT user_id, unnest([event_type, 't' || event_id % 5]) AS tag FROM events),
        u AS (SELECT user_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t WHERE tag IS NOT NULL GROUP BY user_id)
        SELECT user_id AS key, max(event_id) AS version, arg_max(value, event_id) AS value, any_value(tags) AS tags FROM events JOIN u USING (user_id) GROUP BY user_id""",
    "io6_replace": """
        WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE trim(coalesce(text, '')) <> ''),
        b AS (SELECT conv_id, p, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM t),
        r AS (SELECT conv_id % 4 = 0 AS again, * FROM b WHERE NOT (conv_id % 4 = 0 AND conv_id % 10 = 0))
        SELECT conv_id::varchar AS document_id, count(*) AS n_blocks, sum(length(text) + CASE WHEN again THEN 4 ELSE 0 END)::bigint AS chars
        FROM r WHERE NOT again OR p <> 2 GROUP BY conv_id""",
}
