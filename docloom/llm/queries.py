"""The registered queries of the numbered operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bytebpe import decode, encode
from docloom.llm.divergence import divergence
from docloom.llm.jaccard import jaccard_components
from docloom.llm.kdtree import top_k
from docloom.llm.language import fit, identify, in_training
from docloom.llm.linededup import dedup_lines
from docloom.llm.mixing import mix_sources
from docloom.llm.packing import pack
from docloom.llm.quality import GAMMA, METRICS, NOISE, OF_ALL, OF_LANGUAGE, REACH, ZERO_BUCKET, judged, measure, thresholds
from docloom.llm.resampling import importance_resample
from docloom.llm.revisit import capture_log, resolve_revisits
from docloom.llm.substring import dedup_substrings
from docloom.llm.wordpiece import count_pieces
from docloom.sources.store import written

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, "doc_id", "text", "lang")
    held_out = F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(capture_log(_table(spark, sf_dir, "pages")))
    names = ("date", "etag", "content-length", "cache-control")
    return found.select("record_id", "url_key", "outcome", "response_id", *[F.col("headers")[n].alias(n.replace("-", "_")) for n in names])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_pieces(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_words", "n_pieces", "n_unknown")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = written(measure(docs).drop("text"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(measured, thresholds(measured)).select(*columns)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_sources(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    encoded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return decode(encoded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quality_sql() -> str:
    value = f"CASE WHEN {{b}} = {ZERO_BUCKET} THEN 0.0 ELSE 2 * pow({GAMMA}, {{b}}) / ({GAMMA} + 1) END"
    metrics = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, CASE WHEN {d[1]} > 0 THEN {d[0]}::double / {d[1]} ELSE 0.0 END AS x FROM measured WHERE NOT base_failed"
        for m, d in METRICS.items()
    )
    most, least = "f_{m}.high * {d}", "greatest(f_{m}.low * {d}, 0.0)"
    above = f"coalesce({{n}} > {most} + (1 + {NOISE} * sqrt(greatest({most}, 1.0))), false)"
    below = f"coalesce({{n}} < {least} - (1 + {NOISE} * sqrt(greatest({least}, 1.0))), false)"
    tests = [t.format(m=m, n=d[0], d=d[1]) for m, d in METRICS.items() for t, use in ((below, d[2]), (above, d[3])) if use]
    beyond = " OR ".join(tests)
    joins = " ".join(
        f"LEFT JOIN fences f_{m} ON f_{m}.metric = '{m}' AND f_{m}.lang IS NOT DISTINCT FROM d.lang AND f_{m}.source IS NOT DISTINCT FROM d.source"
        for m in METRICS
    )
    return f"""
        WITH base AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        grams AS (
            SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base)),
        twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM grams JOIN twice USING (doc_id, g), range(8) AS r(k) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base)
            WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        measured AS (
            SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   length(regexp_replace(t, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks,
                   coalesce(list_max(map_values(list_aggregate(w, 'histogram'))), 0)::bigint AS n_top, len(list_distinct(w)) AS n_distinct,
                   len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
                   len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
            FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
        metrics AS ({metrics}),
        sketch AS (
            SELECT lang, source, metric, count(*) AS n,
                   CASE WHEN x > 0 THEN ceil(ln(x) / ln({GAMMA}))::int ELSE {ZERO_BUCKET} END AS bucket
            FROM metrics GROUP BY ALL),
        by_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
        overall AS (SELECT metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
        groups AS (
            SELECT DISTINCT s.lang, source, s.metric, n_lang, n_all FROM sketch s
            JOIN (SELECT lang, metric, sum(n) AS n_lang FROM sketch GROUP BY ALL) l ON l.lang IS NOT DISTINCT FROM s.lang AND l.metric = s.metric
            JOIN (SELECT metric, sum(n) AS n_all FROM sketch GROUP BY ALL) a ON a.metric = s.metric),
        parts AS (
            SELECT g.lang, g.source, g.metric, bucket, n * n_lang * n_all AS w FROM groups g
            JOIN sketch s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.metric = g.metric
            UNION ALL
            SELECT g.lang, source, g.metric, bucket, n * {OF_LANGUAGE} * n_all FROM groups g
            JOIN by_lang s ON s.lang IS NOT DISTINCT FROM g.lang AND s.metric = g.metric
            UNION ALL
            SELECT lang, source, g.metric, bucket, n * {OF_ALL} * n_lang FROM groups g JOIN overall s ON s.metric = g.metric),
        weights AS (SELECT lang, source, metric, bucket, sum(w) AS w FROM parts GROUP BY ALL),
        placed AS (
            SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto,
                   sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM weights),
        cuts AS (
            SELECT lang, source, metric, min(bucket) FILTER (upto * 10 >= total * 2) AS b2,
                   min(bucket) FILTER (upto * 10 >= total * 5) AS b5, min(bucket) FILTER (upto * 10 >= total * 8) AS b8 FROM placed GROUP BY ALL),
        quantiles AS (
            SELECT lang, source, metric, {value.format(b="b2")} AS under, {value.format(b="b5")} AS mid, {value.format(b="b8")} AS over_ FROM cuts),
        fences AS (
            SELECT lang, source, metric, mid - {REACH} * greatest(mid - under, mid * ({GAMMA} - 1)) AS low,
                   mid + {REACH} * greatest(over_ - mid, mid * ({GAMMA} - 1)) AS high FROM quantiles)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT ({beyond}) AS kept
        FROM measured d {joins}
    """


_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM split WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
            WHERE 100 * c >= 90 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """,
    "op3_warc_revisits": r"""
        WITH visits AS (
            SELECT page_id AS p, url AS u, html, v, page_id * 3 + v * 1000 AS time, page_id % 3 = 0 AS changed FROM pages, range(4) AS r(v)),
        kinds AS (
            SELECT *, CASE WHEN v = 0 OR (v = 2 AND changed) THEN 'response' ELSE 'revisit' END AS kind,
                   sha1(CASE WHEN v >= 2 AND changed THEN html || '+' ELSE html END) AS d FROM visits),
        records AS (
            SELECT p * 4 + v AS record_id, time, kind, p, v, html,
                   CASE v WHEN 1 THEN u || '#again' WHEN 3 THEN regexp_replace(u, '^https?://', 'HTTPS://') ELSE u END AS url,
                   CASE WHEN v = 1 AND p % 4 = 0 THEN '"stale"' WHEN v = 1 THEN 'W/"' || d[1:12] || '"'
                        WHEN kind = 'response' THEN '"' || d[1:12] || '"' END AS etag,
                   CASE WHEN kind = 'response' OR v = 2 THEN 'day ' || p % 7 END AS last_modified,
                   CASE WHEN kind = 'response' OR (v = 3 AND p % 5 <> 0) THEN d END AS digest FROM kinds),
        bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM records),
        split AS (
            SELECT *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS place,
                   substring(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1) AS rest FROM bare),
        keyed AS (
            SELECT *, regexp_replace(regexp_replace(place, '^(http://[^/?]*):80$', '\1'), '^(https://[^/?]*):443$', '\1')
                || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                    rest, '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS url_key FROM split),
        found AS (
            SELECT x.*, y.record_id AS of, y.etag AS of_etag, y.last_modified AS of_modified, y.digest AS of_digest, length(y.html) AS of_length,
                   row_number() OVER (PARTITION BY x.record_id ORDER BY y.time DESC NULLS LAST, y.record_id DESC) AS k
            FROM keyed x LEFT JOIN keyed y
              ON y.kind = 'response' AND x.url_key = y.url_key AND (y.time < x.time OR (y.time = x.time AND y.record_id < x.record_id))
            WHERE x.kind = 'revisit'),
        judged AS (
            SELECT *, CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM regexp_replace(of_etag, '^W/', '')
                           WHEN last_modified IS NOT NULL THEN last_modified IS NOT DISTINCT FROM of_modified
                           WHEN digest IS NOT NULL THEN digest IS NOT DISTINCT FROM of_digest END AS agrees
            FROM found WHERE k = 1),
        named AS (
            SELECT *, CASE WHEN of IS NULL THEN 'no_response' WHEN agrees IS NULL THEN 'unvalidated'
                           WHEN agrees THEN 'resolved' ELSE 'mismatch' END AS outcome FROM judged)
        SELECT record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN of END AS response_id,
               CASE WHEN outcome = 'resolved' THEN 't' || time END AS date,
               CASE WHEN outcome = 'resolved' THEN coalesce(etag, of_etag) END AS etag,
               CASE WHEN outcome = 'resolved' THEN of_length::varchar END AS content_length,
               CASE WHEN outcome = 'resolved' THEN 'max-age=' || (p % 100 + v) END AS cache_control
        FROM named
    """,
    "op5_substring_dedup": f"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
        twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        covered AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN twice USING (h), range(35) AS r(k)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split)
        SELECT d.doc_id, count(word) AS n_words, count(word) FILTER (c.i IS NOT NULL) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '')) AS kept_sha256
        FROM documents d LEFT JOIN words x USING (doc_id) LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.i = x.i
        GROUP BY d.doc_id
    """,
    "op7_quality_rules": _quality_sql(),
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        asked AS (SELECT vec_id, arg_min(e, embedding) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
            FROM asked q, v c WHERE c.vec_id <> q.vec_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS k FROM lines),
        repeated AS (
            SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        judged AS (SELECT l.*, r.first IS NOT NULL AND l.doc_id > r.first AS gone FROM keyed l LEFT JOIN repeated r USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_importance_resampling": f"""
        WITH RECURSIVE steps AS (
            SELECT i::bigint AS i, i::bigint AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
        texts AS (
            SELECT 'own' AS side, doc_id, row_number() OVER () AS r, text FROM documents
            UNION ALL SELECT 'target', NULL, NULL, text FROM benchmark),
        words AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        features AS (
            SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
        named AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)),
        bytes AS (
            SELECT f, list_transform(range(1, length(x), 2), lambda i:
                16 * (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) AS b FROM named),
        buckets AS (
            SELECT f, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM bytes, crc_table),
        counts AS (
            SELECT bucket, (count(*) FILTER (side = 'own'))::double AS s, (count(*) FILTER (side = 'target'))::double AS t
            FROM features JOIN buckets USING (f) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint AS gain
            FROM counts, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts)),
        weights AS (
            SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::bigint AS weight
            FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'own' GROUP BY r),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h
            FROM words LEFT JOIN weights USING (r) WHERE side = 'own'),
        noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM scored),
        ranked AS (
            SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k,
                   count(*) OVER (PARTITION BY n_words >= 20) AS n FROM noisy)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * n // 100 THEN k END AS rank FROM ranked
    """,
    "op13_source_divergence": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        langs AS (SELECT lang, sum(n)::hugeint + 5 * count(*) AS m, count(*) AS v FROM kept GROUP BY lang),
        sizes AS (
            SELECT g.lang, g.source, (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.lang = g.lang AND c.source = g.source)::hugeint + 5 * v AS m
            FROM groups g JOIN langs USING (lang)),
        cells AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // s.m AS p,
                   1 + (1000000000::hugeint * (k.n + 5)) // l.m AS q
            FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::bigint FROM cells WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
