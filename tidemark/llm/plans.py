"""The operators bound to the driver tables: one registered query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, htmltext, lines, pieces, quality, repeats, sharding, simhash, toxicity, urls, vectorcodes, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


@query("op1_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shuffled_shards(table(spark, folder, "documents"), shards=8)
    text = F.col("record.text")
    return out.select("record.doc_id", sharding.record_size("record.text").alias("size"), F.crc32(text).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_SPLIT = r"[\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP2_FLAGS = rf"""
SELECT rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND 1000 * word_chars >= 2000 * n_words AND 1000 * word_chars <= 15000 * n_words
       AND 1000 * n_symbols <= 200 * n_words AND 1000 * n_shouts <= 100 * n_words
       AND 1000 * n_stop_words >= 50 * n_words AND 1000 * n_dup_lines <= 500 * n_lines AS kept
FROM (
  SELECT b.rid, b.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{_SPLIT}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda w: ends_with(w, '!!')))::BIGINT AS n_shouts,
         len(list_filter(ws, lambda w: rtrim(lower(w), '.,;:!?') IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM base b LEFT JOIN (
    SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
      SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (
        SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM (
          SELECT rid, unnest(range(1, len(ws) - 6)) AS i,
                 unnest(list_transform(range(1, len(ws) - 6), lambda i: hash(ws[i:i+7]))) AS w
          FROM base WHERE len(ws) >= 8)) WHERE c > 1)
    GROUP BY rid) r ON b.rid = r.rid)
"""
OP2_BASE = rf"""
SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
       list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda w: w <> '') AS ws,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
FROM documents
"""


@query("op2_quality_rules", f"""
WITH base AS MATERIALIZED ({OP2_BASE}), flags AS ({OP2_FLAGS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM flags""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_flags(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     m AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trips(table(spark, folder, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = htmltext.main_texts(table(spark, folder, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op6_url_filters")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_suffix_array")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = "list_filter(regexp_split_to_array(" + _FOLD + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP8_HITS = f"""
bw AS MATERIALIZED (SELECT item_id, {_ITEM_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
bg AS MATERIALIZED (
  SELECT DISTINCT item_id, n, hash(list_slice(ws, i, i + n - 1)) AS g FROM (
    SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM (SELECT item_id, ws, least(len(ws), 13) AS n FROM bw WHERE len(ws) > 0))),
dw AS MATERIALIZED (SELECT rid, doc_id, {_ITEM_WORDS.format("t")} AS ws FROM docs),
dg AS (
  SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i,
         unnest(list_transform(range(1, len(ws) - n + 2), lambda i: hash(list_slice(ws, i, i + n - 1)))) AS g
  FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n),
met AS MATERIALIZED (SELECT rid, i, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
hit AS (
  SELECT dw.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256
  FROM dw
  LEFT JOIN (SELECT rid, count(DISTINCT w) AS h FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM met) GROUP BY rid) a ON dw.rid = a.rid
  LEFT JOIN (SELECT rid, count(*) AS k, string_agg(s, ',' ORDER BY s) AS ids
             FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM met) GROUP BY rid) b ON dw.rid = b.rid)
"""


@query("op8_decontamination", f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {OP8_HITS}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM hit""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.report(hits)


@query("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _lloyd_sql(rounds: int = 2) -> str:
    """The rounds unrolled: every part meets every entry of its codebook."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    nearest = "SELECT rid, part, any_value(x) AS x, min({{'d': {0}, 'e': e}}) AS best FROM x JOIN book{1} USING (part) GROUP BY rid, part"
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.format(distance, r)})")
        steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT part, e, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM (
      SELECT part, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY 1, 2, 3)
    GROUP BY part, e) m ON b.part = m.part AND b.e = m.e)""")
    return ",\n".join([*steps, f"coded AS MATERIALIZED ({nearest.format(distance, rounds)})"])


@query("op11_vector_codes", f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT rid, p AS part, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM x WHERE rid <= 64),
{_lloyd_sql()},
whole AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM coded GROUP BY rid),
out AS (SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error FROM whole JOIN kept USING (rid)),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM out, digest""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vectorcodes.vector_codes(table(spark, folder, "embeddings"))
    return vectorcodes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.books_digest(books)).alias("codebooks_sha256"))


@query("op12_line_dedup", f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS MATERIALIZED (
  SELECT rid, doc_id, i, line, {_FOLD.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs)),
crowded AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT rid, lines.doc_id, i, line, coalesce(lines.doc_id <> top, false) AS goes FROM lines LEFT JOIN crowded USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY rid""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.deduplicated_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op13_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d)),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN vs USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN vs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
