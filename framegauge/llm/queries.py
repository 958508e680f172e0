"""Registered queries of this subpackage: name -> (query, SQL with the same result or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.session import checkpointed
from framegauge.llm.bpe_codec import bpe_roundtrip
from framegauge.llm.conversation_repair import conversation_digests, repair_conversations
from framegauge.llm.host_quality import quality_measures, with_host_verdicts
from framegauge.llm.line_dedup import line_dedup
from framegauge.llm.metric_join import metric_range_join
from framegauge.llm.sequences import pieces_of
from framegauge.llm.sharding import shuffle_into_shards
from framegauge.llm.simhash_dedup import simhash_groups
from framegauge.llm.spelling_variants import counted_runs, spelling_variants
from framegauge.llm.token_counts import token_counts
from framegauge.llm.token_matrix import token_matrix
from framegauge.llm.toxicity import fit_toxicity, held_out, toxic_passages
from framegauge.llm.url_filters import temporal_url_filter, url_host, url_section
from framegauge.llm.window_packing import window_pack

TOXIC_SCORE = 0.7
SHARDS = 40
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packing of all documents; one row per piece."""
    rows = token_matrix(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces_of(
        rows, "ids", ("positions_crc32", lambda s: F.crc32(F.substring(
            F.col("positions"), (s["offset"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")))),
        ("n_segments", lambda s: (F.size("cu_seqlens") - 1).cast("bigint")))


def op2_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving packing of all documents; one row per piece."""
    rows = window_pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces_of(rows, "ids", ("padded_length", lambda s: F.col("padded_length")))


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_range_join(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN counted c ON c.a = vec_id LEFT JOIN least_of r ON r.a = vec_id"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return token_counts(docs, TOKENIZER, keep_text=False).select(
        "doc_id", "n_bytes", "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"),
                                   F.octet_length("text").cast("bigint").alias("kept_bytes"))


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP5_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
long AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, k) AS place FROM (SELECT *, {_WORDS.format('line')} AS w FROM lines) WHERE len(w) >= 1),
classes AS (SELECT w, min(place) AS first FROM long GROUP BY w),
fuzzy AS (SELECT first, w, len(w) AS n, w[1:5] AS head, w[-5:] AS tail FROM classes WHERE len(w) >= 10),
pairs AS (
  SELECT a.first, CASE WHEN a.n >= b.n THEN a.w ELSE b.w END AS x, CASE WHEN a.n >= b.n THEN b.w ELSE a.w END AS y
  FROM fuzzy a JOIN fuzzy b ON a.head = b.head WHERE b.first < a.first AND abs(a.n - b.n) <= 1
  UNION ALL
  SELECT a.first, CASE WHEN a.n >= b.n THEN a.w ELSE b.w END, CASE WHEN a.n >= b.n THEN b.w ELSE a.w END
  FROM fuzzy a JOIN fuzzy b ON a.tail = b.tail WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
differing AS (
  SELECT first, x, y, coalesce(list_min(list_filter(range(1, len(y) + 1), lambda i: x[i] <> y[i])), len(x)) AS p FROM pairs),
near AS (SELECT DISTINCT first FROM differing WHERE x[p + 1:] = CASE WHEN len(x) = len(y) THEN y[p + 1:] ELSE y[p:] END),
gone AS (
  SELECT doc_id, k FROM long JOIN classes USING (w) LEFT JOIN near ON near.first = classes.first
  WHERE near.first IS NOT NULL OR place > classes.first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS t
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, md5(t) AS kept_md5,
  strlen(t)::BIGINT AS kept_bytes FROM documents d LEFT JOIN kept USING (doc_id)"""


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measures = checkpointed(quality_measures(docs).drop("text"))
    return with_host_verdicts(measures).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(list_aggregate([''] || w, 'string_agg', ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated, n_symbols > n_words * 0.1 AS symbols,
    n_dup_lines > n_lines * 0.3 AS dup_lines FROM base),
counts AS (
  SELECT source, unnest(['short', 'repeated', 'symbols', 'dup_lines']) AS rule, n, unnest([a, b, c, d]) AS f FROM (
    SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (short) AS a, count(*) FILTER (repeated) AS b,
      count(*) FILTER (symbols) AS c, count(*) FILTER (dup_lines) AS d FROM failed WHERE source IS NOT NULL GROUP BY source)),
pooled AS (SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS m FROM counts GROUP BY rule),
spread AS (
  SELECT rule, m, m * (1 - m) AS chance, (sum(n * pow(f / n - m, 2)) - m * (1 - m) * (any_value(hosts) - 1)) / any_value(docs) AS v
  FROM counts JOIN pooled USING (rule) GROUP BY rule, m),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(chance / v - 1, 1), 1e6) ELSE 1e6 END AS s FROM spread),
bad AS (SELECT DISTINCT source FROM counts JOIN prior USING (rule) WHERE (f + m * s) / (n + s) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
  NOT (short OR repeated) AND b.source IS NULL AS kept, b.source IS NOT NULL AS host_rejected
FROM failed f LEFT JOIN bad b ON f.source = b.source"""


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list made of the events: each adds or removes the host of a page, its
    parent domain or one of its sections."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), url_section(F.col("url")).alias("section"))
    form = F.col("event_id") % 3
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    return table(spark, sf_dir, "events").join(pages, F.col("user_id") == F.col("page_id")).select(
        F.when(form == 0, F.col("host")).when(form == 1, parent).otherwise(F.concat_ws("/", "host", "section")).alias("pattern"),
        F.when(F.col("event_id") % 2 == 0, "block").otherwise("allow").alias("kind"),
        F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("add").alias("action"),
        F.col("ts").cast("timestamp").alias("at"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a time of fetching within the month of the events."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(
        F.lit(1704067200) + F.col("page_id") * 7919 % 43200 * 60).alias("fetched_at"))


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_url_filter(page_captures(spark, sf_dir), url_list(spark, sf_dir)).select(
        "page_id", "host", "matched", "verdict", "kept")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
OP8_SQL = rf"""
WITH named AS (
  SELECT page_id, url, make_timestamp((1704067200 + page_id * 7919 % 43200 * 60) * 1000000) AS t,
    nullif(regexp_replace(lower(regexp_extract(url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.|\.+$', '', 'g'), '') AS host,
    nullif(regexp_extract(url, '{_SCHEME}[^/?#]*/([^/?#]+)', 1), '') AS section
  FROM pages),
hosts AS (SELECT * REPLACE (CASE WHEN length(host) <= 253 THEN host END AS host) FROM named),
log AS (
  SELECT CASE event_id % 3 WHEN 0 THEN host
      WHEN 1 THEN CASE WHEN len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END
      ELSE concat_ws('/', host, section) END AS pattern,
    CASE WHEN event_id % 2 = 0 THEN 'block' ELSE 'allow' END AS kind,
    max(CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'add' END) AS action, ts AS moment
  FROM events JOIN hosts ON user_id = page_id GROUP BY ALL),
spans AS (SELECT *, lead(moment) OVER (PARTITION BY pattern, kind ORDER BY moment) AS until FROM log WHERE pattern IS NOT NULL),
keys AS (
  SELECT page_id, t, unnest(list_distinct(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || CASE WHEN section IS NULL THEN []::VARCHAR[] ELSE [host || '/' || section] END)) AS pattern
  FROM hosts WHERE host IS NOT NULL),
hits AS (
  SELECT page_id, k.pattern, kind FROM keys k JOIN spans s ON k.pattern = s.pattern AND moment <= t AND (until IS NULL OR t < until)
  WHERE action = 'add'
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY contains(k.pattern, '/') DESC, length(k.pattern) DESC, k.pattern DESC, kind) = 1)
SELECT h.page_id, host, pattern AS matched, coalesce(kind, 'none') AS verdict, coalesce(kind, 'none') <> 'block' AS kept
FROM hosts h LEFT JOIN hits USING (page_id)"""


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_roundtrip(docs, TOKENIZER).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxic_passages(docs, model, keep_text=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_SCORE).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more that occur three times or more; every 97th occurrence is misspelt."""
    words = counted_runs(table(spark, sf_dir, "documents"), least_chars=5, damaged_mod=97).where("n >= 3")
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 40 shards of equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in every fourth row, by a checksum of its place."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired = repair_conversations(damaged_conversations(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = repaired.summary.select(F.col("conv_id").alias("a"), *counts, "audit")
    digests = conversation_digests(repaired.rows).withColumnRenamed("conv_id", "b")
    every = rows.select("conv_id").distinct()
    every = every.join(found, F.col("conv_id").eqNullSafe(F.col("a")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("b")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


ENTRIES = {
    "op1_token_matrix": (op1_token_matrix, None),
    "op2_window_packing": (op2_window_packing, None),
    "op3_metric_join": (op3_metric_join, OP3_SQL),
    "op4_simhash": (op4_simhash, None),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_token_counts": (op6_token_counts, None),
    "op7_host_quality": (op7_host_quality, OP7_SQL),
    "op8_temporal_url_filter": (op8_temporal_url_filter, OP8_SQL),
    "op9_bpe_roundtrip": (op9_bpe_roundtrip, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_sharding": (op12_sharding, None),
    "op13_conversation_repair": (op13_conversation_repair, None),
}
