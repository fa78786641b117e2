"""Sliding windows, splits, orders and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import profiles as P
from corpusloom.operators import slicing as S
from corpusloom.operators import tokenize as K
from corpusloom.operators.normalize import normalize_window_text
from corpusloom.plans.registry import query
from corpusloom.runtime import table as t

_SQL_NORM = "regexp_replace(regexp_replace(translate(text, chr(160) || chr(13) || chr(10), '   '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
_TOK = f"(SELECT doc_id, id, list_filter(string_split({_SQL_NORM}, ' '), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)"


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "id", F.filter(F.split(normalize_window_text(F.col("text")), r"\s+"), lambda w: w != "").alias("w")).withColumn("n", F.size("w"))


@query(f"SELECT doc_id, CASE WHEN len(w) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(w) - 128) / 64.0) AS INT) END AS windows, greatest(1, CAST(floor((len(w) - 64) / 64.0) AS INT) + 1) AS legacy_windows FROM {_TOK}")
def d1_d6_window_counts(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return _tokens(s, d).select("doc_id", S.window_count(n, 128, 64).alias("windows"), S.legacy_window_count(n, 128, 64).alias("legacy_windows"))


@query(f"SELECT doc_id, i, CAST(i * 64 AS INT) AS start_pos FROM (SELECT doc_id, unnest(range(0, CASE WHEN len(w) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(w) - 128) / 64.0) AS INT) END)) AS i FROM {_TOK})")
def d2_window_starts(s: SparkSession, d: str) -> DataFrame:
    x = _tokens(s, d).select("doc_id", F.posexplode(S.window_starts(F.col("n"), 128, 64)).alias("i", "start_pos"))
    return x.select("doc_id", F.col("i").cast("long").alias("i"), "start_pos")


@query(f"SELECT id || '_window_' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, CAST(i AS INT) AS window_idx, CAST(i * 64 AS INT) AS start_pos, CAST(least(i * 64 + 128, len(w)) AS INT) AS end_pos, md5(array_to_string(w[i * 64 + 1 : i * 64 + 128], ' ')) AS digest FROM (SELECT id, w, unnest(range(0, CASE WHEN len(w) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(w) - 128) / 64.0) AS INT) END)) AS i FROM {_TOK} WHERE len(w) > 0)")
def d3_windows(s: SparkSession, d: str) -> DataFrame:
    return S.windows(t(s, d, "documents"), length=128).select("id", "window_idx", "start_pos", "end_pos", F.md5("text").alias("digest"))


_SPREAD = f"""SELECT id || '_window_' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, CAST(p AS INT) AS start_pos, CAST(least(p + 128, n) AS INT) AS end_pos FROM (
 SELECT id, n, i, CASE WHEN k > 1 AND n - (k - 1) * 64 < 48 THEN round_even(i * (n - 128) / greatest(k - 1, 1), 0) ELSE i * 64 END AS p FROM (
 SELECT id, n, k, unnest(range(0, k)) AS i FROM (SELECT id, len(w) AS n, CASE WHEN len(w) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(w) - 128) / 64.0) AS INT) END AS k FROM {_TOK} WHERE len(w) > 0)))"""


@query(_SPREAD)
def d2_d3_rebalanced_windows(s: SparkSession, d: str) -> DataFrame:
    return S.windows(t(s, d, "documents"), length=128, min_last=48).select("id", "start_pos", "end_pos")


@query("SELECT id, md5(text) AS digest FROM text_windows WHERE metadata.actual_tokens >= 64 AND length(text) >= 100 AND len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) / greatest(length(text), 1) <= 0.2")
def f4_window_filter(s: SparkSession, d: str) -> DataFrame:
    w = t(s, d, "text_windows").withColumn("actual_tokens", F.col("metadata.actual_tokens"))
    return S.filter_windows(w, min_tokens=64, min_chars=100, max_punct=0.2).select("id", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, CAST(i AS INT) AS window_idx, CAST(i * 8 AS INT) AS start_pos, array_to_string(list_resize(list_transform(w[i * 8 + 1 : i * 8 + 16], lambda x: length(x)), 16, 0), ' ') AS ids FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 16 THEN 1 ELSE 1 + CAST(ceil((len(w) - 16) / 8.0) AS INT) END)) AS i FROM {_TOK} WHERE len(w) > 0)")
def d4_padded_output(s: SparkSession, d: str) -> DataFrame:
    """Every window of a text, in steps of half its length, filled up to 16."""
    w = S.windows(t(s, d, "documents"), "doc_id", length=16)
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    return w.select(F.col("original_doc_id").alias("doc_id"), "window_idx", "start_pos", F.array_join(S.padded_ids(ids, 16), " ").alias("ids"))


@query(f"SELECT id, len(list_filter(string_split({_SQL_NORM}, ' '), lambda w: w <> '')) AS tokens, metadata.actual_tokens AS stated FROM text_windows")
def d5_recount(s: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split(normalize_window_text(F.col("text")), r"\s+"), lambda w: w != "")).cast("long")
    return t(s, d, "text_windows").select("id", n.alias("tokens"), F.col("metadata.actual_tokens").alias("stated"))


@query("SELECT id, p AS start_pos, CAST(least(p + 256, len(w)) - p AS INT) AS tokens FROM (SELECT id, w, unnest(range(0, len(w) - 100 + 1, 128)) AS p FROM (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 100)")
def d7_german_windows(s: SparkSession, d: str) -> DataFrame:
    w = S.german_windows(t(s, d, "documents"), "doc_id", "text", 256, 0.5)
    return w.select("id", F.col("start_pos").cast("long").alias("start_pos"), "tokens")


_ORD = "md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42'))"
_POS = f"(SELECT doc_id, row_number() OVER (ORDER BY {_ORD}, doc_id) - 1 AS position FROM documents)"


@query(f"SELECT doc_id, position, CASE WHEN position < greatest(CAST(floor((SELECT count(*) FROM documents) * 0.05) AS INT), 100) THEN 'val' ELSE 'train' END AS split FROM {_POS}")
def d8_d9_split(s: SparkSession, d: str) -> DataFrame:
    return P.split_exact(t(s, d, "documents").select("doc_id"), "doc_id", 0.05, 100)


@query(f"SELECT doc_id, CAST(position % 8 AS INT) AS rank, CAST(floor(position / 8) AS BIGINT) AS step FROM {_POS} WHERE position >= 16 AND floor(position / 8) < floor((SELECT count(*) FROM documents) / 8)")
def d10_rank_shards(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("doc_id")
    n = docs.count()
    return P.rank_shard(P.deterministic_order(docs, "doc_id", rows=n), 8, n, 16).select("doc_id", "rank", "step")


@query("SELECT CAST(s AS BIGINT) AS steps, CAST(s * 8 * 4 * 2 AS BIGINT) AS position FROM range(0, 1000, 250) AS r(s)")
def d11_resume_position(s: SparkSession, d: str) -> DataFrame:
    return s.range(0, 1000, 250).select(F.col("id").alias("steps"), (F.col("id") * 8 * 4 * 2).alias("position"))


@query("SELECT count(*) AS seen, count(*) FILTER (WHERE metadata.document_type IS NOT NULL AND metadata.preprocessing_version IS NOT NULL) AS known FROM (SELECT metadata FROM text_windows ORDER BY id, md5(text) LIMIT 5)")
def d12_verify_windows(s: SparkSession, d: str) -> DataFrame:
    first = t(s, d, "text_windows").orderBy("id", F.md5("text")).limit(5)
    return first.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("metadata.document_type").isNotNull() & F.col("metadata.preprocessing_version").isNotNull()).alias("known"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(trim(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: TRY_CAST(CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN x END AS INT)), lambda x: x IS NOT NULL)) AS ids FROM documents WHERE text IS NOT NULL")
def d13_parse_ids(s: SparkSession, d: str) -> DataFrame:
    """Whole texts through the parser: what is no number is left out."""
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(S.parse_ids(F.col("text"))).cast("long").alias("ids"))


@query("SELECT 512 AS inputs, 568 AS tokens, 114 AS targets UNION ALL SELECT 256, 284, 58")
def d14_length_solver(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(n, *S.expanded_length(n)) for n in (512, 256)], "inputs int, tokens int, targets int")


def _ids(s: SparkSession, d: str) -> DataFrame:
    return _tokens(s, d).select("doc_id", F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(32000)).cast("long")).alias("ids"))


@query()
def d15_d16_span_corruption(s: SparkSession, d: str) -> DataFrame:
    return S.span_corruption(_ids(s, d), "doc_id", "ids")


@query()
def d18_fast_span_corruption(s: SparkSession, d: str) -> DataFrame:
    return S.span_corruption(_ids(s, d), "doc_id", "ids", fast=True)


_LEN = f"(SELECT doc_id, list_transform(w, lambda x: length(x)) AS y FROM {_TOK})"


@query(f"SELECT doc_id, array_to_string(list_transform(list_resize(y[1:32], 32, 0), lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ' ') AS labels, array_to_string(list_concat([0], list_resize(y[1:32], 32, 0)[1:31]), ' ') AS decoder, list_sum(list_transform(list_resize(y[1:64], 64, 0), lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END)) AS real_tokens FROM {_LEN}")
def d17_model_inputs(s: SparkSession, d: str) -> DataFrame:
    y = F.transform("w", lambda x: F.length(x))
    m = S.model_inputs(y, y, 64, 32)
    return _tokens(s, d).select("doc_id", F.array_join(m["labels"], " ").alias("labels"), F.array_join(m["decoder_input_ids"], " ").alias("decoder"), F.aggregate(m["attention_mask"], F.lit(0), lambda a, x: a + x).cast("long").alias("real_tokens"))


@query(f"SELECT round(1 - sum(least(len(w), 512)) / (count(*) * 512.0), 6) AS padding_ratio, CAST(sum(least(len(w), 512)) AS BIGINT) AS tokens FROM {_TOK}")
def d20_padding_ratio(s: SparkSession, d: str) -> DataFrame:
    real = F.sum(F.least("n", F.lit(512)))
    return _tokens(s, d).agg(F.round(1 - real / (F.count(F.lit(1)) * 512.0), 6).alias("padding_ratio"), real.alias("tokens"))


# In the tokens of an existing tokenizer.
@query()
def t4_token_stats(s: SparkSession, d: str) -> DataFrame:
    return K.token_stats(t(s, d, "documents"), "doc_id")


@query()
def d3_token_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 512 tokens, half overlapping, of every document."""
    w = K.token_windows(t(s, d, "documents"), "doc_id")
    return w.select("id", "doc_id", "window_idx", "start_pos", "end_pos", "actual_tokens", "original_token_count", "original_window_count", F.md5("text").alias("digest"))


@query()
def d4_token_ids(s: SparkSession, d: str) -> DataFrame:
    """Every window as the ids of its tokens, filled up with 0."""
    return K.padded_output(K.token_windows(t(s, d, "documents"), "doc_id", overlap=0.0, pad=0)).select("id", "doc_id", "window_idx", "token_ids")


@query()
def d5_token_recount(s: SparkSession, d: str) -> DataFrame:
    """Tokens of the windows' normalised texts beside the number they came with."""
    w = t(s, d, "text_windows").select("id", F.col("metadata.actual_tokens").alias("stated"), F.md5("text").alias("digest"), normalize_window_text(F.col("text")).alias("text"))
    counted = K.token_stats(w.withColumn("key", F.struct("id", "stated", "digest")), "key")
    return counted.select("key.id", "key.stated", F.col("token_count").alias("tokens"))


@query()
def d7_token_windows(s: SparkSession, d: str) -> DataFrame:
    return K.fixed_step_windows(t(s, d, "documents"), "doc_id").select("doc_id", "start_pos", "tokens", F.md5(F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ")).alias("digest"))
