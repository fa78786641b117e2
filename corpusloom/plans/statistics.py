"""Text metrics, summaries, histograms and cleaning totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import compare
from corpusloom.operators import textstats as T
from corpusloom.plans.registry import query
from corpusloom.runtime import table as t

_N = "greatest(length(text), 1)"


def _c(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


_PUNCT = r"[!-/:-@\[-`{-~]"
_DOC = {
    "length": "length(text)", "white_space_ratio": f"{_c(r'[ \t\n\x0B\f\r]')} / {_N}", "digit_ratio": f"{_c('[0-9]')} / {_N}", "uppercase_ratio": f"{_c('[A-Z]')} / {_N}",
    "punctuation_ratio": f"{_c(_PUNCT)} / {_N}", "non_alpha_digit_ratio": f"{_c('[^A-Za-z0-9]')} / {_N}", "elipsis_ratio": f"{_c(r'\.\.\.|…')} / {_N}",
}


def _metrics(s: SparkSession, d: str, group: str) -> DataFrame:
    m = T.GROUPS[group](F.col("text"))
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in m.items()])


@query("SELECT lang, count(*) AS docs, round(avg(length(n)), 4) AS mean_length, min(length(n)) AS min_length, max(length(n)) AS max_length FROM (SELECT lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)^ +', '', 'g'), '^\\s+|\\s+$', '', 'g') AS n FROM documents) WHERE n <> '' GROUP BY 1")
def t1_doc_stats_by_lang(s: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.normalize import normalize_whitespace

    out = normalize_whitespace(t(s, d, "documents").select("lang", "text"), meta=False).filter("text <> ''")
    n = F.length("text")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(n), 4).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


@query("SELECT doc_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _DOC.items()) + " FROM documents WHERE text IS NOT NULL")
def t1_doc_stats(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, "doc")


_L = "string_split(text, chr(10))"
_LINE = {
    "n_lines": f"len({_L})", "avg_line_length": f"list_sum(list_transform({_L}, lambda x: length(x))) / len({_L})",
    "short_line_ratio_chars_10": f"len(list_filter({_L}, lambda x: length(x) <= 10)) / len({_L})", "short_line_ratio_chars_30": f"len(list_filter({_L}, lambda x: length(x) <= 30)) / len({_L})",
    "long_line_ratio_chars_2000": f"len(list_filter({_L}, lambda x: length(x) >= 2000)) / len({_L})", "long_line_ratio_chars_10000": f"len(list_filter({_L}, lambda x: length(x) >= 10000)) / len({_L})",
    "lines_ending_with_terminal_mark_ratio": f"len(list_filter({_L}, lambda x: regexp_matches(x, '[.!?][ \\t\\x0B\\f\\r]*$'))) / len({_L})", "bullet_point_lines_ratio": f"len(list_filter({_L}, lambda x: regexp_matches(x, '^[ \\t\\x0B\\f\\r]*[-*•]'))) / len({_L})",
    "line_duplicates": f"1 - len(list_distinct({_L})) / len({_L})",
    "line_char_duplicates": f"CASE WHEN list_sum(list_transform({_L}, lambda x: length(x))) > 0 THEN 1 - list_sum(list_transform(list_distinct({_L}), lambda x: length(x))) / list_sum(list_transform({_L}, lambda x: length(x))) ELSE 0 END",
}


@query("SELECT doc_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _LINE.items()) + " FROM documents WHERE text IS NOT NULL")
def t2_line_stats(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, "line")


_P = "string_split(text, chr(10) || chr(10))"
_PARA = {
    "n_paragraphs": f"len({_P})", "avg_paragraph_length": f"list_sum(list_transform({_P}, lambda x: length(x))) / len({_P})",
    "short_paragraph_ratio_100": f"len(list_filter({_P}, lambda x: length(x) <= 100)) / len({_P})", "long_paragraph_ratio_1000": f"len(list_filter({_P}, lambda x: length(x) >= 1000)) / len({_P})",
    "paragraph_duplicates": f"1 - len(list_distinct({_P})) / len({_P})",
    "paragraph_char_duplicates": f"CASE WHEN list_sum(list_transform({_P}, lambda x: length(x))) > 0 THEN 1 - list_sum(list_transform(list_distinct({_P}), lambda x: length(x))) / list_sum(list_transform({_P}, lambda x: length(x))) ELSE 0 END",
}


@query("SELECT doc_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _PARA.items()) + " FROM documents WHERE text IS NOT NULL")
def t3_paragraph_stats(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, "paragraph")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS token_count FROM documents WHERE text IS NOT NULL")
def t4_token_count(s: SparkSession, d: str) -> DataFrame:
    """Tokens as words between white space; counts under a public tokenizer are a query of their own."""
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("token_count"))


@query("SELECT source, round(avg(fasttext_en), 6) AS mean, count(fasttext_en) AS n FROM documents GROUP BY 1")
def t5_t8_score_columns(s: SparkSession, d: str) -> DataFrame:
    """Scores of outside models (perplexity, language) come as columns and are summed up like any metric."""
    return t(s, d, "documents").groupBy("source").agg(F.round(F.avg("fasttext_en"), 6).alias("mean"), F.count("fasttext_en").alias("n"))


_S = "list_filter(string_split_regex(text, '[.!?]+[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


_SENTENCE = {
    "n_sentences": f"len({_S})", "avg_sentence_length": f"CASE WHEN len({_S}) > 0 THEN list_sum(list_transform({_S}, lambda x: length(x))) / len({_S}) ELSE 0 END",
    "short_sentence_ratio_20": f"CASE WHEN len({_S}) > 0 THEN len(list_filter({_S}, lambda x: length(x) <= 20)) / len({_S}) ELSE 0 END", "long_sentence_ratio_75": f"CASE WHEN len({_S}) > 0 THEN len(list_filter({_S}, lambda x: length(x) >= 75)) / len({_S}) ELSE 0 END",
}


@query("SELECT doc_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _SENTENCE.items()) + " FROM documents WHERE text IS NOT NULL")
def t6_sentence_stats(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, "sentence")


_W = "regexp_extract_all(text, '[A-Za-z]+')"
_WS = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def _ws(p: str) -> str:
    return f"CASE WHEN len({_W}) > 0 THEN len(list_filter({_W}, lambda x: {p})) / len({_W}) ELSE 0 END"


_WORD = {
    "n_words": f"len({_W})", "avg_word_length": f"CASE WHEN len({_W}) > 0 THEN list_sum(list_transform({_W}, lambda x: length(x))) / len({_W}) ELSE 0 END", "avg_words_per_line": f"len({_W}) / len({_L})",
    "short_word_ratio_3": _ws("length(x) <= 3"), "long_word_ratio_7": _ws("length(x) >= 7"), "type_token_ratio": f"CASE WHEN len({_W}) > 0 THEN len(list_distinct({_W})) / len({_W}) ELSE 0 END",
    "uppercase_word_ratio": _ws("regexp_full_match(x, '[A-Z]+')"), "capitalized_word_ratio": _ws("regexp_full_match(x, '[A-Z][a-z]*')"), "stop_word_ratio": _ws(f"lower(x) IN {_WS}"),
}


@query("SELECT doc_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _WORD.items()) + " FROM documents WHERE text IS NOT NULL")
def t7_word_stats(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d, "word")


_QL = "len(regexp_extract_all(text, '[A-Za-z]'))"


@query(f"SELECT id, md5(text) AS digest, round({_c(_PUNCT)} / {_N}, 6) AS punct_ratio, round({_c(r'[^A-Za-z0-9 \t\n\x0B\f\r]')} / {_N}, 6) AS non_alnum_ratio, round(CASE WHEN {_QL} > 0 THEN {_c('[A-Z]')} / {_QL} ELSE 0 END, 6) AS uppercase_ratio FROM text_windows WHERE text IS NOT NULL")
def t9_window_quality(s: SparkSession, d: str) -> DataFrame:
    q = T.window_quality(F.col("text"))
    return t(s, d, "text_windows").filter("text IS NOT NULL").select("id", F.md5("text").alias("digest"), *[F.round(q[n], 6).alias(n) for n in ("punct_ratio", "non_alnum_ratio", "uppercase_ratio")])


_ALL = {"doc": _DOC, "line": _LINE, "paragraph": _PARA}


@query("SELECT doc_id, source, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for g in _ALL.values() for n, e in g.items()) + " FROM documents WHERE text IS NOT NULL")
def t10_enrichment(s: SparkSession, d: str) -> DataFrame:
    """Documents with all metrics of the document, its lines and its paragraphs as columns."""
    e = T.with_stats(t(s, d, "documents").filter("text IS NOT NULL"))
    return e.select("doc_id", "source", *[F.round(F.col(n).cast("double"), 6).alias(n) for g in _ALL.values() for n in g])


_LONG = " UNION ALL ".join(f"SELECT doc_id, '{g}' AS stat_type, '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM documents WHERE text IS NOT NULL" for g, m in _ALL.items() for n, e in m.items())


def _long(s: SparkSession, d: str) -> DataFrame:
    return T.long_metrics(t(s, d, "documents"), ["doc_id"])


@query(f"SELECT stat_type, metric, round(value, 3) AS bucket, count(*) AS n FROM ({_LONG}) GROUP BY ALL")
def a19_rounded_histogram(s: SparkSession, d: str) -> DataFrame:
    return T.histogram(_long(s, d))


@query(f"SELECT stat_type, metric, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(var_pop(value), 3) AS variance, round(stddev_pop(value), 6) AS std_dev, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM ({_LONG}) GROUP BY 1, 2")
def a20_summary(s: SparkSession, d: str) -> DataFrame:
    m = T.summary(_long(s, d))
    return m.select("stat_type", "metric", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"), F.round("std_dev", 6).alias("std_dev"), F.round("min", 6).alias("lo"), F.round("max", 6).alias("hi"))


@query(f"SELECT stat_type, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std_dev FROM ({_LONG}) GROUP BY 1, 2")
def a21_shard_merge(s: SparkSession, d: str) -> DataFrame:
    """Summaries of the sources, merged: equal to the summary of all."""
    parts = T.summary(T.long_metrics(t(s, d, "documents"), ["source"]), ("source", "stat_type", "metric"))
    m = T.merge_summaries(parts)
    return m.select("stat_type", "metric", "n", F.round("mean", 6).alias("mean"), F.round("std_dev", 5).alias("std_dev"))


_H = "(SELECT stage, stat_type, metric, bucket, sum(n) AS n FROM metric_buckets WHERE bucket IS NOT NULL GROUP BY ALL)"
_BY = ("stage", "stat_type", "metric")


def _hist(s: SparkSession, d: str) -> DataFrame:
    return T.merge_histograms(t(s, d, "metric_buckets"), _BY)


@query(f"SELECT stage, stat_type, metric, bucket, CAST(n AS BIGINT) AS n FROM {_H}")
def a22_histogram_merge(s: SparkSession, d: str) -> DataFrame:
    return _hist(s, d)


@query(f"SELECT stage, stat_type, metric, CAST(sum(n) AS BIGINT) AS n, round(sum(bucket * n) / sum(n), 5) AS mean, round(sqrt(greatest(sum(bucket * bucket * n) / sum(n) - (sum(bucket * n) / sum(n)) * (sum(bucket * n) / sum(n)), 0)), 3) AS std FROM {_H} GROUP BY 1, 2, 3")
def a23_weighted_moments(s: SparkSession, d: str) -> DataFrame:
    return T.weighted_moments(_hist(s, d), _BY).select(*_BY, "n", F.round("mean", 5).alias("mean"), F.round("std", 3).alias("std"))


def _pct(op: str) -> str:
    return (
        "SELECT stage, stat_type, metric, " + ", ".join(f"min(bucket) FILTER (WHERE c * 100 {op} t * {p}) AS p{p}" for p in (25, 50, 75, 95, 99))
        + f" FROM (SELECT stage, stat_type, metric, bucket, sum(n) OVER (PARTITION BY stage, stat_type, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY stage, stat_type, metric) AS t FROM {_H}) GROUP BY 1, 2, 3"
    )


@query(_pct(">="))
def a24_percentiles_left(s: SparkSession, d: str) -> DataFrame:
    return T.histogram_percentiles(_hist(s, d), by=_BY)


@query(_pct(">"))
def a24_percentiles_right(s: SparkSession, d: str) -> DataFrame:
    return T.histogram_percentiles(_hist(s, d), by=_BY, side="right")


_MOMENTS = f"(SELECT stage, stat_type, metric, CAST(sum(n) AS BIGINT) AS n, sum(bucket * n) / sum(n) AS mean, sqrt(greatest(sum(bucket * bucket * n) / sum(n) - (sum(bucket * n) / sum(n)) * (sum(bucket * n) / sum(n)), 0)) AS std, min(bucket) AS lo, max(bucket) AS hi FROM {_H} GROUP BY 1, 2, 3)"


@query(f"WITH p AS ({_pct('>=')}), m AS {_MOMENTS} SELECT stage, stat_type, metric, m.n, round(mean, 5) AS mean, round(std, 3) AS std, round(CASE WHEN mean = 0 THEN 0 ELSE std / mean END, 4) AS cv, p25, p50, p75, p95, p99, round(p75 - p25, 6) AS iqr, round(hi - lo, 6) AS range, 'histogram' AS data_source FROM p JOIN m USING (stage, stat_type, metric)")
def a25_a26_metric_table(s: SparkSession, d: str) -> DataFrame:
    m = T.metric_table(_hist(s, d), by=_BY)
    return m.select(*_BY, "n", F.round("mean", 5).alias("mean"), F.round("std", 3).alias("std"), F.round("cv", 4).alias("cv"), *[f"p{p}" for p in (25, 50, 75, 95, 99)], F.round("iqr", 6).alias("iqr"), F.round("range", 6).alias("range"), "data_source")


@query(f"WITH p AS ({_pct('>=')}) SELECT stage, stat_type, metric, round((p95 - p50 - (p50 - p25)) / nullif(p95 - p50 + (p50 - p25), 0), 6) AS skew, round((p99 - p95) / nullif(p95 - p75, 0), 6) AS tail FROM p WHERE (p95 - p50 - (p50 - p25)) / nullif(p95 - p50 + (p50 - p25), 0) IS NOT NULL AND (p99 - p95) / nullif(p95 - p75, 0) IS NOT NULL")
def a40_shape(s: SparkSession, d: str) -> DataFrame:
    return T.shape_indicators(T.histogram_percentiles(_hist(s, d), by=_BY)).select(*_BY, F.round("skew", 6).alias("skew"), F.round("tail", 6).alias("tail"))


@query("SELECT a.stat_type, a.metric, round(a.m, 4) AS before, round(b.m, 4) AS after FROM (SELECT stat_type, metric, sum(bucket * n) / sum(n) AS m FROM metric_buckets WHERE stage = (SELECT min(stage) FROM metric_buckets) AND bucket IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT stat_type, metric, sum(bucket * n) / sum(n) AS m FROM metric_buckets WHERE stage = (SELECT max(stage) FROM metric_buckets) AND bucket IS NOT NULL GROUP BY 1, 2) b USING (stat_type, metric)")
def j4_before_after_metrics(s: SparkSession, d: str) -> DataFrame:
    h = t(s, d, "metric_buckets").filter("bucket IS NOT NULL")
    ends = F.broadcast(t(s, d, "metric_buckets").agg(F.min("stage").alias("lo"), F.max("stage").alias("hi")))
    m = T.weighted_moments(h.crossJoin(ends), ("stage", "lo", "hi", "stat_type", "metric"))
    out = compare.before_after(m.filter("stage = lo"), m.filter("stage = hi"), ["stat_type", "metric"], "mean")
    return out.select("stat_type", "metric", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query(f"SELECT DISTINCT stat_type || '_stats' AS stat_type, metric FROM ({_LONG}) EXCEPT SELECT stat_type, metric FROM metric_buckets WHERE bucket IS NOT NULL")
def j10_not_covered(s: SparkSession, d: str) -> DataFrame:
    """Metrics that have a summary of the documents but no histogram."""
    covered = t(s, d, "metric_buckets").filter("bucket IS NOT NULL").select("stat_type", "metric").distinct()
    have = T.summary(_long(s, d)).withColumn("stat_type", F.concat("stat_type", F.lit("_stats")))
    return have.join(F.broadcast(covered), ["stat_type", "metric"], "left_anti").select("stat_type", "metric")


# Cleaning totals from the log.
_TYPES = ("eckige_klammern_numerisch", "autor_jahr_klammer_einzel")
_A27 = " UNION ALL ".join(f"SELECT '{k}' AS type, {k}_citations_found AS found, {k}_citations_removed AS removed FROM cleaning_log" for k in _TYPES)


def _by_type(s: SparkSession, d: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_citations_found").alias("found"), F.col(f"{k}_citations_removed").alias("removed")) for k in _TYPES])
    return t(s, d, "cleaning_log").select("log_id", "id", F.explode(entries).alias("x")).select("log_id", "id", "x.*")


@query(f"SELECT type, count(*) FILTER (WHERE found > 0) AS docs, CAST(sum(found) AS BIGINT) AS found, CAST(sum(removed) AS BIGINT) AS removed FROM ({_A27}) GROUP BY 1")
def a27_citations_by_type(s: SparkSession, d: str) -> DataFrame:
    return _by_type(s, d).groupBy("type").agg(F.count_if(F.col("found") > 0).alias("docs"), F.sum("found").alias("found"), F.sum("removed").alias("removed"))


@query(f"SELECT type, found, count(*) AS docs FROM ({_A27}) WHERE found IS NOT NULL GROUP BY 1, 2")
def a27_citation_distribution(s: SparkSession, d: str) -> DataFrame:
    return _by_type(s, d).filter("found IS NOT NULL").groupBy("type", "found").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT count(*) AS docs, count(*) FILTER (WHERE eckige_klammern_numerisch_citations_found > 0 OR autor_jahr_klammer_einzel_citations_found > 0) AS with_citations, count(*) FILTER (WHERE figure_lines_removed > 0) AS figure_docs, CAST(sum(figure_lines_removed) AS BIGINT) AS figure_lines, CAST(sum(appendix_sections_removed) AS BIGINT) AS appendix_sections, CAST(sum(short_lines_removed) AS BIGINT) AS short_lines, count(*) FILTER (WHERE NOT language_document_kept) AS language_removed, round(sum(fasttext_score_used), 4) AS score_sum FROM cleaning_log")
def a28_cleaning_totals(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "cleaning_log").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if((F.col("eckige_klammern_numerisch_citations_found") > 0) | (F.col("autor_jahr_klammer_einzel_citations_found") > 0)).alias("with_citations"), F.count_if(F.col("figure_lines_removed") > 0).alias("figure_docs"),
        F.sum("figure_lines_removed").alias("figure_lines"), F.sum("appendix_sections_removed").alias("appendix_sections"), F.sum("short_lines_removed").alias("short_lines"), F.count_if(~F.col("language_document_kept")).alias("language_removed"), F.round(F.sum("fasttext_score_used"), 4).alias("score_sum"),
    )


@query("SELECT run_id, log_id FROM (SELECT run_id, log_id, row_number() OVER (PARTITION BY run_id ORDER BY log_id) AS r FROM cleaning_log WHERE eckige_klammern_numerisch_citations_rejected > 0) WHERE r <= 10")
def a29_bounded_samples(s: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.profiles import top_k

    return top_k(t(s, d, "cleaning_log").filter("eckige_klammern_numerisch_citations_rejected > 0"), ["run_id"], [F.col("log_id")], 10).select("run_id", "log_id")


_RATES = "SELECT run_id, sum(eckige_klammern_numerisch_citations_found) AS f, sum(eckige_klammern_numerisch_citations_removed) AS m, sum(eckige_klammern_numerisch_citations_rejected) AS j FROM cleaning_log GROUP BY 1"


@query(f"SELECT run_id, round(m / nullif(f, 0), 6) AS precision, round(j / nullif(f, 0), 6) AS fp_rate, round(least(1, j / nullif(0.1 * f, 0)), 6) AS effectiveness, CASE WHEN j / nullif(f, 0) > 0.3 THEN 'High' WHEN j / nullif(f, 0) > 0.1 THEN 'Medium' ELSE 'Low' END AS risk FROM ({_RATES})")
def a30_derived_rates(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "cleaning_log").groupBy("run_id").agg(*[F.sum(f"eckige_klammern_numerisch_citations_{c}").alias(n) for n, c in (("f", "found"), ("m", "removed"), ("j", "rejected"))])
    f = F.nullif("f", F.lit(0))
    fp = F.col("j") / f
    return g.select("run_id", F.round(F.col("m") / f, 6).alias("precision"), F.round(fp, 6).alias("fp_rate"), F.round(F.when(f.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("j") / (0.1 * f))), 6).alias("effectiveness"), F.when(fp > 0.3, "High").when(fp > 0.1, "Medium").otherwise("Low").alias("risk"))


@query("SELECT run_id, count(*) AS docs, round(avg(CASE WHEN citation_text_changed THEN 1.0 ELSE 0 END), 6) AS changed_rate, round(avg(citation_length_reduction), 4) AS avg_reduction, round(count(*) FILTER (WHERE NOT language_document_kept) / count(*), 6) AS removed_rate FROM cleaning_log GROUP BY 1")
def a31_final_rates(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "cleaning_log").groupBy("run_id").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.when(F.col("citation_text_changed"), 1.0).otherwise(0.0)), 6).alias("changed_rate"), F.round(F.avg("citation_length_reduction"), 4).alias("avg_reduction"), F.round(F.count_if(~F.col("language_document_kept")) / F.count(F.lit(1)), 6).alias("removed_rate"))


@query("SELECT run_id, CAST(sum(figure_lines_removed) AS BIGINT) AS figure_lines, CAST(sum(appendix_sections_removed) AS BIGINT) AS appendix_sections, CAST(sum(short_lines_removed) AS BIGINT) AS short_lines FROM cleaning_log GROUP BY 1")
def a32_worker_merge(s: SparkSession, d: str) -> DataFrame:
    """What workers merged through files is one aggregation here."""
    return t(s, d, "cleaning_log").groupBy("run_id").agg(F.sum("figure_lines_removed").alias("figure_lines"), F.sum("appendix_sections_removed").alias("appendix_sections"), F.sum("short_lines_removed").alias("short_lines"))


@query("SELECT count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS removed, round(avg(s), 6) AS mean_all, round(avg(s) FILTER (WHERE k), 6) AS mean_kept, round(avg(s) FILTER (WHERE NOT k), 6) AS mean_removed, min(s) AS lo, max(s) AS hi FROM (SELECT language_document_kept AS k, fasttext_score_used AS s FROM cleaning_log)")
def a33_fasttext_stats(s: SparkSession, d: str) -> DataFrame:
    k, v = F.col("language_document_kept"), F.col("fasttext_score_used")
    return t(s, d, "cleaning_log").agg(F.count_if(k).alias("kept"), F.count_if(~k).alias("removed"), F.round(F.avg(v), 6).alias("mean_all"), F.round(F.avg(F.when(k, v)), 6).alias("mean_kept"), F.round(F.avg(F.when(~k, v)), 6).alias("mean_removed"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("SELECT count(*) AS windows, count(DISTINCT metadata.original_doc_id) AS docs, round(count(*) / count(DISTINCT metadata.original_doc_id), 6) AS windows_per_doc, round(avg(metadata.actual_tokens), 4) AS mean_tokens FROM text_windows")
def a34_window_totals(s: SparkSession, d: str) -> DataFrame:
    w = t(s, d, "text_windows")
    docs = F.countDistinct("metadata.original_doc_id")
    return w.agg(F.count(F.lit(1)).alias("windows"), docs.alias("docs"), F.round(F.count(F.lit(1)) / docs, 6).alias("windows_per_doc"), F.round(F.avg("metadata.actual_tokens"), 4).alias("mean_tokens"))
