"""Evaluation results: parsing, baselines, ranks, matrices, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import compare as C
from corpusloom.operators import normalize as N
from corpusloom.plans.registry import query
from corpusloom.runtime import table as t
from corpusloom.sources import io

_E = "(SELECT DISTINCT model, language, subject, acc, acc_stderr, source_file FROM eval_subtasks)"
_M = f"(SELECT model, language AS benchmark, avg(acc) AS score FROM {_E} GROUP BY 1, 2)"


def scores(s: SparkSession, d: str) -> DataFrame:
    """Subtask rows without repeated ones."""
    return t(s, d, "eval_subtasks").distinct()


def by_benchmark(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).groupBy("model", F.col("language").alias("benchmark")).agg(F.avg("acc").alias("score"))


@query(f"SELECT model, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS std, min(acc) AS lo, max(acc) AS hi, count(acc) AS n FROM {_E} GROUP BY 1")
def a35_per_run(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).groupBy("model").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("std"), F.min("acc").alias("lo"), F.max("acc").alias("hi"), F.count("acc").alias("n"))


@query(f"SELECT subject, round(avg(acc), 6) AS mean FROM {_E} GROUP BY 1")
def a36_group_mean(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).groupBy("subject").agg(F.round(F.avg("acc"), 6).alias("mean"))


@query("SELECT source, round(exp(sum(l * n) / sum(n)), 4) AS perplexity FROM (SELECT source, length(text) AS n, 1 + coalesce(fasttext_en, 1.0) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def a37_weighted_perplexity(s: SparkSession, d: str) -> DataFrame:
    """exp of the token-weighted mean loss; 1 plus the score stands for a loss."""
    x = t(s, d, "documents").filter("text IS NOT NULL").select("source", F.length("text").alias("n"), (1 + F.coalesce("fasttext_en", F.lit(1.0))).alias("l"))
    return x.groupBy("source").agg(F.round(F.exp(F.sum(F.col("l") * F.col("n")) / F.sum("n")), 4).alias("perplexity"))


@query(f"SELECT benchmark, round(max(score), 6) AS best, round(min(score), 6) AS worst, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS range, count(score) AS n FROM {_M} GROUP BY 1")
def a39_per_benchmark(s: SparkSession, d: str) -> DataFrame:
    v = F.col("score")
    return by_benchmark(s, d).groupBy("benchmark").agg(F.round(F.max(v), 6).alias("best"), F.round(F.min(v), 6).alias("worst"), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v) - F.min(v), 6).alias("range"), F.count(v).alias("n"))


@query("SELECT source, round(avg(CASE WHEN starts_with(upper(trim(coalesce(lang, ''))), 'EN') THEN 1.0 ELSE 0 END), 6) AS accuracy FROM documents GROUP BY 1")
def a41_accuracy(s: SparkSession, d: str) -> DataFrame:
    ok = F.startswith(F.upper(F.trim(F.coalesce("lang", F.lit("")))), F.lit("EN"))
    return t(s, d, "documents").groupBy("source").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("accuracy"))


_BASE = f"(SELECT benchmark, score AS b FROM {_M} WHERE model = (SELECT min(model) FROM eval_subtasks))"


@query(f"SELECT model, benchmark, round(score - b, 10) AS delta, round(CASE WHEN b > 0 THEN (score - b) / b * 100 END, 8) AS percent FROM {_M} LEFT JOIN {_BASE} USING (benchmark)")
def j6_baseline(s: SparkSession, d: str) -> DataFrame:
    first = t(s, d, "eval_subtasks").agg(F.min("model"))
    return C.against_baseline(by_benchmark(s, d), first).select("model", "benchmark", F.round("delta", 10).alias("delta"), F.round("percent", 8).alias("percent"))


_SUBJ = f"(SELECT model, subject, avg(acc) AS a FROM {_E} GROUP BY 1, 2)"


@query(f"SELECT x.model, x.subject, round((x.a - y.a) / y.a * 100, 4) AS improvement FROM {_SUBJ} x JOIN {_SUBJ} y ON x.subject = y.subject AND y.model = (SELECT min(model) FROM eval_subtasks) WHERE y.a <> 0 AND x.a IS NOT NULL")
def j7_subject_improvement(s: SparkSession, d: str) -> DataFrame:
    m = scores(s, d).groupBy("model", "subject").agg(F.avg("acc").alias("score"))
    first = t(s, d, "eval_subtasks").agg(F.min("model"))
    out = C.against_baseline(m, first, by="subject").filter("baseline_score <> 0 AND score IS NOT NULL")
    return out.select("model", "subject", F.round("percent", 4).alias("improvement"))


@query(f"SELECT a.language, a.subject, a.acc AS first_acc, b.acc AS second_acc FROM (SELECT language, subject, max(acc) AS acc FROM {_E} WHERE model = (SELECT min(model) FROM eval_subtasks) GROUP BY 1, 2) a JOIN (SELECT language, subject, max(acc) AS acc FROM {_E} WHERE model = (SELECT max(model) FROM eval_subtasks) GROUP BY 1, 2) b USING (language, subject)")
def j8_run_alignment(s: SparkSession, d: str) -> DataFrame:
    ends = F.broadcast(t(s, d, "eval_subtasks").agg(F.min("model").alias("lo"), F.max("model").alias("hi")))
    e = scores(s, d).crossJoin(ends)
    one = lambda c, n: e.filter(f"model = {c}").groupBy("language", "subject").agg(F.max("acc").alias(n))
    return one("lo", "first_acc").join(one("hi", "second_acc"), ["language", "subject"])


_LG = f"(SELECT model, subject, avg(acc) FILTER (WHERE lower(language) = 'en') AS en, avg(acc) FILTER (WHERE lower(language) = 'de') AS de FROM {_E} GROUP BY 1, 2)"


@query(f"SELECT model, round(avg(de - en), 6) AS mean_delta, count(de - en) AS subjects FROM {_LG} GROUP BY 1")
def j9_language_delta(s: SparkSession, d: str) -> DataFrame:
    def one(code: str) -> DataFrame:
        return scores(s, d).filter(F.lower("language") == code).groupBy("model", "subject").agg(F.avg("acc").alias(code))

    j = one("en").join(one("de"), ["model", "subject"], "full").join(scores(s, d).select("model", "subject").distinct(), ["model", "subject"], "right")
    return j.groupBy("model").agg(F.round(F.avg(F.col("de") - F.col("en")), 6).alias("mean_delta"), F.count(F.col("de") - F.col("en")).alias("subjects"))


@query(f"SELECT m.model, x.subject, round(a, 6) AS acc FROM (SELECT DISTINCT model FROM eval_subtasks) m CROSS JOIN (SELECT DISTINCT subject FROM eval_subtasks) x LEFT JOIN {_SUBJ} s ON s.model = m.model AND s.subject = x.subject")
def j11_full_matrix(s: SparkSession, d: str) -> DataFrame:
    e = scores(s, d)
    grid = e.select("model").distinct().crossJoin(e.select("subject").distinct())
    return grid.join(e.groupBy("model", "subject").agg(F.round(F.avg("acc"), 6).alias("acc")), ["model", "subject"], "left")


_STEPS = "(SELECT DISTINCT language, CAST(publication_year AS BIGINT) AS step FROM raw_corpus WHERE publication_year IS NOT NULL)"


@query(f"WITH RECURSIVE taken AS (SELECT language, min(step) AS step FROM {_STEPS} GROUP BY 1 UNION ALL SELECT language, step FROM (SELECT s.language, min(s.step) AS step FROM taken t JOIN {_STEPS} s ON s.language IS NOT DISTINCT FROM t.language AND s.step >= t.step + 10 GROUP BY 1)) SELECT language, step FROM taken")
def w9_greedy_intervals(s: SparkSession, d: str) -> DataFrame:
    steps = t(s, d, "raw_corpus").select("language", F.col("publication_year").cast("long").alias("step"))
    return C.greedy_intervals(steps, "language", "step", 10)


@query(f"SELECT benchmark, model, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC NULLS LAST, model) AS rank FROM {_M}")
def w10_rank_nulls_last(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("benchmark").orderBy(F.desc_nulls_last("score"), "model")
    return by_benchmark(s, d).select("benchmark", "model", F.row_number().over(w).cast("long").alias("rank"))


_LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja", "hi")
_BY_LANG = ", ".join(f"round(avg(acc) FILTER (WHERE lower(language) = '{x}'), {{0}}) AS {x}" for x in _LANGS)


@query(f"SELECT subject, {_BY_LANG.format(6)}, round(avg(acc), 6) AS row_mean FROM {_E} GROUP BY 1")
def w13_matrix(s: SparkSession, d: str) -> DataFrame:
    e = scores(s, d).withColumn("l", F.lower("language"))
    return e.groupBy("subject").agg(*[F.round(F.avg(F.when(F.col("l") == x, F.col("acc"))), 6).alias(x) for x in _LANGS], F.round(F.avg("acc"), 6).alias("row_mean"))


@query(f"SELECT x.model, x.subject, round(x.a - coalesce(y.a, 0.25), 6) AS delta FROM {_SUBJ} x LEFT JOIN (SELECT * FROM {_SUBJ} WHERE model = (SELECT max(model) FROM eval_subtasks)) y USING (subject)")
def w14_relative_matrix(s: SparkSession, d: str) -> DataFrame:
    m = scores(s, d).groupBy("model", "subject").agg(F.avg("acc").alias("a"))
    last = F.broadcast(t(s, d, "eval_subtasks").agg(F.max("model").alias("hi")))
    base = m.join(last, m.model == F.col("hi"), "left_semi").select("subject", F.col("a").alias("b"))
    return m.join(base, "subject", "left").select("model", "subject", F.round(F.col("a") - F.coalesce("b", F.lit(0.25)), 6).alias("delta"))


@query(f"SELECT model, third, round(avg(a), 6) AS mean FROM (SELECT model, a, CASE WHEN r < n // 3 THEN 'early' WHEN r < 2 * (n // 3) THEN 'middle' ELSE 'late' END AS third FROM (SELECT model, a, row_number() OVER (PARTITION BY model ORDER BY subject) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM {_SUBJ})) GROUP BY 1, 2")
def w15_thirds(s: SparkSession, d: str) -> DataFrame:
    m = scores(s, d).groupBy("model", "subject").agg(F.avg("acc").alias("a"))
    return C.thirds(m, "model", "subject").groupBy("model", "third").agg(F.round(F.avg("a"), 6).alias("mean"))


_ROUND = f"(SELECT model, benchmark, round(score, 9) AS score FROM {_M})"


@query(f"SELECT benchmark, model, rank, round(gap, 7) AS gap FROM (SELECT benchmark, model, row_number() OVER w AS rank, score - lag(score) OVER w AS gap, count(*) OVER (PARTITION BY benchmark) AS n FROM {_ROUND} WINDOW w AS (PARTITION BY benchmark ORDER BY score DESC NULLS LAST, model)) WHERE n > 1")
def w19_rank_and_gap(s: SparkSession, d: str) -> DataFrame:
    """Scores are rounded first, so that averages summed in another order rank and differ alike."""
    rounded = by_benchmark(s, d).withColumn("score", F.round("score", 9))
    return C.ranked(rounded, "benchmark", "score", "model").select("benchmark", "model", F.col("rank").cast("long").alias("rank"), F.round("gap", 7).alias("gap"))


def cleaned_pairs(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, before, after): texts before and after white-space and symbol cleaning."""
    docs = t(s, d, "documents").select("doc_id", F.col("text").alias("before"), "text")
    return N.normalize_whitespace(N.normalize_symbols(docs, count=False), meta=False).select("doc_id", "before", F.col("text").alias("after"))


@query()
def x1_x2_diffs(s: SparkSession, d: str) -> DataFrame:
    return C.with_diffs(cleaned_pairs(s, d), "before", "after").select("doc_id", "lines_added", "lines_removed", "has_changes", F.md5("word_diff").alias("digest"))


@query()
def x3_side_by_side(s: SparkSession, d: str) -> DataFrame:
    return C.side_by_side_rows(cleaned_pairs(s, d), "doc_id", "before", "after").filter("kind <> 'equal'")


@query("SELECT log_id, coalesce(eckige_klammern_numerisch_citations_removed, 0) + coalesce(autor_jahr_klammer_einzel_citations_removed, 0) AS citations_removed FROM cleaning_log")
def x4_removed_sum(s: SparkSession, d: str) -> DataFrame:
    """Sum of all *_citations_removed entries of a map of metadata."""
    log = t(s, d, "cleaning_log")
    names = [c for c in log.columns if c.startswith(("eckige", "autor"))]
    meta = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    values = F.map_values(F.map_filter(meta, lambda k, v: k.endswith("_citations_removed")))
    return log.select("log_id", F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0))).alias("citations_removed"))


def as_json(s: SparkSession, d: str) -> DataFrame:
    """(model, json): the results of each model in the shape of an evaluation's file."""
    e = scores(s, d).filter("acc IS NOT NULL").groupBy("model", "subject").agg(F.avg("acc").alias("acc"), F.avg("acc_stderr").alias("err"))
    r = e.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("subject", F.create_map(F.lit("acc,none"), F.col("acc"), F.lit("acc_stderr,none"), F.col("err"))))).alias("results"))
    return r.select("model", F.to_json(F.struct("results")).alias("json"))


_ACC = f"(SELECT model, subject, avg(acc) AS acc FROM {_E} WHERE acc IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT model, round(avg(acc), 6) AS full_mean, round(avg(acc) FILTER (WHERE subject LIKE 'c%'), 6) AS subset_mean FROM {_ACC} GROUP BY 1")
def x5_full_and_subset(s: SparkSession, d: str) -> DataFrame:
    r = C.parse_results(as_json(s, d)).filter("metric = 'acc,none'")
    return r.groupBy("model").agg(F.round(F.avg("value"), 6).alias("full_mean"), F.round(F.avg(F.when(F.col("task").startswith("c"), F.col("value"))), 6).alias("subset_mean"))


@query(f"SELECT model, subject AS task, round(acc, 6) AS score FROM {_ACC}")
def x6_generic_metric(s: SparkSession, d: str) -> DataFrame:
    m = as_json(s, d).select("model", F.explode(F.from_json("json", "results MAP<STRING, MAP<STRING, DOUBLE>>")["results"]).alias("task", "m"))
    return m.select("model", "task", F.round(C.best_metric(F.col("m")), 6).alias("score"))


@query(f"SELECT model, subject AS task, round(acc, 6) AS value FROM {_ACC} WHERE length(subject) > 8")
def x7_x10_subtasks(s: SparkSession, d: str) -> DataFrame:
    return C.parse_results(as_json(s, d)).filter("metric = 'acc,none' AND length(task) > 8").select("model", "task", F.round("value", 6).alias("value"))


@query(f"SELECT model, {_BY_LANG.format(10)} FROM {_E} GROUP BY 1")
def x8_wide_export(s: SparkSession, d: str) -> DataFrame:
    """One row for each model with a column for each language, written as CSV and read back."""
    wide = scores(s, d).withColumn("l", F.lower("language")).groupBy("model").pivot("l", list(_LANGS)).agg(F.avg("acc"))
    columns = wide.select("model", *[F.round(x, 10).alias(x) for x in _LANGS])
    return io.csv_round_trip(columns, ["model"], digits=10)


_NAMES = "(SELECT DISTINCT 'run-' || length(model) || '/clean/' || model || '/step-' || (length(model) * 1000) || '_ppl-12.5' AS name FROM eval_subtasks)"


@query(f"SELECT name, 'clean' AS run_type, TRY_CAST(regexp_extract(name, 'run[-_]?([0-9]+)', 1) AS INT) AS run_no, TRY_CAST(regexp_extract(name, 'step[-_=]([0-9]+)', 1) AS BIGINT) AS step, TRY_CAST(regexp_extract(name, 'ppl[-_=]?([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS perplexity FROM {_NAMES}")
def x9_model_names(s: SparkSession, d: str) -> DataFrame:
    n = F.length("model")
    names = t(s, d, "eval_subtasks").select(F.concat(F.lit("run-"), n, F.lit("/clean/"), "model", F.lit("/step-"), n * 1000, F.lit("_ppl-12.5")).alias("_name")).distinct()
    return names.select(F.col("_name").alias("name"), *[c.alias(k) for k, c in C.parse_model_name(F.col("_name")).items()])


_PATHS = "(SELECT DISTINCT 'results/' || CASE length(model || subject) % 5 WHEN 0 THEN 'Baseline/step-' || length(subject) WHEN 1 THEN 'green_v' || length(model) || '/' || length(subject) || 'k_mmlu' WHEN 2 THEN 'clean_restart/checkpoint-' || length(subject) || '000' WHEN 3 THEN 't5_base/final' ELSE 'kept/' || 'step-' || (length(subject) * 7) END || '.json' AS path FROM eval_subtasks)"


@query(f"SELECT path, CASE WHEN contains(lower(path), 'baseline') OR contains(lower(path), 't5_base') THEN 'baseline' WHEN contains(lower(path), 'clean_restart') THEN 'clean_restart' WHEN contains(lower(path), 'green') THEN 'green_run' ELSE 'unknown' END AS run_type, coalesce(TRY_CAST(nullif(regexp_extract(path, 'step-(\\d+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(path, '(\\d+)k', 1), '') AS BIGINT) * 1000, TRY_CAST(nullif(regexp_extract(path, '(\\d+)000', 1), '') AS BIGINT) * 1000, 0) AS step FROM {_PATHS}")
def x9b_paths(s: SparkSession, d: str) -> DataFrame:
    """Steps and run types from paths of five shapes."""
    n, m = F.length("subject").cast("string"), F.length("model").cast("string")
    shape = F.length(F.concat("model", "subject")) % 5
    named = F.when(shape == 0, F.concat(F.lit("Baseline/step-"), n)).when(shape == 1, F.concat(F.lit("green_v"), m, F.lit("/"), n, F.lit("k_mmlu"))).when(shape == 2, F.concat(F.lit("clean_restart/checkpoint-"), n, F.lit("000"))).when(shape == 3, F.lit("t5_base/final"))
    paths = t(s, d, "eval_subtasks").select(F.concat(F.lit("results/"), named.otherwise(F.concat(F.lit("kept/step-"), F.length("subject") * 7)), F.lit(".json")).alias("path")).distinct()
    return paths.select("path", *[c.alias(k) for k, c in C.parse_path(F.col("path")).items()])


@query(f"SELECT model, count(*) AS results, round(max(acc), 6) AS best, max_by(subject, struct_pack(a := acc, s := subject)) AS best_subject FROM {_ACC} GROUP BY 1")
def x11_run_report(s: SparkSession, d: str) -> DataFrame:
    a = scores(s, d).filter("acc IS NOT NULL").groupBy("model", "subject").agg(F.avg("acc").alias("acc"))
    return a.groupBy("model").agg(F.count(F.lit(1)).alias("results"), F.round(F.max("acc"), 6).alias("best"), F.max_by("subject", F.struct("acc", "subject")).alias("best_subject"))


@query("SELECT DISTINCT id AS doc_id FROM cleaning_log WHERE id IS NOT NULL")
def x12_ids_of_tables(s: SparkSession, d: str) -> DataFrame:
    """Ids out of logged tables {columns, data}, made from the log's own rows, one table for each run and thousand log rows."""
    rows = t(s, d, "cleaning_log").groupBy("run_id", F.floor(F.col("log_id") / 1000).alias("b")).agg(F.collect_list(F.array(F.col("log_id").cast("string"), "id")).alias("data"))
    return C.ids_of_table(rows.select(F.to_json(F.struct(F.array(F.lit("log"), F.lit("Doc ID")).alias("columns"), "data")).alias("json")))
