"""Comparison of documents and of evaluation results: diffs, baselines, ranks, matrices, parsers."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import arrow_columns


def line_diff(before: str | None, after: str | None) -> tuple[str, int, int, bool]:
    """(unified diff, lines added, lines removed, whether anything changed); null counts as empty."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    diff = list(difflib.unified_diff(a, b, lineterm=""))
    body = diff[2:]
    return "\n".join(diff), sum(x[:1] == "+" for x in body), sum(x[:1] == "-" for x in body), bool(body)


def word_diff(before: str | None, after: str | None) -> str:
    """Words with [-removed-] and {+added+} parts marked."""
    a, b = (before or "").split(), (after or "").split()
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += a[i:j]
        else:
            out += [f"[-{' '.join(a[i:j])}-]"] * (j > i) + [f"{{+{' '.join(b[k:m])}+}}"] * (m > k)
    return " ".join(out)


def side_by_side(before: str | None, after: str | None) -> list[tuple[str, int | None, int | None, str, str]]:
    """(kind, line before, line after, text before, text after); replaced lines that are alike by more than half get a word diff."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    rows: list[tuple[str, int | None, int | None, str, str]] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for d in range(max(j - i, m - k)):
            x, y = (a[i + d] if i + d < j else None), (b[k + d] if k + d < m else None)
            kind = "equal" if op == "equal" else "insert" if x is None else "delete" if y is None else "replace"
            if kind == "replace" and difflib.SequenceMatcher(None, x, y).ratio() > 0.5:
                kind, y = "change", word_diff(x, y)
            rows.append((kind, i + d + 1 if x is not None else None, k + d + 1 if y is not None else None, x or "", y or ""))
    return rows


def with_diffs(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """pairs with diff, lines_added, lines_removed, has_changes and word_diff, in one Arrow stage."""
    return arrow_columns(pairs, [before, after], "diff string, lines_added int, lines_removed int, has_changes boolean, word_diff string", lambda a, b: (*line_diff(a, b), word_diff(a, b)))


def side_by_side_rows(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, row_no, kind, left_no, right_no, left, right): the rows of a side-by-side view."""
    source = pairs.select(F.col(key).alias("key"), F.col(before).alias("x"), F.col(after).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *r) for k, x, y in zip(b["key"], b["x"], b["y"], strict=True) for n, r in enumerate(side_by_side(x, y), 1)]
            out = pd.DataFrame(rows, columns=["key", "row_no", "kind", "left_no", "right_no", "left", "right"])
            yield out.astype({"left_no": "Int64", "right_no": "Int64"})

    return source.mapInPandas(run, f"key {source.schema['key'].dataType.simpleString()}, row_no long, kind string, left_no long, right_no long, left string, right string")


def against_baseline(scores: DataFrame, baseline: str | DataFrame, model: str = "model", by: str = "benchmark", score: str = "score") -> DataFrame:
    """scores with baseline_score, delta and percent; percent is null where the baseline is null or not above 0. baseline: the model's name, or one row with it."""
    own = scores.filter(F.col(model) == baseline) if isinstance(baseline, str) else scores.join(F.broadcast(baseline.toDF(model)), model, "left_semi")
    base = own.groupBy(by).agg(F.max(score).alias("baseline_score"))
    out = scores.join(base, by, "left").withColumn("delta", F.col(score) - F.col("baseline_score"))
    return out.withColumn("percent", F.when(F.col("baseline_score") > 0, F.col("delta") / F.col("baseline_score") * 100))


def before_after(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, before, after, diff, pct_change) of metrics that both have."""
    j = before.select(*by, F.col(value).alias("before")).join(after.select(*by, F.col(value).alias("after")), by)
    return j.withColumns({"diff": F.col("after") - F.col("before"), "pct_change": F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100)})


def ranked(scores: DataFrame, by: str, score: str, model: str) -> DataFrame:
    """scores with rank (nulls last, ties by the model) and gap, the distance to the next better one; groups of one model are left out."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), F.col(model))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return scores.withColumns({"rank": F.row_number().over(w), "gap": F.col(score) - F.lag(score).over(w), "_n": n}).filter("_n > 1").drop("_n")


def thirds(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with third: early, middle or late by whole n // 3 rows of the group's order; the rest is late."""
    w = Window.partitionBy(group).orderBy(order)
    k = F.floor(F.count(F.lit(1)).over(Window.partitionBy(group)) / 3)
    r = F.row_number().over(w) - 1
    return df.withColumn("third", F.when(r < k, "early").when(r < 2 * k, "middle").otherwise("late"))


def greedy_intervals(df: DataFrame, group: str, step: str, interval: int) -> DataFrame:
    """(group, step): from each group's ordered steps those at least `interval` after the last one taken, the first included.

    Steps are made distinct before the shuffle; a group's array holds its different steps, not its rows.
    """
    df = df.filter(F.col(step).isNotNull()).select(group, F.col(step).cast("bigint").alias(step)).distinct()
    empty = F.array().cast("array<bigint>")
    taken = F.aggregate(F.sort_array(F.collect_list(step)), empty, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= interval), F.concat(a, F.array(x))).otherwise(a))
    return df.groupBy(group).agg(taken.alias("t")).select(group, F.explode("t").alias(step))


def parse_results(df: DataFrame, column: str = "json") -> DataFrame:
    """df with task, metric, value: one row for each metric of an evaluation's JSON {results: {task: {metric: value}}}; bad JSON has none."""
    parsed = F.from_json(column, "results MAP<STRING, MAP<STRING, STRING>>")["results"]
    return df.withColumn("_r", parsed).select("*", F.explode("_r").alias("task", "_m")).select("*", F.explode("_m").alias("metric", "_v")).withColumn("value", F.expr("try_cast(_v AS DOUBLE)")).drop("_r", "_m", "_v")


def best_metric(metrics: Column) -> Column:
    """First present of accuracy, normalised accuracy and exact match, then perplexities, of a map of metrics."""
    names = ["acc,none", "acc_norm,none", "exact_match,none", "word_perplexity,none", "byte_perplexity,none", "bits_per_byte,none"]
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def parse_model_name(name: Column) -> dict[str, Column]:
    """run_type, run_no, step, perplexity from a run's path; step-N and Nk are read, Nk as thousands."""
    step = F.coalesce(F.expr("try_cast(nullif(regexp_extract({0}, 'step[-_=](\\\\d+)', 1), '') AS BIGINT)".format("_name")), F.expr("try_cast(nullif(regexp_extract(_name, '(\\\\d+)k(?:[^a-z]|$)', 1), '') AS BIGINT)") * 1000)
    return {
        "run_type": F.when(name.contains("clean"), "clean").when(name.contains("raw"), "raw").otherwise("other"),
        "run_no": F.expr("try_cast(nullif(regexp_extract(_name, 'run[-_]?(\\\\d+)', 1), '') AS INT)"),
        "step": step,
        "perplexity": F.expr("try_cast(nullif(regexp_extract(_name, 'ppl[-_=]?(\\\\d+(?:\\\\.\\\\d+)?)', 1), '') AS DOUBLE)"),
    }


def parse_path(path: Column) -> dict[str, Column]:
    """run_type and step from a result file's path. Types by the first of their marks in any case; steps as step-N, Nk (in
    thousands) or a number of whole thousands, else 0."""
    low = F.lower(path)
    number = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).try_cast("bigint")
    kind = F.when(low.contains("baseline") | low.contains("t5_base"), "baseline").when(low.contains("clean_restart"), "clean_restart").when(low.contains("green"), "green_run").otherwise("unknown")
    return {"run_type": kind, "step": F.coalesce(number(r"step-(\d+)"), number(r"(\d+)k") * 1000, number(r"(\d+)000") * 1000, F.lit(0).cast("bigint"))}


def ids_of_table(df: DataFrame, column: str = "json", header: str = "Doc ID") -> DataFrame:
    """(doc_id): distinct values of a column of logged tables {columns: [...], data: [[...]]}."""
    t = df.select(F.from_json(column, "columns ARRAY<STRING>, data ARRAY<ARRAY<STRING>>").alias("t")).select("t.*", F.array_position("t.columns", header).cast("int").alias("at")).filter("at > 0")
    return t.select(F.explode("data").alias("row"), "at").select(F.try_element_at("row", F.col("at")).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
