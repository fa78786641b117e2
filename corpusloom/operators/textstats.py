"""Text statistics as columns, their long form, and summaries and histograms of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English words that carry no content.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


_CLASSES = {"S": " \t\n\x0b\f\r", "D": "0123456789", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "L": "abcdefghijklmnopqrstuvwxyz", "P": "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())}


def _classed(text: Column) -> Column:
    """text with each ASCII sign as the letter of its class: one translation for all counts."""
    return F.translate(text, "".join(_CLASSES.values()), "".join(k * len(v) for k, v in _CLASSES.items()))


def _signs(text: Column, kinds: str) -> Column:
    """How many characters of text are of the kinds: S white space, D digits, U and L letters, P punctuation; no regular expression."""
    classed = _classed(text)
    return reduce(lambda a, b: a + b, [F.length(classed) - F.length(F.replace(classed, F.lit(k), F.lit(""))) for k in kinds])


def _mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x)) / F.size(a))


def _share(a: Column, p) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(a, p)) / F.size(a))


def doc_stats(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "length": F.length(text).cast("double"),
        "white_space_ratio": _signs(text, "S") / n,
        "digit_ratio": _signs(text, "D") / n,
        "uppercase_ratio": _signs(text, "U") / n,
        "punctuation_ratio": _signs(text, "P") / n,
        "non_alpha_digit_ratio": (F.length(text) - _signs(text, "ULD")) / n,
        "elipsis_ratio": _count(text, r"\.\.\.|…") / n,
    }


def line_stats(text: Column, short: tuple[int, ...] = (10, 30), long: tuple[int, ...] = (2000, 10000)) -> dict[str, Column]:
    lines = F.split(text, "\n")
    distinct = F.array_distinct(lines)
    chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    out = {"n_lines": F.size(lines).cast("double"), "avg_line_length": _mean(lines)}
    # A lambda with two parameters would be given the index as the second one, so bounds come by closure.
    at_most, at_least = (lambda k: lambda x: F.length(x) <= k), (lambda k: lambda x: F.length(x) >= k)
    out |= {f"short_line_ratio_chars_{k}": _share(lines, at_most(k)) for k in short}
    out |= {f"long_line_ratio_chars_{k}": _share(lines, at_least(k)) for k in long}
    return out | {
        "lines_ending_with_terminal_mark_ratio": _share(lines, lambda x: x.rlike(r"[.!?]\s*$")),
        "bullet_point_lines_ratio": _share(lines, lambda x: x.rlike(r"^\s*[-*•]")),
        "line_duplicates": 1 - F.size(distinct) / F.size(lines),
        "line_char_duplicates": F.when(chars == 0, 0.0).otherwise(1 - F.aggregate(distinct, F.lit(0), lambda a, x: a + F.length(x)) / chars),
    }


def paragraph_stats(text: Column) -> dict[str, Column]:
    paras = F.split(text, "\n\n")
    distinct = F.array_distinct(paras)
    chars = F.aggregate(paras, F.lit(0), lambda a, x: a + F.length(x))
    return {
        "n_paragraphs": F.size(paras).cast("double"),
        "avg_paragraph_length": _mean(paras),
        "short_paragraph_ratio_100": _share(paras, lambda x: F.length(x) <= 100),
        "long_paragraph_ratio_1000": _share(paras, lambda x: F.length(x) >= 1000),
        "paragraph_duplicates": 1 - F.size(distinct) / F.size(paras),
        "paragraph_char_duplicates": F.when(chars == 0, 0.0).otherwise(1 - F.aggregate(distinct, F.lit(0), lambda a, x: a + F.length(x)) / chars),
    }


def sentence_stats(text: Column) -> dict[str, Column]:
    """Sentences by a plain rule: they end at . ! or ? before a blank."""
    parts = F.filter(F.split(text, r"[.!?]+\s+"), lambda x: x != "")
    return {"n_sentences": F.size(parts).cast("double"), "avg_sentence_length": _mean(parts), "short_sentence_ratio_20": _share(parts, lambda x: F.length(x) <= 20), "long_sentence_ratio_75": _share(parts, lambda x: F.length(x) >= 75)}


def word_stats(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return {
        "n_words": F.size(words).cast("double"),
        "avg_word_length": _mean(words),
        "avg_words_per_line": F.size(words) / F.size(F.split(text, "\n")),
        "short_word_ratio_3": _share(words, lambda x: F.length(x) <= 3),
        "long_word_ratio_7": _share(words, lambda x: F.length(x) >= 7),
        "type_token_ratio": F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_distinct(words)) / F.size(words)),
        "uppercase_word_ratio": _share(words, lambda x: x.rlike("^[A-Z]+$")),
        "capitalized_word_ratio": _share(words, lambda x: x.rlike("^[A-Z][a-z]*$")),
        "stop_word_ratio": _share(words, lambda x: F.lower(x).isin(STOP_WORDS)),
    }


def window_quality(text: Column) -> dict[str, Column]:
    """Ratios for windows: capitals among letters, punctuation and others among all characters."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = _signs(text, "UL")
    others = F.length(text) - _signs(text, "ULDS")
    return {"length": n, "punct_ratio": _signs(text, "P") / n, "non_alnum_ratio": others / n, "uppercase_ratio": F.when(letters > 0, _signs(text, "U") / letters).otherwise(0.0)}


GROUPS = {"doc": doc_stats, "line": line_stats, "paragraph": paragraph_stats, "sentence": sentence_stats, "word": word_stats}


def with_stats(df: DataFrame, text: str = "text", groups: tuple[str, ...] = ("doc", "line", "paragraph")) -> DataFrame:
    """df with the metrics of the groups as columns: enrichment. Null texts get nulls."""
    return df.withColumns(reduce(lambda a, g: a | GROUPS[g](F.col(text)), groups, {}))


def long_metrics(df: DataFrame, key: list[str], groups: tuple[str, ...] = ("doc", "line", "paragraph"), text: str = "text") -> DataFrame:
    """(key, stat_type, metric, value): one pass over the texts; nulls are left out."""
    # Metrics are columns first, so that what they share (split lines, translated text) is worked out once.
    named = {(g, m): c for g in groups for m, c in GROUPS[g](F.col(text)).items()}
    wide = df.select(*key, *[c.cast("double").alias(f"_m{i}") for i, c in enumerate(named.values())])
    entries = [F.struct(F.lit(g).alias("stat_type"), F.lit(m).alias("metric"), F.col(f"_m{i}").alias("value")) for i, (g, m) in enumerate(named)]
    return wide.select(*key, F.explode(F.array(*entries)).alias("m")).select(*key, "m.*").filter("value IS NOT NULL")


def summary(metrics: DataFrame, by: tuple[str, ...] = ("stat_type", "metric"), value: str = "value") -> DataFrame:
    """n, total, mean, variance and std of the population, min, max."""
    v = F.col(value)
    return metrics.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"))


def histogram(metrics: DataFrame, by: tuple[str, ...] = ("stat_type", "metric"), value: str = "value", digits: int = 3) -> DataFrame:
    """(by, bucket, n): counts of rounded values."""
    return metrics.groupBy(*by, F.round(value, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_summaries(parts: DataFrame, by: tuple[str, ...] = ("stat_type", "metric")) -> DataFrame:
    """Summaries of shards as one: counts and sums add up, variances by their distances from the common mean."""
    total = F.sum("total") / F.sum("n")
    square = F.sum(F.col("n") * (F.col("variance") + F.col("mean") * F.col("mean"))) / F.sum("n") - total * total
    out = parts.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), total.alias("mean"), F.greatest(square, F.lit(0.0)).alias("variance"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.withColumn("std_dev", F.sqrt("variance"))


def merge_histograms(parts: DataFrame, by: tuple[str, ...] = ("stat_type", "metric")) -> DataFrame:
    return parts.filter("bucket IS NOT NULL").groupBy(*by, F.col("bucket").cast("double").alias("bucket")).agg(F.sum("n").alias("n"))


def weighted_moments(hist: DataFrame, by: tuple[str, ...] = ("stat_type", "metric")) -> DataFrame:
    """(by, n, mean, std): mean and population deviation of bucket values."""
    n, b = F.sum("n"), F.col("bucket")
    mean = F.sum(b * F.col("n")) / n
    return hist.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(b * b * F.col("n")) / n - mean * mean, F.lit(0.0))).alias("std"))


def histogram_percentiles(hist: DataFrame, percents: tuple[int, ...] = (25, 50, 75, 95, 99), by: tuple[str, ...] = ("stat_type", "metric"), side: str = "left") -> DataFrame:
    """(by, p25, …): least bucket whose running count reaches the share. right: must exceed it. Null past the end."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*by))
    run = hist.select(*by, "bucket", F.sum("n").over(w).alias("c"), total.alias("t"))
    reach = (lambda p: F.col("c") * 100 >= F.col("t") * p) if side == "left" else (lambda p: F.col("c") * 100 > F.col("t") * p)
    return run.groupBy(*by).agg(*[F.min(F.when(reach(p), F.col("bucket"))).alias(f"p{p}") for p in percents])


def metric_table(hist: DataFrame, summaries: DataFrame | None = None, by: tuple[str, ...] = ("stat_type", "metric")) -> DataFrame:
    """Moments and percentiles of each metric from its histogram, or, where there is none, what its summary has; with cv, iqr and range."""
    h = weighted_moments(hist, by).join(histogram_percentiles(hist, by=by), list(by)).join(hist.groupBy(*by).agg(F.min("bucket").alias("min"), F.max("bucket").alias("max")), list(by)).withColumn("data_source", F.lit("histogram"))
    if summaries is not None:
        s = summaries.join(h, list(by), "left_anti").select(*by, "n", "mean", F.col("std_dev").alias("std"), "min", "max", F.lit("summary").alias("data_source"))
        h = h.unionByName(s, allowMissingColumns=True)
    return h.withColumns({"cv": F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean")), "iqr": F.col("p75") - F.col("p25"), "range": F.col("max") - F.col("min")})


def shape_indicators(table: DataFrame) -> DataFrame:
    """skew and tail from percentiles; rows where either isn't finite are left out."""
    up, down = F.col("p95") - F.col("p50"), F.col("p50") - F.col("p25")
    return table.withColumns({"skew": (up - down) / F.nullif(up + down, F.lit(0.0)), "tail": (F.col("p99") - F.col("p95")) / F.nullif(F.col("p95") - F.col("p75"), F.lit(0.0))}).filter("skew IS NOT NULL AND tail IS NOT NULL")
