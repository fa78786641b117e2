"""Profiling of tables: completeness, duplicates, tops with a rest, shares, outliers, sampling, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(field: T.StructField) -> Column:
    """A string is present if not blank, a number of the name year also if not 0."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return c.isNotNull() & (F.trim(c) != "")
    if "year" in field.name:
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def completeness(df: DataFrame) -> DataFrame:
    """(column_name, total, present_count, present_percent): one scan for all columns."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(present(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("present_count")) for i, f in enumerate(fields)])).alias("x")).select(
        "x.column_name", "total", "x.present_count", F.round(F.col("x.present_count") * 100.0 / F.nullif("total", F.lit(0)), 4).alias("present_percent")
    )


def top_with_rest(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """(label, n): the k most frequent values, the others as Others, nulls and blanks as Missing/Empty; ties by the value."""
    c = F.col(column)
    missing = c.isNull() | (F.trim(c) == "")
    counts = df.filter(~missing).groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(k)
    rest = counts.join(top.select("label"), "label", "left_anti").agg(F.sum("n").alias("n")).filter("n IS NOT NULL").select(F.lit("Others").alias("label"), "n")
    none = df.filter(missing).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("Missing/Empty").alias("label"), "n")
    return reduce(DataFrame.unionByName, [top, rest, none])


def share_or_other(df: DataFrame, column: str, least: float = 0.005) -> DataFrame:
    """(label, n, percent): values above the share, the rest as Other. The window is over one row for each value."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    labelled = counts.crossJoin(F.broadcast(total)).select(F.when(F.col("n") / F.col("t") > least, F.col("label")).otherwise("Other").alias("label"), "n", "t")
    return labelled.groupBy("label").agg(F.sum("n").alias("n"), F.round(F.sum("n") * 100.0 / F.first("t"), 4).alias("percent"))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select(column, "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("percent"))


def duplicates(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Key values that occur at least so often, blanks aside."""
    solid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c)) != "") for c in columns])
    return df.filter(solid).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def sample_per_group(df: DataFrame, group: str | None, key: str, k: int, seed: str = "42") -> DataFrame:
    """k rows of each group (or of all) in a reproducible random order: by md5 of key and seed, ties by the key."""
    order = [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), F.col(key)]
    if group is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def systematic_sample(df: DataFrame, group: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of each group, the first included."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") - 1) % step == 0).drop("_r")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, cells: int = 256) -> DataFrame:
    """(by, one column for each share): exact percentiles, between two values in proportion, as percentile() gives them.

    Equal values are counted first. Approximate quantiles cut the range of a group into cells; a percentile's two
    neighbours are found by counts of cells, then by running counts within their cells alone, so no task gets all
    different values of a group. Groups without values have no row; without groups there is one row, of nulls if there are no values.
    """
    by = by or []
    named = [f"_g{i}" for i in range(len(by))]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, named, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy(*named).agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], cells * 16).alias("_cuts"), F.sum("_n").alias("_total"))
    a, e = counts.alias("a"), ends.alias("e")
    # The number of cuts below a value is its cell; cells rise with the values.
    placed = a.join(F.broadcast(e) if not by else e, reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"e.{n}")) for n in named], F.lit(True))).select(*[F.col(f"a.{n}").alias(n) for n in named], "_v", "_n", "_total", F.expr("CAST(array_size(filter(_cuts, c -> c < _v)) AS INT)").alias("_cell"))
    cell = placed.groupBy(*named, "_cell").agg(F.sum("_n").alias("_in"))
    before = cell.select(*named, "_cell", F.coalesce(F.sum("_in").over(Window.partitionBy(*named).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    p, b = placed.alias("p"), before.alias("b")
    both = p.join(b, reduce(lambda x, y: x & y, [F.col(f"p.{n}").eqNullSafe(F.col(f"b.{n}")) for n in named], F.col("p._cell") == F.col("b._cell"))).select(*[F.col(f"p.{n}").alias(n) for n in named], "_v", "_n", "_total", "p._cell", "_before")
    run = both.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*named, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return run.groupBy(*named).agg(*out).select(*[F.col(n).alias(c) for c, n in zip(by, named, strict=True)], *shares)


def three_digits(score: Column) -> Column:
    """A number from 0 to below 2 with three decimals, rounded by its exact binary value, ties to even (as C does; Java rounds the shortest decimal)."""
    whole = F.lit(2**62).cast("decimal(20,0)")
    scaled = (score * float(2**62)).cast("bigint").cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    down = F.floor(scaled / whole).cast("decimal(4,0)")
    down = F.when(down * whole > scaled, down - 1).otherwise(down).cast("decimal(4,0)")
    rest = (scaled - down * whole) * 2
    k = (down + F.when((rest > whole) | (rest == whole) & (down % 2 == 1), 1).otherwise(0)).cast("int")
    return F.concat(F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))


def language_threshold(df: DataFrame, text: str = "text", score: str = "fasttext_en", least: float = 0.75) -> DataFrame:
    """df with the text of documents below the score blanked, and language_document_kept, fasttext_score_used, language_length_reduction, language_reason; a null score counts as 1."""
    s = F.coalesce(F.col(score), F.lit(1.0))
    keep = s >= least
    added = {"language_document_kept": keep, "fasttext_score_used": s, "language_length_reduction": F.when(keep, 0).otherwise(F.coalesce(F.length(text), F.lit(0))), "language_reason": F.when(~keep, F.concat(F.lit("low_fasttext_en_score_"), three_digits(s)))}
    return df.withColumns(added).withColumn(text, F.when(F.col("language_document_kept"), F.col(text)).otherwise(""))


def recover_band(df: DataFrame, score: str = "fasttext_en", new: float = 0.7, old: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(documents whose score lies in [new, old), marked as recovered with a reason; one row of counts: docs, recovered, too_high, too_low)."""
    s = F.coalesce(F.col(score), F.lit(1.0))
    within = (s >= new) & (s < old)
    marks = {"recovered_by_fasttext": F.lit(True), "recovery_reason": F.concat(F.lit("fasttext_score_"), three_digits(s), F.lit(f"_between_{new}_and_{old}")), "original_fasttext_score": s}
    return df.filter(within).withColumns(marks), df.agg(F.count(F.lit(1)).alias("docs"), F.count_if(within).alias("recovered"), F.count_if(s >= old).alias("too_high"), F.count_if(s < new).alias("too_low"))


def iqr_outliers(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """(q1, q3, lower, upper, outliers, total): quartiles first, then one pass for the counts."""
    q = exact_percentiles(df, value, {"q1": 0.25, "q3": 0.75})
    b = q.withColumns({"lower": F.col("q1") - k * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    return df.select(value).crossJoin(F.broadcast(b)).groupBy("q1", "q3", "lower", "upper").agg(F.count_if((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))).alias("outliers"), F.count(value).alias("total"))


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): bins of equal width from least to greatest; the greatest value belongs to the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).select(value).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, value: str, per_decade: int = 10) -> DataFrame:
    """(bin, n): bins of equal width in the logarithm to the base 10; values up to 0 have none."""
    return df.filter(F.col(value) > 0).groupBy(F.floor(F.log10(value) * per_decade).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def deterministic_order(df: DataFrame, key: str, seed: str = "42", rows: int | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """df with position from 0 in a permutation given by md5 of key and seed.

    Positions come from bucket counts: the first hexadecimal digits of the digest make buckets of about `bucket_rows`
    rows or fewer, so no task sorts all rows. The order is the same for any number of digits. rows: how many, if known.
    """
    n = df.count() if rows is None else rows
    digits = 2
    while 16**digits * bucket_rows < n:
        digits += 1
    d = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))).withColumn("_b", F.substring("_h", 1, digits))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return d.join(before, "_b").withColumn("position", F.col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1).drop("_h", "_b", "_o")


def rank_shard(ordered: DataFrame, world: int, total: int, start: int = 0, drop_last: bool = True) -> DataFrame:
    """ordered with rank and step: positions from start are dealt to the ranks in turn; drop_last leaves out an uneven rest."""
    out = ordered.filter(F.col("position") >= start).withColumns({"rank": F.pmod("position", F.lit(world)).cast("int"), "step": F.floor(F.col("position") / world)})
    return out.filter(F.col("step") < total // world) if drop_last else out


def split_exact(df: DataFrame, key: str, share: float, least: int = 0, seed: str = "42", total: int | None = None) -> DataFrame:
    """df with split: the first max(int(n * share), least) rows of the deterministic order are val, the others train."""
    n = df.count() if total is None else total
    val = min(n, max(int(n * share), least))
    return deterministic_order(df, key, seed, n).withColumn("split", F.when(F.col("position") < val, "val").otherwise("train"))
