"""Readers and writers of documents, statistics and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, at any depth, that fit the glob, or that lie in a folder that fits it: a table of many files is such a folder."""
    read, jvm = spark.read.option("recursiveFileLookup", "true"), spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    above = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/").count("/") + 1
    fits = f"^(?:{jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})$"
    names = F.split("path", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(names.alias("names"), F.transform(F.slice(names, above + 1, 1_000_000), lambda x: x.rlike(fits)).alias("fit"))
    first = above + F.array_position("fit", True).cast("int")
    found = files.filter(F.array_contains("fit", True)).select(F.concat_ws("/", F.slice("names", 1, first)).alias("path"), (first < F.size("names")).alias("folder")).distinct().collect()
    if not any(r.folder for r in found):
        return read.option("pathGlobFilter", glob).parquet(path)
    return read.parquet(*(re.sub(r"([\\{}\[\]*?])", r"\\\1", r.path) for r in found))


def read_documents(spark: SparkSession, path: str, glob: str = "*.parquet", text_key: str = "text", id_key: str = "id", defaults: dict | None = None, limit: int = -1) -> DataFrame:
    """read_files() with text and id under these names, defaults where a column is null or absent."""
    df = read_files(spark, path, glob)
    for old, new in ((text_key, "text"), (id_key, "id")):
        if old != new:
            df = df.drop(new).withColumnRenamed(old, new)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df if limit < 0 else df.limit(limit)


def limit_per_shard(df: DataFrame, shard: str, key: str, limit: int) -> DataFrame:
    """At most limit rows of each shard, in the order of key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(shard).orderBy(key))).filter(F.col("_r") <= limit).drop("_r")


def write_documents(df: DataFrame, path: str, rows_per_file: int = 0, compression: str = "snappy", mode: str = "errorifexists", sort_by: str = "") -> None:
    """Parquet; sorting by a key within partitions lets later lookups skip row groups."""
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    w = out.write.mode(mode).option("compression", compression)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def write_split(df: DataFrame, keep: str, kept_path: str, rejected_path: str) -> None:
    """Rows for which keep holds to one place, all others (null included) to the other, from one evaluation."""
    from corpusloom.runtime import cut

    marked = cut(df.withColumn("_keep", F.coalesce(F.expr(keep), F.lit(False))), "split")
    marked.filter("_keep").drop("_keep").write.parquet(kept_path)
    marked.filter("NOT _keep").drop("_keep").write.parquet(rejected_path)


def write_split_temp(df: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """write_split() into a new place in the shared folder, both sides read back."""
    import uuid

    from corpusloom.runtime import shared_dir

    base = f"{shared_dir(df.sparkSession)}/corpusloom/sinks-{uuid.uuid4().hex}"
    write_split(df, keep, f"{base}/kept", f"{base}/rejected")
    read = df.sparkSession.read.schema(df.schema).parquet
    return read(f"{base}/kept"), read(f"{base}/rejected")


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """(stat_type, kind, metric, json) of a tree {stat}/{summary|histogram}/{metric}/{file}, files ending in .json or, as Spark writes text, .txt."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,txt}").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.split("_metadata.file_path", "/").alias("p"), F.col("value").alias("json"))
    name = lambda k: F.regexp_replace(F.element_at("p", k), "^[a-z_]+=", "")  # noqa: E731  (plain folders, or those of partitions)
    return files.select(name(-4).alias("stat_type"), name(-3).alias("kind"), name(-2).alias("metric"), "json")


def histogram_of_json(stats: DataFrame) -> DataFrame:
    """(stat_type, metric, bucket, n) of histogram files: counts plain or under n."""
    h = stats.filter("kind = 'histogram'").select("stat_type", "metric", F.explode(F.from_json("json", "MAP<STRING, STRING>")).alias("b", "v"))
    n = F.coalesce(F.expr("try_cast(v AS BIGINT)"), F.get_json_object("v", "$.n").cast("long"))
    return h.select("stat_type", "metric", F.expr("try_cast(b AS DOUBLE)").alias("bucket"), n.alias("n")).filter("bucket IS NOT NULL AND n IS NOT NULL")


def summary_of_json(stats: DataFrame) -> DataFrame:
    s = stats.filter("kind = 'summary'").select("stat_type", "metric", F.from_json("json", "summary STRUCT<n: BIGINT, total: DOUBLE, mean: DOUBLE, variance: DOUBLE, std_dev: DOUBLE, min: DOUBLE, max: DOUBLE>")["summary"].alias("s"))
    return s.select("stat_type", "metric", "s.*")


def write_stats_json(df: DataFrame, path: str, by: tuple[str, ...] = ("stat_type", "metric")) -> None:
    """One JSON object a row, in folders by the given columns."""
    df.write.partitionBy(*by).json(path)


def write_histograms_json(hist: DataFrame, path: str) -> None:
    """(stat_type, metric, bucket, n) as the tree that read_stats_json reads: {stat}/histogram/{metric}/{file}.json, each
    file one object from bucket to count. The buckets of a metric are spread over sixteen files."""
    numbered = hist.withColumn("_part", F.pmod(F.xxhash64("bucket"), F.lit(16)))
    files = numbered.groupBy("stat_type", "metric", "_part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("string"), "n")))).alias("value"))
    rows = files.select("stat_type", "metric", "value")
    rows.withColumn("kind", F.lit("histogram")).repartition("stat_type", "metric").write.option("maxRecordsPerFile", 1).partitionBy("stat_type", "kind", "metric").text(path)


def write_csv(df: DataFrame, path: str, order: list[str], digits: int = 6) -> None:
    """Sorted rows with a header; floating numbers with fixed digits. Ranges keep the order over several files."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*cols).write.option("header", "true").csv(path)


def csv_round_trip(df: DataFrame, order: list[str], digits: int = 6) -> DataFrame:
    """write_csv() into a new place in the shared folder, read back with the same columns and types."""
    import uuid

    from corpusloom.runtime import shared_dir

    path = f"{shared_dir(df.sparkSession)}/corpusloom/csv-{uuid.uuid4().hex}"
    write_csv(df, path, order, digits)
    return df.sparkSession.read.schema(df.schema).option("header", "true").option("nullValue", "null").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(id, text): one document a file, stripped; empty files are left out."""
    t = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    return t.filter("text <> ''")


def file_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, files, bytes) of the folder above each file; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    return f.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def validate_parquet(spark: SparkSession, path: str, required: tuple[str, ...] = ("text", "id"), expected: tuple[str, ...] = ("length", "token_count", "fasttext_en", "n_words", "n_sentences")) -> DataFrame:
    """(file, opens, rows, columns, missing, warn, ok): footers are read by the tasks, one row for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    f = pq.ParquetFile(p.removeprefix("file:"))
                    names = f.schema_arrow.names
                    missing = [c for c in required if c not in names]
                    warn = sum(c not in names for c in expected) > len(expected) / 2
                    first = next(f.iter_batches(1, columns=["text"]), None) if "text" in names and f.metadata.num_rows else None
                    blank = first is not None and not (first.column(0)[0].as_py() or "").strip()
                    rows.append((p, True, f.metadata.num_rows, len(names), missing, warn, not missing and not blank))
                except Exception:  # an unreadable file is a finding, not a failure
                    rows.append((p, False, 0, 0, list(required), True, False))
            yield pd.DataFrame(rows, columns=["file", "opens", "rows", "columns", "missing", "warn", "ok"])

    return files.mapInPandas(run, "file string, opens boolean, rows long, columns long, missing array<string>, warn boolean, ok boolean")


def rows_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """Rows of a file by their number in it, from 0."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.row_index").alias("row_index")).filter(F.col("row_index").isin(positions))


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column_name, column_type)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """df whose next action also fills the observation with the measures."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in measures.items()]), o
