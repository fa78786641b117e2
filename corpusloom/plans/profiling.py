"""Scans, filters, profiles, joins and samples over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import profiles as P
from corpusloom.plans.registry import query
from corpusloom.runtime import table as t
from corpusloom.sources import io

MD5 = "md5(concat_ws('|', CAST({0} AS VARCHAR), '42'))"


@query("SELECT id, text, coalesce(fasttext_en, 1.0) AS fasttext_en, 'sci' AS corpus FROM documents")
def io1_read_documents(s: SparkSession, d: str) -> DataFrame:
    return io.read_documents(s, d, "documents.parquet", defaults={"fasttext_en": 1.0, "corpus": "sci"}).select("id", "text", "fasttext_en", "corpus")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def io2_limit_per_shard(s: SparkSession, d: str) -> DataFrame:
    return io.limit_per_shard(t(s, d, "documents"), "source", "doc_id", 5).select("doc_id", "source")


@query("SELECT CASE WHEN coalesce(regexp_matches(text, '\\S'), false) THEN 'kept' ELSE 'rejected' END AS sink, count(*) AS n FROM documents GROUP BY 1")
def io4_rejected_sink(s: SparkSession, d: str) -> DataFrame:
    """Both sinks are written, then read back and counted."""
    kept, rejected = io.write_split_temp(t(s, d, "documents"), r"text RLIKE '\\S'")
    count = lambda df, sink: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(sink).alias("sink"), "n")
    return count(kept, "kept").unionByName(count(rejected, "rejected"))


@query("SELECT count(*) AS n, sum(length(text)) AS chars FROM documents")
def io9_scan(s: SparkSession, d: str) -> DataFrame:
    return io.read_files(s, d, "documents.parquet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT column_name FROM (DESCRIBE SELECT * FROM raw_corpus)")
def io10_schema(s: SparkSession, d: str) -> DataFrame:
    return io.schema_of(t(s, d, "raw_corpus")).select("column_name")


@query()
def io12_file_sizes(s: SparkSession, d: str) -> DataFrame:
    return io.file_sizes(s, d, "*.parquet")


@query()
def io13_validate(s: SparkSession, d: str) -> DataFrame:
    return io.validate_parquet(s, d)


def _place(s: SparkSession, name: str) -> str:
    """A new place in the shared folder for what a query writes and reads again."""
    import uuid

    from corpusloom.runtime import shared_dir

    return f"{shared_dir(s)}/corpusloom/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, md5(text) AS digest FROM documents")
def io3_io8_chunked_files(s: SparkSession, d: str) -> DataFrame:
    """Documents written in files of at most 10,000 rows, sorted by their key, and read again."""
    path = _place(s, "chunked")
    io.write_documents(t(s, d, "documents"), path, rows_per_file=10_000, sort_by="doc_id")
    return io.read_documents(s, path).select("doc_id", "source", F.md5("text").alias("digest"))


@query("SELECT stat_type, metric, bucket, CAST(sum(n) AS BIGINT) AS n FROM metric_buckets WHERE bucket IS NOT NULL AND stage = (SELECT min(stage) FROM metric_buckets) GROUP BY 1, 2, 3")
def io5_json_histograms(s: SparkSession, d: str) -> DataFrame:
    """Histograms of the first stage as a tree of JSON files, read again."""
    path = _place(s, "stats")
    h = t(s, d, "metric_buckets").filter("bucket IS NOT NULL")
    first = h.join(F.broadcast(t(s, d, "metric_buckets").agg(F.min("stage").alias("stage"))), "stage", "left_semi")
    merged = first.groupBy("stat_type", "metric", "bucket").agg(F.sum("n").alias("n"))
    io.write_histograms_json(merged, path)
    return io.histogram_of_json(io.read_stats_json(s, path)).groupBy("stat_type", "metric", "bucket").agg(F.sum("n").alias("n"))


@query("SELECT run_id, count(*) AS docs, CAST(sum(figure_lines_removed) AS BIGINT) AS figure_lines FROM cleaning_log GROUP BY 1")
def io7_json_report(s: SparkSession, d: str) -> DataFrame:
    """Totals of each run as a JSON report, read again."""
    path = _place(s, "report")
    totals = t(s, d, "cleaning_log").groupBy("run_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("figure_lines_removed").alias("figure_lines"))
    io.write_report(totals, path)
    return s.read.schema(totals.schema).json(path)


@query("SELECT row_index, doc_id FROM (SELECT doc_id, row_number() OVER () - 1 AS row_index FROM documents) WHERE row_index IN (0, 7, 99, 100)")
def io14_rows_at(s: SparkSession, d: str) -> DataFrame:
    return io.rows_at(s, f"{d}/documents.parquet", [0, 7, 99, 100]).select("row_index", "doc_id")


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def s1_event_windows(s: SparkSession, d: str) -> DataFrame:
    """The windowed counts of the stream over the whole table at once."""
    from corpusloom.streaming.documents import event_counts

    counted = event_counts(t(s, d, "events"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS docs_processed, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS docs_empty, coalesce(sum(length(text)), 0) AS chars FROM documents")
def io16_counters(s: SparkSession, d: str) -> DataFrame:
    """Counters that a pass over the documents fills on its way, without a job of their own."""
    empty = F.col("text").isNull() | (F.trim("text") == "")
    seen, counters = io.observed(t(s, d, "documents"), "counters", docs_processed=F.count(F.lit(1)), docs_empty=F.count_if(empty), chars=F.coalesce(F.sum(F.length("text")), F.lit(0)))
    seen.write.format("noop").mode("overwrite").save()
    c = counters.get
    return s.createDataFrame([(c["docs_processed"], c["docs_empty"], c["chars"])], "docs_processed long, docs_empty long, chars long")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')")
def f1_non_empty(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id")


@query("SELECT doc_id, coalesce(fasttext_en, 1.0) >= 0.75 AS language_document_kept, coalesce(fasttext_en, 1.0) AS fasttext_score_used, CASE WHEN coalesce(fasttext_en, 1.0) >= 0.75 THEN 0 ELSE coalesce(length(text), 0) END AS language_length_reduction, CASE WHEN coalesce(fasttext_en, 1.0) < 0.75 THEN printf('low_fasttext_en_score_%.3f', coalesce(fasttext_en, 1.0)) END AS language_reason, md5(CASE WHEN coalesce(fasttext_en, 1.0) >= 0.75 THEN text ELSE '' END) AS digest FROM documents")
def f2_language_threshold(s: SparkSession, d: str) -> DataFrame:
    return P.language_threshold(t(s, d, "documents")).select("doc_id", "language_document_kept", "fasttext_score_used", "language_length_reduction", "language_reason", F.md5("text").alias("digest"))


_BAND = "coalesce(fasttext_en, 1.0) >= 0.70 AND coalesce(fasttext_en, 1.0) < 0.75"


@query(f"SELECT doc_id, true AS recovered_by_fasttext, printf('fasttext_score_%.3f_between_0.7_and_0.75', coalesce(fasttext_en, 1.0)) AS recovery_reason, coalesce(fasttext_en, 1.0) AS original_fasttext_score FROM documents WHERE {_BAND}")
def f3_score_band(s: SparkSession, d: str) -> DataFrame:
    return P.recover_band(t(s, d, "documents"))[0].select("doc_id", "recovered_by_fasttext", "recovery_reason", "original_fasttext_score")


@query(f"SELECT count(*) AS docs, count(*) FILTER (WHERE {_BAND}) AS recovered, count(*) FILTER (WHERE coalesce(fasttext_en, 1.0) >= 0.75) AS too_high, count(*) FILTER (WHERE coalesce(fasttext_en, 1.0) < 0.70) AS too_low FROM documents")
def f3_recovery_counts(s: SparkSession, d: str) -> DataFrame:
    return P.recover_band(t(s, d, "documents"))[1]


@query("SELECT row_id FROM raw_corpus WHERE title IS NOT NULL AND trim(title) <> ''")
def f5_non_blank(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").filter("title IS NOT NULL AND trim(title) <> ''").select("row_id")


@query("SELECT row_id, TRY_CAST(language_score AS DOUBLE) AS score FROM raw_corpus WHERE TRY_CAST(language_score AS DOUBLE) IS NOT NULL")
def f6_castable(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").select("row_id", F.expr("try_cast(language_score AS DOUBLE)").alias("score")).filter("score IS NOT NULL")


@query("SELECT CASE WHEN v < 0.2 THEN 0 WHEN v < 0.4 THEN 1 WHEN v < 0.6 THEN 2 WHEN v < 0.8 THEN 3 ELSE 4 END AS band, count(*) AS n FROM (SELECT TRY_CAST(language_score AS DOUBLE) AS v FROM raw_corpus) WHERE v IS NOT NULL GROUP BY 1")
def f7_score_bands(s: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    band = F.when(v < 0.2, 0).when(v < 0.4, 1).when(v < 0.6, 2).when(v < 0.8, 3).otherwise(4)
    return t(s, d, "raw_corpus").select(F.expr("try_cast(language_score AS DOUBLE)").alias("v")).filter("v IS NOT NULL").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, publication_year FROM raw_corpus WHERE publication_year IS NOT NULL AND publication_year <> 0 AND publication_year BETWEEN 1800 AND 2026")
def f8_year_sanity(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").filter("publication_year <> 0 AND publication_year BETWEEN 1800 AND 2026").select("row_id", "publication_year")


FORMATS = "CASE WHEN source_file_path LIKE '%.grobid.tei.xml' THEN 'grobid' WHEN source_file_path LIKE '%.tei.xml' THEN 'tei' WHEN source_file_path LIKE '%.xml' THEN 'xml' WHEN source_file_path LIKE '%.pdf' THEN 'pdf' WHEN source_file_path LIKE '%.txt' THEN 'txt' ELSE 'other' END"


@query(f"SELECT {FORMATS} AS format, count(*) AS n FROM raw_corpus GROUP BY 1")
def f9_suffix_class(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").groupBy(F.expr(FORMATS).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, source_zip_content_path FROM raw_corpus WHERE source_zip_content_path IN (SELECT source_zip_content_path FROM archives WHERE language = 'fr') OR title = 'Introduction'")
def f10_in_list(s: SparkSession, d: str) -> DataFrame:
    r = t(s, d, "raw_corpus")
    listed = r.join(t(s, d, "archives").filter("language = 'fr'").select("source_zip_content_path").withColumn("hit", F.lit(True)).distinct(), "source_zip_content_path", "left")
    return listed.filter("hit OR title = 'Introduction'").select("row_id", "source_zip_content_path")


@query("SELECT id FROM documents WHERE contains(lower(id), lower((SELECT right(max(id), 2) FROM documents))) ORDER BY id LIMIT 20")
def f11_id_search(s: SparkSession, d: str) -> DataFrame:
    """The first 20 ids that hold a term in any case; the term is the end of the last id."""
    docs = t(s, d, "documents").select("id")
    term = F.broadcast(docs.agg(F.lower(F.substring(F.max("id"), -2, 2)).alias("term")))
    return docs.join(term, F.contains(F.lower("id"), F.col("term"))).select("id").orderBy("id").limit(20)


@query("SELECT row_id FROM raw_corpus WHERE lower(replace(id, ' ', '')) = (SELECT lower(min(id)) FROM documents)")
def f12_id_lookup(s: SparkSession, d: str) -> DataFrame:
    wanted = t(s, d, "documents").agg(F.lower(F.min("id")).alias("w"))
    return t(s, d, "raw_corpus").join(F.broadcast(wanted), F.lower(F.replace("id", F.lit(" "), F.lit(""))) == F.col("w"), "left_semi").select("row_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '')) >= 10")
def f13_min_tokens(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter(F.size(F.filter(F.split("text", "[ \t\n]+"), lambda x: x != "")) >= 10).select("doc_id")


@query("SELECT count(*) AS n FROM raw_corpus")
def a1_count(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE title IS NULL) AS null_title, count(*) FILTER (WHERE trim(title) = '') AS blank_title, count(*) FILTER (WHERE doi IS NULL) AS null_doi, count(*) FILTER (WHERE publication_year = 0) AS zero_year FROM raw_corpus")
def a2_conditional_sums(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").agg(F.count_if(F.col("title").isNull()).alias("null_title"), F.count_if(F.trim("title") == "").alias("blank_title"), F.count_if(F.col("doi").isNull()).alias("null_doi"), F.count_if(F.col("publication_year") == 0).alias("zero_year"))


@query("SELECT publisher, count(*) AS n FROM raw_corpus GROUP BY 1")
def a3_group_count(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").groupBy("publisher").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, count(*) AS n FROM raw_corpus WHERE id IS NOT NULL AND trim(id) <> '' GROUP BY 1 HAVING count(*) > 1")
def a4_duplicates(s: SparkSession, d: str) -> DataFrame:
    return P.duplicates(t(s, d, "raw_corpus"), ["id"])


@query("SELECT count(DISTINCT id) AS ids, count(DISTINCT publisher) AS publishers FROM raw_corpus")
def a5_count_distinct(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").agg(F.countDistinct("id").alias("ids"), F.countDistinct("publisher").alias("publishers"))


@query("SELECT DISTINCT language, journal FROM raw_corpus")
def a6_distinct(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").select("language", "journal").distinct()


@query("SELECT min(v) AS q0, max(v) AS q100, true AS q25_near, true AS q50_near, true AS q75_near FROM (SELECT TRY_CAST(language_score AS DOUBLE) AS v FROM raw_corpus) WHERE v IS NOT NULL")
def a7_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Approximate quantiles from mergeable sketches; each must lie within a thousandth of its rank."""
    v = t(s, d, "raw_corpus").select(F.expr("try_cast(language_score AS DOUBLE)").alias("v")).filter("v IS NOT NULL")
    q = v.agg(F.min("v").alias("q0"), F.percentile_approx("v", [0.25, 0.5, 0.75], 10_000).alias("q"), F.max("v").alias("q100"))
    ranks = v.join(F.broadcast(q)).groupBy("q0", "q100").agg(*[(F.count_if(F.col("v") < F.col("q")[i]) <= F.count("v") * (p + 0.001)).alias(f"lo{i}") for i, p in enumerate((0.25, 0.5, 0.75))], *[(F.count_if(F.col("v") <= F.col("q")[i]) >= F.count("v") * (p - 0.001)).alias(f"hi{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    return ranks.select("q0", "q100", *[(F.col(f"lo{i}") & F.col(f"hi{i}")).alias(f"q{p}_near") for i, p in enumerate((25, 50, 75))])


@query("SELECT source, round(quantile_cont(length(text), 0.25), 4) AS p25, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.75), 4) AS p75, round(quantile_cont(length(text), 0.95), 4) AS p95, min(length(text)) AS lo, max(length(text)) AS hi, round(avg(length(text)), 4) AS mean FROM documents GROUP BY 1")
def a8_percentiles(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("source", F.length("text").alias("n"))
    p = P.exact_percentiles(docs, "n", {f"p{p}": p / 100 for p in (25, 50, 75, 95)}, ["source"])
    ends = docs.groupBy("source").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 4).alias("mean"))
    return ends.join(p, ends["source"].eqNullSafe(p["source"]), "left").select(ends["source"], *[F.round(f"p{x}", 4).alias(f"p{x}") for x in (25, 50, 75, 95)], "lo", "hi", "mean")


@query("WITH c AS (SELECT quantile_cont(length(text), 0.95) AS cap FROM documents) SELECT count(*) FILTER (WHERE length(text) <= cap) AS kept, round(100.0 * count(*) FILTER (WHERE length(text) > cap) / count(text), 4) AS outlier_percent FROM documents, c")
def a9_capped(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select(F.length("text").alias("n"))
    cap = P.exact_percentiles(docs, "n", {"cap": 0.95})
    return docs.crossJoin(F.broadcast(cap)).agg(F.count_if(F.col("n") <= F.col("cap")).alias("kept"), F.round(F.count_if(F.col("n") > F.col("cap")) * 100.0 / F.count("n"), 4).alias("outlier_percent"))


@query("WITH q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM (SELECT length(text) AS n FROM documents)), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q) SELECT q1, q3, lower, upper, count(*) FILTER (WHERE length(text) < lower OR length(text) > upper) AS outliers, count(text) AS total FROM documents, b GROUP BY ALL")
def a10_iqr_outliers(s: SparkSession, d: str) -> DataFrame:
    return P.iqr_outliers(t(s, d, "documents").select(F.length("text").cast("double").alias("n")), "n")


_COMPLETE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(*) FILTER (WHERE {p}) AS present_count, round(count(*) FILTER (WHERE {p}) * 100.0 / count(*), 4) AS present_percent FROM raw_corpus"
    for c, p in [(c, f"{c} IS NOT NULL AND trim({c}) <> ''") for c in ("id", "text", "title", "doi", "authors", "publisher", "journal", "journal_abbrev")] + [("publication_year", "publication_year IS NOT NULL AND publication_year <> 0"), ("ingested_at", "ingested_at IS NOT NULL")]
)


@query(_COMPLETE)
def a11_completeness(s: SparkSession, d: str) -> DataFrame:
    return P.completeness(t(s, d, "raw_corpus").select("id", "text", "title", "doi", "authors", "publisher", "journal", "journal_abbrev", "publication_year", "ingested_at"))


@query("WITH c AS (SELECT publisher AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, publisher) AS r FROM raw_corpus WHERE trim(publisher) <> '' GROUP BY 1) SELECT label, n FROM c WHERE r <= 10 UNION ALL SELECT 'Others', CAST(sum(n) AS BIGINT) FROM c WHERE r > 10 HAVING sum(n) IS NOT NULL UNION ALL SELECT 'Missing/Empty', count(*) FROM raw_corpus WHERE publisher IS NULL OR trim(publisher) = '' HAVING count(*) > 0")
def a12_top_with_rest(s: SparkSession, d: str) -> DataFrame:
    return P.top_with_rest(t(s, d, "raw_corpus"), "publisher", 10)


@query("WITH c AS (SELECT language AS label, count(*) AS n FROM raw_corpus GROUP BY 1), t AS (SELECT count(*) AS t FROM raw_corpus) SELECT CASE WHEN n / t > 0.005 THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n, round(sum(n) * 100.0 / any_value(t), 4) AS percent FROM c, t GROUP BY 1")
def a13_share_or_other(s: SparkSession, d: str) -> DataFrame:
    return P.share_or_other(t(s, d, "raw_corpus"), "language")


@query("SELECT versions, count(*) AS documents FROM (SELECT lower(trim(id)) AS base, count(*) AS versions FROM raw_corpus WHERE id IS NOT NULL GROUP BY 1) GROUP BY 1")
def a14_two_level_count(s: SparkSession, d: str) -> DataFrame:
    v = t(s, d, "raw_corpus").filter("id IS NOT NULL").groupBy(F.lower(F.trim("id")).alias("base")).agg(F.count(F.lit(1)).alias("versions"))
    return v.groupBy("versions").agg(F.count(F.lit(1)).alias("documents"))


@query(f"SELECT formats, count(*) AS documents FROM (SELECT id, string_agg(DISTINCT {FORMATS}, '+' ORDER BY {FORMATS}) AS formats FROM raw_corpus WHERE id IS NOT NULL GROUP BY 1) GROUP BY 1")
def a15_format_sets(s: SparkSession, d: str) -> DataFrame:
    sets = t(s, d, "raw_corpus").filter("id IS NOT NULL").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.expr(FORMATS))), "+").alias("formats"))
    return sets.groupBy("formats").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT language, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM raw_corpus), 4) AS percent FROM raw_corpus GROUP BY 1")
def a16_share_of_total(s: SparkSession, d: str) -> DataFrame:
    return P.share_of_total(t(s, d, "raw_corpus"), "language")


@query("WITH e AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM documents) SELECT CAST(least(floor((length(text) - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, count(*) AS n FROM documents, e WHERE text IS NOT NULL GROUP BY 1")
def a17_equal_width(s: SparkSession, d: str) -> DataFrame:
    return P.equal_width_histogram(t(s, d, "documents").select(F.length("text").alias("n")), "n", 30)


@query("SELECT CAST(floor(log10(length(text)) * 10) AS INT) AS bin, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1")
def a18_log_histogram(s: SparkSession, d: str) -> DataFrame:
    return P.log_histogram(t(s, d, "documents").select(F.length("text").alias("n")), "n")


@query("SELECT count(*) AS docs, round(avg(length(text)), 4) AS avg_chars, sum(length(text)) AS total_chars, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS estimated_tokens FROM documents WHERE text IS NOT NULL")
def a38_length_rollup(s: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return t(s, d, "documents").filter("text IS NOT NULL").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(n), 4).alias("avg_chars"), F.sum(n).alias("total_chars"), F.floor(F.sum(n) / 4).alias("estimated_tokens"))


@query("SELECT source, count(*) AS docs, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS estimated_tokens FROM documents WHERE text IS NOT NULL GROUP BY 1")
def t11_estimated_tokens(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("text IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.floor(F.sum(F.length("text")) / 4).alias("estimated_tokens"))


# Joins and set operations.
@query("SELECT id FROM documents INTERSECT SELECT id FROM cleaning_log")
def j1_intersect(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("id").intersect(t(s, d, "cleaning_log").select("id"))


@query("SELECT id, id IN (SELECT id FROM raw_corpus WHERE id IS NOT NULL) AS in_raw, id IN (SELECT id FROM cleaning_log WHERE id IS NOT NULL) AS in_log FROM documents")
def j2_in_both(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("id")
    raw = t(s, d, "raw_corpus").select("id").filter("id IS NOT NULL").distinct().withColumn("r", F.lit(True))
    log = t(s, d, "cleaning_log").select("id").filter("id IS NOT NULL").distinct().withColumn("l", F.lit(True))
    return docs.join(raw, "id", "left").join(log, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("in_raw"), F.coalesce("l", F.lit(False)).alias("in_log"))


@query("SELECT d.doc_id, l.log_id, length(d.text) AS chars, l.citation_length_reduction FROM documents d JOIN cleaning_log l USING (id)")
def j3_before_after(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").join(t(s, d, "cleaning_log"), "id").select("doc_id", "log_id", F.length("text").alias("chars"), "citation_length_reduction")


@query("SELECT r.row_id, r.id, a.language AS archive_language, a.declared_rows FROM raw_corpus r JOIN archives a USING (source_zip_content_path)")
def j5_lookup(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "raw_corpus").join(t(s, d, "archives").withColumnRenamed("language", "archive_language"), "source_zip_content_path").select("row_id", "id", "archive_language", "declared_rows")


@query("SELECT id, 'documents' AS origin FROM documents UNION ALL SELECT id, 'raw_corpus' FROM raw_corpus")
def u1_union(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("id", F.lit("documents").alias("origin")).unionByName(t(s, d, "raw_corpus").select("id", F.lit("raw_corpus").alias("origin")))


@query("SELECT subject FROM eval_subtasks WHERE model = (SELECT min(model) FROM eval_subtasks) UNION SELECT subject FROM eval_subtasks WHERE model = (SELECT max(model) FROM eval_subtasks)")
def u2_union_distinct(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "eval_subtasks")
    ends = F.broadcast(e.agg(F.min("model").alias("lo"), F.max("model").alias("hi")))
    j = e.crossJoin(ends)
    return j.filter("model = lo").select("subject").union(j.filter("model = hi").select("subject")).distinct()


# Windows, sorts, samples.
@query(f"SELECT row_id FROM raw_corpus ORDER BY {MD5.format('row_id')}, row_id LIMIT 100")
def w1_random_rows(s: SparkSession, d: str) -> DataFrame:
    return P.sample_per_group(t(s, d, "raw_corpus"), None, "row_id", 100).select("row_id")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {MD5.format('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 5")
def w2_random_per_band(s: SparkSession, d: str) -> DataFrame:
    return P.sample_per_group(t(s, d, "documents"), "source", "doc_id", 5).select("source", "doc_id")


@query("SELECT * EXCLUDE (text, collected_at) FROM documents")
def w3_except_columns(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").drop("text", "collected_at")


@query("SELECT publication_year, n, CAST(sum(n) OVER (ORDER BY publication_year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT publication_year, count(*) AS n FROM raw_corpus WHERE publication_year IS NOT NULL GROUP BY 1)")
def w4_cumulative(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    y = t(s, d, "raw_corpus").filter("publication_year IS NOT NULL").groupBy("publication_year").agg(F.count(F.lit(1)).alias("n"))
    return y.withColumn("running", F.sum("n").over(Window.orderBy("publication_year").rowsBetween(Window.unboundedPreceding, 0)))


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 10")
def w5_top_k(s: SparkSession, d: str) -> DataFrame:
    return P.top_k(t(s, d, "documents").select("source", "doc_id", F.length("text").alias("n")), ["source"], [F.desc_nulls_last("n"), F.col("doc_id")], 10)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 15")
def w6_top_k_global(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(15)


@query("SELECT source, max_by(doc_id, struct_pack(n := coalesce(length(text), -1), k := -doc_id)) AS longest FROM documents GROUP BY 1")
def w7_argmax(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.coalesce(F.length("text"), F.lit(-1)), -F.col("doc_id"))).alias("longest"))


@query("SELECT id, log_id FROM (SELECT id, log_id, row_number() OVER (PARTITION BY id ORDER BY coalesce(language_document_kept, false) DESC, processed_at DESC, log_id) AS r FROM cleaning_log) WHERE r = 1")
def w8_prefer_best(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc(F.coalesce("language_document_kept", F.lit(False))), F.desc_nulls_last("processed_at"), F.col("log_id")]
    return P.top_k(t(s, d, "cleaning_log"), ["id"], order, 1).select("id", "log_id")


@query("SELECT doc_id, source, subject_area FROM documents ORDER BY source DESC, subject_area NULLS LAST, doc_id")
def w11_multi_sort(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", "source", "subject_area").orderBy(F.desc("source"), F.asc_nulls_last("subject_area"), "doc_id")


LANGUAGES = ["en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja", "hi"]


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGUAGES) + " FROM documents GROUP BY 1")
def w12_pivot(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "documents").groupBy("source").pivot("lang", LANGUAGES).agg(F.count(F.lit(1)))
    return p.fillna(0, LANGUAGES)


@query("SELECT stage, stat_type, metric, shard, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY stage, stat_type, metric ORDER BY bucket, shard, n) AS r FROM metric_buckets WHERE bucket IS NOT NULL) WHERE (r - 1) % 10 = 0")
def w16_systematic_sample(s: SparkSession, d: str) -> DataFrame:
    return P.systematic_sample(t(s, d, "metric_buckets").filter("bucket IS NOT NULL"), ["stage", "stat_type", "metric"], ["bucket", "shard", "n"], 10).select("stage", "stat_type", "metric", "shard", "bucket", "n")


@query(f"SELECT id FROM (SELECT id FROM documents ORDER BY {MD5.format('id')}, id LIMIT 50)")
def w17_random_ids(s: SparkSession, d: str) -> DataFrame:
    return P.sample_per_group(t(s, d, "documents"), None, "id", 50).select("id").orderBy("id")


@query("SELECT id FROM documents WHERE source_zip_content_path = (SELECT min(source_zip_content_path) FROM documents)")
def w18_ids_of_file(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("id", "source_zip_content_path")
    return docs.join(F.broadcast(docs.agg(F.min("source_zip_content_path").alias("source_zip_content_path"))), "source_zip_content_path", "left_semi").select("id")
