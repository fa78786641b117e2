"""Statistics, windows, samples, comparisons and I/O on small tables."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import compare as K
from corpusloom.operators import profiles as P
from corpusloom.operators import slicing as S
from corpusloom.operators import textstats as T
from corpusloom.sources import io


def test_merged_summaries_equal_the_whole(spark):
    rows = [(f"s{i % 3}", "doc", "m", float(i * i % 17)) for i in range(50)]
    df = spark.createDataFrame(rows, "shard string, stat_type string, metric string, value double")
    whole = T.summary(df).first()
    merged = T.merge_summaries(T.summary(df, ("shard", "stat_type", "metric"))).first()
    for c in ("n", "total", "mean", "variance", "std_dev", "min", "max"):
        assert merged[c] == pytest.approx(whole[c])


def test_histogram_percentiles_left_and_right(spark):
    h = spark.createDataFrame([("a", "m", float(b), 1) for b in range(1, 5)], "stat_type string, metric string, bucket double, n long")
    left, right = T.histogram_percentiles(h, (25, 50)).first(), T.histogram_percentiles(h, (25, 50), side="right").first()
    assert (left.p25, left.p50, right.p25, right.p50) == (1.0, 2.0, 2.0, 3.0)


def test_exact_percentiles_are_those_of_the_library(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.lognormal(3, 2, 3000)] + [("b", float(v)) for v in rng.integers(0, 3, 500)] + [(None, 7.0), ("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.x, r.y, r.z, r.u) for r in P.exact_percentiles(df, "v", {"x": 0.0, "y": 0.25, "z": 0.501, "u": 1.0}, ["g"], cells=8).collect()}
    assert set(got) == {"a", "b", "d", None}
    for g in got:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx(np.quantile(v, [0, 0.25, 0.501, 1]), rel=1e-12)
    assert [r.x for r in P.exact_percentiles(df.filter("false"), "v", {"x": 0.5}).collect()] == [None] and P.exact_percentiles(df.filter("false"), "v", {"x": 0.5}, ["g"]).count() == 0


def test_language_threshold_and_recovery(spark):
    values = [0.3585, 0.0915, 0.0005, 0.7, 0.7499999, 0.75, 1.0, 1.00002, 0.0, None, 0.6999999999]
    df = spark.createDataFrame(list(enumerate(values)), "i int, fasttext_en double").withColumn("text", F.lit("text"))
    out = P.language_threshold(df).orderBy("i").collect()
    assert [r.text for r in out] == ["text" if v is None or v >= 0.75 else "" for v in values]
    assert [r.language_reason for r in out] == [None if v is None or v >= 0.75 else f"low_fasttext_en_score_{v:.3f}" for v in values]
    kept, counts = P.recover_band(df)
    assert {r.recovery_reason for r in kept.collect()} == {"fasttext_score_0.700_between_0.7_and_0.75", "fasttext_score_0.750_between_0.7_and_0.75"}
    assert tuple(counts.first()) == (11, 2, 4, 5)


def test_paths(spark):
    paths = {"x/Baseline/step-250": ("baseline", 250), "clean_restart/15k_kept": ("clean_restart", 15000), "green/checkpoint-364000": ("green_run", 364000), "t5_base": ("baseline", 0), "kept/step-7": ("unknown", 7)}
    df = spark.createDataFrame([(x,) for x in paths], "p string")
    assert {r.p: (r.run_type, r.step) for r in df.select("p", *[c.alias(k) for k, c in K.parse_path(F.col("p")).items()]).collect()} == paths


def test_text_statistics_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One two.\nThree")], "i int, text string")
    out = {r.i: r for r in T.with_stats(df, groups=("doc", "line", "paragraph", "sentence", "word")).collect()}
    assert out[1].length is None and out[1].n_lines is None and out[1].n_words is None and out[2].n_words == 0 and out[3].n_words == 3 and out[3].n_lines == 2


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 300), st.sampled_from([(10, 0.5), (16, 0.0), (7, 0.3)]))
def test_window_formula_covers_every_token(n, shape):
    length, overlap = shape
    step = S.stride(length, overlap)
    count = 1 if n <= length else 1 + -(-(n - length) // step)
    seen = {t for i in range(count) for t in range(i * step, min(i * step + length, n))}
    assert seen == set(range(n))


def test_windows(spark):
    df = spark.createDataFrame([("a", " ".join(map(str, range(25)))), ("b", "x y"), ("c", None), ("d", " ")], "id string, text string")
    w = S.windows(df, length=10, overlap=0.5).orderBy("id").collect()
    assert [(r.id, r.start_pos, r.end_pos) for r in w] == [("a_window_0000", 0, 10), ("a_window_0001", 5, 15), ("a_window_0002", 10, 20), ("a_window_0003", 15, 25), ("b_window_0000", 0, 2)]
    spread = S.windows(df, length=10, overlap=0.0, min_last=8).filter("original_doc_id = 'a'").orderBy("window_idx").collect()
    assert [r.start_pos for r in spread] == [0, 8, 15]


def test_length_solver_and_masks():
    assert S.expanded_length(512) == (568, 114)
    for n in (2, 5, 57, 400):
        m = S.noise_mask(n, 7)
        assert not m[0] and m.sum() == min(max(round(n * 0.15), 1), n - 1)
        ids = np.arange(100, 100 + n)
        x, y = S.with_sentinels(ids, m, 32100), S.with_sentinels(ids, ~m, 32100)
        assert sorted([*x[x < 30000], *y[y < 30000]])[2:] == ids.tolist()


def test_order_is_a_permutation_and_shards_split_it(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    o = P.deterministic_order(df, "k")
    assert sorted(r.position for r in o.collect()) == list(range(101))
    assert P.rank_shard(o, 4, 101).groupBy("rank").count().select("count").distinct().collect()[0][0] == 25
    assert P.split_exact(df, "k", 0.1, 15).filter("split = 'val'").count() == 15


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), ("", 5), (None, 2000)], "name string, year int")
    c = {r.column_name: r.present_count for r in P.completeness(df).collect()}
    assert c == {"name": 3, "year": 3}
    assert {(r.label, r.n) for r in P.top_with_rest(df, "name", 1).collect()} == {("a", 2), ("Others", 1), ("Missing/Empty", 2)}
    assert P.completeness(df.filter("false")).count() == 2


def test_ranks_baselines_and_intervals(spark):
    df = spark.createDataFrame([("m1", "b", 0.5), ("m2", "b", 0.7), ("m3", "b", None), ("m1", "c", 0.1)], "model string, benchmark string, score double")
    r = {x.model: (x.rank, x.gap) for x in K.ranked(df, "benchmark", "score", "model").collect()}
    assert r["m2"] == (1, None) and r["m1"][0] == 2 and r["m1"][1] == pytest.approx(-0.2) and r["m3"][0] == 3
    assert {(x.model, x.benchmark): x.percent for x in K.against_baseline(df, "m1").collect()}[("m2", "b")] == pytest.approx(40.0)
    steps = spark.createDataFrame([("g", s) for s in (0, 3, 10, 11, 25, 19)], "g string, step long")
    assert sorted(x.step for x in K.greedy_intervals(steps, "g", "step", 10).collect()) == [0, 10, 25]


def test_diffs():
    assert K.line_diff("a\nb", "a\nc")[1:] == (1, 1, True) and K.line_diff(None, "")[1:] == (0, 0, False)
    assert K.word_diff("a b c", "a x c") == "a [-b-] {+x+} c"
    assert [r[0] for r in K.side_by_side("a\nbcdef", "a\nbcdeg\nz")] == ["equal", "change", "insert"]


def test_parsers(spark):
    good = json.dumps({"results": {"t,1": {"acc,none": 0.5, "acc_stderr,none": "N/A"}}})
    rows = K.parse_results(spark.createDataFrame([(good,), ("{bad",), (None,)], "json string")).collect()
    assert {(r.task, r.metric, r.value) for r in rows} == {("t,1", "acc,none", 0.5), ("t,1", "acc_stderr,none", None)}
    table = json.dumps({"columns": ["x", "Doc ID"], "data": [["1", "d1"], ["2", "d1"], ["3", "d2"]]})
    assert {r.doc_id for r in K.ids_of_table(spark.createDataFrame([(table,)], "json string")).collect()} == {"d1", "d2"}


def test_io_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.5), ("b", " ", None)], "id string, text string, v double")
    io.write_documents(df.repartition(1), f"{tmp_path}/p", rows_per_file=1)
    assert io.read_documents(spark, f"{tmp_path}/p", defaults={"v": 9.0}).orderBy("id").select("v").collect()[1].v == 9.0
    assert io.validate_parquet(spark, f"{tmp_path}/p").filter("opens").count() == 2
    io.write_split(df, "text RLIKE '\\\\S'", f"{tmp_path}/k", f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/k").count() == 1 and spark.read.parquet(f"{tmp_path}/r").count() == 1
    io.write_csv(df, f"{tmp_path}/c", ["id"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c").filter("v = '1.500000'").count() == 1
    io.write_report(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    for kind, body in (("histogram", {"1.0": {"n": 3}, "2": 4}), ("summary", {"summary": {"n": 7, "mean": 1.5}})):
        (tmp_path / "s" / "doc" / kind / "len").mkdir(parents=True)
        (tmp_path / "s" / "doc" / kind / "len" / "metric.json").write_text(json.dumps(body))
    s = io.read_stats_json(spark, f"{tmp_path}/s")
    assert {(r.bucket, r.n) for r in io.histogram_of_json(s).collect()} == {(1.0, 3), (2.0, 4)}
    assert io.summary_of_json(s).first().n == 7
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text(" hi ")
    (tmp_path / "t" / "b.txt").write_text(" ")
    assert [r.text for r in io.read_texts(spark, f"{tmp_path}/t").collect()] == ["hi"]
    assert io.file_sizes(spark, f"{tmp_path}/t").first().files == 2
    out, seen = io.observed(df, "o", rows=F.count(F.lit(1)))
    out.collect()
    assert seen.get["rows"] == 2


def test_streaming(spark, tmp_path):
    from corpusloom.streaming import documents as D

    spark.createDataFrame([("a", "x [1]")], "id string, text string").write.parquet(f"{tmp_path}/in")
    q = D.clean_stream(D.read_stream(spark, f"{tmp_path}/in", f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "x"


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the library without the training-text subpackage has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "corpusloom"), tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 120 and not [x for x in q if x[0] == 'p' and x[1].isdigit()]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
