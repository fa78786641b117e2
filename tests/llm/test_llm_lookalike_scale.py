"""Look-alike classes that hold a third of all rows, and skeletons against the collation."""

import itertools
import unicodedata

from pyspark.sql import functions as F

from corpusloom.llm import lookalike


def test_a_class_with_a_third_of_all_rows(spark):
    """One string of a class fills a third of the table; its rows never meet each other."""
    hot = [(i, "the same café") for i in range(3000)]
    rows = hot + [(10_000 + i, f"text {i}") for i in range(6000)] + [(90_001, "the same café"), (90_002, "the  same café"), (90_003, "the same cafe")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    pairs = {(r.a, r.b) for r in lookalike.lookalike_pairs(df, "row_id", "text").collect()}
    assert pairs == {(i, j) for i in range(3000) for j in (90_001, 90_002)} | {(90_001, 90_002)}
    members = {r.key: (r.forms, r.class_rows, r.links) for r in lookalike.lookalike_members(df, "row_id", "text").collect()}
    assert members == {i: (3, 3002, 2) for i in range(3000)} | {90_001: (3, 3002, 3001), 90_002: (3, 3002, 3001)}


def test_equal_under_the_collation_means_equal_skeletons(spark):
    texts = ["été ñ", "各가각", "がぎ パ", "Å ệ ǘ", "ά ϊ", "й ё", "क़ ड़", "אָ"]
    both = [(i, t) for i, x in enumerate(texts) for t in {unicodedata.normalize(f, x) for f in ("NFC", "NFD")}] + [(99, "ete n"), (98, "ñ")]
    df = spark.createDataFrame(both, "i long, text string").withColumn("seen", lookalike.look(F.col("text"))).withColumn("skel", lookalike.skeleton(F.col("seen")))
    for a, b in itertools.combinations(df.collect(), 2):
        assert (a.skel == b.skel) == (a.i == b.i or {a.i, b.i} == {0, 99}), (a.text, b.text)
    equal = df.alias("x").join(df.alias("y"), F.expr("collate(x.seen, 'UNICODE') = collate(y.seen, 'UNICODE')")).filter("x.skel <> y.skel")
    assert equal.count() == 0
