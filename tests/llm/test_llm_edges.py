"""Empty tables, nulls, repeated rows and clashing columns for operators that changed."""

import pytest

from corpusloom.llm import languages, lookalike, neardup, packing, quality

EN = ["The membrane potential was compared with the assumed geometry.", "Several independent trials gave a weak signal near the upper limit.", "We tested the salts after careful filtering."] * 5
DE = ["Die Proben wurden bei Raumtemperatur gelagert und danach gemischt.", "Das Verfahren wurde auf die untersuchte Gruppe übertragen."] * 7


@pytest.fixture(scope="module")
def model():
    return languages.KneserNey.fit({"en": EN, "de": DE})


def rows(spark, values):
    own = [(i, v, "x", 1.0, "y", [1]) for i, v in enumerate(values)]
    return spark.createDataFrame(own + own[:1], "doc_id long, text string, lang string, stats double, kind string, chars array<int>")


def test_quality_without_prose(spark, model):
    common = {"en": ["the"], "de": ["die"]}
    out = quality.text_quality(rows(spark, [None, "", " \n\t", "x", "12 %% && 34 ## 55 ++"]), model, common).collect()
    assert len(out) == 6 and [r.blank for r in sorted(out, key=lambda r: r.key)] == [True, True, True, True, False, False]
    assert all(r.distance is None and r.kind is None and r.outlier_share is None for r in out if r.blank)
    assert quality.text_quality(rows(spark, ["a"]).filter("false"), model, common).count() == 0
    long = "\n".join(f"name{i} | {i}.5 | {i}.25 | {i}" for i in range(20_000))
    got = {r.key: r.kind for r in quality.text_quality(rows(spark, [long, *[" ".join(EN[:4])] * 60]), model, common).collect()}
    assert got[0] == "table" and not any(v for k, v in got.items() if k)


def test_languages_without_samples(spark):
    model = languages.fit_from(spark.createDataFrame([], "lang string, text string"))
    out = languages.document_languages(rows(spark, ["some text here", None]), model).collect()
    assert len(out) == 3 and languages.language_passages(rows(spark, [None]), model).count() == 0


def test_lookalike_members_edges(spark):
    df = rows(spark, ["a  b", "a b", None, " ", "c"])
    got = sorted((r.key, r.links) for r in lookalike.lookalike_members(df, "doc_id", "text").collect())
    assert got == [(0, 1), (0, 1), (1, 2)]
    assert lookalike.lookalike_members(df.filter("false"), "doc_id", "text").count() == 0
    assert {(r.a, r.b) for r in lookalike.lookalike_pairs(df, "doc_id", "text").collect()} == {(0, 1)}


def test_near_duplicates_edges(spark):
    df = rows(spark, ["one two three four five six", None, "", "one two three four five six", "a b c"])
    assert {(r.a, r.b) for r in neardup.near_duplicate_pairs(df).collect()} == {(0, 3)}
    groups = neardup.near_duplicate_groups(df).collect()
    assert {r.key for r in groups} == {0, 3} and all(r.links == 0 and r.group_id == 0 for r in groups)
    assert neardup.near_duplicate_groups(df.filter("false")).count() == 0


def test_packing_report_of_nothing(spark):
    empty = packing.fill_report(packing.pack(rows(spark, [None, ""]))).first()
    assert empty.containers == 0 and empty.unused_share is None and empty.bound_by_docs == 0
