"""Line-level cases of the cleaning rules: what goes, what stays."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import citations as C
from corpusloom.operators import lines as L
from corpusloom.operators import normalize as N
from corpusloom.operators import sections as S


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def result(df, column="text"):
    return [r[column] for r in df.orderBy("i").collect()]


def test_artefacts_and_citations(spark):
    df = texts(spark, "mail a.b@c.org now", "see http://x.y/z and www.q.org", "doi:10.1000/xyz", "ISBN 978-1-23", "a [1, 2] b [3-5]", "x (Smith et al., 2020a) y", "z (Lee, 2019; Kim, 2021)", "n (1)(2)(3)", "plain (25 °C)", "", None)
    out = C.remove_citations(C.remove_artefacts(df))
    assert result(out) == ["mail  now", "see  and ", "", "", "a  b ", "x  y", "z ", "n ", "plain (25 °C)", "", None]
    assert result(out, "urls_citations_found")[1] == 2
    assert result(C.remove_patterns(df, P.ARTEFACTS, placeholders={"email_addresses": "[EMAIL]"}))[0] == "mail [EMAIL] now"
    assert "[DEBUG:artefakt:urls]" in result(C.remove_artefacts(df, debug=True))[1]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("shown here ( 7 ), again", "shown here , again"),
        ("shown here (7) again", "shown here (7) again"),
        ("(1) first item", "(1) first item"),
        ("values (25 °C) stay", "values (25 °C) stay"),
        ("as in ref 12 we saw", "as in ref 12 we saw"),
        ("2020 2021 2022 2023\np. 12\n2020 2021 2022 2023", "2020 2021 2022 2023\n2020 2021 2022 2023"),
        ("end.\np. 12\nnext", "end.\np. 12\nnext"),
        ("on p. 12 of it", "on p. 12 of it"),
        ("alpha; the; beta text", "alpha; the; beta text"),
        (" Smith; Lee; Kim ", ""),
    ],
)
def test_validated_matches(text, expected):
    assert C.remove_validated_text(text)[0] == expected


def test_overlapping_spans_do_not_garble():
    assert C.remove_validated_text("Known here (1), hello (2); world")[0] == "Known here , hello ; world"
    assert C.remove_validated_text(None) == (None, [0] * 8)


def test_lines(spark):
    text = "Introduction\nTABLE 5\np. 12\n12 34 5\na\tb\tc\nd\te\tf\nplain\n\nplain\n© 2020 X\nend"
    out = L.clean_lines(texts(spark, text, "", None, "one\r\ntwo"))
    assert result(out) == ["Introduction\nplain\n\nend", "", None, "one\ntwo"]
    assert result(out, "lines_removed")[0] == 7
    assert [result(out, f"{t}_lines_removed")[0] for t in ("repetition", "tabular", "short_line", "metadata", "copyright")] == [1, 2, 3, 0, 1]
    reasons = [x["reason"] for x in result(out, "removed_lines")[0]]
    assert "repetition:repeated_line" in reasons and "tabular:consecutive_tabs" in reasons


def test_kept_line_memory(spark):
    out = L.kept_line_memory(texts(spark, "a\nb\na\nc\nd\ne\nf\ng\na", None))
    assert result(out)[0] == "a\nb\nc\nd\ne\nf\ng\na"
    assert result(out, "repeated_lines_removed")[0] == 1


def test_captions(spark):
    out = L.clean_captions(texts(spark, "Figure 2.1: x\n1 2 3\nα 1 2\ntext 5", None))
    assert result(out)[0] == "α 1 2\ntext 5"


def test_sections():
    table = "\n".join(["TABLE 1", *["ABC1 XYZ2 KLM3"] * 8])
    assert S.remove_sections_text("prose first\n" + table) [:4] == ("prose first", 1, 9, len("TABLE 1") + 8 * 14)
    assert S.remove_sections_text("References\nshort") == ("References\nshort", 0, 0, 0, [])
    assert S.remove_sections_text("") == ("", 0, 0, 0, [])
    assert S.remove_sections_text(None)[0] is None
    tagged, n, lines, chars, samples = S.remove_sections_text("prose first\n" + table, debug=True)
    assert (tagged, n, lines, chars) == ("prose first\n[DEBUG:appendix_end:gene_table]", 1, 9, 0)
    assert samples[0] | {"confidence": 1.0} == {"start_line": 1, "end_line": 10, "lines_count": 9, "total_length": 119, "section_type": "gene_table", "confidence": 1.0, "sample_lines": ["TABLE 1", "ABC1 XYZ2 KLM3", "ABC1 XYZ2 KLM3"]}


def test_caption_tags_and_samples(spark):
    out = L.clean_captions(texts(spark, "Figure 2.1: x\nkept\n 1 2 3", None), debug=True).orderBy("i").collect()
    assert out[0].text == "[DEBUG:figure_line:figure_table_caption]\nkept\n[DEBUG:figure_line:numeric_table_data_3of3]"
    assert [tuple(r) for r in out[0].removed_figure_lines] == [("Figure 2.1: x", 1, 13, "figure_table_caption"), ("1 2 3", 3, 5, "numeric_table_data_3of3")]
    assert out[0].figure_lines_removed == 2 and out[0].figure_length_reduction == 0 and out[1].text is None


@pytest.mark.parametrize(
    "text,remove,reason",
    [
        ("X. " + "word " * 15 + "(Lee, 2019) shows it", False, "well_integrated_score_0.50"),
        ("Start. (Lee, 2019) showed that", False, "author_as_subject_with_verb_showed"),
        ("Start. (Lee, 2019) is", False, "author_at_sentence_start"),
        ("word " * 20 + "see (Lee, 2019) there", True, "disruptive_reference_indicator"),
        ("word " * 20 + "x; (Lee, 2019) there", True, "part_of_reference_list"),
        ("word " * 20 + "research (Lee, 2019) showed it", False, "well_integrated_score_1.00"),
        ("word " * 20 + "((Lee, 2019)) here", True, "poorly_integrated_score_0.00"),
        ("word " * 20 + "going (Lee, 2019) and on", False, "well_integrated_score_0.70"),
        ("word " * 20 + "x (Lee, 2019) here", False, "uncertain_keep_for_training_score_0.50"),
    ],
)
def test_author_year_decisions(text, remove, reason):
    start = text.index("(Lee")
    got = C.author_year_decision(text, start, start + len("(Lee, 2019)"))
    assert got[0] == remove and (got[1] == reason or "uncertain" in got[1] and reason.endswith("0.50"))


def test_symbols_and_whitespace(spark):
    df = texts(spark, "x  y\t z\n\n\n\n  Lead. A → B … ‘q’ “r” • item – dash", "Introduction", "E = mc² ≤ 5", "", None)
    out = N.normalize_whitespace(N.normalize_symbols(df))
    assert result(out) == ["x y z\n\nLead. A -> B ... 'q' \"r\" * item - dash", "Introduction", "E = mc² ≤ 5", "", None]
    assert result(out, "symbol_normalizations")[:2] == [8, 0]
    again = N.normalize_whitespace(out.select("i", "text"))
    assert result(again) == result(out)


def test_null_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a [1] b", "y")], "i int, text string, line_info string")
    assert result(C.remove_citations(df)) == [None, "a  b"]
    empty = df.filter("false").drop("line_info")
    assert L.clean_lines(empty).count() == 0 and C.remove_validated(empty).count() == 0 and S.remove_sections(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1; ()[]\n.pref,", max_size=80))
def test_validated_never_grows(text):
    assert len(C.remove_validated_text(text)[0]) <= len(text)


def test_patterns_are_complete():
    assert len(P.ARTEFACTS) == 5 and len(P.CITATIONS) == 6 and len(P.VALIDATED) == 4 and len(P.STOPWORDS) > 85


def test_pipeline_registry(spark):
    from corpusloom.plans import pipeline

    pipeline.STEPS.pop("shout", None)
    pipeline.register("shout", lambda d: d.withColumn("text", F.upper("text")))
    assert result(pipeline.run_pipeline(texts(spark, "a [1]", " "), ["citations", "whitespace", "non_empty", "shout"])) == ["A"]
    with pytest.raises(ValueError):
        pipeline.register("shout", lambda d: d)
