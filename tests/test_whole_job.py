"""Queries over all their rows: nothing is left out that the rules are for."""

import duckdb
import pytest

from corpusloom.functions import patterns as P
from corpusloom.operators import citations as C
from corpusloom.plans import catalog, cleaning  # noqa: F401  (the catalog registers all queries)
from corpusloom.plans.registry import ORACLES, QUERIES

_PAGES = "Head of page\nbody text goes on here\nTABLE 5\fp. 12\r\nHead of page\rHead of page\na\tb\tc\x0bd\te\tf\x1c© 2020 X\x85KEYWORDS: a Figure 2: x 12 34 5\n"
_TEXTS = [_PAGES, _PAGES.replace("\f", "\n"), "\f\fp. 3\f", "one\r\r\ntwo\n\n", "plain\nplain\n", "", None, _PAGES * 2]


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["l0_split_lines", "l1_repetition", "l2_consecutive_tabs", "l3_short_lines", "l4_l5_metadata_copyright", "l6_fused_line_cleaner", "l7_l9_captions"])
def test_line_queries_take_all_documents(spark, tmp_path, name):
    d = documents(spark, tmp_path, _TEXTS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES[name]).fetchall(), key=str)
    out = QUERIES[name](spark, d)
    got = sorted((tuple(r) for r in out.select(*[x[0] for x in con.execute(ORACLES[name]).description]).collect()), key=str)
    assert got == want
    assert {r[0] for r in got} >= {0, 7}


def test_padded_output_has_every_window(spark, tmp_path):
    texts = [" ".join("x" * (1 + i % 7) for i in range(n)) for n in (0, 1, 16, 17, 40, 100)] + [None, "  a\n b c "]
    got = {(r.doc_id, r.window_idx): (r.start_pos, r.ids) for r in QUERIES["d4_padded_output"](spark, documents(spark, tmp_path, texts)).collect()}
    want = {}
    for i, x in enumerate(texts):
        w = [len(y) for y in (x or "").split()]
        for k in range(1 + max(0, -(-(len(w) - 16) // 8)) if w else 0):
            own = w[k * 8 : k * 8 + 16]
            want[i, k] = (k * 8, " ".join(map(str, own + [0] * (16 - len(own)))))
    assert got == want


def test_counts_of_all_types(spark, tmp_path):
    """Artefact and citation types, and in a query of their own the validated ones, each against its counts text by text."""
    texts = ["doi:10.1000/xyz a.b@c.org", "(1) first item", "shown here ( 7 ), again", " Smith; Lee; Kim ", None, "x", "y", "as in ref 12 we saw"]
    d = documents(spark, tmp_path, texts)
    got = {r.type: (r.found, r.removed, r.rejected) for r in QUERIES["c24_counts"](spark, d).union(QUERIES["c24_validated_counts"](spark, d)).collect()}
    assert set(got) == {*P.ARTEFACTS, *P.CITATIONS, *P.VALIDATED}
    want = dict.fromkeys(got, (0, 0, 0))
    kinds = list(P.VALIDATED)
    for r in C.remove_citations(C.remove_artefacts(cleaning.injected(spark, d))).collect():
        for k in (*P.ARTEFACTS, *P.CITATIONS):
            n = r[f"{k}_citations_found"]
            want[k] = (want[k][0] + n, want[k][1] + n, 0)
        counts = C.remove_validated_text(r.text)[1]
        for k, f, x in zip(kinds, counts[::2], counts[1::2], strict=True):
            want[k] = (want[k][0] + f, want[k][1] + x, want[k][2] + f - x)
    assert got == want
    assert got["email_addresses"][0] >= 2 and sum(x[2] for x in got.values()) > 0
