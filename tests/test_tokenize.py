"""Windows in the tokens of a tokenizer against the library, window by window."""

import glob
import os

import pytest

from corpusloom.operators import tokenize as K

FILES = [p for p in (K.TOKENIZER, os.path.join(os.path.dirname(K.TOKENIZER), "byte_bpe_50k.json")) if os.path.exists(p)]
TEXTS = ["A short one.", " ".join(f"word{i} and more of it," for i in range(200)), "流域的面积很大。" * 40, "", None, "  \n\t ", "a\nb\xa0c\r\nd " * 30]


@pytest.fixture(params=FILES or [None])
def tokenizer(request):
    if request.param is None:
        pytest.skip("no vocabulary here")
    return request.param


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "y")], "doc_id long, text string, token_ids string")


def normal(t):
    return " ".join(t.replace("\xa0", " ").split())


def test_counts(spark, tokenizer):
    encode, _ = K.load(tokenizer)
    got = sorted(((r.doc_id, r.token_count) for r in K.token_stats(rows(spark), "doc_id", tokenizer=tokenizer).collect()), key=str)
    assert got == sorted([(i, None if t is None else len(encode([t])[0])) for i, t in enumerate(TEXTS)] + [(1, len(encode([TEXTS[1]])[0]))], key=str)


def test_windows_cover_whole_texts(spark, tokenizer):
    encode, decode = K.load(tokenizer)
    out = K.token_windows(rows(spark), "doc_id", length=64, overlap=0.5, pad=0, tokenizer=tokenizer).collect()
    for i, t in enumerate(TEXTS):
        ids = encode([normal(t or "")])[0] if t else []
        own = sorted({(r.window_idx, r.start_pos, r.end_pos, tuple(r.token_ids), r.text, r.actual_tokens, r.id) for r in out if r.doc_id == i})
        starts = list(range(0, max(1, len(ids) - 32), 32)) if ids else []
        assert [(w[0], w[1]) for w in own] == list(enumerate(starts))
        for k, a, b, window, text, n, name in own:
            assert b == min(a + 64, len(ids)) and list(window) == ids[a:b] + [0] * (64 - (b - a))
            assert text == normal(decode([ids[a:b]])[0]) and n == len(encode([text])[0]) and name == f"{i}_window_{k:04d}"
    assert len([r for r in out if r.doc_id == 1]) == 2 * len({r.window_idx for r in out if r.doc_id == 1})


def test_fixed_steps(spark, tokenizer):
    encode, _ = K.load(tokenizer)
    got = {(r.doc_id, r.start_pos): list(r.token_ids) for r in K.fixed_step_windows(rows(spark), "doc_id", length=50, overlap=0.5, least=20, tokenizer=tokenizer).collect()}
    want = {(i, p): ids[p : p + 50] for i, t in enumerate(TEXTS) for ids in [encode([t or ""])[0]] for p in range(0, len(ids) - 20 + 1, 25)}
    assert got == want


def test_spans():
    assert K.window_spans(0, 8, 4) == [] and K.window_spans(8, 8, 4) == [(0, 8)] and K.window_spans(9, 8, 4) == [(0, 8), (4, 9)]
    assert K.window_spans(17, 8, 8, min_last=4) == [(0, 8), (4, 12), (9, 17)]
    for n in range(1, 200):
        spans = K.window_spans(n, 16, 8, min_last=5)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b >= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_no_vocabulary_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert not glob.glob(f"{root}/**/*.model", recursive=True)
