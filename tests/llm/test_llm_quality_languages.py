"""Languages on held-out sentences of all ten languages; kinds of text that are easily taken for others."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import languages, quality

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def sentences_of():
    if not os.path.exists(SAMPLES):
        pytest.skip("no labelled sentences here")
    import pyarrow.parquet as pq

    by = defaultdict(list)
    for r in pq.read_table(SAMPLES).to_pylist():
        if r["lang"] and r["text"]:
            by[r["lang"]].append(r["text"])
    return dict(by)


def one(model, text):
    p, _, _ = languages.passages(text.split("\n"), np.zeros(text.count("\n") + 1, int), languages.Words(model))
    i, conf = model.assign(p.loglik.sum(0)[None], p.size.sum(keepdims=True))
    return (model.langs[i[0]] if i[0] >= 0 else None), float(conf[0])


def test_held_out_sentences_of_all_languages(sentences_of):
    """Each sentence is told by models that haven't seen it; Spanish and Portuguese, the closest pair, also two by two."""
    wrong, total, alone, together, pairs = 0, 0, 0, 0, 0
    near = {"es", "pt"}
    for fold in range(5):
        model = languages.KneserNey.fit({x: [s for i, s in enumerate(v) if i % 5 != fold] for x, v in sentences_of.items()})
        for x, v in sentences_of.items():
            held = v[fold::5]
            got = [one(model, s)[0] for s in held]
            total += len(held)
            wrong += sum(g != x for g in got)
            if x in near:
                alone += sum(g in near - {x} for g in got)
                two = [one(model, f"{a} {b}")[0] for a, b in zip(held, held[1:], strict=False)]
                pairs += len(two)
                together += sum(g in near - {x} for g in two)
    assert total == 600 and wrong <= 12
    assert alone <= 6 and pairs == 110 and together / pairs < 0.02


def test_texts_keep_their_language_and_its_confidence(spark, sentences_of):
    model = languages.KneserNey.fit({x: v[:40] for x, v in sentences_of.items()})
    rows = [(i, " ".join(v[40:])) for i, v in enumerate(sentences_of.values())]
    got = {r.key: r for r in languages.document_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).filter("share > 0.5").collect()}
    assert [got[i].lang for i in range(len(rows))] == list(sentences_of)
    assert all(r.confidence > 0.9 for r in got.values())
    # The confidence is that of the language in the row: a passage smoothed into its neighbours' language isn't sure.
    p = model.probability(np.asarray([[-1.0, -3.0], [-2.0, -1.0]]))
    assert p[0, 0] > 0.9 and p[1, 0] < 0.1


def test_scripts_and_lookalikes(sentences_of):
    model = languages.KneserNey.fit(sentences_of)
    hexes = "\n".join(" ".join(f"{random.Random(i * 99 + j).randint(0, 255):02x}" for j in range(16)) for i in range(30))
    assert one(model, hexes)[0] not in ("zh", "ja", "hi", "ru")
    assert languages.letters("слyчaяx") == ["случаях"] and languages.letters("ѕcopе") == ["scope"] and languages.letters("mоdеl") == ["model"]
    russian = sentences_of["ru"][0]
    assert one(model, russian.translate(str.maketrans("аеорсух", "aeopcyx")))[0] == "ru"


def kinds_of(spark, sentences_of, texts, **kw):
    rng = random.Random(3)
    prose = [" ".join(rng.choices(v, k=rng.randint(5, 12))) + "\n\n" + " ".join(rng.choices(v, k=5)) for v in (sentences_of["en"], sentences_of["es"]) for _ in range(25)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *prose])], "doc_id long, text string")
    model = languages.KneserNey.fit(sentences_of)
    from pyspark.sql import SparkSession  # noqa: F401

    samples = spark.createDataFrame([(x, s) for x, v in sentences_of.items() for s in v], "lang string, text string")
    stats = quality.statistics(df, model, quality.common_words(samples))
    out = {r.key: r for r in quality.outlierness(stats, kw.get("params") or quality.fit_prose(stats)).collect()}
    return [out[i] for i in range(len(texts))], [out[i] for i in range(len(texts), len(out))]


def planted(sentences_of):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice(["ran", "tel", "vi", "so", "mer", "zel", "qua"]) for _ in range(rng.randint(2, 4)))
    menu = "\n".join(name().title() + rng.choice([" »", " PDF", f" ({rng.randint(2, 99)})", f" DOI 10.99999/q.{rng.randint(10**6, 10**7)}", " Introduction"]) for _ in range(60))
    hexes = "\n".join(f"{16 * i:08x}  " + " ".join(f"{rng.randint(0, 255):02x}" for _ in range(16)) for i in range(50))
    keys = "\n".join("; ".join(name() for _ in range(rng.randint(2, 5))) + rng.choice(["", ";", " –"]) for _ in range(40))
    table = "\n".join(f"{name()};{rng.random() * 90:.2f};{rng.random() * 90:.2f};{name()}" for _ in range(40))
    mixed = "".join(rng.sample(s := " ".join(sentences_of["en"][:20]), len(s)))
    short = "\n".join(w for s in sentences_of["en"][:14] for w in (" ".join(s.split()[:6]), " ".join(s.split()[6:])) if w)
    wide = " ".join(sentences_of["en"][:12]).translate({c: c + 0xFEE0 for c in range(33, 127)})
    small = " ".join(sentences_of["en"][:15]) + "\n\n" + "\n".join(table.split("\n")[:6])
    return [menu, hexes, keys, table, mixed, short, wide, small], ["list", "junk", "list", "table", "junk", None, None, None]


def test_menus_dumps_and_key_words(spark, sentences_of):
    texts, want = planted(sentences_of)
    got, prose = kinds_of(spark, sentences_of, texts)
    assert [r.kind for r in got] == want
    assert all(r.kind is None for r in prose)
    assert all(sum(r.contributions) == pytest.approx(r.distance, rel=1e-6) for r in got)
    assert 0 < got[-1].outlier_share < 0.5


def test_the_distance_decides(spark, sentences_of):
    """Without a distance (no inverse covariance) nothing is an outlier; with another prose, other texts are."""
    texts, _ = planted(sentences_of)
    k = len(quality.STATISTICS)
    flat = {x: (np.zeros(k), np.zeros((k, k))) for x in [*sentences_of, "other"]}
    got, _ = kinds_of(spark, sentences_of, texts, params=flat)
    assert all(r.kind is None and r.distance == 0 for r in got)
