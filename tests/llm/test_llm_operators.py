"""The training-text operators against brute force, round trips and held-out text; null, empty, repeated and clashing inputs."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import languages, lookalike, mixing, neardup, packing, quality, scans, sentences, splitting, tokens
from corpusloom.llm.gbdt import GradientBoosting

WORDS = "the membrane potential was compared with assumed geometry near upper limit after careful filtering several independent trials gave weak signal".split()
EN = ["The membrane potential was compared with the assumed geometry.", "Several independent trials gave a weak signal near the upper limit.", "We tested the salts after careful filtering.", "A long survey was lost before the final rinse.", "The crystal lattice confirms the local temperature."] * 3
DE = ["Die Proben wurden bei Raumtemperatur gelagert und danach gemischt.", "Der Streuwinkel bestimmt die übrigen Proben während der Saison.", "Das Verfahren wurde auf die untersuchte Gruppe übertragen.", "Die Nervenfaser war nach sorgfältiger Filterung stabil.", "Wir fanden, dass die Randbedingung deutlich war."] * 3
RU = ["Мы установили, что верхний слой дополняет данные калибровки.", "Нервное волокно ограничивает ожидаемый порог на низких частотах.", "Хотя почвенная колонка уточняет местные условия, она была слабой.", "Содержание достигло предела в каждом повторе.", "Кривая обучения изменяет опубликованное значение."] * 3


def clashing(spark, values):
    """Rows with a null and a blank text, one row twice, and columns of names the operators use inside."""
    rows = [(i, t, "x", 1, "y", 2.0) for i, t in enumerate(values)]
    return spark.createDataFrame(rows + rows[:1], "doc_id long, text string, key string, tokens int, form string, look double")


@pytest.fixture(scope="module")
def model():
    return languages.KneserNey.fit({"en": EN, "de": DE, "ru": RU})


# 4: look-alikes
def test_lookalike_pairs(spark):
    same = [("café x", "café  x "), ("scope", "ѕсоре"), ("fine wide", "ﬁne ｗｉｄｅ​"), ("a-b…", "a‑b..."), ("5 °C", "5 ℃"), ("カタガ", "ｶﾀｶﾞ")]
    other = [("Case", "case"), ("cafe", "café"), ("x²", "x2"), ("“q”", '"q"'), ("a–b", "a-b"), ("a. b", "a, b")]
    rows = [(i, t) for i, t in enumerate(itertools.chain(*same, *other))]
    got = {(r.a, r.b) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(same))}


def test_lookalike_edges(spark):
    df = clashing(spark, ["a b", "a  b", None, " ", "​"])
    assert {(r.a, r.b) for r in lookalike.lookalike_pairs(df, "doc_id", "text").collect()} == {(0, 1)}
    out = lookalike.canonical_texts(df, "doc_id", "text").collect()
    assert len(out) == 6 and {r.canonical_text for r in out if r.key in (0, 1)} == {"a b"} and [r.canonical_text for r in out if r.key == 2] == [None]
    assert lookalike.canonical_texts(df.filter("false"), "doc_id", "text").count() == 0


# 5: splitting
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。é", min_size=0, max_size=400))
def test_split_covers_within_limit(text):
    cuts = splitting.split_text(text, 50, 10)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b, _ in cuts:
        assert b - a <= 50
    for (_, end, _), (start, _, _) in itertools.pairwise(cuts):
        assert 0 <= end - start <= 10 and start < end or not text


def test_range_max_is_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 200)
    t = splitting.RangeMax(v, 64)
    assert all(t.top(i, j) == v[i:j].max() for i in range(200) for j in range(i + 1, min(i + 65, 201)))


def test_split_prefers_strong_boundaries(spark):
    text = "x" * 30 + "\n\n" + "y " * 5 + "z" * 100
    (a, b, s), *_ = splitting.split_text(text, 50, 5)
    assert (b, s) == (32, splitting.PARAGRAPH)
    out = splitting.split_oversized(clashing(spark, [text, "", None]), limit=50, overlap=5)
    assert out.filter("key = 1").count() == 1 and out.filter("key = 2").count() == 0 and out.filter("key = 0 AND piece_no = 1").count() == 2
    with pytest.raises(ValueError):
        splitting.split_text("a", 10, 9)


# 10: sentences
@pytest.mark.parametrize(
    "text,parts",
    [
        ("Dr. Miller paid 3.5 units, e.g. for Fig. 2. Then he left.", ["Dr. Miller paid 3.5 units, e.g. for Fig. 2.", "Then he left."]),
        ('"Is it so?" asked one. It was.', ['"Is it so?" asked one.', "It was."]),
        ('M. Vi wrote: "It holds." Next one.', ['M. Vi wrote: "It holds."', "Next one."]),
        ("Il vit ... et partit. « Oui ? » demanda-t-il. Fin.", ["Il vit ... et partit.", "« Oui ? » demanda-t-il.", "Fin."]),
        ("Am 9. Mai war es, z. B. hier, usw. Dann nicht.", ["Am 9. Mai war es, z. B. hier, usw.", "Dann nicht."]),
        ("著者は「安定か？」と尋ねた。次の文！", ["著者は「安定か？」と尋ねた。", "次の文！"]),
        ("审稿人问道：“稳定吗？”此外，流域。", ["审稿人问道：“稳定吗？”", "此外，流域。"]),
        ("यह है। वह भी है।", ["यह है।", "वह भी है।"]),
        ("Introduction\n\nIt begins. 5.3 K. The end", ["Introduction", "It begins.", "5.3 K.", "The end"]),
        ("heated to 12 K. pH values stayed.", ["heated to 12 K.", "pH values stayed."]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_sentence_rules(text, parts):
    _, a, b = sentences.sentence_spans([text])
    assert [text[i:j] for i, j in zip(a, b, strict=True)] == parts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet='aB1 .?!"\n。と', max_size=60), max_size=6))
def test_scan_equals_sequential_run(texts):
    cls, _ = sentences.classify(texts)
    step, ends = sentences.transducer()
    state, want = 0, []
    for i, c in enumerate(cls.tolist()):
        if ends[state, c]:
            want.append(i)
        state = step[state, c]
    assert sentences.run_transducer(cls, 7).tolist() == want


def test_sentences_edges(spark):
    out = sentences.sentences(clashing(spark, ["One. Two.", None, " "]))
    assert out.count() == 4 and {r.sentence for r in out.collect()} == {"One.", "Two."}
    assert sentences.sentences(clashing(spark, ["x"]).filter("false")).count() == 0


# 7: languages
def test_held_out_languages(model):
    for lang, s in (("en", "The survey was compared with the upper limit."), ("de", "Die Gruppe war während der Saison stabil."), ("ru", "Верхний слой был слабой колонкой.")):
        total, n = model.score_sentence(s)
        i, conf = model.assign(total[None], np.asarray([n]))
        assert model.langs[int(i[0])] == lang and 0.5 < conf[0] <= 1
    total, n = model.score_sentence("zqxj wvkq xxqz jjqk qqzx vvkz")
    assert model.assign(total[None], np.asarray([n]))[0][0] == -1


def test_relabel(spark, model):
    mixed = " ".join(EN[:4]) + "\n\n" + " ".join(DE[:4])
    rows = [(1, " ".join(EN[:4]), "English"), (2, " ".join(EN[:4]), "de"), (3, " ".join(DE[:4]), None), (4, mixed, "en"), (5, None, "en"), (6, " ", ""), (7, " ".join(RU[:4]), "ru-RU")]
    got = {(r.key, r.lang) for r in languages.relabel(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert got == {(2, "en"), (3, "de"), (4, "en"), (4, "de")}


def test_document_languages_edges(spark, model):
    out = languages.document_languages(clashing(spark, [EN[0], None, ""]), model).collect()
    assert len(out) == 4 and [r.share for r in out if r.key in (1, 2)] == [1.0, 1.0] and all(r.lang is None for r in out if r.key)


# 3: quality
def test_kinds_and_contributions(spark, model):
    rng = random.Random(0)
    prose = [" ".join(rng.choice(EN) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    table = "\n".join(f"row{i} | {i}.5 | {i}.7 | {i}.9" for i in range(30))
    items = "\n".join(f"[{i}] Name, A. ({1950 + i}). Title. Place, 3(2), 5-9." for i in range(30))
    junk = "\n".join("%$ 12 ## ~~ @@ 77 ^^ && ** 55" for _ in range(30))
    df = clashing(spark, [*prose, table, items, junk, None, "", prose[0] + "\n\na | 1 | 2\nb | 3 | 4\nc | 5 | 6\n"])
    common = {"en": ["the", "was", "a", "with"], "de": ["die", "der"], "ru": ["на"]}
    out = {r.key: r for r in quality.text_quality(df, model, common).collect()}
    assert [out[i].kind for i in (40, 41, 42)] == ["table", "list", "junk"]
    assert all(out[i].kind is None for i in (*range(40), 43, 44, 45))
    assert out[43].blank and out[43].distance is None
    for i in (0, 41):
        assert sum(out[i].contributions) == pytest.approx(out[i].distance, rel=1e-6)


# 2: tokens
def test_viterbi_is_brute_force():
    costs = {"a": 2.0, "b": 2.0, "ab": 2.5, "bc": 1.5, "c": 2.5, "abc": 5.0, "▁": 1.0, "▁a": 2.2}
    trie = tokens.DoubleArray.build(costs, 9.0)

    def brute(s):
        best = {0: (0.0, 0)}
        for i in range(len(s)):
            if i not in best:
                continue
            c, n = best[i]
            steps = [(j, costs[s[i:j]], 1) for j in range(i + 1, len(s) + 1) if s[i:j] in costs]
            if s[i] not in costs:
                k = len(s[i].encode())
                steps.append((i + 1, 9.0 * k, k))
            for j, x, m in steps:
                best[j] = min(best.get(j, (1e9, 0)), (c + x, n + m))
        return best[len(s)][1]

    words = ["".join(p) for n in range(1, 6) for p in itertools.product("abc▁é", repeat=n)]
    assert trie.count(words).tolist() == [brute(w) for w in words]
    long = "ab" * 50_000
    assert trie.count(["", long, "ab"]).tolist() == [0, 50_000, 1]
    rng = random.Random(4)
    many = ["".join(rng.choice("abc▁éb") for _ in range(n)) for n in (2047, 2048, 2049, 2500, 4096, 4097)]
    side_by_side = trie._count(many)
    assert trie.count(many).tolist() == side_by_side.tolist() == [trie._walk(s) for s in many]


def test_exact_counts_are_the_librarys(spark):
    import os

    import sentencepiece

    path = f"{tokens.TOKENIZERS}/piece_bpe_32k.model"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    texts = ["Hello world", "  two  blanks ", "a\nb\n\n c", "流域的面积，很大。是", "é😀 \t x", "", "x" * 300]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.key: r for r in tokens.token_counts(clashing(spark, [*texts, None])).collect()}
    assert [out[i].tokens for i in range(len(texts))] == [len(x) for x in sp.encode(texts)] and out[len(texts)].tokens == 0
    assert abs(out[0].tokens_est - out[0].tokens) <= 1


def test_budget_counts_each_document_once(spark):
    docs = spark.createDataFrame([(1, "a", "one two", "s", "Soil_Science"), (1, "a", "one two", "s", "Soil_Science"), (2, "b", None, None, None)], "doc_id long, id string, text string, source string, subject_area string")
    raw = spark.createDataFrame([(" A ", "English"), ("a", "en"), ("a", "de"), ("b", "unknown"), (None, "en")], "id string, language string")
    got = {(r.source, r.language, r.area): r.docs for r in tokens.token_budget(docs, raw).collect()}
    assert got == {("s", "en", "soil science"): 1, (None, "unknown", "unknown"): 1}


# 8: packing
def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 600)
    at = packing.vector_best_fit(sizes, 100, 9, 100.0**2, (1.0, 0.05, 0.2))
    load, docs = np.bincount(at, sizes), np.bincount(at)
    assert (at >= 0).all() and load.max() <= 100 and docs.max() <= 9
    assert len(load) <= 1.05 * -(-sizes.sum() // 100)


def test_each_capacity_binds_somewhere():
    weights = (1.0, 0.05, 0.2)
    small = np.full(200, 3)
    docs = np.bincount(packing.vector_best_fit(small, 100, 8, 95.0**2, weights))
    assert docs.tolist() == [8] * 25  # 24 tokens of 100: the number of documents binds
    large = np.repeat([70, 20], 30)
    at = packing.vector_best_fit(large, 100, 9, 5000.0, weights)
    load, cost = np.bincount(at, large), np.bincount(at, large**2)
    assert cost.max() <= 5000 and sorted(load.tolist()) == [70] * 30 + [100] * 6  # 70 and 20 make 5300: attention binds
    even = np.repeat([60, 40], 30)
    assert np.bincount(packing.vector_best_fit(even, 100, 9, 95.0**2, weights), even).tolist() == [100] * 30  # tokens bind
    alone = packing.vector_best_fit(np.asarray([98, 2, 1]), 100, 9, 95.0**2, weights)
    assert alone[0] not in alone[1:]  # above the attention capacity by itself: a container of its own, not split


def test_partitions_do_not_matter(spark):
    rng = random.Random(8)
    rows = [(i if i % 3 else 7, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), rng.choice(["a", "b"])) for i in range(300)]
    rows += rows[:20]
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    packed, mixed = [], []
    for n in (1, 4, 16):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        packed.append(sorted(map(tuple, packing.pack(df, capacity=64, group_containers=20).collect())))
        mixed.append(sorted(map(tuple, mixing.mix(df, targets, bucket_rows=50).collect())))
    assert packed[0] == packed[1] == packed[2] and mixed[0] == mixed[1] == mixed[2]


def test_pack_splits_only_what_is_too_long(spark):
    df = clashing(spark, ["word " * 300, "a b", None, "", "word " * 40])
    out = packing.pack(df, capacity=100).collect()
    long = [r for r in out if r.key == 0]
    assert sum(r.tokens for r in long) == 2 * (sum(r.tokens for r in long) // 2) and max(r.tokens for r in out) <= 100
    assert {r.key for r in out} == {0, 1, 4} and len([r for r in out if r.key == 4]) == 1
    assert packing.pack(df.filter("false")).count() == 0 and packing.fill_report(packing.pack(df.filter("false"))).first().containers == 0


# 9: mixing
def test_mix_meets_its_shares(spark):
    rows = [(i, "word " * (20 + i % 7), "big" if i % 5 else "small") for i in range(400)] + [(900, None, "big"), (901, "x", None), (902, "x", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, bucket_rows=50)
    rows = m.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert max(r.copy_no for r in rows) <= 3 and max(r.copy_no for r in rows if r.source == "big") == 1
    shares = {r.source: r.actual_share for r in mixing.share_report(m, targets).collect()}
    assert shares["big"] == pytest.approx(0.5, abs=0.02) and shares["small"] == pytest.approx(0.5, abs=0.02) and shares["absent"] == 0
    assert mixing.mix(docs.filter("false"), targets).count() == 0


# 6: near duplicates
def brute_pairs(rows, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if len(w) >= 5:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, rows[0][1].upper()), (1001, "  " + rows[0][1]), (1002, None), (1003, ""), (1004, "a b c d"), (1005, rows[1][1])]
    df = spark.createDataFrame([(a, b, "x", b"y") for a, b in rows], "doc_id long, text string, key string, set_key binary")
    for threshold in (0.6, 0.8):
        got = {(r.a, r.b) for r in neardup.near_duplicate_pairs(df, threshold=threshold).collect()}
        assert got == brute_pairs(rows, threshold)
    assert neardup.near_duplicate_pairs(df.filter("false")).count() == 0
    groups = {r.key: r.group_id for r in neardup.near_duplicate_groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in brute_pairs(rows, 0.6))


def test_dual_traversal_loses_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 40)).astype(np.uint64)))) for _ in range(90)]
    bits = np.stack([neardup.bitmap(s) for s in sets])
    n = np.asarray([len(s) for s in sets])
    found = {(int(i), int(j)) for a, b in neardup.dual_traversal(neardup.Node(bits, bits, n, n, n), 0.6) for i, j in zip(a, b, strict=True)}
    for i, j in itertools.combinations(range(90), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both / (n[i] + n[j] - both) >= 0.6:
            assert (i, j) in found


def test_very_long_texts(spark, model):
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, long + " end")], "doc_id long, text string")
    cuts = splitting.split_oversized(df).filter("key < 3").groupBy("key").agg(F.max("end_pos").alias("end"), F.max(F.length("piece")).alias("longest"))
    assert {(r.key, r.end, r.longest <= 8000) for r in cuts.collect()} == {(1, len(long), True), (2, 300_000, True)}
    assert sentences.sentences(df, with_text=False).filter("key = 2").first().end_pos == 300_000
    assert languages.document_languages(df, model).filter("key = 1").count() >= 1
    assert {r.key for r in tokens.token_counts(df).filter("tokens > 1000").collect()} == {1, 2, 3}
    assert [(r.a, r.b) for r in neardup.near_duplicate_pairs(df).collect()] == [(1, 3)]
    assert scans.damaged_lines(df)[0].count() == 0


# 1: scanned pages
def scan_texts(n=60):
    rng = random.Random(9)
    prose = [" ".join(" ".join(["The", *rng.choices(WORDS, k=9), f"name{rng.randint(0, 9)}"]).replace("name", rng.choice(["zelqua", "morint"])) + "." for _ in range(25)) for _ in range(n)]
    pages, truth = [], []
    for p in prose[: n // 2]:
        lines, kinds, hyphens = scans.lay_out(p, rng, {w: 9 for w in WORDS})
        pages.append("\n".join(lines))
        truth.append((kinds, hyphens))
    return prose, pages, truth


def test_damage_is_found(spark):
    prose, pages, truth = scan_texts()
    bad = [p.replace("membrane", "mernbrane", 1) if d < 3 else p for d, p in enumerate(pages)]
    df = clashing(spark, [*bad, *prose, None, "", "plain\nlist"])
    found, fixes = scans.damaged_lines(df)
    got = {(r.key, r.line_no, r.kind) for r in found.collect()}
    want = {(d, i + 1, k) for d, (kinds, hyphens) in enumerate(truth) for i, k in [*kinds.items(), *((i, "hyphen") for i, b in hyphens.items() if b)] if scans.is_laid_out(bad[d].split("\n"))}
    hit = {g for g in got if g[2] != "misread"}
    assert len(hit & want) >= 0.9 * len(want) and len(hit & want) >= 0.9 * len(hit)
    assert {(r.word, r.right) for r in fixes.collect()} >= {("mernbrane", "membrane")}
    assert all(g[0] < len(bad) for g in got)


def test_repair_joins_lines():
    text = "One of the boun-\ndary lines is\n\n                 12\nTITLE\n\nlong. A new sen­\ntence.\n\n  Second one."
    found = [(1, "hyphen"), (4, "pageno"), (5, "running"), (7, "hyphen")]
    assert scans.repair_text(text, found, {"lines": "limes"}) == "One of the boundary limes is long. A new sentence.\n\nSecond one."


def test_repair_edges(spark):
    out = {r.key: r.repaired for r in scans.repair(clashing(spark, ["plain", None, ""])).collect()}
    assert out == {0: "plain", 1: None, 2: ""}


def test_own_session_uses_the_named_folder(spark):
    from corpusloom.runtime import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file:")
    assert spark.createDataFrame([(1,)], "a int").select(F.lit(1)).count() == 1


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    g = GradientBoosting().fit(x[:1500], y[:1500])
    assert ((g.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_short_forms_meet_their_candidates(spark):
    """A change in the middle of a three-letter form leaves no 3-gram whole; forms of any length are looked up."""
    long = "x" * 30 + "membranepotential" * 2
    words = [("cat", 900), ("fox", 800), (long, 700), ("other", 600)]
    dictionary = spark.createDataFrame(words, "word string, df long")
    wrong = [("cxt",), ("f0x",), (long.replace("membrane", "mernbrane", 1),)]
    models = scans.train([], dict(words))
    got = scans.corrections(spark.createDataFrame(wrong, "word string"), dictionary, dictionary, models, least=0.0)
    assert {(r.word, r.right) for r in got.collect()} == {("cxt", "cat"), ("f0x", "fox"), (wrong[2][0], long)}
