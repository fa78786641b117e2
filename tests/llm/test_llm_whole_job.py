"""Training-text operators on cases that were left out before."""

import random
import textwrap

from corpusloom.llm import languages, queries, scans


def prose(rng, n=700):
    words = "the probe rose over a season while samples of salt were stored before rinsing and results remained stable under dry conditions".split()
    return " ".join(rng.choice(words) for _ in range(n))


def test_pages_with_heads_wider_than_the_text():
    """Every layout counts: one that is rejected is a miss."""
    rng = random.Random(5)
    for width in range(40, 80, 5):
        body = textwrap.wrap(prose(rng), width)
        head = f"{rng.randint(100, 400)}  " + "Viste & Zeldenran ".ljust(width + 9, "x")
        lines = [y for i, x in enumerate(body) for y in ([head, ""] * (i % 30 == 0) + [x])]
        got = scans.is_laid_out(lines)
        assert width - 3 <= got <= width, (width, got)
        # A single line above 130 characters rejects no page either.
        assert scans.is_laid_out([*body, "y " * 100])


def test_lists_with_one_wide_row_are_no_pages():
    rng = random.Random(6)
    rows = [", ".join(prose(rng, 1) + str(rng.randint(1, 99)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    assert not scans.is_laid_out([*rows, "z" * 90])


EN = ["The membrane potential was compared with the assumed geometry.", "Several independent trials gave a weak signal near the upper limit.", "We tested the salts after careful filtering.", "A long survey was lost before the final rinse."]
DE = ["Die Proben wurden bei Raumtemperatur gelagert und danach gemischt.", "Der Streuwinkel bestimmt die übrigen Proben während der Saison.", "Das Verfahren wurde auf die untersuchte Gruppe übertragen.", "Die Nervenfaser war nach sorgfältiger Filterung stabil."]
ZH = ["我们发现表层样品补充了两种竞争假设。", "这表明热梯度与系统的关系是稳定的。", "在每次重复中，温度改变了早期的测量。"]


def test_each_passage_in_another_language_has_its_place(spark):
    model = languages.KneserNey.fit({"en": EN * 3, "de": DE * 3, "zh": ZH * 3})
    en, de, zh = " ".join(EN), " ".join(DE), "".join(ZH)
    parts = ["  " + en + "\n\n", de + "\n", en + "\n\n\n", zh + "\n", de + " "]
    rows = [(1, "".join(parts)), (2, None), (3, " \n "), (4, de)]
    got = languages.language_passages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    text = rows[0][1]
    one = sorted((r for r in got if r.key == 1), key=lambda r: r.start_pos)
    assert [(r.lang, text[r.start_pos : r.end_pos]) for r in one] == [("en", en), ("de", de), ("en", en), ("zh", zh), ("de", de)]
    assert all(0.5 < r.confidence <= 1 for r in got)
    assert [(r.key, r.start_pos, r.end_pos, r.lang) for r in got if r.key != 1] == [(4, 0, len(de), "de")]
    assert "p7_passages" in queries.queries()


def test_titles_as_wide_as_the_page_are_looked_at():
    rng = random.Random(7)
    body = textwrap.wrap(prose(rng, 900), 60)
    for head in ("VISTE AND ZELDENRAN ON THE PROBE IN DRY SEASONS OF STABILITY", "Viste & Zeldenran".ljust(56) + "{}", "{}" + "Viste & Zeldenran".rjust(57)):
        lines = []
        for k in range(0, 90, 30):
            lines += [head.format(100 + k), *body[k : k + 30]]
        page = scans.Page(lines, 60, {})
        assert {0, 31, 62} <= set(page.candidates())
        assert len(page.candidates()) < 0.3 * len(lines)
        assert all(page.features(i)[13] == 3 for i in (0, 31, 62))


def test_layouts_have_numbers_at_the_other_edge():
    text = prose(random.Random(8), 900)
    wide = 0
    for seed in range(40):
        lines, kinds, _ = scans.lay_out(text, random.Random(seed), {})
        width = scans.is_laid_out(lines)
        wide += any(len(lines[i].strip()) > 0.92 * width for i, k in kinds.items() if k == "running" and "  " in lines[i].strip())
    assert wide >= 3
