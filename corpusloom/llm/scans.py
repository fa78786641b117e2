"""Problem 1: repair of text from scanned pages.

Method: word frequencies of all documents give a dictionary of ordinary words. Rare word forms of laid-out pages meet
their correction candidates in a join of character q-grams against the dictionary's inverted lists, and a
gradient-boosted ranker chooses the replacement, if any. Classifiers of the same kind look at a line and its neighbours
and tell running titles and page numbers, and whether a mark at a line's end was put there by the layout.

No labelled rows exist, so all three are trained here on pages that the operator lays out itself from a bounded sample
of unbroken prose of the same corpus, with breaks, furniture and misreadings whose places are known.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.gbdt import GradientBoosting
from corpusloom.llm.languages import _TO_LATIN, _UNSEEN
from corpusloom.llm.quality import _ENTRY, _INDEX, _LEADER, _fields
from corpusloom.runtime import cut, pieces

# Marks that a layout puts at a broken word's end, and those of them that no word has.
BREAK_MARKS = "-‐\xad¬"
ONLY_BREAKS = "\xad¬"
# Signs that recognition takes for one another; the right one first.
CONFUSED = [("e", "c"), ("a", "ä"), ("t", "f"), ("i", "!"), ("o", "0"), ("s", "5"), ("l", "1"), ("g", "9"), ("b", "6"), ("m", "rn"), ("u", "ii"), ("n", "ii"), ("d", "cl"), ("w", "vv"), ("l", "i"), ("i", "l"), ("i", "1"), ("h", "b"), ("b", "8"), ("z", "2"), ("rn", "m"), ("l", "|"), ("i", "|"), ("о", "0"), ("з", "3"), ("б", "6")]

_EDGE_LEFT, _EDGE_RIGHT = "\"'([{<«‹“„‘‚¿¡*", "\"')]}>»›”“’.,;:?…*。，、！？"
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"^[-–+±<>=~≈]?\d[\d.,/:%°×·–-]*\D{0,3}$")
_PAGE = re.compile(r"^\W*(?:(?:page|seite|p\.|s\.|pág\.|página|pag\.|pagina|стр\.|с\.|पृष्ठ|第)?\s*(?:\d{1,4}(?:\s*(?:/|of|von|de|sur|di|из)\s*\d{1,4})?|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})\s*(?:页|頁|ページ)?)\W*$", re.IGNORECASE)
_BRACKETED = re.compile(r"^\s*[(\[]\s*[\dA-Z]{1,3}(?:[.\d]*[a-z]?)\s*[)\]]\s*$")
_SIDE_NUMBER = re.compile(r"^\s*\d{1,4}\s{2,}\S|\S(?:\s{2,}|\s*[|·—–]\s*)\d{1,4}\s*$")
_CITE = re.compile(r"&|·|\bet al\b|\b(?:Bd|Vol|vol|Jg|t|T|т|n)\. ?\d+|\(\d{4}\)|第\d+巻|第\d+卷")
_SECTION = re.compile(r"^\s*(?:\d+\.)*\d+\.?\s+\S")
_TITLE_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
_STOP = re.compile(r"[.!?…:。！？।॥][\"'”’»」』)）\]“]*$")


@lru_cache(maxsize=1 << 17)
def fold_token(token: str) -> str:
    """A token in small letters without edge punctuation, look-alikes and unseen signs folded, marks inside kept."""
    t = token.strip(_EDGE_LEFT + _EDGE_RIGHT)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _UNSEEN.sub("", t))
        if re.search("[A-Za-z]", t):
            t = t.translate(_TO_LATIN)
    return t.lower()


@lru_cache(maxsize=1 << 17)
def shape(word: str) -> str:
    """A word with signs that are taken for one another folded into one: what a misreading leaves unchanged."""
    w = word.replace("rn", "m").replace("ii", "u").replace("cl", "d").replace("vv", "w").replace("n", "u")
    return w.translate(_SHAPE)


_SHAPE = str.maketrans({"c": "e", "ä": "a", "f": "t", "!": "i", "1": "i", "l": "i", "|": "i", "0": "o", "о": "o", "5": "s", "9": "g", "6": "b", "8": "b", "h": "b", "2": "z", "3": "з", "б": "b"})


def _breaks_at(bare: list[str], width: int, strict: bool) -> bool:
    """Whether lines end where the next word would pass the width and go on in the next line. Lines far wider than that say nothing."""
    full = pairs = going_on = 0
    for a, b in zip(bare, bare[1:], strict=False):
        if a and b and 0.5 * width < len(a) <= 1.1 * width + 2:
            pairs += 1
            head = b.lstrip()
            word = head.split(None, 1)[0]
            if a[-1] in BREAK_MARKS or len(a) + 1 + len(word) > width - 1 and not (strict and len(word) > 0.5 * width and len(a) <= 0.85 * width):
                full += 1
                # Prose goes on in small letters somewhere; where a script has none, its lines are full.
                going_on += head[0].islower() or not (head[0].isupper() or head[0].isdigit()) and head[0].isalpha() and len(a) > 0.85 * width
    return full >= 3 and full >= (0.75 if strict else 0.5) * pairs and going_on >= (0.4 if strict else 0.25) * full


def is_laid_out(lines: list[str]) -> int:
    """Width of the page if a text's lines were broken by a layout, else 0.

    The width is the longest line's or, as running titles and single lines may be wider than the text, that which a tenth of the
    lines may pass. Entries of lists and rows of tables come near the latter too, so more of the lines must be full there.
    """
    bare = [x.rstrip() for x in lines]
    sizes = sorted(len(x) for x in bare if x)
    if len(lines) < 4 or not sizes:
        return 0
    most = sizes[int(0.9 * (len(sizes) - 1))]
    width = next((w for w, strict in ((sizes[-1], False), (most, True)) if 24 <= w <= 130 and _breaks_at(bare, w, strict)), 0)
    letters = sum(map(str.isalpha, "".join(bare)))
    return width if letters > 0.45 * sum(map(len, bare)) else 0


@dataclass
class Page:
    """A laid-out text with what the classifiers ask of its lines."""

    lines: list[str]
    width: int
    ordinary: dict[str, int]

    def __post_init__(self) -> None:
        self.bare = [x.strip() for x in self.lines]
        self.solid = [i for i, x in enumerate(self.bare) if x]
        self.place = {i: k for k, i in enumerate(self.solid)}
        self.head_at = {i: self.head(x) for i, x in enumerate(self.bare) if len(x) > 0.92 * self.width}
        self.heads = Counter(self.head_at.values())
        self.keys = Counter(self.key(x) for i, x in enumerate(self.bare) if x and (len(x) < 0.95 * self.width or self.titled(i)))

    @staticmethod
    def key(line: str) -> str:
        """What stays of a running title from page to page, numbers and misreadings aside."""
        return " ".join(shape(x.lower())[:4] for x in _TITLE_WORD.findall(line)[:2])

    @staticmethod
    def head(line: str) -> str:
        """All words of a line, numbers and misreadings aside: what a title as wide as the page has on every one."""
        return " ".join(shape(x.lower()) for x in _TITLE_WORD.findall(line))

    def at_edge(self, i: int) -> bool:
        """Whether a line touches a form feed, an empty line or an end of the text."""
        return "\x0c" in self.lines[i] or i == 0 or not self.bare[i - 1] or "\x0c" in self.lines[i - 1] or i + 1 >= len(self.bare) or not self.bare[i + 1] or "\x0c" in self.lines[i + 1][:1]

    def titled(self, i: int) -> bool:
        """Whether a line of the page's width has a number at its side or comes again with the same words."""
        if _SIDE_NUMBER.search(self.lines[i]):
            return True
        head = self.head_at[i] if i in self.head_at else self.head(self.bare[i])
        return head != "" and self.heads[head] > 1

    def candidates(self) -> list[int]:
        """Lines that are shorter than the page or may be titles as wide as it, no rows of a table and no entries of a list."""
        row = [(_fields(self.lines[i]), bool(_ENTRY.match(self.lines[i]) or _LEADER.search(self.bare[i]) or _INDEX.match(self.bare[i]))) for i in self.solid]
        out = []
        for k, i in enumerate(self.solid):
            (sep, n), entry = row[k]
            near = row[max(0, k - 1) : k] + row[k + 1 : k + 2]
            if len(self.bare[i]) > 0.92 * self.width and not (self.titled(i) or self.at_edge(i)) or n >= 3 and any(m >= 3 and s == sep for (s, m), _ in near) or entry and any(e for _, e in near):
                continue
            out.append(i)
        return out

    def features(self, i: int) -> list[float]:
        s, raw = self.bare[i], self.lines[i]
        k = self.place[i]
        before = self.bare[self.solid[k - 1]] if k else ""
        after = self.bare[self.solid[k + 1]] if k + 1 < len(self.solid) else ""
        words = s.split()
        tokens = [fold_token(x) for x in words]
        alpha = [t for t in tokens if _LETTER.search(t)]
        letters = "".join(filter(str.isalpha, s))
        known = sum(t in self.ordinary for t in alpha)
        near = [self.bare[j] for j in self.solid[max(0, k - 2) : k] + self.solid[k + 1 : k + 3] if abs(j - i) <= 4]
        key = self.key(s)
        return [
            len(s) / self.width,
            (len(raw) - len(raw.lstrip())) / self.width,
            float(bool(_PAGE.match(s))),
            sum(map(str.isupper, letters)) / max(1, len(letters)),
            known / max(1, len(alpha)),
            float(len(words)),
            float(bool(_STOP.search(s))),
            float(s[0].islower()),
            float(bool(_STOP.search(before))) if before else 2.0,
            float(after[:1].islower()) if after else 2.0,
            float(i == 0 or not self.bare[i - 1]),
            float(i + 1 >= len(self.bare) or not self.bare[i + 1]),
            float("\x0c" in raw or i > 0 and "\x0c" in self.lines[i - 1]),
            float(min(self.keys.get(key, 1), 9)) if key else 0.0,
            float(any(_PAGE.match(x) for x in near)),
            float(bool(_SIDE_NUMBER.search(raw))),
            float(bool(_BRACKETED.match(s))),
            float(len(_CITE.findall(s))),
            float(k == 0) + 2.0 * (k + 1 == len(self.solid)),
            sum(map(str.isdigit, s)) / len(s),
            float(bool(after) and len(s) + 1 + len(after.split(None, 1)[0]) <= self.width),
            sum(w[:1].isupper() for w in words) / max(1, len(words)),
            float(bool(_SECTION.match(s))),
            float(len(before) >= 0.85 * self.width),
            float(bool(before) and not _STOP.search(before) and before[-1:].isalpha()),
        ]


def join_features(first: str, second: str, mark: str, ordinary: dict[str, int], own: Counter) -> list[float]:
    """Of a word part before a mark at a line's end and the part at the next line's start."""
    df = lambda w: float(np.log1p(ordinary.get(w, 0)))
    joined, compound = first + second, f"{first}-{second}"
    return [float(mark in ONLY_BREAKS), df(joined), df(compound), df(first), df(second), float(min(own[joined], 5)), float(min(own[compound], 5)), float(len(first)), float(len(second)), df(joined) - df(compound), float(min(own[first], 5)), float(min(own[second], 5)), float("-" in first)]


def edit_cost(wrong: str, right: str) -> tuple[float, float, float]:
    """(cheapest cost of reading `right` as `wrong`, its number of visual confusions, of other edits): a confusion costs 0.3, any other edit 1."""
    n, m = len(right), len(wrong)
    best: list[list[tuple[float, int, int]]] = [[(99.0, 0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            c, v, o = best[i][j]
            if c >= 4:
                continue
            if i < n and j < m:
                step = (c, v, o) if right[i] == wrong[j] else (c + 1, v, o + 1)
                best[i + 1][j + 1] = min(best[i + 1][j + 1], step)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], (c + 1, v, o + 1))
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], (c + 1, v, o + 1))
            for a, b in CONFUSED:
                if right.startswith(a, i) and wrong.startswith(b, j):
                    to = (c + 0.3, v + 1, o)
                    if to < best[i + len(a)][j + len(b)]:
                        best[i + len(a)][j + len(b)] = to
    c, v, o = best[n][m]
    return c, float(v), float(o)


def rank_features(wrong: str, right: str, df_wrong: int, df_right: int) -> list[float]:
    cost, visual, other = edit_cost(wrong, right)
    signs = sum(not c.isalpha() for c in wrong)
    return [cost, visual, other, float(len(right)), float(np.log1p(df_right)), float(np.log1p(df_right) - np.log1p(df_wrong)), float(signs), float(wrong[:1] == right[:1]), float(wrong[-1:] == right[-1:]), float(shape(wrong) == shape(right)), cost / len(right), float(len(wrong) - len(right))]


@dataclass
class Models:
    ordinary: dict[str, int]
    running: GradientBoosting
    pageno: GradientBoosting
    hyphen: GradientBoosting
    ranker: GradientBoosting


def _misread(word: str, rng: random.Random) -> str:
    ways = [(a, b, i) for a, b in CONFUSED for i in range(len(word)) if word.startswith(a, i)]
    if not ways:
        return word
    a, b, i = rng.choice(ways)
    return word[:i] + b + word[i + len(a) :]


def _slip(word: str, rng: random.Random) -> str:
    """A writer's own slip: letters swapped, left out, doubled, or another letter of the alphabet."""
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + rng.choice("bdghjkmpqrvwxyz") + word[i + 1 :]])


def lay_out(text: str, rng: random.Random, ordinary: dict[str, int]) -> tuple[list[str], dict[int, str], dict[int, bool]]:
    """(lines, kind of furniture by line, broken or own hyphen by line): a text set on pages."""
    width = rng.randint(45, 82)
    mark = rng.choice(BREAK_MARKS)
    break_share = rng.choice([0.0, 0.3, 0.6, 0.9])
    names = [w for w in dict.fromkeys(re.findall(r"[^\W\d_]{4,}", text)) if fold_token(w) not in ordinary] or ["Anon"]
    every = re.findall(r"[^\W\d_]{6,}", text) or names
    pick = [rng.choice(every) if rng.random() < 0.3 else rng.choice(names) for _ in range(rng.randint(1, 4))]
    title = " ".join(x.capitalize() for x in pick)
    names = pick + names
    style = rng.randrange(7)
    if style in (0, 5):
        title = title.upper()
    elif style == 6:
        title = f"{pick[0].capitalize()} {rng.choice(['and', 'und', 'et', 'y', 'e', 'и'])} {rng.choice(names).capitalize()}"
    elif style == 1:
        title = f"{rng.choice(names).capitalize()} & {rng.choice(names).capitalize()}"
    elif style == 2:
        title = f"{rng.choice(names).capitalize()} et al. · {rng.choice(names).capitalize()}"
    elif style == 3:
        title = f"{rng.choice(names).capitalize()}, {rng.choice(['Bd.', 'vol.', 'Vol.', 't.', 'T.'])} {rng.randint(1, 60)} ({rng.randint(1930, 2023)})"
    elif style == 4:
        title = title[:1].upper() + title[1:].lower()
    number = rng.randint(1, 400)
    adorn = rng.choice(["{}", "- {} -", "— {} —", "– {} –", "[{}]", "{} / 480", "Page {}", "S. {}", "~ {} ~", "· {} ·"])
    roman = rng.random() < 0.1
    wide = random.Random(1000 * width + number)
    flush = wide.random() < 0.35  # the number stands at the other edge of the page
    if wide.random() < 0.12:  # a title as wide as the text
        while len(title) < 0.93 * width:
            title += " " + (wide.choice(every).upper() if title.isupper() else wide.choice(every))
        title = title[: width + 6]
    gap = rng.randint(12, 45)
    until = rng.randint(6, gap)
    lines: list[str] = []
    kinds: dict[int, str] = {}
    hyphens: dict[int, bool] = {}

    def page() -> None:
        nonlocal number
        number += 1
        n = "".join(c * (number // v % 10 if v > 1 else 1) for c, v in (("x", 10), ("i", 1))) or "i" if roman else str(number)
        shown = adorn.format(n)
        pad = rng.choice([0, 0, width // 2 - 2, max(0, width - len(shown))])
        both = rng.random()
        parts = []
        if both < 0.25:
            t = title if not rng.random() < 0.15 else _misread(title.lower(), rng).capitalize()
            gaps = [max(3, width - len(t) - len(n)) if flush else g for g in (rng.randint(3, 14), rng.randint(3, 14))]
            parts.append((rng.choice([f"{t}{' ' * gaps[0]}{n}", f"{n}{' ' * gaps[1]}{t}"]), "running"))
        else:
            if both < 0.75:
                parts.append((" " * pad + shown, "pageno"))
            if both > 0.5:
                parts.append((" " * rng.choice([0, 0, max(0, (width - len(title)) // 2)]) + (title if rng.random() > 0.15 else _misread(title, rng)), "running"))
        rng.shuffle(parts)
        if rng.random() < 0.4:
            lines.append("")
        for k, (x, kind) in enumerate(parts):
            if rng.random() < 0.15 and not k:
                x = "\x0c" + x
            kinds[len(lines)] = kind
            lines.append(x)
            if rng.random() < 0.25 and k + 1 < len(parts):
                lines.append("")
        if rng.random() < 0.4:
            lines.append("")

    if rng.random() < 0.5:
        page()
    for para in text.split("\n"):
        if not para.strip():
            if lines and lines[-1]:
                lines.append("")
            continue
        words = para.split()
        if len(words) > 8 and rng.random() < 0.06:  # a heading of the text's own ordinary words
            lines += [rng.choice(["", "2 ", "3.1 "]) + " ".join(w for w in words[:6] if fold_token(w) in ordinary)[:40].strip(" ,.").capitalize(), ""]
            if not lines[-2]:
                lines[-2:] = []
        line = " " * rng.choice([0, 0, 2, 3])
        while words:
            w = words.pop(0)
            room = width - len(line) - (1 if line.strip() else 0)
            if len(w) <= room:
                line += (" " if line.strip() else "") + w
                continue
            own = w.find("-", 1)
            if 1 < own < room and w[own + 1 :].isalpha() and w[:own].isalpha() and rng.random() < 0.8:
                line += (" " if line.strip() else "") + w[: own + 1]
                hyphens[len(lines)] = False
                words.insert(0, w[own + 1 :])
            elif rng.random() < break_share and room > 3 and (m := re.match(r"[^\W\d_]{6,}", w)) and min(room - 1, len(m.group()) - 2) >= 2:
                at = min(room - 1, len(m.group()) - 2)
                line += (" " if line.strip() else "") + w[:at] + mark
                hyphens[len(lines)] = True
                words.insert(0, w[at:])
            else:
                words.insert(0, w)
                if not line.strip():
                    line = words.pop(0)
            lines.append(line)
            line = ""
            until -= 1
            if until <= 0 and words:
                page()
                until = gap
        if line.strip():
            lines.append(line)
            until -= 1
        if rng.random() < 0.05:
            lines.append(" " * rng.choice([0, 6, 20]) + f"({rng.randint(1, 40)})")
        if rng.random() < 0.5:
            lines.append("")
        if until <= 0:
            page()
            until = gap
    if rng.random() < 0.5:
        page()
    return lines, kinds, hyphens


def train(sample: list[str], ordinary: dict[str, int], seed: int = 11) -> Models:
    """Fits all classifiers on pages laid out from the sample's unbroken prose."""
    rng = random.Random(seed)
    xs, kinds_y, hx, hy = [], [], [], []
    for text in sample:
        lines, kinds, hyphens = lay_out(text, rng, ordinary)
        width = is_laid_out(lines)
        if not width:
            continue
        page = Page(lines, width, ordinary)
        for i in page.candidates():
            xs.append(page.features(i))
            kinds_y.append(kinds.get(i, ""))
        own = Counter(t for x in lines for t in map(fold_token, x.split()))
        for i, broken in hyphens.items():
            rest = next((lines[j] for j in range(i + 1, len(lines)) if lines[j].strip() and j not in kinds), "")
            m, n = _LAST_PART.search(lines[i]), _FIRST_PART.match(rest)
            if m and n:
                hx.append(join_features(m.group(1).lower(), n.group(1).lower(), m.group(2), ordinary, own))
                hy.append(float(broken))
    words = sorted((w for w in ordinary if len(w) >= 4 and w.isalpha()), key=lambda w: (-ordinary[w], w))[:4000]
    compounds = [w for w in ordinary if w.count("-") == 1 and all(len(p) > 1 and p.isalpha() for p in w.split("-"))]
    for w in compounds[:400]:
        a, b = w.split("-")
        for mark in "-‐":
            hx += [join_features(a, b, mark, ordinary, Counter({w: k})) for k in (0, 1)]
            hy += [0.0, 0.0]
    for w in words[:1500]:
        if len(w) >= 6:
            at = rng.randint(2, len(w) - 2)
            hx.append(join_features(w[:at], w[at:], rng.choice(BREAK_MARKS), ordinary, Counter()))
            hy.append(1.0)
    by = {}
    for w in words:
        by.setdefault(shape(w)[:3], []).append(w)
    rx, ry = [], []
    for w in words:
        for _ in range(2):
            bad = _misread(w, rng)
            if rng.random() < 0.2:
                bad = _misread(bad, rng)
            if bad == w or bad in ordinary:
                continue
            seen = max(0, int(ordinary[w] * rng.random() * 0.03))
            rx.append(rank_features(bad, w, seen, ordinary[w]))
            ry.append(1.0)
            other = rng.choice(by[shape(w)[:3]])
            if other != w:
                rx.append(rank_features(bad, other, seen, ordinary[other]))
                ry.append(0.0)
        slip = _slip(w, rng)
        if slip not in ordinary and edit_cost(slip, w)[2] > 0:
            rx.append(rank_features(slip, w, rng.randint(0, 3), ordinary[w]))
            ry.append(0.0)
        tail = w + rng.choice(["s", "e", "n", "es", "a"]) if rng.random() < 0.5 else w[:-1]
        if tail not in ordinary and len(tail) > 2:
            rx.append(rank_features(tail, w, rng.randint(0, 3), ordinary[w]))
            ry.append(0.0)
        # A word of its own that differs by a sign which could be confused, but is about as frequent.
        bad = _misread(w, rng)
        if bad != w and bad.isalpha() and "ä" not in bad:
            rx.append(rank_features(bad, w, int(ordinary[w] * rng.uniform(0.2, 2)), ordinary[w]))
            ry.append(0.0)
    width = 25
    x = np.asarray(xs, np.float64).reshape(-1, width)
    kind = np.asarray(kinds_y, object)
    empty = np.zeros((2, width))

    def fit(a: np.ndarray, y: np.ndarray, none: np.ndarray) -> GradientBoosting:
        return GradientBoosting().fit(a, y) if len(a) else GradientBoosting(trees=1).fit(none, np.zeros(len(none)))

    return Models(
        ordinary,
        fit(x, (kind == "running").astype(float), empty),
        fit(x, (kind == "pageno").astype(float), empty),
        fit(np.asarray(hx, np.float64).reshape(-1, 13), np.asarray(hy), np.zeros((2, 13))),
        fit(np.asarray(rx, np.float64).reshape(-1, 12), np.asarray(ry), np.zeros((2, 12))),
    )


_LAST_PART = re.compile(r"([^\W\d_](?:[^\s]*[^\W_])?)([-‐\xad¬])\s*$")
_FIRST_PART = re.compile(r"\s*((?:[^\W_]|[!|])*[^\W\d_](?:[^\W_]|[!|'’](?=\w))*)")


@dataclass
class Damage:
    """What is wrong with a laid-out text: kinds of furniture by line, joined line pairs, suspicious words (first line, second line or -1, length in the first, word)."""

    furniture: dict[int, str]
    joins: dict[int, int]
    suspects: list[tuple[int, int, int, str]]


def examine(texts: list[str], models: Models) -> list[Damage | None]:
    """Damage of each text, None if it wasn't laid out on pages. Suspects are the forms that the dictionary lacks.

    The classifiers are asked once for all lines of a batch: first for furniture, then for the joins of what is left.
    """
    pages: dict[int, Page] = {}
    for d, text in enumerate(texts):
        lines = text.split("\n") if "\n" in text else []
        if width := is_laid_out(lines):
            pages[d] = Page(lines, width, models.ordinary)
    short = [(d, i) for d, page in pages.items() for i in page.candidates()]
    furniture: dict[int, dict[int, str]] = {d: {} for d in pages}
    if short:
        x = np.asarray([pages[d].features(i) for d, i in short])
        run, num = models.running.predict(x), models.pageno.predict(x)
        for (d, i), r, p, f in zip(short, run.tolist(), num.tolist(), x, strict=True):
            # A line as wide as the page that has no number and doesn't come again is most often a paragraph's first or last one.
            sure = 0.9 if f[0] > 0.92 and not pages[d].titled(i) else 0.5
            if max(r, p) > sure and not f[16]:  # a number in brackets is an equation's
                furniture[d][i] = "pageno" if p >= r and f[2] else "running" if r >= 0.5 else "pageno"
    bodies = {d: [i for i in page.solid if i not in furniture[d]] for d, page in pages.items()}
    parts, features = [], []
    for d, page in pages.items():
        own = None
        for i, j in zip(bodies[d], bodies[d][1:], strict=False):
            if page.bare[i][-1] not in BREAK_MARKS:
                continue
            m, n = _LAST_PART.search(page.lines[i]), _FIRST_PART.match(page.lines[j])
            if m and n and not n.group(1)[0].isupper():
                if own is None:
                    own = Counter(t for x in page.lines for t in map(fold_token, x.split()))
                parts.append((d, i, j))
                features.append(join_features(m.group(1).split()[-1].lower(), n.group(1).lower(), m.group(2), models.ordinary, own))
    joins: dict[int, dict[int, int]] = {d: {} for d in pages}
    if parts:
        for (d, i, j), ok in zip(parts, (models.hyphen.predict(np.asarray(features)) > 0.5).tolist(), strict=True):
            if ok:
                joins[d][i] = j
    return [Damage(furniture[d], joins[d], _suspects(pages[d], bodies[d], joins[d], models.ordinary)) if d in pages else None for d in range(len(texts))]


def _suspects(page: Page, body: list[int], joins: dict[int, int], ordinary: dict[str, int]) -> list[tuple[int, int, int, str]]:
    out = []
    after = set(joins.values())
    for i in body:
        words = page.lines[i].split()
        for k, w in enumerate(words):
            if k == 0 and i in after or w in ordinary:
                continue
            if k == len(words) - 1 and i in joins:
                head = w.rstrip(BREAK_MARKS)
                t = fold_token(head + page.lines[joins[i]].split(None, 1)[0])
                if _suspicious(t, ordinary):
                    out.append((i, joins[i], len(head.lstrip(_EDGE_LEFT)), t))
                continue
            t = fold_token(w)
            if _suspicious(t, ordinary):
                out.append((i, -1, 0, t))
    return out


def _suspicious(t: str, ordinary: dict[str, int]) -> bool:
    """Whether a folded form may be a misread word. Of two signs (`0f`, `5s`) nothing tells it from a number with a unit."""
    return len(t) >= 3 and t not in ordinary and bool(_LETTER.search(t)) and not _NUMBER.match(t)


def word_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, df): documents in which each folded word form occurs, over all documents; partitions count before they send."""
    base = df.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[str, str] = {}
        count: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "df"])
            count.clear()
            return out

        for batch in pieces(batches, "text"):
            for t in batch.column("text").to_pylist():
                forms = set(t.split())
                for w in forms:
                    if w not in folded:
                        f = fold_token(w)
                        folded[w] = f if len(f) >= 3 and _LETTER.search(f) and not _NUMBER.match(f) else ""
                count.update({folded[w] for w in forms})
            if len(folded) > 400_000:
                folded.clear()
            if len(count) > 300_000:
                yield send()
        if count:
            yield send()

    return base.mapInArrow(run, "word string, df long").filter("word <> ''").groupBy("word").agg(F.sum("df").alias("df"))


def qgrams(column: str, q: int = 3) -> Column:
    """The q-grams of a form with its ends marked; of forms of q + 1 signs or fewer also the shorter ones, as an edit in their middle may leave no q-gram whole."""
    padded = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(column) <= q + 1, F.concat(grams(q), grams(q - 1))).otherwise(grams(q)))


def corrections(suspects: DataFrame, dictionary: DataFrame, frequencies: DataFrame, models: Models, least: float = 0.5) -> DataFrame:
    """(word, right, score): the replacement of each suspicious form that has one.

    suspects: (word); dictionary: (word, df) of ordinary words. Folded forms within one edit share at least one of any
    four of a word's 3-grams; the four with the shortest inverted lists are looked up, of forms of up to four signs all.
    A form that stands only broken over two lines has no frequency of its own and counts as seen once.
    """
    lists = cut(dictionary.select(F.col("word").alias("right"), F.col("df").alias("df_right"), _shape_column(F.col("word")).alias("shape_right")), "dictionary")
    postings = lists.select("right", "df_right", "shape_right", F.explode(qgrams("shape_right")).alias("gram"))
    rarity = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = cut(suspects.select("word").distinct().join(frequencies, "word", "left").select("word", F.coalesce("df", F.lit(1)).alias("df"), _shape_column(F.col("word")).alias("shape")), "asked")
    grams = asked.select("word", "df", "shape", F.explode(qgrams("shape")).alias("gram")).join(rarity, "gram", "left").fillna(0, ["n"])
    four = grams.groupBy("word", "df", "shape").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g")).withColumn("g", F.when(F.length("shape") <= 4, F.col("g")).otherwise(F.slice("g", 1, 4))).select("word", "df", "shape", F.explode("g.gram").alias("gram"))
    near = four.join(postings, "gram").filter((F.abs(F.length("shape") - F.length("shape_right")) <= 1) & (F.col("word") != F.col("right")) & (F.levenshtein("shape", "shape_right", 1) >= 0)).select("word", "df", "right", "df_right").distinct()
    sent = suspects.sparkSession.sparkContext.broadcast(models.ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("word", "right", "df", "df_right")), strict=True))
            if rows:
                p = sent.value.predict(np.asarray([rank_features(*r) for r in rows]))
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("right"), pa.array(p)], ["word", "right", "score"])

    scored = near.mapInArrow(run, "word string, right string, score double").filter(F.col("score") >= least)
    return scored.groupBy("word").agg(F.max_by(F.struct("right", "score"), F.struct("score", "right")).alias("b")).select("word", "b.right", "b.score")


def _shape_column(c: Column) -> Column:
    """shape() in built-in functions."""
    for a, b in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("n", "u")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(map(chr, _SHAPE)), "".join(_SHAPE.values()))


def frequent_misreadings(ordinary: dict[str, int], ratio: float = 40.0) -> set[str]:
    """Forms that are frequent themselves but far rarer than a word of the same shape: not taken for ordinary words."""
    by: dict[str, list[str]] = {}
    for w in ordinary:
        by.setdefault(shape(w), []).append(w)
    return {w for ws in by.values() for w in ws if ordinary[w] * ratio <= max(ordinary[x] for x in ws)}


def prepare(df: DataFrame, key: str, text: str, sample_docs: int = 400, share: float = 0.0005, max_words: int = 2_000_000) -> tuple[Models, DataFrame, DataFrame]:
    """(models, dictionary, frequencies). Ordinary words are those in at least `share` of the documents and in five.

    The dictionary is bounded: a share s of documents of at most m different words each leaves at most m / s words; more
    than `max_words` raise.
    Training uses `sample_docs` texts, the first by digest of the key among those that are unbroken prose; only keys are
    sorted, so no task sends more than that many keys.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    frequencies = cut(word_frequencies(base), "frequencies")
    total = base.count()
    dictionary = frequencies.filter(F.col("df") >= max(5, share * total))
    if (size := dictionary.count()) > max_words:
        raise ValueError(f"{size} ordinary words are more than the {max_words} that every worker may hold: raise share")
    ordinary = {r.word: r.df for r in dictionary.collect()}
    common = frequent_misreadings(ordinary)
    ordinary = {w: n for w, n in ordinary.items() if w not in common}
    if common:
        dictionary = dictionary.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in sorted(common)], "word string")), "word", "left_anti")
    prose = base.filter((F.length("text") > 600) & (F.length("text") < 9000) & F.col("text").rlike(r"(?:^|\n)[^\n]{200}") & ~F.col("text").rlike(r"\|[^\n]*\||\t[^\n]*\t"))
    chosen = [r.key for r in prose.select("key", F.md5(F.col("key").cast("string")).alias("h")).orderBy("h", "key").limit(sample_docs).collect()]
    sample = sorted(r.text for r in base.filter(F.col("key").isin(chosen)).select("text").distinct().limit(sample_docs).collect()) if chosen else []
    return train(sample, ordinary), dictionary, frequencies


def damaged_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, fixes). found: (key, line_no, kind), lines counted from 1, kinds running, pageno, hyphen and misread.
    fixes: (key, word, right), the replacements in each text.

    Texts that weren't laid out on pages, null and empty texts have no rows; repeated rows come out once.
    """
    models, dictionary, frequencies = prepare(df, key, text)
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    key_type = base.schema["key"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            source: list[int] = []
            rows: list[tuple] = []
            for r, d in enumerate(examine(batch.column("text").to_pylist(), sent.value)):
                if d is None:
                    continue
                new = [(i + 1, 0, 0, k, None) for i, k in d.furniture.items()] + [(i + 1, 0, 0, "hyphen", None) for i in d.joins] + [(i + 1, j + 1, n, "suspect", w) for i, j, n, w in d.suspects]
                rows += new
                source += [r] * len(new)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(source)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], ["key", "line_no", "next_no", "split", "kind", "word"])

    seen = cut(base.mapInArrow(run, f"key {key_type}, line_no int, next_no int, split int, kind string, word string"), "lines")
    suspects = seen.filter("kind = 'suspect'")
    right = cut(corrections(suspects, dictionary, frequencies, models), "corrections")
    wrong = suspects.join(right, "word")
    # A word broken over two lines: the line that has the first sign that differs.
    same = F.expr("aggregate(sequence(1, least(length(word), length(right))), 0, (n, i) -> if(n = i - 1 AND substr(word, i, 1) = substr(right, i, 1), i, n))")
    line = F.when((F.col("next_no") > 0) & (same >= F.col("split")), F.col("next_no")).otherwise(F.col("line_no"))
    found = seen.filter("kind <> 'suspect'").select("key", "line_no", "kind").union(wrong.select("key", line.alias("line_no"), F.lit("misread").alias("kind"))).distinct()
    return found, wrong.select("key", "word", "right").distinct()


def repair_text(text: str, found: list[tuple[int, str]], fixes: dict[str, str]) -> str:
    """Continuous paragraphs: furniture gone, broken words and lines joined, misread words replaced in their case."""
    lines = text.split("\n")
    kinds = {i: k for i, k in found if k != "misread"}

    def mend(word: str) -> str:
        core = word.strip(_EDGE_LEFT + _EDGE_RIGHT)
        to = fixes.get(fold_token(word))
        if not to or not core:
            return word
        to = to.upper() if core.isupper() and len(core) > 1 else to.capitalize() if core[0].isupper() else to
        return word.replace(core, to, 1)

    paragraphs: list[list[str]] = [[]]
    open_word = False
    blank = False
    for i, x in enumerate(lines, 1):
        if kinds.get(i) in ("running", "pageno"):
            continue
        words = x.split()
        if not words:
            blank = True
            continue
        own = paragraphs[-1]
        if not open_word and own and (blank and not words[0][0].islower() and _STOP.search(own[-1]) or x[:2].isspace() and not blank and _STOP.search(own[-1]) or blank and _STOP.search(own[-1])):
            paragraphs.append([])
            own = paragraphs[-1]
        blank = False
        if open_word:
            own[-1] += words.pop(0)
        own += words
        open_word = kinds.get(i) == "hyphen" and bool(own)
        if open_word:
            own[-1] = own[-1].rstrip(BREAK_MARKS)
    return "\n\n".join(" ".join(map(mend, p)) for p in paragraphs if p)


def repair(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, repaired): every row; texts that weren't laid out come back as they are, nulls as null."""
    found, fixes = damaged_lines(df, key, text)
    lines = found.groupBy("key").agg(F.collect_list(F.struct("line_no", "kind")).alias("found"))
    words = fixes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("fixes"))
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    joined = base.join(lines, "key", "left").join(words, "key", "left")
    key_type = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for t, f, w in zip(*(batch.column(c).to_pylist() for c in ("text", "found", "fixes")), strict=True):
                laid = t is not None and (f or is_laid_out(t.split("\n")))
                out.append(repair_text(t, [(x["line_no"], x["kind"]) for x in f or []], dict(w or {})) if laid else t)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), pa.array(out, pa.string())], ["key", "text", "repaired"])

    return joined.mapInArrow(run, f"key {key_type}, text string, repaired string")
