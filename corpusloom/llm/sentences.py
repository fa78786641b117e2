"""Problem 10: sentence boundaries across languages and scripts.

Method: the boundary rules are a finite transducer over character classes. Texts are laid end to end, cut into chunks,
and every chunk becomes a function from states to states, computed for all chunks at once; a parallel prefix scan
composes the functions, so that each chunk's first state is known and the outputs come from one more pass. A long text
is thus worked on in as many lanes as it has chunks. Abbreviations, initials, decimals and line wraps are marked
beforehand as classes of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import pieces

# Character classes.
(OTHER, LOWER, UPPER, DIGIT, SPACE, PERIOD, HARD, CLOSE, OPEN, PAUSE, PLAIN, QUOTING, BREAK, RESET, ABBR, SOFT, DOTS) = range(17)
# States: before a sentence; in one; after a period, a hard mark, a soft abbreviation, dots; the same after closers, or after blanks.
(OUT, IN, P, H, A, E, PC, HC, PS, HS, AS, ES) = range(12)

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = """
Dr Dra Drs Prof Mr Mrs Ms Mme Mlle Sr Sra Srta Dott dott Sig sig Hr Fr St Fig Figs fig figs Figg Sec Secs sec Sect Abb Kap Tab Bd Nr Eq Eqs Ref Refs Vol vol Ch Chap chap cap Cap pp pág núm
cf vgl approx aprox env vs viz resp bzw ggf evtl ej
рис табл гл ок см ср стр проф акад им
डॉ प्रो
""".split()
# Abbreviations that may also close a sentence.
CLOSING = "etc ecc usw др пр".split()
# Abbreviations only before a number.
BEFORE_NUMBER = "no No nos Nos p S art Art ca n".split()
# Second parts of abbreviations of two words, after a single letter and a period.
AFTER_LETTER = "ex ej es".split()
# Month names after an ordinal day.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split()

_SEPARATOR = "\U0010ffff"
_TAIL = re.compile(r"[\w.]*$")
_LATER = re.compile(r"\s(?:" + "|".join(MONTHS) + r")\b")
_ALWAYS, _MAY_CLOSE, _NUMBERED, _SECOND = map(frozenset, (ABBREVIATIONS, CLOSING, BEFORE_NUMBER, AFTER_LETTER))
_SPACES = "  \u202f\n"


def _period(text: str, i: int) -> int:
    """Class of the period at text[i], which has no period beside it."""
    tail = _TAIL.search(text, max(0, i - 14), i).group()
    word = tail.rpartition(".")[2]
    if not word:
        return PERIOD
    before = text[max(0, i - len(tail) - 4) : i - len(tail)]
    joint = text[max(0, i - len(word) - 3) : i - len(word)]  # what precedes the last part: "z. " or "z."
    second = (joint[-1:] == "." and joint[-2:-1].isalpha() or joint[-1:] in _SPACES and joint[-2:-1] == "." and joint[-3:-2].isalpha()) and len(joint) > 1
    if word in _ALWAYS:
        return ABBR
    if word in _MAY_CLOSE or word in ("г", "гг") and before[-2:-1].isdigit() or second and word in ("д", "п"):
        return SOFT
    if word in _NUMBERED and text[i + 1 : i + 3].lstrip()[:1].isdigit() or word == "al" and before[-3:-1] == "et" or second and word in _SECOND:
        return ABBR
    if len(word) == 1 and word.isalpha() and word.lower() != word.upper():
        if "." in tail and word.isupper():
            return SOFT
        unit = before[-1:] in _SPACES and before[-2:-1].isdigit() and "." not in tail
        return PERIOD if unit else ABBR
    if len(word) <= 2 and word.isdigit() and word == tail and _LATER.match(text, i + 1):
        return ABBR
    return PERIOD


@cache
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane."""
    t = np.zeros(0x10000, np.uint8)
    by = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Lo": PLAIN, "Lm": PLAIN, "Zs": SPACE, "Mn": PLAIN, "Mc": PLAIN, "Nl": PLAIN, "Ps": OPEN, "Pe": CLOSE, "Pi": OPEN, "Pf": CLOSE, "Pd": PAUSE, "Cf": SPACE}
    for cp in range(0x10000):
        t[cp] = by.get(unicodedata.category(chr(cp)), OTHER)
    for group, k in ((".．", PERIOD), ("!?！？。｡।॥؟۔‼⁇⁈⁉", HARD), ("„‚¿¡", OPEN), (",;:،，、；：﹐", PAUSE), ("\t\r\v\f\x1c\x1d\x1e\x1f\x85\n  ", SPACE), ("と", QUOTING), ("…", DOTS), ("​⁠﻿", SPACE)):
        for ch in group:
            t[ord(ch)] = k
    return t


@cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a sentence has ended before this character), both by state and class."""
    step = np.full((12, 17), IN, np.uint8)
    ends = np.zeros((12, 17), bool)
    after_mark = {PERIOD: P, HARD: H, SOFT: A, DOTS: E}
    for s in range(12):
        for c, to in after_mark.items():
            step[s, c] = to
        step[s, BREAK] = step[s, RESET] = OUT
        ends[s, BREAK] = ends[s, RESET] = s != OUT
    step[OUT, SPACE] = OUT
    step[[E, ES], DOTS] = E
    step[H, PERIOD] = H  # "?." and the like
    for s, closed, spaced in ((P, PC, PS), (H, HC, HS), (A, A, AS), (E, E, ES), (PC, PC, PS), (HC, HC, HS), (PS, PC, PS), (HS, HC, HS), (AS, A, AS), (ES, E, ES)):
        step[s, CLOSE], step[s, SPACE] = closed, spaced
    starts = [UPPER, DIGIT, OPEN, PLAIN, OTHER, QUOTING, ABBR]
    for s, at in ((PS, starts), (HS, starts), (AS, [UPPER, DIGIT, OPEN, PLAIN]), (ES, [UPPER, OPEN]), (P, [UPPER, OPEN, ABBR]), (PC, [UPPER, OPEN, DIGIT, PLAIN]), (H, [UPPER, OPEN, PLAIN, DIGIT, QUOTING]), (HC, [UPPER, OPEN, PLAIN, DIGIT])):
        ends[s, at] = True
    return step, ends


def _wrap_breaks(text: str) -> list[int]:
    """Offsets of newlines that end a sentence: those next to an empty line, and those where the next word would have fitted on the line."""
    lines = text.split("\n")
    bare = [x.rstrip() for x in lines]
    width = max(map(len, bare))
    out, at = [], 0
    for i in range(len(lines) - 1):
        at += len(lines[i])
        a, b = bare[i], bare[i + 1].lstrip()
        if not a or not b:
            out.append(at)
        elif a[-1] not in "-\xad‐¬":
            gap = b.find(" ")
            if len(a) + 1 + (gap if gap >= 0 else len(b)) <= width - (len(bare[i + 1]) - len(b)) and not (len(lines) == 2 and width < 25):
                out.append(at)
        at += 1
    return out


def classify(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all characters with a RESET after each text, offset of each text)."""
    joined = _SEPARATOR.join(texts) + _SEPARATOR
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[np.minimum(cp, 0xFFFF)]
    cls[cp > 0xFFFF] = np.where((cp[cp > 0xFFFF] >= 0x20000) & (cp[cp > 0xFFFF] < 0x33480), PLAIN, OTHER)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    cls[offsets[1:] - 1] = RESET
    # Straight quotation marks open after a blank or an opener, else they close; marks inside words are letters.
    prev = np.concatenate(([RESET], cls[:-1])).astype(np.uint8)
    nxt = np.concatenate((cls[1:], [RESET])).astype(np.uint8)
    straight = (cp == 34) | (cp == 39) | (cp == 0xFF02)
    cls[straight] = np.where(np.isin(prev[straight], (SPACE, RESET, OPEN)), OPEN, CLOSE)
    curly = (cp == 0x201C) & np.isin(prev, (PERIOD, HARD, DOTS)) & np.isin(nxt, (SPACE, RESET, PERIOD, PAUSE))  # German closing mark
    cls[curly] = CLOSE
    word = (LOWER, UPPER, PLAIN)
    cls[((cp == 0x2019) | (cp == 39)) & np.isin(prev, word) & np.isin(nxt, word)] = LOWER
    # Rows of dots, also spaced ones, are an ellipsis; each other period is looked at with the word before it.
    dot = cp == 46
    near = np.flatnonzero(dot)
    gap = np.diff(near)
    run = (gap == 1) | ((gap == 2) & (cls[near[:-1] + 1] == SPACE)) if len(near) > 1 else np.zeros(0, bool)
    row = np.concatenate((run, [False])) | np.concatenate(([False], run)) if len(near) else np.zeros(0, bool)
    cls[near[row]] = DOTS
    cls[near[:-1][run] + 1] = DOTS
    single = near[~row]
    after = cp[np.minimum(single + 1, len(cp) - 1)]
    single = single[(after < 48) | (after > 57)]  # decimals need no look
    cls[single] = [_period(joined, i) for i in single.tolist()]
    # A small letter or two before a capital, as in pH, may begin a sentence.
    solid = np.maximum.accumulate(np.where(cls == SPACE, -1, np.arange(len(cls))))
    for size in (1, 2):
        m = len(cls) - size - 1
        at = np.flatnonzero((cls[:m] == SPACE) & (cls[1 : m + 1] == LOWER) & (cls[size : m + size] == LOWER) & (cls[size + 1 :] == UPPER))
        at = at[np.isin(cls[solid[at]], (PERIOD, HARD))]
        cls[at + 1] = UPPER
    for i, t in enumerate(texts):
        if "\n" in t:
            cls[np.asarray(_wrap_breaks(t), np.int64) + offsets[i]] = BREAK
    return cls, offsets


def run_transducer(cls: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Places before which a sentence has ended. Chunks are functions on states, composed by a prefix scan."""
    step, ends = transducer()
    n = len(cls)
    lanes = max(1, -(-n // chunk))
    grid = np.full(lanes * chunk, SPACE, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    flat = step.ravel()
    width = step.shape[1]
    f = np.tile(np.arange(step.shape[0], dtype=np.int64), (lanes, 1))
    for row in grid:
        f = flat[f * width + row[:, None]].astype(np.int64)
    # Inclusive scan: f[i] becomes the function of chunks 0..i.
    d = 1
    while d < lanes:
        f[d:] = np.take_along_axis(f[d:], f[:-d].copy(), 1)
        d *= 2
    state = np.concatenate(([OUT], f[:-1, OUT]))
    out = np.zeros((chunk, lanes), bool)
    end_flat = ends.ravel()
    for i, row in enumerate(grid):
        at = state * width + row
        out[i] = end_flat[at]
        state = flat[at].astype(np.int64)
    return np.flatnonzero(out.T.ravel()[:n])


def sentence_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of every sentence, in code points of its text."""
    if not texts:
        return (np.zeros(0, np.int64),) * 3
    cls, offsets = classify(texts)
    at = run_transducer(cls)
    blank = (cls == SPACE) | (cls == BREAK) | (cls == RESET)
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(cls))))
    end = last[at - 1] + 1
    doc = np.searchsorted(offsets, at - 1, "right") - 1
    before = np.concatenate(([0], end[:-1]))
    before = np.maximum(before, offsets[doc])
    content = np.flatnonzero(~blank)
    start = content[np.searchsorted(content, before)]
    return doc, start - offsets[doc], end - offsets[doc]


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, sent_no, start_pos, end_pos[, sentence]): one row for each sentence, counted from 1.

    Null, empty and blank texts have none; repeated rows come out each on its own; other columns are not used.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    key_type = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            doc, start, end = sentence_spans(texts)
            first = np.searchsorted(doc, doc, "left")
            cols = [batch.column("key").take(pa.array(doc)), pa.array(np.arange(len(doc)) - first + 1, pa.int32()), pa.array(start), pa.array(end)]
            names = ["key", "sent_no", "start_pos", "end_pos"]
            if with_text:
                cols.append(pa.array([texts[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
                names.append("sentence")
            yield pa.RecordBatch.from_arrays(cols, names)

    return base.mapInArrow(run, f"key {key_type}, sent_no int, start_pos long, end_pos long" + ", sentence string" * with_text)
