"""Problem 7: a language with a confidence for each document and each passage in another language.

Method: interpolated Kneser-Ney character models, one for each language, fitted on the labelled sentences; all n-grams
lie in sorted hash arrays with their log-probabilities in every language. A passage goes to the language of the lowest
length-normalised cross-entropy, or to none where even that is above the bound of that language, calibrated on held-out
sentences. A language whose samples are written in other scripts than a passage is no candidate for it.
Words are scored once per Python worker and looked up afterwards; a document's sentences are smoothed by a Viterbi pass
that makes each change of language cost something. Nothing is shuffled; the model is bounded by the sample's size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import HOMOGLYPHS
from corpusloom.runtime import pieces

ORDER = 4
FLOOR = -9.0
_WORD = re.compile(r"(?:[^\W\d_]|[\u0900-\u0903\u093a-\u094d\u0951-\u0957\u0962\u0963])+")  # letters with the marks of their script
_TERMINAL = re.compile(r"[.!?…。！？｡।॥][\"'”’»」』)）\]“]*$")
_LATIN = re.compile(r"[A-Za-z]")
_WIDE_STOP = re.compile(r"([。！？][」』”’）]*)")
_TO_LATIN = str.maketrans({k: v for k, v in HOMOGLYPHS.items() if len(v) == 1})
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_OF_LATIN = {v: k for k, v in reversed(HOMOGLYPHS.items()) if "а" <= k.lower() <= "я"}
_TO_CYRILLIC = str.maketrans(_OF_LATIN | {k: _OF_LATIN[v] for k, v in HOMOGLYPHS.items() if v in _OF_LATIN and not "\u0400" <= k <= "\u04ff"})
_ONLY_CYRILLIC = re.compile("[" + "".join(c for c in map(chr, range(0x410, 0x450)) if c not in HOMOGLYPHS) + "]")
_ONLY_LATIN = re.compile("[" + "".join(c for c in map(chr, (*range(65, 91), *range(97, 123))) if c not in _OF_LATIN) + "]")
# First code points of the blocks of a script; its number stands beside them (0: any other).
_BLOCKS = [(0x41, 1), (0x370, 2), (0x400, 3), (0x530, 0), (0x900, 4), (0x980, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3005, 6), (0x3008, 0), (0x3040, 5), (0x3100, 0), (0x3400, 6), (0xA000, 0), (0xAC00, 7), (0xD7B0, 0), (0xF900, 6), (0xFB00, 0), (0x20000, 6)]
SCRIPTS = 8
_UNSEEN = re.compile(r"[\xad​-‏⁠-⁤﻿]")


def letters(token: str) -> list[str]:
    """The runs of letters in a token, in small letters, look-alikes and width forms folded, marks kept as letters.

    A token of several scripts is folded into the script of the letters that have no look-alike."""
    if token.isascii():
        return _WORD.findall(token.lower())
    t = unicodedata.normalize("NFKC", _UNSEEN.sub("", token))
    if _CYRILLIC.search(t) and len(_ONLY_CYRILLIC.findall(t)) > len(_ONLY_LATIN.findall(t)):
        t = t.translate(_TO_CYRILLIC)
    elif _LATIN.search(t) or len(t) == 1:
        t = t.translate(_TO_LATIN)
    return _WORD.findall(t.lower())


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a code point matrix."""
    h = np.full(len(codes), 0xCBF29CE484222325, np.uint64)
    for column in codes.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


def script_counts(words: list[str]) -> np.ndarray:
    """Letters of each word in each script."""
    size = np.asarray([len(w) for w in words], np.int64)
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    block = np.searchsorted([a for a, _ in _BLOCKS], cp, "right") - 1
    script = np.asarray([k for _, k in _BLOCKS])[block]
    return np.bincount(np.repeat(np.arange(len(words)), size) * SCRIPTS + script, minlength=len(words) * SCRIPTS).reshape(len(words), SCRIPTS)


@dataclass
class KneserNey:
    """log-probabilities of all n-grams in all languages, by sorted hash arrays; grams[k] and histories[k] are of length k."""

    langs: list[str]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    histories: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    scale: float = 1.0
    written: np.ndarray | None = None

    @classmethod
    def fit(cls, sentences: dict[str, list[str]], discount: float = 0.75, folds: int = 5, least_script: float = 0.05) -> KneserNey:
        """Interpolated Kneser-Ney of order 4 within words. Bounds and scale are calibrated on every sentence, each scored by
        the models of the other folds; a language is written in the scripts of at least `least_script` of its letters."""
        langs = sorted(sentences)
        held: dict[str, list[tuple[np.ndarray, int]]] = {x: [] for x in langs}
        for fold in range(folds):
            part = {x: [s for i, s in enumerate(sentences[x]) if i % folds != fold] or sentences[x] for x in langs}
            model = cls._count(langs, part, discount)
            for x in langs:
                held[x] += [model.score_sentence(s) for i, s in enumerate(sentences[x]) if i % folds == fold]
        full = cls._count(langs, sentences, discount)
        counts = np.stack([script_counts([w for s in sentences[x] for t in s.split() for w in letters(t)]).sum(0) for x in langs])
        full.written = counts >= least_script * np.maximum(counts.sum(1, keepdims=True), 1)
        full._calibrate(held)
        return full

    @classmethod
    def _count(cls, langs: list[str], sentences: dict[str, list[str]], discount: float) -> KneserNey:
        probs: list[list[dict[str, float]]] = []
        backs: list[list[dict[str, float]]] = []
        for x in langs:
            counts: list[Counter] = [Counter() for _ in range(ORDER + 1)]
            for s in sentences[x]:
                for token in s.split():
                    for w in letters(token):
                        w = f"\x02{w}\x03"
                        for k in range(1, ORDER + 1):
                            counts[k].update(w[i : i + k] for i in range(len(w) - k + 1))
            # Below the highest order, counts of the different signs that precede; n-grams at a word's start keep their own.
            kn = [Counter() for _ in range(ORDER + 1)]
            kn[ORDER] = counts[ORDER]
            for k in range(1, ORDER):
                kn[k].update(g[1:] for g in counts[k + 1])
                kn[k].update({g: n for g, n in counts[k].items() if g[0] == "\x02" and k > 1})
            p: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
            b: list[dict[str, float]] = [{} for _ in range(ORDER)]
            base = np.exp(FLOOR)
            for k in range(1, ORDER + 1):
                total: dict[str, float] = defaultdict(float)
                kinds: dict[str, int] = defaultdict(int)
                for g, n in kn[k].items():
                    if not (k == 1 and g == "\x02"):
                        total[g[:-1]] += n
                        kinds[g[:-1]] += 1
                for h in total:
                    b[k - 1][h] = discount * kinds[h] / total[h]
                for g, n in kn[k].items():
                    if k == 1 and g == "\x02":
                        continue
                    low = base if k == 1 else p[k - 1].get(g[1:], b[0].get("", 1.0) * base)
                    p[k][g] = max(n - discount, 0) / total[g[:-1]] + b[k - 1][g[:-1]] * low
            probs.append(p)
            backs.append(b)
        self = cls(langs)
        codes = lambda gs: np.asarray([[ord(c) for c in g] for g in gs], np.int64).reshape(len(gs), -1)
        full: dict[str, np.ndarray] = {}
        start = np.asarray([np.log(b[0].get("", 1.0)) + FLOOR for b in backs])
        for k in range(1, ORDER + 1):
            gs = sorted(set().union(*(p[k] for p in probs)))
            hs = sorted(set().union(*(b[k - 1] for b in backs)))
            for g in gs:
                low = full.get(g[1:], start) if k > 1 else start
                full[g] = np.asarray([np.log(p[k][g]) if g in p[k] else (np.log(b[k - 1].get(g[:-1], 1.0)) if k > 1 else 0.0) + low[i] for i, (p, b) in enumerate(zip(probs, backs, strict=True))])
            for store, values, names, table in ((self.grams, self.logp, gs, [full[g] for g in gs]), (self.histories, self.back, hs, [[np.log(b[k - 1].get(h, 1.0)) for b in backs] for h in hs])):
                n = k if store is self.grams else k - 1
                h = _hash(codes(names))
                order = np.argsort(h)
                store[n], values[n] = h[order], np.asarray(table, np.float32)[order]
        self.floor = start.astype(np.float32)
        return self

    def score_words(self, words: list[str]) -> np.ndarray:
        """Total log-probability of each word, its end included, in each language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not words:
            return out
        text = "".join(f"\x02{w}\x03" for w in words)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.asarray([len(w) + 2 for w in words])
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(cp))
        inner = at - first[owner]
        todo = at[inner > 0]
        logp = np.zeros((len(cp), len(self.langs)), np.float32)
        carried = np.zeros_like(logp)
        for k in range(ORDER, 0, -1):
            ready = todo[inner[todo] >= k - 1]
            if not len(ready):
                continue
            window = np.stack([cp[ready - k + 1 + i] for i in range(k)], 1)
            h = _hash(window)
            j = np.minimum(np.searchsorted(self.grams[k], h), len(self.grams[k]) - 1)
            hit = self.grams[k][j] == h
            logp[ready[hit]] = carried[ready[hit]] + self.logp[k][j[hit]]
            miss = ready[~hit]
            if k > 1 and len(miss):
                h = _hash(window[~hit, :-1])
                j = np.minimum(np.searchsorted(self.histories[k - 1], h), len(self.histories[k - 1]) - 1)
                seen = self.histories[k - 1][j] == h
                carried[miss[seen]] += self.back[k - 1][j[seen]]
            elif k == 1:
                logp[miss] = carried[miss] + self.floor
            done = np.zeros(len(cp), bool)
            done[ready[hit]] = True
            todo = todo[~done[todo]]
        np.add.at(out, owner[inner > 0], logp[inner > 0])
        return out

    def score_sentence(self, text: str) -> tuple[np.ndarray, int]:
        words = [w for t in text.split() for w in letters(t)]
        return self.score_words(words).sum(0), sum(len(w) + 1 for w in words)

    def _calibrate(self, held: dict[str, list[tuple[np.ndarray, int]]], prior: float = 20.0) -> None:
        """mean, spread: what held-out sentences of each language reach a letter, and the deviation of one letter (of a
        passage of m letters it is the m-th root's part); few sentences lean on the pooled spread. scale: of the confidence."""
        n = len(self.langs)
        self.mean = np.full(n, -3.0)
        squares, count, margins = np.zeros(n), np.zeros(n), []
        for i, x in enumerate(self.langs):
            scored = [(s / m, m) for s, m in held[x] if m >= 8]
            if scored:
                own, size = np.asarray([s[i] for s, _ in scored]), np.asarray([m for _, m in scored])
                self.mean[i] = own.mean()
                squares[i], count[i] = ((own - own.mean()) ** 2 * size).sum(), len(own)
                margins += [(s[i] - np.max(np.delete(s, i))) if n > 1 else 1.0 for s, _ in scored]
        pooled = squares.sum() / count.sum() if count.sum() else 6.25
        self.spread = np.sqrt((squares + prior * pooled) / (count + prior))
        low = np.percentile(margins, 5) if margins else 0.1
        self.scale = float(np.clip(4.6 / max(low, 0.05), 2.0, 40.0))  # 0.99 at the fifth percentile of the held-out margins

    def bound(self, lang: np.ndarray, size: np.ndarray, least: float = 1.0, z: float = 4.0) -> np.ndarray:
        """The mean log-probability a letter that passages of the given languages and sizes must reach: z deviations below held-out sentences, `least` at least."""
        return self.mean[lang] - np.maximum(least, z * self.spread[lang] / np.sqrt(np.maximum(size, 1)))

    def temper(self, scores: np.ndarray, scripts: np.ndarray, each: float = -4.0) -> np.ndarray:
        """Word scores, those of words in scripts that a language isn't written in no lower than `each` a letter: a few foreign words don't make a sentence unreadable."""
        size = scripts.sum(1, keepdims=True)
        return np.where(2 * (scripts @ (~self.written).T.astype(np.int64)) > size, np.maximum(scores, each * (size + 1)), scores).astype(np.float32)

    def candidates(self, loglik: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """loglik, lowered beyond any rival where more than half of the letters stand in scripts that a language isn't written in."""
        letters_ = scripts.sum(1, keepdims=True)
        foreign = scripts @ (~self.written).T.astype(np.int64)
        return loglik + np.where(2 * foreign > letters_, letters_ * 2 * FLOOR, 0).astype(np.float32)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        """Calibrated probability of each language from the mean log-probabilities a letter."""
        z = np.exp((mean - mean.max(1, keepdims=True)) * self.scale)
        return z / z.sum(1, keepdims=True)

    def assign(self, loglik: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, its confidence) of passages with the given totals; -1 has the best language's."""
        mean = loglik / np.maximum(size, 1)[:, None]
        best = np.argmax(mean, 1)
        rejected = (mean[np.arange(len(best)), best] < self.bound(best, size)) | (size == 0)
        return np.where(rejected, -1, best), np.where(size == 0, 0.0, self.probability(mean).max(1))


def fit_from(samples: DataFrame, lang: str = "lang", text: str = "text", bound: int = 20_000) -> KneserNey:
    """Models from labelled sentences; at most `bound` of them, the first by digest of the text."""
    s = samples.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = s.distinct().orderBy(F.md5("text"), "lang", "text").limit(bound).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r.text)
    return KneserNey.fit(dict(by) or {"und": ["und"]})  # without samples there is one language, which means none


class Words:
    """Scores of the tokens met so far in a Python worker, with what else is asked of a token."""

    LIMIT = 400_000

    def __init__(self, model: KneserNey):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.score = np.zeros((1024, len(self.model.langs)), np.float32)
        self.size = np.zeros(1024, np.int32)
        self.stop = np.zeros(1024, bool)
        self.length = np.zeros(1024, np.int32)
        self.script = np.zeros((1024, SCRIPTS), np.int32)

    def find(self, tokens: list[str]) -> np.ndarray:
        """Index of every token in the arrays of this table."""
        if len(self.at) > self.LIMIT:
            self._clear()
        at = self.at
        new = [t for t in dict.fromkeys(tokens) if t not in at]
        if new:
            base = len(at)
            at.update(zip(new, range(base, base + len(new)), strict=True))
            need = base + len(new)
            if need > len(self.size):
                grow = max(need, 2 * len(self.size))
                self.score, self.script = (np.concatenate((a, np.zeros((grow - len(a), a.shape[1]), a.dtype))) for a in (self.score, self.script))
                self.size, self.stop, self.length = (np.concatenate((a, np.zeros(grow - len(a), a.dtype))) for a in (self.size, self.stop, self.length))
            parts = [letters(t) for t in new]
            distinct = list(dict.fromkeys(w for p in parts for w in p))
            known = dict(zip(distinct, range(len(distinct)), strict=True))
            scripts = script_counts(distinct)
            scores = self.model.temper(self.model.score_words(distinct), scripts)
            owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
            flat = np.asarray([known[w] for p in parts for w in p], np.int64)
            add = np.zeros((len(new), scores.shape[1]), np.float32)
            np.add.at(add, owner, scores[flat])
            self.score[base:need] = add
            in_script = np.zeros((len(new), SCRIPTS), np.int32)
            np.add.at(in_script, owner, scripts[flat])
            self.script[base:need] = in_script
            self.size[base:need] = [sum(map(len, p)) + len(p) for p in parts]
            self.stop[base:need] = [len(t) > 2 and bool(_TERMINAL.search(t)) for t in new]
            self.length[base:need] = [len(t) for t in new]
        return np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] for each pair."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)))
    return total[last] - total[first]


@dataclass
class Passages:
    """Sentences (or lines) of a batch of texts: text, place, scores, letters with and without word ends, language (-1: none)."""

    doc: np.ndarray
    first_token: np.ndarray
    last_token: np.ndarray
    loglik: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    lang: np.ndarray
    letters: np.ndarray


def _tokens(line: str) -> list[str]:
    return (_WIDE_STOP.sub(r"\1 ", line) if "。" in line or "？" in line else line).split()


def passages(lines: list[str], line_doc: np.ndarray, words: Words, switch: float = 8.0) -> tuple[Passages, np.ndarray, np.ndarray]:
    """(passages, token indices, number of tokens of each line) of the lines of a batch, documents in order."""
    split = [_tokens(x) for x in lines]
    tokens = [t for x in split for t in x]
    count = np.asarray([len(x) for x in split], np.int64)
    index = words.find(tokens)
    first = np.cumsum(count) - count
    start = np.zeros(len(tokens) + 1, bool)
    start[first] = True
    if len(tokens):
        start[1:][words.stop[index]] = True
    begin = np.flatnonzero(start[: len(tokens)])
    end = np.append(begin[1:], len(tokens)) if len(begin) else begin
    token_doc = np.repeat(line_doc, count)
    doc = token_doc[begin]
    scripts = _sums(words.script[index], begin, end).astype(np.int64)
    loglik = words.model.candidates(_sums(words.score[index], begin, end).astype(np.float32), scripts)
    size = _sums(words.size[index], begin, end).astype(np.int64)
    chars = _sums(words.length[index] + 1, begin, end).astype(np.int64)
    found = Passages(doc, begin, end, loglik, size, chars, np.full(len(begin), -1), scripts.sum(1))
    found.lang = _smooth(found, words.model, switch)
    return found, index, count


def _smooth(p: Passages, model: KneserNey, switch: float) -> np.ndarray:
    """Viterbi over each document's passages. Languages compete by log-probability alone; the last state is 'none', at the
    calibrated bound of the passage's best language. All documents step together."""
    n = len(model.langs)
    if not len(p.doc):
        return p.lang
    gain = np.concatenate((p.loglik, (p.size * model.bound(np.argmax(p.loglik, 1), p.size))[:, None]), 1)
    docs, first, count = np.unique(p.doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    best = np.zeros((len(docs), n + 1))
    origin = np.zeros((len(p.doc), n + 1), np.int8)
    alive = len(docs)
    for step in range(int(count[0])):
        while alive and count[alive - 1] <= step:
            alive -= 1
        rows = first[:alive] + step
        b = best[:alive]
        top = np.argmax(b, 1)
        level = b[np.arange(alive), top] - switch
        stay = b >= level[:, None]
        origin[rows] = np.where(stay, np.arange(n + 1), top[:, None])
        best[:alive] = np.where(stay, b, level[:, None]) + gain[rows]
    out = np.empty(len(p.doc), np.int64)
    state = np.argmax(best, 1)
    for step in range(int(count[0]) - 1, -1, -1):
        while alive < len(docs) and count[alive] > step:
            alive += 1
        rows = first[:alive] + step
        out[rows] = state[:alive]
        state[:alive] = origin[rows, state[:alive]]
    return np.where(out == n, -1, out)


# Names and three-letter codes of languages, and labels that say nothing.
NAMES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it", "russian": "ru", "chinese": "zh", "japanese": "ja", "hindi": "hi",
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "rus": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "hin": "hi",
    "deutsch": "de", "français": "fr", "español": "es", "português": "pt", "italiano": "it", "русский": "ru", "中文": "zh", "日本語": "ja", "हिन्दी": "hi",
}
PLACEHOLDERS = ("und", "unknown", "zxx", "mul", "mis", "none", "null", "n/a", "na", "xx", "other", "-", "?")


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null for null, blank and placeholder labels."""
    plain = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    short = F.regexp_replace(plain, r"[-_].*$", "")
    return F.when((plain == "") | plain.isin(*PLACEHOLDERS), None).otherwise(F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, short), short))


def document_languages(df: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, share, confidence, chars): one row for each language found in a text, lang null for the part without one.

    share is of all the text's characters. Null and blank texts give one row with lang null, share 1, confidence 0.
    Repeated rows come out each on its own; other columns are not used.
    """
    from corpusloom.llm.quality import nonprose_lines

    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = base.schema["key"].dataType.simpleString()
    sent = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        n = len(words.model.langs)
        names = np.asarray([*words.model.langs, None], object)
        for batch in pieces(batches, "text", 2_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            per = [t.split("\n") for t in texts]
            lines = [x for t in per for x in t]
            line_doc = np.repeat(np.arange(len(texts)), [len(t) for t in per])
            p, _, count = passages(lines, line_doc, words)
            other = nonprose_lines(lines, line_doc, p, count) > 0
            token_line = np.repeat(np.arange(len(lines)), count)
            lang = np.where(other[token_line[p.first_token]], -1, p.lang) if len(p.lang) else p.lang
            cell = p.doc * (n + 1) + np.where(lang < 0, n, lang)
            chars = np.bincount(cell, p.chars, len(texts) * (n + 1)).reshape(len(texts), n + 1)
            size = np.bincount(cell, p.size, len(texts) * (n + 1)).reshape(len(texts), n + 1)
            loglik = np.zeros((len(texts) * (n + 1), n))
            np.add.at(loglik, cell, p.loglik)
            conf = words.model.probability(loglik / np.maximum(size.ravel(), 1)[:, None]).reshape(len(texts), n + 1, n)
            empty = chars.sum(1) == 0
            chars[empty, n] = 1
            d, k = np.nonzero(chars)
            total = chars.sum(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(d)),
                    pa.array(names[k].tolist(), pa.string()),
                    pa.array(chars[d, k] / total[d]),
                    pa.array(np.where(k == n, 0.0, conf[d, k, np.minimum(k, n - 1)])),  # the row's own language
                    pa.array(np.where(empty[d], 0, chars[d, k]).astype(np.int64)),
                    pa.array([bool(x) for x in empty[d]]),
                    pa.array(np.bincount(line_doc, _line_chars(lines) * other, len(texts))[d] / np.maximum(np.bincount(line_doc, _line_chars(lines), len(texts)), 1)[d]),
                ],
                ["key", "lang", "share", "confidence", "chars", "blank", "nonprose"],
            )

    return base.mapInArrow(run, f"key {key_type}, lang string, share double, confidence double, chars long, blank boolean, nonprose double")


def language_passages(df: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos, lang, confidence): each run of sentences of one language, text[start_pos:end_pos] in code points.

    The runs of a text follow each other and hold all its words; lang is null, confidence 0 for those in no language. Null
    and blank texts have no row; repeated rows come out each on its own.
    """
    from corpusloom.llm.quality import nonprose_lines

    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = base.schema["key"].dataType.simpleString()
    sent = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        n = len(words.model.langs)
        names = np.asarray([*words.model.langs, None], object)
        for batch in pieces(batches, "text", 2_000_000):
            per = [(t or "").split("\n") for t in batch.column("text").to_pylist()]
            lines = [x for t in per for x in t]
            line_doc = np.repeat(np.arange(len(per)), [len(t) for t in per])
            p, _, count = passages(lines, line_doc, words)
            if not len(p.doc):
                continue
            starts, ends = _places(per)
            token_line = np.repeat(np.arange(len(lines)), count)
            other = nonprose_lines(lines, line_doc, p, count) > 0
            lang = np.where(other[token_line[p.first_token]] | (p.lang < 0), n, p.lang)
            first = np.flatnonzero(np.append(True, (p.doc[1:] != p.doc[:-1]) | (lang[1:] != lang[:-1])))
            last = np.append(first[1:], len(lang))
            own = lang[first]
            mean = _sums(p.loglik, first, last) / np.maximum(_sums(p.size, first, last), 1)[:, None]
            conf = np.where(own == n, 0.0, words.model.probability(mean)[np.arange(len(own)), np.minimum(own, n - 1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(p.doc[first])), pa.array(starts[p.first_token[first]]), pa.array(ends[p.last_token[last - 1] - 1]), pa.array(names[own].tolist(), pa.string()), pa.array(conf)],
                ["key", "start_pos", "end_pos", "lang", "confidence"],
            )

    return base.mapInArrow(run, f"key {key_type}, start_pos long, end_pos long, lang string, confidence double")


def _places(per: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each token of the texts, given as their lines, begins and ends in its text."""
    starts: list[int] = []
    ends: list[int] = []
    for lines in per:
        base = 0
        for x in lines:
            at = 0
            for t in _tokens(x):
                at = x.index(t, at)
                starts.append(base + at)
                at += len(t)
                ends.append(base + at)
            base += len(x) + 1
    return np.asarray(starts, np.int64), np.asarray(ends, np.int64)


def _line_chars(lines: list[str]) -> np.ndarray:
    return np.asarray([len(x.strip()) for x in lines], np.int64)


def relabel(df: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.2) -> DataFrame:
    """(key, lang, share, confidence, label_code): languages of at least `least` of the text, for prose whose label is
    missing, a placeholder or not its language, or that has several such languages."""
    from corpusloom.runtime import cut

    labels = df.select(F.col(f"`{key}`").alias("key"), label_code(F.col(f"`{label}`")).alias("label_code")).dropDuplicates(["key"])
    found = document_languages(df, model, key, text).filter(f"NOT blank AND nonprose <= 0.5 AND lang IS NOT NULL AND share >= {least}").dropDuplicates(["key", "lang"])
    rows = cut(found.join(labels, "key"), "languages")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(several, "key").filter("n > 1 OR label_code IS NULL OR label_code <> lang").select("key", "lang", "share", "confidence", "label_code")
