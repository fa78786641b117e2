"""Problem 3: statistics of each text that tell natural prose from tables, lists and junk.

Method: a text falls into segments, runs of filled lines of one shape; each has a vector of statistics. Mean and
covariance of prose are fitted for each language over the segments of all documents (median and MAD first, then
concentration steps that keep what lies within the cutoff), and a segment's squared Mahalanobis distance splits into one
contribution for each statistic. The distance decides which segments are no prose, the contributions decide their kind;
a document is a table, a list or junk if such segments hold over half of its characters. Its own statistics, distance
and contributions are the means of its segments', weighted by their characters.

Texts are read once; what is kept is one vector of K numbers for each segment, pre-aggregated into moments for each
language and partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.languages import KneserNey, Passages, Words, passages
from corpusloom.runtime import cut, pieces

PROSE, TABLE, LIST, JUNK = range(4)
KINDS = ("table", "list", "junk")
STATISTICS = ("log_words", "word_length", "symbol_share", "digit_share", "upper_share", "terminal_share", "common_share", "log_line", "entry_start_share", "line_spread", "row_share", "entry_share", "unread_share", "fit", "letter_share")
#: The least deviation of each statistic, so that one that prose never varies in still counts.
FLOOR = (0.8, 0.5, 0.02, 0.03, 0.03, 0.3, 0.08, 0.8, 0.25, 0.25, 0.05, 0.05, 0.05, 0.25, 0.05)
#: The statistics whose contributions speak for a table, a list, junk.
SPEAK = ((10,), (11,), (12, 13))

_ENTRY = re.compile(r"\s*(?:\[\d{1,4}\]|\(?\d{1,3}[).]|\(?[a-z]\)|(?:\d+\.)+\d+\.?|[-–—•*·▪◦‣+o])\s+\S")
_LEADER = re.compile(r"(?:\.{4,}|…{2,}|(?:\. ){3,}|·{4,})\s*(?:\d+|[ivxlc]+)\s*$")
_INDEX = re.compile(r"\D{2,80}?(?:[,;]\s*\d{1,4}(?:[-–]\d{1,4})?)+$")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_COMMA = re.compile(r",(?=\S|$)")
_END = re.compile(r"[.!?…。！？｡।॥:][\"'”’»」』)）\]“]*$")
_STOP = re.compile(r"[.!?…。！？｡।॥:,;\-\xad‐¬，、][\"'”’」』)）\]“]*$")
_DIGITS = re.compile(r"\d+")
_CID = re.compile(r"\(cid:\d+\)")


def _fields(line: str) -> tuple[str, int]:
    """(separator, fields) of a line that may be a row of a table; bars at the ends separate nothing."""
    for sep in "|\t;":
        if sep in line:
            return sep, (line.strip(" ").strip("|") if sep == "|" else line).count(sep) + 1
    if "  " in line and (n := len(_GAP.findall(line.strip(" ")))) >= 2:
        return " ", n + 1
    if line.count(",") >= 2 and (n := len(_COMMA.findall(line))) >= 2:
        return ",", n + 1
    return "", 0


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, length) of each run; same[i] says that row i + 1 goes on the run of row i."""
    first = np.flatnonzero(np.append(True, ~same)) if len(same) + 1 else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(same) + 1))


def nonprose_lines(lines: list[str], line_doc: np.ndarray, p: Passages, count: np.ndarray) -> np.ndarray:
    """PROSE, TABLE, LIST or JUNK for each line, by its shape and that of the lines around it, empty ones aside.

    Rows: the same separator in lines that follow each other, three fields or more of at most 3.5 words. Where the fields
    of a run vary in number (key words in wrapped lines), they are entries. Entries: marked ones (numbers, bullets, leaders,
    page numbers at the end), three or more together; or four or more short lines (at most 8 words, 80 signs) without
    a sentence's end, whose lengths vary or of which most would have had room for the next word. Junk: what no language explains, hardly any
    letters, bare glyph numbers.
    """
    kind = np.zeros(len(lines), np.int8)
    size = np.asarray([len(x.strip()) for x in lines], np.int64)
    solid = np.flatnonzero(size)
    if not len(solid):
        return kind
    doc = line_doc[solid]
    one_doc = doc[1:] == doc[:-1]
    found = [_fields(lines[j]) for j in solid.tolist()]
    sep = np.asarray([ord(s) if s else 0 for s, _ in found], np.int64)
    fields = np.asarray([n for _, n in found], np.int64)
    words_per = count[solid] / np.maximum(fields, 1)
    row = (sep > 0) & (words_per <= np.where(sep == 44, 2.2, 3.5))
    first, length = _runs(one_doc & (sep[1:] == sep[:-1]) & row[1:] & row[:-1])
    for a, n in zip(first[(length >= 2) & row[first]].tolist(), length[(length >= 2) & row[first]].tolist()):
        part = fields[a : a + n]
        varied = sep[a] in (59, 44) and n >= 3 and np.bincount(part).max() < 0.6 * n and sum(map(len, _DIGITS.findall(" ".join(lines[j] for j in solid[a : a + n].tolist())))) < 0.1 * size[solid[a : a + n]].sum()
        if varied or 2 * (part >= 3).sum() >= n:
            kind[solid[a : a + n]] = LIST if varied else TABLE
    # Entries.
    marked = np.zeros(len(solid), bool)
    short = np.zeros(len(solid), bool)
    for i, j in enumerate(solid.tolist()):
        if kind[j]:
            continue
        x, n = lines[j], size[j]
        s = x.strip()
        marked[i] = bool(("..." in s or ". . ." in s or "……" in s or "····" in s) and _LEADER.search(s) or s[-1].isdigit() and _INDEX.match(s) or _ENTRY.match(x) and (n < 130 and not _END.search(s) or s[0] == "["))
        short[i] = n <= 80 and count[j] <= 8 and not s[0].islower() and not _STOP.search(s)
    entry = marked | short
    first, length = _runs(one_doc & (entry[1:] == entry[:-1]))
    width = np.asarray([len(lines[j].split(None, 1)[0]) for j in solid.tolist()], np.int64)
    for a, n in zip(first[entry[first] & (length >= 3)].tolist(), length[entry[first] & (length >= 3)].tolist()):
        own = size[solid[a : a + n]]
        room = own[:-1] + 1 + width[a + 1 : a + n] <= own.max()
        if 2 * marked[a : a + n].sum() >= n or n >= 4 and (room.mean() >= 0.5 or own[:-1].std() > 0.2 * own[:-1].mean()):
            kind[solid[a : a + n]] = LIST
    # Junk.
    token_line = np.repeat(np.arange(len(lines)), count)
    unread, letters = np.zeros(len(lines)), np.zeros(len(lines))
    if len(p.doc):
        line_of = token_line[p.first_token]
        np.add.at(unread, line_of, np.where((p.lang < 0) & (p.size > 0), p.chars, 0))
        np.add.at(letters, line_of, p.letters)
    few = (letters < 0.3 * size) & (size >= 12)
    cid = np.zeros(len(lines), bool)
    for j in np.flatnonzero((size >= 6) & (letters < 0.75 * size)).tolist():
        cid[j] = "(cid:" in lines[j] and sum(map(len, _CID.findall(lines[j]))) > 0.4 * size[j]
    kind[(kind == 0) & (size > 0) & ((unread > 0.5 * size) | few)] = JUNK
    kind[cid] = JUNK
    # Unmarked entries of which nothing is readable are junk too, where a text has hardly any others.
    by = lambda which: np.bincount(line_doc[which], size[which], line_doc[-1] + 1)
    listed = kind == LIST
    mark_line = np.zeros(len(lines), bool)
    mark_line[solid[marked]] = True
    dead = listed & ~mark_line & (letters >= 0.4 * size) & (unread > 0.9 * size)
    kind[dead & (by(dead) > 0.97 * np.maximum(by(listed), 1))[line_doc]] = JUNK
    return kind


def _segments(kind: np.ndarray, size: np.ndarray, line_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each line or -1 for an empty one, document of each segment): filled lines of one document and kind that follow each other."""
    solid = np.flatnonzero(size)
    if not len(solid):
        return np.full(len(size), -1), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(solid) > 1) | (kind[solid[1:]] != kind[solid[:-1]]) | (line_doc[solid[1:]] != line_doc[solid[:-1]]))
    segment = np.full(len(size), -1)
    segment[solid] = np.cumsum(new) - 1
    return segment, line_doc[solid[new]]


def _vectors(lines: list[str], line_doc: np.ndarray, words: Words, flags: dict, common: frozenset, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of each segment, its document, its characters, main language of each document) of a batch of texts as lines."""
    model = words.model
    p, index, count = passages(lines, line_doc, words)
    kind = nonprose_lines(lines, line_doc, p, count)
    bare = [x.strip() for x in lines]
    size = np.asarray([len(x) for x in bare], np.int64)
    segment, owner = _segments(kind, size, line_doc)
    n = len(owner)
    full = segment >= 0
    seg = segment[full]
    by = lambda w: np.bincount(seg, w[full], n)
    chars, solid = by(size), np.bincount(seg, minlength=n)
    cp = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum(size)))
    ascii_ = cp < 128
    letter = ascii_ & ((cp | 32) >= 97) & ((cp | 32) <= 122) | (cp >= 0xC0) & (cp < 0x2000) | (cp >= 0x2100) & (cp < 0x2190) | (cp >= 0x2C00) & ((cp < 0x3000) | (cp >= 0x3040))
    digit = (cp >= 48) & (cp <= 57)
    space = (cp <= 32) | (cp == 0xA0) | (cp == 0x3000)
    of = lambda m: by(np.diff(np.concatenate(([0], np.cumsum(m)))[at]))
    visible = np.maximum(of(~space), 1)
    token_seg = np.repeat(segment, count)
    tokens = np.bincount(token_seg, minlength=n)
    hit = _flags(words, flags, common)[index] if len(index) else np.zeros(0)
    languages = np.zeros((docs, len(model.langs)))
    good = p.lang >= 0
    np.add.at(languages, (p.doc[good], p.lang[good]), p.chars[good])
    main = np.where(languages.sum(1) > 0, np.argmax(languages, 1), len(model.langs))
    own = token_seg[p.first_token]
    # How well a segment's letters fit the best language of each of its passages.
    best = np.argmax(p.loglik, 1) if len(p.doc) else np.zeros(0, np.int64)
    gain = p.loglik[np.arange(len(best)), best] - p.size * model.mean[best] if len(best) else np.zeros(0)
    fit = np.bincount(own, gain, n) / np.maximum(np.bincount(own, p.size, n), 1)
    # Rows and entries are what their shape says, whatever their words are.
    shaped = np.isin(np.repeat(kind, count)[p.first_token], (TABLE, LIST))
    unread = np.bincount(own, np.where((p.lang < 0) & (p.size > 0) & ~shaped, p.chars, 0), n) / np.maximum(np.bincount(own, p.chars, n), 1)
    ends = np.asarray([bool(x) and bool(_END.search(x[-6:])) for x in bare], float)
    starts = np.asarray([bool(x) and not x[0].islower() for x in bare], float)
    mean = chars / np.maximum(solid, 1)
    spread = np.sqrt(np.maximum(by(size.astype(float) ** 2) / np.maximum(solid, 1) - mean**2, 0)) / np.maximum(mean, 1)
    share = lambda k: by(np.where(kind == k, size, 0)) / np.maximum(chars, 1)
    digits = of(digit) / visible
    stats = np.stack(
        [
            np.log1p(tokens), np.log1p(np.bincount(token_seg, words.length[index], n) / np.maximum(tokens, 1)), of(~letter & ~digit & ~space) / visible, digits, of((cp >= 65) & (cp <= 90)) / visible,
            by(ends) / np.maximum(solid, 1), np.bincount(token_seg, hit, n) / np.maximum(tokens, 1), np.log1p(mean), by(starts) / np.maximum(solid, 1), spread, share(TABLE), share(LIST), np.maximum(share(JUNK), unread), np.clip(fit, -4, 4), of(letter) / visible,
        ],
        1,
    )
    return stats, owner, chars.astype(np.int64), main


def statistics(df: DataFrame, model: KneserNey, common: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, blank, stats ARRAY<DOUBLE>, chars ARRAY<INT>, segments ARRAY<FLOAT>) of each row, computed on the whole text.

    stats: the statistics named in STATISTICS, segments' means weighted by characters; chars: the characters of each
    segment; segments: the statistics of all segments, one after the other. common: the most frequent words of each
    language, see common_words. Null, empty and blank texts have zeros, no segments and blank = true.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = base.schema["key"].dataType.simpleString()
    sent = base.sparkSession.sparkContext.broadcast((model, common))
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = sent.value
        words = Words(model)
        every = frozenset(w for ws in common.values() for w in ws)
        names = np.asarray([*model.langs, "other"], object)
        flags: dict[str, bool] = {}
        for batch in pieces(batches, "text", 2_000_000):
            per = [(t or "").split("\n") for t in batch.column("text").to_pylist()]
            n = len(per)
            line_doc = np.repeat(np.arange(n), [len(t) for t in per])
            stats, owner, chars, main = _vectors([x for t in per for x in t], line_doc, words, flags, every, n)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
            whole = weighted(stats, owner, chars, n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(names[main].tolist(), pa.string()), pa.array(offsets[1:] == offsets[:-1]), pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(whole.ravel())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(chars.astype(np.int32))), pa.ListArray.from_arrays(pa.array(offsets * k, pa.int32()), pa.array(stats.astype(np.float32).ravel())),
                ],
                ["key", "lang", "blank", "stats", "chars", "segments"],
            )

    return base.mapInArrow(run, f"key {key_type}, lang string, blank boolean, stats array<double>, chars array<int>, segments array<float>")


def weighted(x: np.ndarray, owner: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Means of the rows of x over their n owners, weighted by characters; 0 without any."""
    total = np.maximum(np.bincount(owner, chars, n), 1)
    return np.stack([np.bincount(owner, column * chars, n) for column in x.T], 1) / total[:, None]


def _flags(words: Words, flags: dict[str, bool], common: frozenset) -> np.ndarray:
    """For each token of the table, whether it is a common word."""
    kept = flags.get("array")
    if kept is None or flags["table"] is not words.at or len(kept) < len(words.at):
        start = 0 if kept is None or flags["table"] is not words.at else len(kept)
        names = list(words.at)[start:] if start else list(words.at)
        new = np.asarray([t.strip(".,;:!?()[]\"'«»“”„").lower() in common for t in names], bool)
        flags["array"] = new if not start else np.concatenate((kept, new))
        flags["table"] = words.at
    return flags["array"]


def common_words(samples: DataFrame, each: int = 60) -> dict[str, list[str]]:
    """The `each` most frequent words of each language in the labelled sentences, ties by the word."""
    words = samples.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.explode(F.split(F.lower("text"), r"[\s\p{Punct}]+")).alias("word")).filter("word <> '' AND NOT word RLIKE '[0-9]'")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, each).alias("top"))
    return {r.lang: [x.word for x in r.top] for r in top.collect()}


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, row of the batch, characters) of all segments of a batch."""
    chars = batch.column("chars")
    x = np.asarray(batch.column("segments").flatten(), np.float64).reshape(-1, len(STATISTICS))
    return x, np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(chars.offsets))), np.asarray(chars.flatten(), np.int64)


def _moments(stats: DataFrame, params: dict, cutoff: float, least: int) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """(n, sum, sum of products) by language over the segments within the cutoff; each partition sends one row a language."""
    sent = stats.sparkSession.sparkContext.broadcast(params)
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            x, row, chars = _flat(b)
            langs = np.asarray(b.column("lang").to_pylist(), object)[row]
            for lang in set(langs.tolist()) & sent.value.keys():
                y = x[(langs == lang) & (chars >= least)]
                y = y[distance(y, sent.value[lang])[0] <= cutoff]
                t = total.setdefault(lang, [0.0, np.zeros(k), np.zeros((k, k))])
                t[0] += len(y)
                t[1] += y.sum(0)
                t[2] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.float64()), pa.array([[*t[1], *t[2].ravel()] for t in total.values()], pa.list_(pa.float64()))], ["lang", "n", "m"])

    parts = stats.select("lang", "chars", "segments").mapInArrow(run, "lang string, n double, m array<double>")
    one = parts.select("lang", "n", F.posexplode("m").alias("i", "v")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = {}
    for r in one.groupBy("lang").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m")).collect():
        v = np.asarray([x.v for x in r.m])
        out[r.lang] = (r.n, v[:k], v[k:].reshape(k, k))
    return out


def distance(x: np.ndarray, param: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(squared Mahalanobis distances, contributions): each contribution is a centred statistic times its entry of S^-1 (x - m)."""
    mean, inverse = param
    c = x - mean
    parts = c * (c @ inverse)
    return parts.sum(1), parts


def chi_square(k: int, z: float) -> float:
    """The quantile of the chi-square distribution whose normal score is z, after Wilson and Hilferty."""
    return k * (1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k))) ** 3


def fit_prose(stats: DataFrame, steps: int = 3, z: float = 4.5, least: int = 40) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust (mean, inverse covariance) of prose for each language, over the segments of all documents.

    It starts from medians and doubled MADs of the documents that are mostly sentences, then takes `steps` concentration
    steps over segments of `least` characters or more; FLOOR is added to every spread.
    """
    k = len(STATISTICS)
    floor = np.asarray(FLOOR)
    s = F.col("stats")
    prosy = stats.filter("NOT blank AND lang <> 'other'").filter(s[10] + s[11] + s[12] < 0.5)
    middle = prosy.groupBy("lang").agg(*[F.percentile_approx(s[i], 0.5, 1000).alias(f"m{i}") for i in range(k)]).collect()
    medians = {r.lang: np.asarray([r[f"m{i}"] for i in range(k)]) for r in middle}
    if not medians:
        return {}
    side = stats.sparkSession.createDataFrame([(lang, [float(v) for v in m]) for lang, m in medians.items()], "lang string, med array<double>")
    mad = prosy.join(F.broadcast(side), "lang").groupBy("lang").agg(*[F.percentile_approx(F.abs(s[i] - F.col("med")[i]), 0.5, 1000).alias(f"m{i}") for i in range(k)]).collect()
    params = {r.lang: (medians[r.lang], np.diag(1 / (2 * np.maximum(1.4826 * np.asarray([r[f"m{i}"] for i in range(k)]), floor)) ** 2)) for r in mad}
    for _ in range(steps):
        for lang, (n, total, products) in _moments(stats, params, chi_square(k, z), least).items():
            if n > 3 * k:
                mean = total / n
                params[lang] = (mean, np.linalg.inv(products / n - np.outer(mean, mean) + np.diag(floor**2)))
    return params


def outlierness(stats: DataFrame, params: dict[str, tuple[np.ndarray, np.ndarray]], z: float = 8.0) -> DataFrame:
    """(key, lang, blank, stats, distance, contributions, outlier_share, kind): how far each document lies from its language's prose.

    A segment is an outlier beyond the chi-square quantile of the normal score z; its kind is the group of SPEAK that
    contributes most. outlier_share: the share of characters in outliers; kind: the one of most of them if that is over
    half, else null. Languages without parameters are measured from the pooled ones. Blank documents have nulls.
    """
    k = len(STATISTICS)
    cutoff = float(chi_square(k, z))
    pooled = (np.mean([m for m, _ in params.values()], 0), np.mean([i for _, i in params.values()], 0)) if params else (np.zeros(k), np.diag(1 / np.asarray(FLOOR) ** 2) * (np.arange(k) >= 10) * (np.arange(k) < 13))
    key_type = stats.schema["key"].dataType.simpleString()
    names = np.asarray([*KINDS, None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x, row, chars = _flat(b)
            langs = np.asarray(b.column("lang").to_pylist(), object)[row]
            d, parts = np.zeros(len(x)), np.zeros_like(x)
            for lang in set(langs.tolist()):
                at = langs == lang
                d[at], parts[at] = distance(x[at], params.get(lang, pooled))
            told = np.argmax(np.stack([parts[:, list(g)].sum(1) for g in SPEAK], 1), 1)
            total = np.maximum(np.bincount(row, chars, n), 1)
            shares = np.stack([np.bincount(row, chars * ((d > cutoff) & (told == i)), n) for i in range(len(KINDS))], 1) / total[:, None]
            kind = np.where(shares.sum(1) > 0.5, np.argmax(shares, 1), len(KINDS))
            blank = b.column("blank").to_numpy(zero_copy_only=False)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(weighted(parts, row, chars, n).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "lang", "blank", "stats")), pa.array(weighted(d[:, None], row, chars, n)[:, 0], mask=blank), whole, pa.array(shares.sum(1), mask=blank), pa.array(names[kind].tolist(), pa.string())], ["key", "lang", "blank", "stats", "distance", "contributions", "outlier_share", "kind"])

    return stats.mapInArrow(run, f"key {key_type}, lang string, blank boolean, stats array<double>, distance double, contributions array<double>, outlier_share double, kind string")


def text_quality(df: DataFrame, model: KneserNey, common: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """outlierness() of every row of df; see there for null and blank texts. Repeated rows come out each on its own."""
    stats = cut(statistics(df, model, common, key, text), "stats")
    return outlierness(stats, fit_prose(stats))
