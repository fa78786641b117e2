"""Removal of artefacts and citations, with counts for each type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators.normalize import word_count
from corpusloom.runtime import arrow_columns


def remove_patterns(df: DataFrame, table: dict[str, str], text: str = "text", replacement: str = "", count: bool = True, debug: str = "", placeholders: dict[str, str] | None = None) -> DataFrame:
    """Removes each pattern in turn; with count: {name}_citations_found. debug names a group whose tag stands in a match's place, placeholders give one by name, such as [EMAIL]."""
    for name, pattern in table.items():
        if count:
            df = df.withColumn(f"{name}_citations_found", F.regexp_count(text, F.lit(pattern)))
        df = df.withColumn(text, F.regexp_replace(text, pattern, f"[DEBUG:{debug}:{name}]" if debug else (placeholders or {}).get(name, replacement)))
    return df


def remove_artefacts(df: DataFrame, text: str = "text", replacement: str = "", count: bool = True, debug: bool = False) -> DataFrame:
    return remove_patterns(df, P.ARTEFACTS, text, replacement, count, "artefakt" if debug else "")


def remove_citations(df: DataFrame, text: str = "text", replacement: str = "", count: bool = True, debug: bool = False) -> DataFrame:
    """The types that are always valid, natively and in one projection each."""
    return remove_patterns(df, P.CITATIONS, text, replacement, count, "citation" if debug else "")


def change_metrics(df: DataFrame, before: str, after: str) -> DataFrame:
    """citation_text_changed, citation_length_reduction, citation_word_reduction."""
    return df.withColumns({"citation_text_changed": F.col(before) != F.col(after), "citation_length_reduction": F.length(before) - F.length(after), "citation_word_reduction": word_count(F.col(before)) - word_count(F.col(after))})


_TECHNICAL = re.compile(P.NO_NAME)
_NAME = re.compile(P.AUTHOR_NAME)
_STOP = frozenset(P.STOPWORDS)
_LIST_ITEM = re.compile(P.LIST_ITEM, re.IGNORECASE)
_LETTER = re.compile("[a-zA-Z]")
_SIMPLE_PAGE = re.compile(P.SIMPLE_PAGE, re.IGNORECASE)


def semicolon_block_is_citation(match: str, least: int = 2, most: int = 12, threshold: float = 0.3) -> bool:
    """Names parted by semicolons: no stopword, no bare number or formula, enough parts of a single word."""
    parts = [p for p in re.split(r"\s*;\s*", match.strip()) if p.strip()]
    if not least <= len(parts) <= most:
        return False
    if any(w in _STOP for p in parts for w in p.lower().split()) or any(_TECHNICAL.search(p) or len(p) > 30 for p in parts):
        return False
    good = sum(1 <= len(p) <= 50 and bool(_NAME.match(p)) and not p.isdigit() and len(p.split()) == 1 for p in parts)
    return good / len(parts) >= threshold


def is_list_item(before: str, match: str) -> bool:
    """A number in brackets that counts items: at a line's start, or behind a colon."""
    line = before.rpartition("\n")[2]
    return bool(_LIST_ITEM.match(match)) and (len(line.strip()) < 5 or before.rstrip().endswith(":"))


def structural_reference(before: str, after: str) -> bool:
    """Whether a reference belongs to the text's own structure and is kept."""
    b, a = before[-150:].lower(), after[:150].lower()
    if any(m in b[-30:] or m in a[:30] for m in P.CITATION_MARKS) or re.search(r" (?:as )?in(?: the)?\s*$", b[-30:]):
        return False
    whole = b + a
    return any(m in whole for m in P.STRUCTURE_MARKS) or sum(m in whole for m in P.PROSE_MARKS) >= 3


def match_is_valid(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a match at text[start:end] is a citation to remove. Positions are those of the text the match comes from."""
    match, before, after = text[start:end], text[max(0, start - 200) : start], text[end : end + 200]  # the widest that any rule looks at
    if kind == "semicolon_blocks":
        return semicolon_block_is_citation(match)
    if kind == "isolated_numeric_citations":
        return not is_list_item(before, match)
    if kind == "ref_nummer":
        return not (_LETTER.search(before[-10:]) and _LETTER.search(after[:10]))
    if kind == "page_references":
        if m := _SIMPLE_PAGE.search(match):
            a, b = start + m.start(), start + m.end()
            if _LETTER.search(text[max(0, a - 15) : a]) and _LETTER.search(text[b : b + 15]):
                return False
            line_end = text.find("\n", b)
            return text[text.rfind("\n", 0, a) + 1 : line_end if line_end >= 0 else len(text)].strip() == match.strip()
        return not structural_reference(before, after)
    return True


_COMPILED = {k: re.compile(p.replace("(?i)", ""), re.IGNORECASE if "(?i)" in p else 0) for k, p in P.VALIDATED.items()}


def remove_validated_text(text: str | None, replacement: str = "", debug: bool = False) -> tuple[str | None, list[int]]:
    """(text, found and removed of each validated type): spans of all types are resolved leftmost, then longest, before anything is cut."""
    if text is None:
        return None, [0] * (2 * len(_COMPILED))
    counts: list[int] = []
    spans: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED.items():
        hits = [(m.start(), m.end()) for m in pattern.finditer(text)]
        ok = [(a, b) for a, b in hits if match_is_valid(kind, text, a, b)]
        counts += [len(hits), len(ok)]
        spans += [(a, b, kind) for a, b in ok]
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a < at:
            continue
        out += [text[at:a], f"[DEBUG:citation:{kind}]" if debug else replacement]
        at = b
    return "".join([*out, text[at:]]), counts


def remove_validated(df: DataFrame, text: str = "text", replacement: str = "", debug: bool = False) -> DataFrame:
    """Context-dependent types, in one Arrow stage; adds {type}_citations_found, _removed and _rejected."""
    names = [f"{k}_citations_{s}" for k in P.VALIDATED for s in ("found", "removed")]

    def rows(t: str | None) -> tuple:
        done, counts = remove_validated_text(t, replacement, debug)
        return done, *counts

    out = arrow_columns(df, [text], f"`{text}` string, " + ", ".join(f"{n} int" for n in names), rows)
    return out.withColumns({f"{k}_citations_rejected": F.col(f"{k}_citations_found") - F.col(f"{k}_citations_removed") for k in P.VALIDATED})


def sentence_integration_score(before: str, after: str) -> float:
    """How much a citation is part of its sentence, 0 to 1, by the word before it, the word after it and brackets around it."""
    score = 0.5
    if left := before.lower().split():
        score += 0.2 if left[-1] in P.RESEARCH_NOUNS else 0.1 if _GERUND.match(left[-1]) else 0.0
    if right := after.lower().split():
        word = _NO_WORD.sub("", right[0])
        score += 0.4 if word in _VERBS else 0.2 if word in P.CONNECTIVES else 0.1 if word == "and" else 0.0
    score -= 0.3 * before.strip().endswith("(") + 0.3 * after.strip().startswith(")")
    return max(0.0, min(1.0, score))


def author_year_decision(text: str, start: int, end: int) -> tuple[bool, str, float]:
    """(remove, reason, score) of the author-year citation at text[start:end].

    Kept near its sentence's start, where its authors are the subject; removed behind a pointing word or in a list of
    references; else by the score: above 0.6 it is part of the sentence and kept, below 0.3 removed, between them kept.
    """
    before, after = text[max(0, start - 200) : start], text[end : end + 200]
    score = sentence_integration_score(before, after)
    reach = max(0, start - 300)
    ends = [at + len(mark) for mark in P.SENTENCE_ENDS if (at := text.rfind(mark, reach, start)) >= 0]
    if start - max([reach, *ends]) < 50:
        verb = next((w for w in (_NO_WORD.sub("", x) for x in after.lower().split()[:5]) if w in _VERBS), None)
        return False, f"author_as_subject_with_verb_{verb}" if verb else "author_at_sentence_start", score
    if _POINTER.search(before.lower()):
        return True, "disruptive_reference_indicator", score
    if before.rstrip().endswith(";") or after.lstrip().startswith(";"):
        return True, "part_of_reference_list", score
    kind = "well_integrated" if score > 0.6 else "poorly_integrated" if score < 0.3 else "uncertain_keep_for_training"
    return kind == "poorly_integrated", f"{kind}_score_{score:.2f}", score


_GERUND, _NO_WORD, _POINTER = re.compile(r"\w+ing$"), re.compile(r"[^\w]"), re.compile(P.POINTING)
_VERBS = frozenset(P.ACADEMIC_VERBS)


def author_year_decisions(df: DataFrame, key: str, text: str = "text", pattern: str = P.CITATIONS["autor_jahr_klammer_einzel"]) -> DataFrame:
    """(key, start_pos, match, remove, reason, score): every author-year citation with its decision. Optional; the default
    cleaning removes them all. Null texts have no row."""
    found = re.compile(pattern)

    def rows(t: str | None) -> tuple[list[dict]]:
        names = ("remove", "reason", "score")
        return ([{"start_pos": m.start(), "match": m.group()} | dict(zip(names, author_year_decision(t, m.start(), m.end()), strict=True)) for m in found.finditer(t or "")],)

    out = arrow_columns(df.select(F.col(key).alias(key), F.col(text).alias("_text")), ["_text"], "_d array<struct<start_pos: int, match: string, remove: boolean, reason: string, score: double>>", rows)
    return out.select(key, F.inline("_d"))
