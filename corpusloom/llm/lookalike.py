"""Problem 4: one consistent form for texts that look the same but differ in characters.

Method: each value is mapped onto look-alike representatives with built-in string functions, the mapped values are
grouped in SQL under the accent-sensitive, case-sensitive ``UNICODE`` collation (it equates composed and decomposed
accents and ignores invisible characters), every class gets a deterministic canonical member, and that is joined back.

What moves: 16-byte digests of every row, and the mapped values of those rows alone whose skeleton (accents and other
combining parts taken off, which no collation class can differ in) stands for several mapped values. Equal mapped values
are pre-aggregated before each shuffle. Pairs meet as distinct (class, string) pairs first, so a class that holds a
third of all rows costs as much as it has different strings, not as it has rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut

# Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ѐ": "è", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "ό": "ó",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ꜱ": "s",
}
# Hyphens of the same length.
HYPHENS = "‐‑⁃﹣－"
#: Code points that show nothing, beside those of the category Cf and control characters: joiners, fillers, variation selectors.
_UNSEEN = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
#: A character that can be seen.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
#: Blocks in which a one-sign form may stand for several signs: dots, letter-like signs, roman numerals, ligatures, digraphs, halfwidth forms.
_SEVERAL = [(0x2024, 0x2026), (0x2100, 0x2122), (0x2160, 0x217F), (0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFF00, 0xFFEF)]


@cache
def mapping() -> tuple[dict[str, str], dict[str, str]]:
    """(single sign to single sign, single sign to several), from Unicode's decompositions and the tables above.

    Kinds of decomposition that change what is seen (super- and subscripts, fractions, circles, squares) are left out.
    """
    one, several = dict(HOMOGLYPHS) | dict.fromkeys(HYPHENS, "-"), {}
    for cp in (c for c in range(0xA0, 0x10000) if not 0xD800 <= c <= 0xDFFF):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if not kind or ch in one or kind.startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>")):
            continue
        if not kind.startswith("<") and len(kind.split()) > 1:
            # Composed letters: the collation equates them with their decompositions, but for letters that look like another one without their marks.
            base, *marks = unicodedata.normalize("NFD", ch)
            to = unicodedata.normalize("NFC", "".join([one.get(base, base), *marks]))
            if base in HOMOGLYPHS and len(to) == 1:
                one[ch] = to
            continue
        to = unicodedata.normalize("NFKC", ch)
        to = "".join(one.get(x, x) for x in to)
        if to == ch or to.startswith(" ") or not to:
            continue
        if len(to) == 1:
            one[ch] = to
        elif any(a <= cp <= b for a, b in _SEVERAL):
            several[ch] = to
    return one, several


@cache
def _translation() -> tuple[str, str]:
    """Arguments of translate(): look-alikes, then blanks onto a space, then unseen signs onto nothing."""
    one, _ = mapping()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x10000 or c >= 0xE0000)]
    blank = [c for c in every if unicodedata.category(c)[0] == "Z" or c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"]
    one = {k: v for k, v in one.items() if k not in blank and k != " "}
    blank = [c for c in blank if c != " "]
    unseen = [c for c in every if c not in blank and (unicodedata.category(c) in ("Cf", "Cc") or any(a <= ord(c) <= b for a, b in _UNSEEN))]
    one = {k: v for k, v in one.items() if k not in unseen}
    return "".join([*one, *blank, *unseen]), "".join(one.values()) + " " * len(blank)


@cache
def _bare() -> tuple[str, str]:
    """Arguments of translate(): composed signs onto their first part, then combining marks and all of Hangul, whose syllables decompose, onto nothing."""
    one, none = {}, []
    for c in map(chr, range(0xA0, 0x110000)):
        if 0xD800 <= ord(c) <= 0xDFFF:
            continue
        if unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\uac00" <= c <= "\ud7ff":
            none.append(c)
        elif unicodedata.decomposition(c)[:1] not in ("", "<"):
            one[c] = unicodedata.normalize("NFD", c)[0]
    none += [c for c, to in one.items() if unicodedata.category(to)[0] == "M"]
    one = {c: to for c, to in one.items() if unicodedata.category(to)[0] != "M"}
    return "".join([*one, *none]), "".join(one.values())


def skeleton(seen: Column) -> Column:
    """Digest of a mapped form that all forms equal to it under UNICODE share."""
    return F.unhex(F.md5(F.translate(seen, *_bare())))


def look(text: Column) -> Column:
    """The mapped form of text: equal under the collation UNICODE where two texts look the same. Null stays null.

    Built-in functions only, each part evaluated once: signs for several signs where there are any, then one translate()
    for look-alikes, blanks and unseen signs, then runs of spaces.
    """
    _, several = mapping()
    wide = text
    for sign, to in several.items():
        wide = F.replace(wide, F.lit(sign), F.lit(to))
    wide = F.when(F.octet_length(F.translate(text, "".join(several), "")) < F.octet_length(text), wide).otherwise(text)
    return F.trim(F.regexp_replace(F.translate(wide, *_translation()), " {2,}", " "))


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, look, skel, size, seen): digests of the string itself, of its mapped form and of that form's skeleton, the string's length, the mapped form. Null and blank texts have no row."""
    shown = df.filter(F.col(f"`{text}`").rlike(VISIBLE))
    seen = shown.select(F.col(f"`{key}`").alias("key"), F.unhex(F.md5(f"`{text}`")).alias("form"), look(F.col(f"`{text}`")).alias("seen"), F.length(F.col(f"`{text}`")).alias("size"))
    return seen.select("key", "form", F.unhex(F.md5("seen")).alias("look"), skeleton(F.col("seen")).alias("skel"), "size", "seen")


def look_classes(rows: DataFrame) -> DataFrame:
    """(look, class_id) of the mapped forms that share a class with another one; a class's id is its least digest.

    Classes are groups equal under UNICODE. Members are joined back by the collated form, never collected, so a class may
    have any number of them; forms alone in their class have no row.
    """
    looks = rows.select("skel", "look").distinct()
    several = looks.groupBy("skel").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("skel")
    near = looks.join(several, "skel", "left_semi").select("look")
    distinct = rows.select("look", "seen").join(near, "look", "left_semi").groupBy("look").agg(F.first("seen").alias("seen"))
    return distinct.sparkSession.sql(
        """
        SELECT d.look, c.class_id FROM {distinct} d JOIN (
            SELECT collate(seen, 'UNICODE') AS k, min(look) AS class_id FROM {distinct} GROUP BY collate(seen, 'UNICODE') HAVING count(*) > 1) c
        ON collate(d.seen, 'UNICODE') = c.k
        """,
        distinct=distinct,
    )


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, class_id) for every row with a non-blank text; rows that look the same share class_id.

    Null and blank texts are left out, repeated keys stay repeated, an empty table gives none; other columns don't matter.
    """
    rows = cut(forms(df, key, text), "forms")
    merged = look_classes(rows)
    return rows.select("key", "form", "look").join(merged, "look", "left").select("key", "form", F.coalesce("class_id", "look").alias("class_id"))


def _several(rows: DataFrame) -> DataFrame:
    """(class_id, form, n, forms, class_rows): the distinct strings of the classes that have several, with the rows of each and of all."""
    strings = rows.groupBy("class_id", "form").agg(F.count(F.lit(1)).alias("n"))
    classes = strings.groupBy("class_id").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("class_rows")).filter("forms > 1")
    return strings.join(classes, "class_id")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: keys of rows that look the same but are not the same string.

    Distinct strings of a class meet first; then each side's rows join their string. Rows of one string never meet.
    """
    rows = cut(lookalike_classes(df, key, text), "classes")
    strings = cut(_several(rows).select("class_id", "form"), "strings")
    both = strings.select("class_id", F.col("form").alias("form_a")).join(strings.select("class_id", F.col("form").alias("form_b")), "class_id").filter("form_a < form_b")
    one = rows.join(strings.select("form"), "form", "left_semi").select("form", "key").distinct()
    met = both.select("form_a", "form_b").join(one.toDF("form_a", "a"), "form_a").join(one.toDF("form_b", "b"), "form_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def lookalike_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, forms, class_rows, links): one row for each row of a class of several strings, with the number of its
    partners, that is, the class's rows of another string. A class with a third of all rows has as many rows here."""
    rows = cut(lookalike_classes(df, key, text), "classes")
    strings = _several(rows)
    return rows.select("key", "form").join(strings, "form").select("key", F.lower(F.hex("class_id")).alias("class_id"), "forms", "class_rows", (F.col("class_rows") - F.col("n")).alias("links"))


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical_key, canonical_text, n_forms, n_rows): every row with the one form all that look like it share.

    The canonical member of a class is the string most rows have, then the shortest, then the least by digest; it is
    joined back to every row. Null or blank texts come back as they are, with nulls for the rest.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = cut(forms(base, "key", "text"), "forms")
    strings = rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.first("look").alias("look"), F.first("size").alias("size"), F.min("key").alias("least_key"))
    strings = cut(strings.join(look_classes(rows), "look", "left").withColumn("class_id", F.coalesce("class_id", "look")), "strings")
    best = F.min_by(F.struct("form", "least_key"), F.struct(-F.col("n"), "size", "form"))
    classes = strings.groupBy("class_id").agg(best.alias("best"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_forms"))
    member = strings.select("form", "class_id").join(classes, "class_id").select("form", F.col("best.form").alias("best_form"), F.col("best.least_key").alias("canonical_key"), "n_forms", "n_rows")
    # Texts move for the canonical members of classes of several strings, and with each row to its class.
    named = base.filter("text IS NOT NULL").select(F.unhex(F.md5("text")).alias("best_form"), F.col("text").alias("canonical_text"))
    chosen = named.join(member.filter("n_forms > 1").select("best_form").distinct(), "best_form", "left_semi").groupBy("best_form").agg(F.first("canonical_text").alias("canonical_text"))
    told = member.join(chosen, "best_form", "left").drop("best_form")
    return base.select("key", "text", F.unhex(F.md5("text")).alias("form")).join(told, "form", "left").select("key", "canonical_key", F.coalesce("canonical_text", "text").alias("canonical_text"), "n_forms", "n_rows")
