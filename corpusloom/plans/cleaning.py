"""Cleaning queries: every rule over all documents, with injected text, so that each rule meets its case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import citations as C
from corpusloom.operators import lines as L
from corpusloom.operators import normalize as N
from corpusloom.operators import sections as S
from corpusloom.operators.compare import line_diff  # noqa: F401
from corpusloom.plans.registry import query
from corpusloom.runtime import table as t


def injected(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): all documents, each with the case of its remainder by 7."""
    case = F.lit("")
    for k, v in P.INJECTED.items():
        case = F.when(F.col("doc_id") % 7 == k, F.lit(v)).otherwise(case)
    return t(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), case).alias("text"))


def _sql(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


INJ = "(SELECT doc_id, coalesce(text, '') || CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {_sql(v)}" for k, v in P.INJECTED.items()) + " END AS text FROM documents)"


def _re2(pattern: str) -> str:
    """The pattern for an engine without possessive, atomic and look-around parts; ASCII classes as they are."""
    return pattern.replace("*+", "*").replace("++", "+").replace("}+", "}").replace("(?>", "(?:").replace("(?U)", "")


# Java's classes under (?U), for an engine whose classes are ASCII ones.
_WIDE = {"w": r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}", "s": r"\t-\r \x{85}\p{Z}", "d": r"\p{Nd}"}


def _re2_wide(pattern: str) -> str:
    """_re2() of a pattern under (?U): its classes spelled out, inside brackets and outside them."""
    out, inside, i = [], False, 0
    p = _re2(pattern)
    while i < len(p):
        c = p[i]
        if c == "\\" and p[i + 1] in _WIDE:
            out.append(_WIDE[p[i + 1]] if inside else f"[{_WIDE[p[i + 1]]}]")
            i += 2
        elif c == "\\" and p[i + 1] == "u":
            out.append(f"\\x{{{p[i + 2 : i + 6]}}}")
            i += 6
        elif c == "\\":
            out.append(p[i : i + 2])
            i += 2
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


def _sql_pattern(pattern: str) -> str:
    return _re2_wide(pattern) if pattern.startswith("(?U)") else _re2(pattern)


def _chain(source: str, steps: list[tuple[str, str, str]]) -> str:
    """CTEs that apply the steps (name, SQL of a count, SQL of the change, both of {t}) one after the other; the last is `done`, with counts c_{name} and the text."""
    ctes = [f"s0 AS (SELECT *, text AS t FROM {source})"]
    for i, (name, count, change) in enumerate(steps, 1):
        ctes.append(f"s{i} AS (SELECT * EXCLUDE (t), CAST({count.replace('{t}', 't')} AS BIGINT) AS c_{name}, {change.replace('{t}', 't')} AS t FROM s{i - 1})")
    return ", ".join([*ctes, f"done AS (SELECT * FROM s{len(steps)})"])


def _removals(table: dict[str, str]) -> list[tuple[str, str, str]]:
    return [(n, f"len(regexp_extract_all({{t}}, {_sql(_sql_pattern(p))}))", f"regexp_replace({{t}}, {_sql(_sql_pattern(p))}, '', 'g')") for n, p in table.items()]


def _count(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, {_sql(_re2(pattern))}))"


def _removal(name: str, pattern: str) -> None:
    p = _re2(pattern)

    @query(f"SELECT doc_id, {_count(p)} AS found, md5(regexp_replace(text, {_sql(p)}, '', 'g')) AS digest FROM {INJ}", name)
    def run(s: SparkSession, d: str) -> DataFrame:
        out = C.remove_patterns(injected(s, d), {"x": pattern})
        return out.select("doc_id", F.col("x_citations_found").alias("found"), F.md5("text").alias("digest"))


for _i, _k in enumerate(P.ARTEFACTS, 1):
    _removal(f"c{_i}_{_k}", P.ARTEFACTS[_k])
for _i, _k in ((7, "eckige_klammern_numerisch"), (8, "consecutive_numeric_citations"), (10, "autor_jahr_multi_klammer"), (11, "autor_jahr_klammer_einzel")):
    _removal(f"c{_i}_{_k}", P.CITATIONS[_k])


_SQUARE = ("autor_jahr_eckig_einzel", "autor_jahr_eckig_multi")


@query(f"WITH {_chain(INJ, _removals({k: P.CITATIONS[k] for k in _SQUARE}))} SELECT doc_id, " + ", ".join(f"CAST(c_{k} AS INT) AS {k}_citations_found" for k in _SQUARE) + ", md5(t) AS digest FROM done")
def c12_c13_author_year_square(s: SparkSession, d: str) -> DataFrame:
    out = C.remove_patterns(injected(s, d), {k: P.CITATIONS[k] for k in ("autor_jahr_eckig_einzel", "autor_jahr_eckig_multi")})
    return out.select("doc_id", "autor_jahr_eckig_einzel_citations_found", "autor_jahr_eckig_multi_citations_found", F.md5("text").alias("digest"))


@query()
def c6_c9_c14_c15_validated(s: SparkSession, d: str) -> DataFrame:
    """Semicolon blocks, isolated numbers, ref numbers and page references, each match looked at in its surroundings."""
    return C.remove_validated(injected(s, d)).withColumn("text", F.md5("text"))


_ART = "text"
for _p in P.ARTEFACTS.values():
    _ART = f"regexp_replace({_ART}, {_sql(_re2(_p))}, '', 'g')"
_DBG = "text"
for _n, _p in P.ARTEFACTS.items():
    _DBG = f"regexp_replace({_DBG}, {_sql(_re2(_p))}, '[DEBUG:artefakt:{_n}]', 'g')"


_WORDS = "len(regexp_extract_all({0}, '[^ \\t\\n\\x0B\\f\\r]+'))"


@query(f"SELECT doc_id, md5({_ART}) AS digest, text <> {_ART} AS citation_text_changed, length(text) - length({_ART}) AS citation_length_reduction, CAST({_WORDS.format('text')} - {_WORDS.format(_ART)} AS INT) AS citation_word_reduction FROM {INJ}")
def c22_c25_artefacts_and_changes(s: SparkSession, d: str) -> DataFrame:
    docs = injected(s, d).withColumn("before", F.col("text"))
    out = C.change_metrics(C.remove_artefacts(docs, count=False), "before", "text")
    return out.select("doc_id", F.md5("text").alias("digest"), "citation_text_changed", "citation_length_reduction", "citation_word_reduction")


@query(f"SELECT doc_id, md5({_DBG}) AS digest FROM {INJ}")
def c23_debug_tags(s: SparkSession, d: str) -> DataFrame:
    return C.remove_artefacts(injected(s, d), count=False, debug=True).select("doc_id", F.md5("text").alias("digest"))


_MARKS = {"email_addresses": "[EMAIL]", "urls": "[URL]"}
_MARKED = "text"
for _n, _p in P.ARTEFACTS.items():
    _MARKED = f"regexp_replace({_MARKED}, {_sql(_re2(_p))}, {_sql(_MARKS.get(_n, ''))}, 'g')"


@query(f"SELECT doc_id, md5({_MARKED}) AS digest FROM {INJ}")
def c27_placeholders(s: SparkSession, d: str) -> DataFrame:
    """The option that leaves a mark for each address and link."""
    return C.remove_patterns(injected(s, d), P.ARTEFACTS, count=False, placeholders=_MARKS).select("doc_id", F.md5("text").alias("digest"))


_TYPES = [(n, "artefacts") for n in P.ARTEFACTS] + [(n, "citations") for n in P.CITATIONS]


def _totals(found: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(stage, type, found, removed, rejected): one aggregation for all types; those without validation have no rejected ones."""
    sums = [F.sum(f"{k}_citations_{w}" if k in P.VALIDATED else f"{k}_citations_found").alias(f"{k}_{w}") for k in stages for w in ("found", "removed", "rejected") if k in P.VALIDATED or w != "rejected"]
    rows = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(k).alias("type"), F.col(f"{k}_found").alias("found"), F.col(f"{k}_removed").alias("removed"), (F.col(f"{k}_rejected") if k in P.VALIDATED else F.lit(0).cast("long")).alias("rejected")) for k, stage in stages.items()])
    return found.agg(*sums).select(F.inline(rows))


@query(f"WITH {_chain(INJ, _removals(P.ARTEFACTS | P.CITATIONS))} " + " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{n}' AS type, CAST(sum(c_{n}) AS BIGINT) AS found, CAST(sum(c_{n}) AS BIGINT) AS removed, CAST(0 AS BIGINT) AS rejected FROM done" for n, stage in _TYPES))
def c24_counts(s: SparkSession, d: str) -> DataFrame:
    """Totals of every artefact and citation type that needs no validation."""
    return _totals(C.remove_citations(C.remove_artefacts(injected(s, d))), dict(_TYPES))


@query()
def c24_validated_counts(s: SparkSession, d: str) -> DataFrame:
    """Totals of the validated types on what the others leave: found, removed, rejected."""
    out = C.remove_validated(C.remove_citations(C.remove_artefacts(injected(s, d), count=False), count=False))
    return _totals(out, dict.fromkeys(P.VALIDATED, "validated"))


@query()
def c17_author_year_decisions(s: SparkSession, d: str) -> DataFrame:
    """The optional rule: each author-year citation in round brackets with its decision, its reason and how far it is part of its sentence."""
    return C.author_year_decisions(injected(s, d), "doc_id")


_ENDS = "'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]'"


def _split(source: str, text: str = "text") -> str:
    """(doc_id, l): the lines of each text at every kind of line end, an ending one adding none."""
    return f"(SELECT doc_id, CASE WHEN x[len(x)] = '' THEN x[1 : len(x) - 1] ELSE x END AS l FROM (SELECT doc_id, string_split_regex({text}, {_ENDS}) AS x FROM {source}))"


def _lines(source: str, text: str = "text") -> str:
    return f"(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM {_split(source, text)})"


LINES = _lines(INJ)


@query(f"SELECT doc_id, CAST(len(l) AS INT) AS n_lines FROM {_split(INJ)}")
def l0_split_lines(s: SparkSession, d: str) -> DataFrame:
    return injected(s, d).select("doc_id", F.size(L.split_lines(F.col("text"))).alias("n_lines"))


_STRIP = r"regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_PLAIN = f"(SELECT doc_id, {_STRIP} AS st, line, i FROM {LINES})"


@query(f"SELECT doc_id, i FROM (SELECT doc_id, i, st, list(st) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev FROM {_PLAIN} WHERE st <> '') WHERE list_contains(prev, st)")
def l1_repetition(s: SparkSession, d: str) -> DataFrame:
    """Lines equal to one of the five non-blank lines before."""
    x = L.classify_lines(injected(s, d)).select("doc_id", F.explode("line_info").alias("x"))
    return x.filter("x.reason LIKE 'repetition%'").select("doc_id", F.col("x.i").cast("long").alias("i"))


_SPACES = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
_MEMORY = f"""SELECT doc_id, CAST(a.n AS INT) AS repeated_lines_removed, md5(array_to_string(a.kept, chr(10))) AS digest FROM (
 SELECT doc_id, list_reduce(list_transform(l, lambda x: {{'x': x, 's': trim(x, {_SPACES}), 'last': []::VARCHAR[], 'kept': []::VARCHAR[], 'n': 0}}),
 lambda a, x: {{'x': '', 's': '', 'last': CASE WHEN x.s = '' OR list_contains(a.last, x.s) THEN a.last ELSE list_append(a.last, x.s)[-5:] END,
 'kept': CASE WHEN x.s <> '' AND list_contains(a.last, x.s) THEN a.kept ELSE list_append(a.kept, x.x) END, 'n': a.n + CASE WHEN x.s <> '' AND list_contains(a.last, x.s) THEN 1 ELSE 0 END}},
 {{'x': '', 's': '', 'last': []::VARCHAR[], 'kept': []::VARCHAR[], 'n': 0}}) AS a FROM {_split(INJ)})"""


@query(_MEMORY)
def l1b_kept_line_memory(s: SparkSession, d: str) -> DataFrame:
    return L.kept_line_memory(injected(s, d)).select("doc_id", "repeated_lines_removed", F.md5("text").alias("digest"))


_TABS = "length(line) - length(replace(line, chr(9), ''))"


@query(f"SELECT doc_id, i FROM (SELECT doc_id, i, {_TABS} >= 2 AS t, coalesce(lag({_TABS} >= 2) OVER w, false) AS p, coalesce(lead({_TABS} >= 2) OVER w, false) AS n FROM {_PLAIN} WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE t AND (p OR n)")
def l2_consecutive_tabs(s: SparkSession, d: str) -> DataFrame:
    lines = injected(s, d).withColumn("_l", L.split_lines(F.col("text"))).withColumn("_t", F.transform("_l", lambda x: F.length(x) - F.length(F.translate(x, "\t", "")) >= 2))
    near = lambda i: F.coalesce(F.try_element_at("_t", i + 2), F.lit(False)) | (i > 0) & F.coalesce(F.try_element_at("_t", F.greatest(i, F.lit(1))), F.lit(False))
    x = lines.select("doc_id", F.posexplode("_t").alias("p", "t"), "_t").filter(F.col("t") & near(F.col("p")))
    return x.select("doc_id", (F.col("p") + 1).cast("long").alias("i"))


_W = r"len(regexp_extract_all(st, '\S+'))"
_SHORT = "CASE " + " ".join(f"WHEN {_W} <= 3 AND length(st) <= 15 AND regexp_matches(st, {_sql(p)}) THEN '{n}'" for n, p in P.SHORT_LINES) + " END"


@query(f"SELECT doc_id, i, {_SHORT} AS reason FROM {_PLAIN} WHERE st <> '' AND {_SHORT} IS NOT NULL")
def l3_short_lines(s: SparkSession, d: str) -> DataFrame:
    x = injected(s, d).select("doc_id", F.posexplode(L.split_lines(F.col("text"))).alias("p", "line")).withColumn("st", N.strip(F.col("line"))).filter("st <> ''")
    reason = F.lit(None).cast("string")
    for n, p in reversed(P.SHORT_LINES):
        reason = F.when(F.col("st").rlike(p), n).otherwise(reason)
    ok = (N.word_count(F.col("st")) <= 3) & (F.length("st") <= 15)
    return x.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), F.when(ok, reason).alias("reason")).filter("reason IS NOT NULL")


_META = f"CASE WHEN regexp_matches(st, {_sql(P.KEYWORD_LINE)}) THEN 'keywords_metadata' WHEN ({_W} <= 8 AND regexp_matches(st, {_sql(P.CODE_START)})) OR (regexp_matches(st, {_sql(P.ALL_CAPS)}) AND length(replace(st, ' ', '')) < 8) THEN 'technical_code_line' WHEN regexp_matches(st, {_sql(P.COPYRIGHT)}) THEN 'copyright_line' END"


@query(f"SELECT doc_id, i, {_META} AS reason FROM {_PLAIN} WHERE st <> '' AND {_META} IS NOT NULL")
def l4_l5_metadata_copyright(s: SparkSession, d: str) -> DataFrame:
    x = injected(s, d).select("doc_id", F.posexplode(L.split_lines(F.col("text"))).alias("p", "line")).withColumn("st", N.strip(F.col("line"))).filter("st <> ''")
    c = F.col("st")
    code = (N.word_count(c) <= 8) & c.rlike(P.CODE_START) | c.rlike(P.ALL_CAPS) & (F.length(F.replace(c, F.lit(" "), F.lit(""))) < 8)
    reason = F.when(c.rlike(P.KEYWORD_LINE), "keywords_metadata").when(code, "technical_code_line").when(c.rlike(P.COPYRIGHT), "copyright_line")
    return x.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), reason.alias("reason")).filter("reason IS NOT NULL")


def _ranked(plain: str) -> str:
    """(doc_id, i, line, reason): the fused cleaner's lines."""
    return f"""(SELECT doc_id, i, line, CASE WHEN st = '' THEN NULL WHEN list_contains(prev, st) THEN 'r' WHEN t AND (p OR n) THEN 't' ELSE coalesce({_SHORT}, {_META}) END AS reason FROM (
 SELECT doc_id, i, st, line, {_TABS} >= 2 AS t, coalesce(lag({_TABS} >= 2) OVER w, false) AS p, coalesce(lead({_TABS} >= 2) OVER w, false) AS n,
 list(st) FILTER (WHERE st <> '') OVER (PARTITION BY doc_id, st = '' ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev FROM {plain} WINDOW w AS (PARTITION BY doc_id ORDER BY i)))"""


@query(f"SELECT doc_id, count(reason) AS lines_removed, coalesce(sum(length(line)) FILTER (WHERE reason IS NOT NULL), 0) AS line_length_reduction FROM {_ranked(_PLAIN)} GROUP BY 1")
def l6_fused_line_cleaner(s: SparkSession, d: str) -> DataFrame:
    return L.clean_lines(injected(s, d)).select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"), F.col("line_length_reduction").cast("long").alias("line_length_reduction"))


_MATH = f"regexp_matches(st, {_sql(P.MATH)})"
_NUM = f"len(list_filter(regexp_extract_all(st, '\\S+'), lambda w: regexp_matches(w, {_sql(P.NUMERIC_WORD)})))"
_CAP = f"CASE WHEN regexp_matches(st, {_sql(P.CAPTION)}) THEN 'figure_table_caption' WHEN NOT {_MATH} AND {_W} BETWEEN 2 AND 5 AND {_NUM} / {_W} >= 0.6 THEN 'numeric_table_data_' || {_NUM} || 'of' || {_W} END"


@query(f"SELECT doc_id, i, {_CAP} AS reason FROM {_PLAIN} WHERE st <> '' AND {_CAP} IS NOT NULL")
def l7_l9_captions(s: SparkSession, d: str) -> DataFrame:
    x = injected(s, d).select("doc_id", F.posexplode(L.split_lines(F.col("text"))).alias("p", "line"))
    return x.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), L.caption_reason(F.col("line")).alias("reason")).filter("reason IS NOT NULL")


_BLANK = r"\t-\r\x1C-\x20\x{85}\p{Z}"  # white space as split() and strip() see it
_STARTED = "{'o': false, 'c': false, 'held': 0, 'id': 0, 'ids': []::INT[]}"


def _ratio(pattern: str, among: str) -> str:
    return f"CASE WHEN {among} > 0 THEN len(regexp_extract_all(st, {_sql(pattern)})) / {among} ELSE 0 END"


def _indicator(k: int, share: str) -> str:
    """The weight of a section's k-th indicator if its share is exceeded."""
    _, least, weight = P.SECTION_INDICATORS[k]
    return f"CASE WHEN avg({share}) FILTER (WHERE st <> '') > {least} THEN {weight} ELSE 0 END"


_SECTION_LINES = (
    f"SELECT doc_id, i, line, st, len(regexp_extract_all(st, {_sql(f'[^{_BLANK}]+')})) AS words, {_ratio(rf'[^\pL\pN_{_BLANK}]', "length(replace(st, ' ', ''))")} AS special, {_ratio(r'\p{Lu}', "length(regexp_replace(st, '[^\\pL]', '', 'g'))")} AS upper"
    f" FROM (SELECT doc_id, i, line, regexp_replace(line, {_sql(f'^[{_BLANK}]+|[{_BLANK}]+$')}, '', 'g') AS st FROM {LINES})"
)
_SECTION_SCORE = " + ".join(
    [
        _indicator(0, "special"), _indicator(1, "upper"), _indicator(2, "(words < 5)::INT"), _indicator(3, rf"regexp_matches(st, '\t|[{_BLANK}]{{3,}}')::INT"), _indicator(4, r"regexp_matches(st, '^[A-Z0-9]{2,}\s+[A-Z0-9]{2,}')::INT"),
        _indicator(5, r"regexp_matches(st, '\d+\.\d+|\d+%')::INT"), "CASE WHEN avg(words) FILTER (WHERE st <> '') < 5 THEN 0.15 ELSE 0 END",
    ]
)
_SECTIONS = rf"""WITH f AS ({_SECTION_LINES}),
m AS (SELECT *, st <> '' AND regexp_matches(st, {_sql(P.SECTION_STARTS)}) AS opens, st <> '' AND words > 15 AND special < 0.15 AND upper < 0.3 AND NOT regexp_matches(st, '^[A-Z]{{2,}}|\d+\.\d+|[:\t]') AS shuts FROM f),
n AS (SELECT doc_id, list_reduce(list_prepend({_STARTED}, list({{'o': opens, 'c': shuts, 'held': 0, 'id': 0, 'ids': []::INT[]}} ORDER BY i)), lambda a, x: CASE
 WHEN a.held = 0 AND x.o THEN {{'o': false, 'c': false, 'held': 1, 'id': a.id + 1, 'ids': list_append(a.ids, a.id + 1)}}
 WHEN a.held = 0 OR a.held >= 5 AND x.c THEN {{'o': false, 'c': false, 'held': 0, 'id': a.id, 'ids': list_append(a.ids, 0)}}
 ELSE {{'o': false, 'c': false, 'held': a.held + 1, 'id': a.id, 'ids': list_append(a.ids, a.id)}} END).ids AS ids FROM m GROUP BY doc_id),
w AS (SELECT m.*, n.ids[m.i] AS sec FROM m JOIN n USING (doc_id)),
c AS (SELECT doc_id, sec, count(*) AS n_lines, sum(length(line)) AS n_chars, least(1, {_SECTION_SCORE}) > 0.8 AS gone FROM w WHERE sec > 0 GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, sum(n_lines) AS l, sum(n_chars) AS c FROM c WHERE gone GROUP BY 1),
k AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.sec = c.sec WHERE NOT coalesce(c.gone, false) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS INT) AS appendix_sections_removed, CAST(coalesce(g.l, 0) AS INT) AS appendix_lines_removed, CAST(coalesce(g.c, 0) AS INT) AS appendix_length_reduction, md5(coalesce(k.t, '')) AS digest
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query(_SECTIONS)
def l10_l12_appendix_sections(s: SparkSession, d: str) -> DataFrame:
    return S.remove_sections(injected(s, d)).select("doc_id", "appendix_sections_removed", "appendix_lines_removed", "appendix_length_reduction", F.md5("text").alias("digest"))


def _symbols(name: str, steps: tuple[str, ...], sql: str) -> None:
    @query(f"SELECT doc_id, md5({sql}) AS digest FROM {INJ}", name)
    def run(s: SparkSession, d: str) -> DataFrame:
        return N.normalize_symbols(injected(s, d), count=False, only=steps).select("doc_id", F.md5("text").alias("digest"))


def _nested(table: dict[str, str], expr: str = "text") -> str:
    for k, v in table.items():
        expr = f"replace({expr}, {_sql(k)}, {_sql(v)})"
    return expr


_symbols("n1_invisible", ("invisible",), f"translate(text, {_sql(P.INVISIBLE)}, '')")
_symbols("n4_dots", ("dots",), "regexp_replace(regexp_replace(text, '\\.{4,}', '...', 'g'), '(?:\\. ){3,}', ' ... ', 'g')")
_symbols("n5_cyrillic", ("cyrillic",), f"translate(text, {_sql(P.CYRILLIC[0])}, {_sql(P.CYRILLIC[1])})")
_symbols("n6_dashes", ("dashes",), f"translate(text, {_sql(P.DASHES)}, '----')")
_symbols("n7_quotes", ("quotes",), _nested(P.QUOTES))
_symbols("n8_bullets", ("bullets",), f"translate(text, {_sql(P.BULLETS)}, '*******')")
_symbols("n9_arrows", ("arrows",), _nested(P.ARROWS))
_symbols("n10_legal", ("legal",), _nested(P.LEGAL))
_symbols("n11_primes_ellipses", ("primes", "ellipses"), _nested(P.ELLIPSES, _nested(P.PRIMES)))


_TERMINATOR = r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"  # where an end may stand before one that ends the text


def _symbol_steps(only: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """The symbol rules in their order as steps of _chain()."""
    regex = lambda p, to="": (f"len(regexp_extract_all({{t}}, {_sql(_sql_pattern(p))}))", f"regexp_replace({{t}}, {_sql(_sql_pattern(p))}, {_sql(to)}, 'g')")
    gone = lambda signs: f"length({{t}}) - length(translate({{t}}, {_sql(signs)}, ''))"

    def table(t: dict[str, str]) -> tuple[str, str]:
        return gone("".join(t)), _nested(t, "{t}")

    row = P.TABULAR[1].replace(".*", r"[^\n\r\x{85}\x{2028}\x{2029}]*").removesuffix("$") + _TERMINATOR
    steps = [("invisible", gone(P.INVISIBLE), f"translate({{t}}, {_sql(P.INVISIBLE)}, '')")]
    steps += [(f"toc_{i}", *regex(p)) for i, p in enumerate(P.TOC)]
    steps += [("tabular_0", *regex(P.TABULAR[0])), ("tabular_1", f"CASE WHEN regexp_matches({{t}}, {_sql(row)}) THEN 1 ELSE 0 END", f"regexp_replace({{t}}, {_sql(row)}, '\\1')")]
    steps += [(f"dots_{i}", *regex(p, to)) for i, (p, to) in enumerate(P.DOTS)]
    steps += [("cyrillic", gone(P.CYRILLIC[0]), f"translate({{t}}, {_sql(P.CYRILLIC[0])}, {_sql(P.CYRILLIC[1])})")]
    steps += [(n, *table(t)) for n, t in (("dashes", dict.fromkeys(P.DASHES, "-")), ("quotes", P.QUOTES), ("bullets", dict.fromkeys(P.BULLETS, "*")), ("arrows", P.ARROWS), ("legal", P.LEGAL), ("primes", P.PRIMES), ("ellipses", P.ELLIPSES))]
    return [x for x in steps if not only or x[0].startswith(only)]


def _symbol_sql(only: tuple[str, ...] = (), changed: str = "") -> str:
    steps = _symbol_steps(only)
    total = " + ".join(f"c_{n}" for n, _, _ in steps)
    return f"WITH {_chain(INJ, steps)} SELECT doc_id, {changed}CAST(CASE WHEN t <> text THEN {total} ELSE 0 END AS INT) AS symbol_normalizations, md5(t) AS digest FROM done"


@query(_symbol_sql(("toc", "tabular")))
def n2_n3_contents_and_tables(s: SparkSession, d: str) -> DataFrame:
    return N.normalize_symbols(injected(s, d), only=("toc", "tabular")).select("doc_id", "symbol_normalizations", F.md5("text").alias("digest"))


@query(_symbol_sql((), "t <> text AS symbol_text_changed, "))
def n13_symbols_in_order(s: SparkSession, d: str) -> DataFrame:
    return N.normalize_symbols(injected(s, d)).select("doc_id", "symbol_text_changed", "symbol_normalizations", F.md5("text").alias("digest"))


_N14 = "regexp_replace(text, '[ \\t]+', ' ', 'g')"
_N15 = f"regexp_replace({_N14}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_N16 = f"regexp_replace(regexp_replace({_N15}, '(^|\\.) {{2,}}([A-Z])', '\\1 \\2', 'g'), '(?m)^ +', '', 'g')"
_N17 = f"regexp_replace({_N16}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({_N17}) AS digest, {_N17} <> text AS norm_text_changed, length(text) - length({_N17}) AS norm_length_reduction, {_N14} <> text AS spaces, {_N15} <> {_N14} AS newlines, {_N16} <> {_N15} AS sentence_spacing_fixes, {_N17} <> {_N16} AS strip, CAST({_WORDS.format('text')} - {_WORDS.format(_N17)} AS INT) AS norm_word_reduction FROM {INJ}")
def n14_n18_whitespace(s: SparkSession, d: str) -> DataFrame:
    out = N.normalize_whitespace(injected(s, d))
    return out.select("doc_id", F.md5("text").alias("digest"), "norm_text_changed", "norm_length_reduction", F.col("norm_changes_made.spaces").alias("spaces"), F.col("norm_changes_made.newlines").alias("newlines"), F.col("norm_changes_made.sentence_spacing_fixes").alias("sentence_spacing_fixes"), F.col("norm_changes_made.strip").alias("strip"), "norm_word_reduction")


@query(f"SELECT doc_id, length(text) - length({_N17}) AS reduction FROM {INJ} ORDER BY reduction DESC, doc_id LIMIT 20")
def n19_top_normalised(s: SparkSession, d: str) -> DataFrame:
    out = N.normalize_whitespace(injected(s, d))
    return out.select("doc_id", F.col("norm_length_reduction").alias("reduction")).orderBy(F.desc("reduction"), "doc_id").limit(20)


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, chr(160) || chr(13) || chr(10), '   '), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM {INJ}")
def n20_window_text(s: SparkSession, d: str) -> DataFrame:
    return injected(s, d).select("doc_id", F.md5(N.normalize_window_text(F.col("text"))).alias("digest"))


@query()
def clean_corpus(s: SparkSession, d: str) -> DataFrame:
    """The cleaning pipeline: artefacts, citations, lines, captions, appendices, language, symbols, white space; empty documents are dropped."""
    docs = t(s, d, "documents").select("doc_id", "id", "text", "fasttext_en").withColumn("before", F.col("text"))
    out = S.remove_sections(L.clean_captions(L.clean_lines(C.remove_validated(C.remove_citations(C.remove_artefacts(docs))))))
    kept = F.coalesce("fasttext_en", F.lit(1.0)) >= 0.75
    out = out.withColumns({"language_document_kept": kept, "text": F.when(kept, F.col("text")).otherwise("")})
    out = C.change_metrics(N.normalize_whitespace(N.normalize_symbols(out)), "before", "text")
    return out.filter(F.col("text").rlike(r"\S")).drop("before", "removed_lines")


_PIPE = _chain("documents", _removals(P.ARTEFACTS | P.CITATIONS))
_PIPE_LINES = f"(SELECT doc_id, {_STRIP} AS st, line, i FROM {_lines('done', 't')})"
_PIPE_TEXT = _N17.replace("text", "kept")


@query(
    f"WITH {_PIPE}, marked AS (SELECT * FROM {_ranked(_PIPE_LINES)}), j AS (SELECT doc_id, count(reason) AS removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE reason IS NULL), '') AS kept FROM marked GROUP BY 1), "
    f"n AS (SELECT doc_id, removed, {_PIPE_TEXT} AS clean FROM j) SELECT doc_id, CAST(removed AS INT) AS lines_removed, md5(clean) AS digest FROM n WHERE regexp_matches(clean, '[^ \\t\\n\\x0B\\f\\r]')"
)
def x13_pipeline_registry(s: SparkSession, d: str) -> DataFrame:
    """The registry of named steps, run as a pipeline of DataFrame -> DataFrame functions."""
    from corpusloom.plans.pipeline import run_pipeline

    out = run_pipeline(t(s, d, "documents").select("doc_id", "text"), ["artefacts", "citations", "lines", "whitespace", "non_empty"])
    return out.select("doc_id", "lines_removed", F.md5("text").alias("digest"))
