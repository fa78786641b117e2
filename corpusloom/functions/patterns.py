"""Fixed values of the cleaning rules: patterns, word lists and character maps. Java regular expressions unless said otherwise."""

# Artefacts, removed in this order without validation.
ARTEFACTS = {
    "email_addresses": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[^\s]+|ftp://[^\s]+|www\.[^\s]+",
    "doi_references": r"\bdoi:\s*[\w\./\-]+|\b10\.\d{4,}/[^\s]+",
    "isbn_references": r"\bISBN[-\s]*:?\s*[\d\-xX]+",
    "arxiv_references": r"\barXiv:\s*[\w\./\-]+",
}
_AUTHOR = r"[A-Z][A-Za-z'-]+(?:\s+(?:and|et)\s+[A-Z][A-Za-z'-]+)?(?:,\s*Jr\.?)?(?: et al\.)?,\s*\d{4}[a-z]?"
_ANY = r"[\w\u00C0-\u017F\u0400-\u04FF\u4E00-\u9FFF\u0590-\u05FF\u0600-\u06FF]+"
_ANY_AUTHOR = rf"{_ANY}(?:\s+(?:and|et|und|y)\s+{_ANY})*(?:,\s*Jr\.?)?(?: et al\.)?,\s*\d{{4}}[a-z]?"
# Citations. The first group of types needs no validation, the second is validated by its surroundings.
CITATIONS = {
    "eckige_klammern_numerisch": r"\[\s*+\d++(?:,\s*+\d++)*+\s*+(?:-\s*+\d++)?\s*+\]",
    "consecutive_numeric_citations": r"(?>\(\s*\d++\s*\)){2,}",
    "autor_jahr_multi_klammer": rf"\((?:{_AUTHOR}\s*;\s*)+{_AUTHOR}\)",
    "autor_jahr_klammer_einzel": rf"\({_AUTHOR}\)",
    "autor_jahr_eckig_einzel": rf"(?U)\[{_ANY_AUTHOR}\]",
    "autor_jahr_eckig_multi": rf"(?U)\[(?:{_ANY_AUTHOR}\s*;\s*)+{_ANY_AUTHOR}\]",
}
VALIDATED = {
    "semicolon_blocks": r"(?:^|\s)(?:[A-Za-z][A-Za-z0-9\-]*(?:\s+\d+)?\s*;\s*)(?:[A-Za-z][A-Za-z0-9\-]*(?:\s+\d+)?\s*;\s*)*[A-Za-z][A-Za-z0-9\-]*(?:\s+\d+)?(?:\s*;)?(?:\s|$)",
    "isolated_numeric_citations": r"\(\s*\d{1,3}\s*\)(?!\s*[A-Za-z°%])",
    "ref_nummer": r"(?i)\b(?:ref|refs)\.?\s*\d+(?:,\s*\d+)*(?:-\s*\d+)?\b",
    "page_references": r"(?i)(?:^|\s)(?:p|pp|page|pages)\.?\s*\d+(?:-\d+)?(?:,\s*\d+(?:-\d+)?)*(?=\s|$)",
}
# Words that no author list has.
STOPWORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after",
    "above", "below", "between", "among", "this", "that", "these", "those", "a", "an", "as", "be", "is", "are", "was", "were", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "form", "however", "therefore", "thus", "also",
    "only", "just", "even", "still", "yet", "already", "now", "then", "here", "there", "where", "when", "why", "how", "what", "which", "who", "whom",
    "whose", "very", "much", "more", "most", "many", "some", "any", "each", "every", "all", "both", "either", "neither",
]
# Signs that no author's name has.
NO_NAME = r"^\d+$|[()\[\]{}+=<>|\\/@#$%^&*]"
# Words near a page reference. The first mark a citation, the second the text's own structure, the third running prose.
CITATION_MARKS = ["see", "cf.", "compare", "according to", "as shown in", "following", "refer to", "shown in", "presented in", "detailed in"]
STRUCTURE_MARKS = ["presents", "shows", "reports", "estimates", "demonstrates", "columns", "panel", "specification", "regression", "model", "analysis", "results", "findings", "outcome"]
PROSE_MARKS = ["the", "that", "this", "which", "where", "when", "how", "what", "we", "our", "using", "with", "for", "from", "on", "in", "at"]
# Verbs of which a cited author is the subject.
ACADEMIC_VERBS = [
    "defined", "explored", "investigated", "studied", "analyzed", "examined", "found", "showed", "demonstrated", "reported", "concluded", "suggested",
    "proposed", "argued", "claimed", "stated", "noted", "observed", "discovered", "revealed", "indicated", "pointed", "emphasized", "discussed",
    "described", "explained", "identified", "established", "conducted", "performed", "collected", "measured", "compared", "developed", "created",
    "designed", "implemented", "tested",
]
# Nouns before and connectives behind a citation that is part of its sentence.
RESEARCH_NOUNS = ["research", "study", "work", "findings", "analysis"]
CONNECTIVES = ["also", "further", "additionally", "moreover"]
# What ends a sentence before a citation, and words that only point at one.
SENTENCE_ENDS = [". ", "! ", "? ", "\n\n", "\n "]
POINTING = r"\b(?:see|cf\.|according to|as noted by|as shown by)\s*$"
# A list item's number, a simple page reference, an author's name (the first two without regard to case).
LIST_ITEM = r"^\s*(\([a-zA-Z0-9]+\)|[a-zA-Z0-9]+\)|[a-zA-Z0-9]+\.|\([ivxlcdm]+\)|[ivxlcdm]+\.)\s*$"
SIMPLE_PAGE = r"p\.?\s*\d+"
AUTHOR_NAME = r"^[A-Za-z0-9\-'\.\s]+$"
# Short lines.
SHORT_LINES = [
    ("keywords_metadata", r"(?i)^KEYWORDS?:\s+"),
    ("isolated_table_reference", r"(?i)^TABLE\s+\d+$"),
    ("isolated_figure_reference", r"(?i)^FIGURE\s+\d+$"),
    ("isolated_chapter_reference", r"(?i)^CHAPTER\s+\d+$"),
    ("page_number", r"(?i)^p\.?\s*\d+$"),
    ("numeric_junk", r"^[\d\s.,;\-()]+$"),
]
KEYWORD_LINE = r"^[Kk]eywords?:\s+"
CODE_START = r"^[A-Z0-9\-]{2,}\s+[A-Z0-9\-]{2,}"
ALL_CAPS = r"^[A-Z0-9\s\-.]+$"
COPYRIGHT = r"(?i)©|copyright|\(c\)|all rights reserved"
CAPTION = r"(?i)^(?:fig|figure|tab|table|tbl)\.?\s*\d+(?:\.\d+)?[\s:]*"
NUMERIC_WORD = r"^\d+\.?\d*$"
# Signs of mathematics that keep a line.
MATH = "|".join(
    [
        "[αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ]", "[∂∇∑∏∫≡≠≤≥±∓×÷∈∉⊂⊃∪∩]", "⟨[^⟩]*⟩", r"\|[^|]*⟩", r"⟨[^|]*\|",
        "[a-zA-Z]+_[a-zA-Z0-9]+", r"[a-zA-Z]+\^[a-zA-Z0-9]+", r"\\[a-z]+\{[^}]*\}", "[a-zA-Z]+=.*[a-zA-Z]", "[ℋℰℱℊℌℍℎℏℐ]", "[Π†‡°µ]",
    ]
)
# Lines that may open an appendix (all without regard to case).
SECTION_STARTS = "(?i)" + "|".join(
    [
        r"^table\s+\d+", r"^tab\s+\d+", r"^figure\s+\d+", r"^fig\s+\d+", r"^acknowledgments?$", r"^acknowledgements?$", r"^references?$", r"^bibliography$", "^appendix",
        "^supplementary", r"^gene\s+symbol", r"^protein\s+name", r"^antibody\s+supplier", r"^[A-Z][A-Z0-9]+\s+[A-Z][A-Z0-9]+\s+[A-Z][A-Z0-9]+",
    ]
)
# Type of an appendix section, the share that must be exceeded, its weight.
SECTION_INDICATORS = [("technical_table", 0.35, 0.3), ("gene_list", 0.4, 0.25), ("tabular_data", 0.7, 0.2), ("formatted_table", 0.3, 0.3), ("gene_table", 0.3, 0.35), ("numeric_data", 0.8, 0.25)]
# Symbols and what stands for them, in the order of the groups.
INVISIBLE = "\u2062\u2063\u2061"
TOC = [r"(?U)\w++[.\s]{5,}+\d+", r"^[.\t\s]{10,}$", r"(?U)\w++[.\t]{5,}+\w+"]
TABULAR = [r"^[\d\t\s.]{20,}$", r"^.*\t.*\t.*\t.*$"]
DOTS = [(r"\.{4,}", "..."), (r"(?:\. ){3,}", " ... ")]
CYRILLIC = ("аеорсухАВЕКМНОРСТУХинть", "aeopcyxABEKMHOPCTYXuhtb")
DASHES = "−‐–—"
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "‚": ",", "„": '"', "‹": "<", "›": ">", "«": "<<", "»": ">>", "❛": "'", "❜": "'", "❝": '"', "❞": '"'}
BULLETS = "•‣‧⁃◦⁌⁍"
ARROWS = {"→": "->", "←": "<-", "↔": "<->", "⇒": "=>", "⇐": "<=", "⇔": "<=>", "⟶": "-->", "⟵": "<--", "⟷": "<-->"}
LEGAL = {"©": "(c)", "®": "(R)", "™": "(TM)", "§": "section", "¶": "paragraph"}
PRIMES = {"′": "'", "″": "''"}
ELLIPSES = {"…": "...", "⋯": "..."}
#: Text given to both engines, so that every rule meets its case. The key is the remainder of doc_id by 7.
INJECTED = {
    0: " see [1, 2] and [3-5] end",
    1: " shown (Smith et al., 2020a) and (Lee, 2019; Kim, 2021) here",
    2: " (1)(2)(3) then (25 °C) and ( 7 )",
    3: " mail a.b@c.org or http://x.y/z or www.q.org doi:10.1000/xyz arXiv:1234.5678 ISBN 978-1-23",
    4: "\nTable 5\nFigure 2.1: caption\np. 12\nKEYWORDS: a\n12 34 5",
    5: "\na\tb\tc\nd\te\tf\nplain\nplain\n© 2020 X",
    6: "x  y\t z\n\n\n\n  Lead. A → B … ‘q’ “r” • item – dash",
}
