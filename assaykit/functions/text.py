"""Text expressions: skill names, buzzwords, words, sentences, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name endings that do not tell two skills apart.
SKILL_ENDINGS = ["js", "ts", "py", "rb", "go", "net", "io"]

# Phrases counted as awkward machine-made language ("." is any character).
BUZZWORDS = [
    "leverage[sd]?",
    "synerg(y|ies|ize[sd]?)",
    "paradigm shift",
    "thought leader",
    "disrupt(ive|ed|ing)?",
    "deep dive",
    "holistic approach",
    "best.in.class",
    "cutting.edge",
    "results.driven",
    "self.starter",
    "team player",
    "go.getter",
    "dynamic professional",
    "proven track record",
    "value.add",
]

# Words inside a job title and the seniority rank they signal; the first row that matches wins.
TITLE_RANKS = [
    (0, ["intern", "junior", "jr."]),
    (1, ["associate", "analyst", "coordinator"]),
    (2, ["staff", "senior", "sr."]),
    (3, ["lead", "principal", "architect"]),
    (4, ["director", "vp ", "vice president", "head of", "chief", "cto", "ceo"]),
]

NOT_WORD = r"[^\p{L}\p{N}_]+"


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ASCII_SPACE = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` alone drops only spaces)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def normalize_skill(c: Column) -> Column:
    """Lower-case skill name without one trailing version and, before it, one trailing file-like ending."""
    tail = r"(?U)(\.(" + "|".join(SKILL_ENDINGS) + r"))?(\s+v?\d[\d.]*)?$"
    return strip(F.regexp_replace(F.lower(strip(c)), tail, ""))


def skill_set(names: Column) -> Column:
    """Distinct normalized names of an array of skill names."""
    return F.array_distinct(F.transform(names, normalize_skill))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays; two empty arrays give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def phrase_pattern(phrases: list[str]) -> str:
    """Case-insensitive, word-bounded alternation; U = Unicode classes, d = only newline ends a line."""
    return r"(?idU)\b(" + "|".join(phrases) + r")\b"


def phrase_count(c: Column, phrases: list[str] | None = None) -> Column:
    """Number of non-overlapping phrase matches, repeats included."""
    return F.regexp_count(c, F.lit(phrase_pattern(phrases or BUZZWORDS)))


def title_rank(title: Column) -> Column:
    """Seniority rank signalled by a title, NULL when no keyword occurs."""
    lowered = F.lower(title)
    ranked = None
    for rank, words in TITLE_RANKS:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        ranked = F.when(hit, F.lit(rank)) if ranked is None else ranked.when(hit, F.lit(rank))
    return ranked


def words(c: Column) -> Column:
    """Lower-case word tokens: runs of letters, digits and underscore in any script."""
    return F.array_remove(F.split(F.lower(c), NOT_WORD, -1), "")


def spaced_words(c: Column) -> Column:
    """White-space words, each with the white space that follows it, so that the pieces tile the text."""
    return F.regexp_extract_all(c, F.lit(r"\S+\s*"), F.lit(0))


def sentence_pieces(c: Column) -> Column:
    """Cut after . ! ? when white space follows; the pieces tile the text (white space leads the next piece)."""
    return F.split(c, r"(?<=[.!?])(?=\s)", -1)


def squeeze(c: Column) -> Column:
    """Drop ASCII white space at both ends (the characters the word and sentence cutters use)."""
    return F.btrim(c, F.lit(ASCII_SPACE))


def leading_space(c: Column) -> Column:
    """Number of ASCII white-space characters in front."""
    return F.length(c) - F.length(F.ltrim(c, F.lit(ASCII_SPACE)))
