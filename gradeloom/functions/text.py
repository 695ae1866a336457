"""Text functions as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> tuple[str, str]:
    """(letters, what they are without marks) of all Latin letters that decompose; the marks themselves come last and stand for nothing."""
    letters = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), (0x212A, 0x212B)) for c in block]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in letters}
    folded = {c: b for c, b in bare.items() if b != c and len(b) == 1}
    return "".join(folded) + "".join(map(chr, range(0x300, 0x370))), "".join(folded.values())


_ACCENTED, _PLAIN = _folding()
#: What Python's splitlines parts at.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Where a line begins, with its blanks: for finding the pages that have a line of some kind before parting any.
LINE_START = r"(?:^|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])(?U:[\s&&[^\n\r\x0B\x0C\x85\u2028\u2029]])*+"
ZERO_WIDTH = "\u200b"
INVISIBLE = "\u200c\u200d\u2060\ufeff\u00ad"


def clean_invisible(text: Column) -> Column:
    """Zero-width spaces become spaces; other invisible characters go."""
    return F.translate(text, ZERO_WIDTH + INVISIBLE, " ")


def fold_accents(text: Column) -> Column:
    """Lower case without accents, trimmed: for comparing headings with aliases."""
    return F.translate(F.lower(F.trim(text)), _ACCENTED, _PLAIN)


def normal_line(line: Column) -> Column:
    """Lower case with single spaces, accents kept: for comparing lines with a template's."""
    return F.lower(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")))


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a last empty one does not count."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def space_words(text: Column) -> Column:
    """Words parted by white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(space_words(text))


def word_tokens(text: Column) -> Column:
    """Unicode word tokens, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Tokens of Spanish letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúñü]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences, trimmed, without empty ones; final punctuation ends one before white space or at the end, so 3.14 stays whole."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)[.!?]+(?:\s|$)"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != "")


def type_token_ratio(tokens: Column, least: int = 50) -> Column:
    """Distinct over all tokens, 4 places; null below ``least`` tokens."""
    return F.when(F.size(tokens) >= least, F.round(F.size(F.array_distinct(tokens)) / F.size(tokens), 4))


def mean_sentence_words(text: Column, least: int = 3) -> Column:
    """Mean words of the sentences that have ``least``, 2 places; null without any."""
    sizes = F.filter(F.transform(sentences(text), lambda s: F.size(F.split(s, " "))), lambda n: n >= least)
    return F.when(F.size(sizes) > 0, F.round(F.aggregate(sizes, F.lit(0), lambda a, n: a + n) / F.size(sizes), 2))


def syllables(text: Column) -> Column:
    """Vowel groups: a fixed rule for Spanish, one for each run of vowels, two for split hiatus with í or ú."""
    low = F.lower(text)
    return F.regexp_count(low, F.lit("[aeiouáéíóúü]+")) + F.regexp_count(low, F.lit("[aeoáéó][íú]|[íú][aeoáéó]"))


def _per_word(text: Column) -> tuple[Column, Column]:
    """Syllables a word and words a sentence."""
    words = F.size(letter_tokens(text)).cast("double")
    return F.coalesce(F.try_divide(syllables(text).cast("double"), words), F.lit(0.0)), words / F.greatest(F.size(sentences(text)), F.lit(1))


def readability(text: Column) -> Column:
    """Fernández-Huerta ease of reading, 2 places; null below 30 words."""
    spoken, long = _per_word(text)
    return F.when(n_words(text) >= 30, F.round(206.84 - 60.0 * spoken - 1.02 * long, 2))


def szigriszt(text: Column) -> Column:
    """Szigriszt-Pazos perspicuity, 2 places; null below 30 words."""
    spoken, long = _per_word(text)
    return F.when(n_words(text) >= 30, F.round(206.835 - 62.3 * spoken - long, 2))


#: Least ease of each band.
EASE_BANDS = (
    (90, "muy fácil"), (80, "fácil"), (70, "algo fácil"), (60, "normal"),
    (50, "algo difícil"), (30, "difícil"), (0, "muy difícil"),
)


def ease_band(value: Column) -> Column:
    """The band's name; below zero the last one's."""
    band = F.when(value.isNull(), None)
    for least, name in EASE_BANDS:
        band = band.when(value >= least, name)
    return band.otherwise(EASE_BANDS[-1][1])


#: Expressions that soften a claim.
HEDGES = (
    r"probablemente", r"posiblemente", r"presumiblemente", r"aparentemente", r"al parecer", r"quiz[aá]s?",
    r"tal vez", r"podr[ií]a(n)?", r"pudiera(n)?", r"puede(n)? que", r"es posible que", r"es probable que",
    r"suele(n)?", r"tiende(n)? a", r"en general", r"generalmente", r"por lo general", r"habitualmente",
    r"frecuentemente", r"a menudo", r"en la mayor[ií]a de", r"en gran medida", r"en cierta medida",
    r"en parte", r"solo en parte", r"parcialmente", r"relativamente", r"en principio",
    r"parece(n)? que", r"sugiere(n)? que", r"se estima que",
    r"pr[aá]cticamente (nul[oa]s?|inexistentes?|ningun[oa]?s?|imposibles?|todos?|todas?|iguales?|ausentes?)",
)


def hedges(sentence: Column) -> Column:
    """Hedging expressions of a sentence, as written."""
    return F.regexp_extract_all(sentence, F.lit(r"(?iuU)\b(" + "|".join(HEDGES) + r")\b"), F.lit(0))
