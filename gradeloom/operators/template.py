"""What of a text is the author's own and what a template's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import n_words, normal_line, split_lines

PAGE_BREAK = "\f"


#: White space as Unicode has it, with the separators that only some engines count.
_BLANK = r"[\s\x1C-\x1F]+"


def phrase_pattern(phrase: str) -> str:
    """A phrase whatever breaks, spaces or page numbers stand between its words."""
    return "(?iU)" + (_BLANK + r"(?:\d{1,3}" + _BLANK + ")?").join(re.sub(r"([^\w])", r"\\\1", w) for w in phrase.split())


def _without(text: Column, phrase: str) -> tuple[Column, Column]:
    """The text with each place of the phrase as a blank and the page ends that it crossed, and how many there are."""
    places = F.regexp_extract_all(text, F.lit(phrase_pattern(phrase)), F.lit(0))
    gaps = F.transform(places, lambda m: F.concat(F.lit(" "), F.regexp_replace(m, f"[^{PAGE_BREAK}]", "")))
    kept = F.split(text, phrase_pattern(phrase))
    glued = F.array_join(F.zip_with(kept, gaps, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(places) > 0, glued).otherwise(text), F.size(places)


def _cleaned(rows: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Column ``text`` without the phrases, taken out one after another, and n_removed; lines left blank are emptied."""
    rows = rows.withColumn("n_removed", F.lit(0))
    for phrase in phrases:
        rest, n = _without(F.col(text), phrase)
        rows = rows.withColumns({text: rest, "n_removed": F.col("n_removed") + n})
    return rows.withColumn(text, F.regexp_replace(text, r"(?dm)^[ \t\r]+$", ""))


def strip_phrases(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """Take a template's phrases out of each document, across page ends too, and count them: doc_id, page_no, text, n_removed.

    pages: doc_id, page_no, text; a null text is an empty page, a page_no that occurs twice two pages, by text.
    Page ends inside a phrase stay, so pages keep their number. A document of which a page holds the mark of
    a page end itself is cleaned page by page, with the count of the whole. ``phrases`` is the template's own
    short list, longest first where one holds another; none leaves all but blank lines as it is.
    """
    listed = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    whole = pages.groupBy("doc_id").agg(listed.alias("_p")).withColumn("_t", F.array_join(F.transform("_p", lambda p: p["text"]), PAGE_BREAK))
    whole = _cleaned(whole, "_t", phrases).withColumn("_c", F.split("_t", PAGE_BREAK))
    ragged = F.size("_c") != F.size("_p")
    numbers, given = F.transform("_p", lambda p: p["page_no"]), F.transform("_p", lambda p: p["text"])
    zipped = F.arrays_zip(numbers.alias("page_no"), F.when(ragged, given).otherwise(F.col("_c")).alias("text"))
    each = whole.select("doc_id", F.col("n_removed").alias("_n"), ragged.alias("_ragged"), F.explode(zipped).alias("_z")).select("doc_id", "_z.page_no", "_z.text", "_n", "_ragged")
    # Null but for pages of ragged documents, so the second pass looks at no others.
    each = _cleaned(each.withColumn("_own", F.when(F.col("_ragged"), F.col("text"))), "_own", phrases)
    return each.select("doc_id", "page_no", F.coalesce("_own", "text").alias("text"), F.col("_n").alias("n_removed"))


def own_lines(sections: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of column text that are neither blank, nor numbers alone, nor a line of the template."""
    each = sections.select(*keys, F.posexplode(split_lines(F.col("text"))).alias("_i", "_l")).withColumn("_n", normal_line(F.col("_l")))
    each = each.where((F.col("_n") != "") & ~F.col("_n").rlike(r"^[\d\s.\-–]+$"))
    known = template.select(normal_line(F.col("line")).alias("_n")).distinct()
    return each.join(known, "_n", "left_anti")


def own_words(sections: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, own_words, own_text) of each section; 0 and empty where nothing is its own."""
    kept = own_lines(sections, template, keys).groupBy(*keys).agg(
        F.sum(n_words(F.col("_n"))).cast("int").alias("own_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_l"))), lambda x: x["_l"]), "\n").alias("own_text")
    )
    out = sections.select(*keys).join(kept, keys, "left")
    return out.select(*keys, F.coalesce("own_words", F.lit(0)).alias("own_words"), F.trim(F.regexp_replace(F.coalesce("own_text", F.lit("")), r"[ \t]+", " ")).alias("own_text"))
