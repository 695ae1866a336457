"""Deterministic measures of a document's text and of its citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import ease_band, letter_tokens, mean_sentence_words, n_words, readability, szigriszt, type_token_ratio
from gradeloom.session import materialise

#: How citations and entries of a reference list are written.
SURNAME = r"[A-ZÁÉÍÓÚÑ][\p{L}\p{N}_'\-]+"
#: The repeated group keeps what it has matched, as giving it back can lead to no other match; else a long list of names recurses until the stack is full.
NARRATIVE = rf"({SURNAME})(?:\s*(?:,|y|e|&)\s*{SURNAME})*+(?:\s+et\s+al\.?)?\s*\((\d{{4}})[a-z]?\)"
IN_BRACKETS = r"\(([^()]*\d{4}[a-z]?[^()]*)\)"
BRACKET_ITEM = rf"^\s*({SURNAME})[^;()]*?(\d{{4}})[a-z]?"
LIST_TITLE = r"(?im)^\s*(?:\d{1,2}[\.\)]?\s*)?(?:REFERENCIAS(?:\s+BIBLIOGR[ÁA]FICAS)?|BIBLIOGRAF[ÍI]A)\s*$"
LIST_END = r"(?im)^\s*(?:ANEXOS?|AP[ÉE]NDICES?)\s*$"
ENTRY_START = rf"\n(?=\s*{SURNAME}(?:\s+{SURNAME})?,\s)"
ENTRY = rf"^\s*({SURNAME}(?:\s+{SURNAME})?)\s*,"


def mtld(tokens: Column, threshold: float = 0.72, least: int = 10) -> Column:
    """Lexical diversity: tokens a factor, mean of both directions, 2 places; 0 without factors, null without tokens.

    A stretch of ``least`` tokens or more is a factor as soon as its ratio of distinct tokens is
    below the threshold, unless it is the last; the last counts by how far its ratio has fallen.
    The state is the set of a stretch's tokens, so this is one Arrow-batched function.
    """

    def factors(ids: list) -> float:
        begin, whole = 0, 0
        while True:
            seen: set = set()
            for end in range(begin, len(ids)):
                seen.add(ids[end])
                size = end - begin + 1
                if size >= least and len(seen) < threshold * size and end < len(ids) - 1:
                    begin, whole = end + 1, whole + 1
                    break
            else:
                return whole + (1 - len(seen) / (len(ids) - begin)) / (1 - threshold)

    @F.pandas_udf("double")
    def of(batch: pd.Series) -> pd.Series:
        def both(words):
            if words is None or not len(words):
                return None
            parts = [factors(w) for w in (list(words), list(words)[::-1])]
            return sum(len(words) / f if f > 0 else 0.0 for f in parts) / 2

        return batch.map(both)

    return F.round(of(tokens), 2)


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words, lexical diversity, sentence length and ease of reading, one row a document."""
    t = F.col(text)
    out = docs.withColumn("_tok", letter_tokens(F.coalesce(t, F.lit(""))))
    out = out.withColumns({"words": n_words(t), "ttr": type_token_ratio(F.col("_tok")), "mtld": F.when(F.size("_tok") >= 50, mtld(F.col("_tok"))), "mean_sentence_words": mean_sentence_words(t), "ease": readability(t), "perspicuity": szigriszt(t)})
    return out.withColumn("ease_band", ease_band(F.col("ease"))).drop("_tok")


def completeness(sections: DataFrame) -> DataFrame:
    """Share of sections present, 4 places, and words in them. sections: doc_id, present, words."""
    return sections.groupBy("doc_id").agg(F.round(F.count_if("present") / F.count("*"), 4).alias("completeness"), F.sum(F.when(F.col("present"), F.col("words")).otherwise(0)).alias("words"))


def bodies(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, full_text, body, section_words, sections_present, sections, completeness), one row a document.

    docs: doc_id, full_text. sections: doc_id, pos, section_id, present, words, text. The body is
    the present sections' texts in order, parted by blank lines, or the whole text where that is
    empty. section_words has every section, in the order of pos. Sections of a document are a
    rubric's, so a group is small.
    """
    part = F.struct("pos", "section_id", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("text", F.lit("")).alias("text"))
    packed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("_s"))
    out = docs.select("doc_id", "full_text").join(packed, "doc_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast(packed.schema["_s"].dataType)))
    there, n = F.filter("_s", lambda s: s["present"]), F.size("_s")
    joined = F.array_join(F.transform(there, lambda s: s["text"]), "\n\n")
    return out.select(
        "doc_id", "full_text", F.coalesce(F.nullif(joined, F.lit("")), "full_text", F.lit("")).alias("body"),
        F.transform("_s", lambda s: F.struct(s["section_id"].alias("section_id"), s["words"].alias("words"))).alias("section_words"),
        F.size(there).alias("sections_present"), n.alias("sections"), F.when(n > 0, F.round(F.size(there) / n, 4)).otherwise(0.0).alias("completeness"),
    )


def document_metrics(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """All deterministic measures of a document: its body's text, words by section, completeness, citations."""
    whole = bodies(docs, sections)
    return text_metrics(whole, "body").join(citation_report(whole), "doc_id", "left").drop("full_text", "body")


def citations(docs: DataFrame, body: str = "body") -> DataFrame:
    """Distinct (doc_id, surname, year) that a body cites, in running text or in brackets."""
    t = F.coalesce(F.col(body), F.lit(""))
    told = F.transform(F.regexp_extract_all(t, F.lit(NARRATIVE), F.lit(0)), lambda m: F.struct(F.lower(F.regexp_extract(m, NARRATIVE, 1)).alias("surname"), F.regexp_extract(m, NARRATIVE, 2).alias("year")))
    items = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(IN_BRACKETS), F.lit(1)), lambda m: F.split(m, ";")))
    noted = F.transform(F.filter(items, lambda x: x.rlike(BRACKET_ITEM)), lambda x: F.struct(F.lower(F.regexp_extract(x, BRACKET_ITEM, 1)).alias("surname"), F.regexp_extract(x, BRACKET_ITEM, 2).alias("year")))
    return docs.select("doc_id", F.explode(F.array_distinct(F.concat(told, noted))).alias("_c")).select("doc_id", "_c.*")


def references(docs: DataFrame, full: str = "full_text") -> DataFrame:
    """Distinct (doc_id, surname, year) of the entries of the reference list."""
    after = F.try_element_at(F.split(F.coalesce(F.col(full), F.lit("")), LIST_TITLE, 2), F.lit(2))
    listed = F.split(F.concat(F.lit("\n"), F.element_at(F.split(after, LIST_END, 2), 1)), ENTRY_START)
    entries = F.filter(listed, lambda e: e.rlike(ENTRY) & e.rlike(r"\(\d{4}[a-z]?\)"))
    rows = F.transform(entries, lambda e: F.struct(F.lower(F.regexp_extract(e, ENTRY, 1)).alias("surname"), F.regexp_extract(e, r"\((\d{4})[a-z]?\)", 1).alias("year")))
    return docs.select("doc_id", F.explode(F.array_distinct(rows)).alias("_r")).select("doc_id", "_r.*")


def _tokens(surname: Column) -> Column:
    return F.filter(F.split(F.trim(surname), r"[\s\-]+"), lambda t: F.length(t) >= 3)


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left without a row of right of the same document and year and a like surname."""
    a = left.withColumn("_a", _tokens(F.col("surname")))
    b = right.select("doc_id", "year", F.col("surname").alias("_s"), _tokens(F.col("surname")).alias("_b"))
    hit = a.join(b, ["doc_id", "year"]).where((F.col("surname") == F.col("_s")) | F.arrays_overlap("_a", "_b")).select("doc_id", "surname", "year").distinct()
    return left.join(hit, ["doc_id", "surname", "year"], "left_anti")


def citation_report(docs: DataFrame) -> DataFrame:
    """Counts of citations and references, and both lists of what has no counterpart; one row a doc_id.

    Both tables are written once, as each is read three times. Texts of one doc_id count together.
    """
    cited, listed = materialise(citations(docs).distinct(), "cited"), materialise(references(docs).distinct(), "listed")
    shown = F.array_sort(F.collect_list(F.concat("surname", F.lit(" ("), "year", F.lit(")"))))
    out = docs.select("doc_id").distinct()
    for name, rows, agg in (("n_citations", cited, F.count("*")), ("n_references", listed, F.count("*")), ("uncited", unmatched(listed, cited), shown), ("unreferenced", unmatched(cited, listed), shown)):
        out = out.join(rows.groupBy("doc_id").agg(agg.alias(name)), "doc_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_references", F.lit(0)).alias("n_references"), F.coalesce("unreferenced", empty).alias("unreferenced"), F.coalesce("uncited", empty).alias("uncited"))
