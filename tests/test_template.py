"""Template phrases taken out across page ends, against a plain walk over joined pages."""

import re

from gradeloom.operators import template

PHRASES = ["Some text (as is) that the form, of course, brings along.", "Choose one.", "Some text (as is) that"]
PAGES = {
    1: ["1. Aim\nSome text (as is)\nthat the form, of\n4", "course, brings  along.\n2. Line"],
    2: ["choose\u00a0ONE. kept Choose 12 one. Choose 1234 one.", None, "", "  \n \t\nx"],
    3: ["Some text (as is) that I changed", "Choose", "7\none.\nend"],
    4: ["own \f break", "Choose one.\nSome text (as is)", "that"],
    5: ["nothing of it\u2028  \u2028here"],
}


def walk(pages):
    gap = r"[\s]+(?:\d{1,3}[\s]+)?"
    patterns = [re.compile(gap.join(map(re.escape, p.split())), re.IGNORECASE) for p in PHRASES]

    def clean(text):
        removed = 0
        for pattern in patterns:
            text, n = pattern.subn(lambda m: " " + "\f" * m[0].count("\f"), text)
            removed += n
        return "\n".join(line if line.strip(" \t\r") else "" for line in text.split("\n")), removed

    pages = [p or "" for p in pages]
    text, removed = clean("\f".join(pages))
    parts = text.split("\f")
    return (parts if len(parts) == len(pages) else [clean(p)[0] for p in pages]), removed


def test_phrases_go_across_page_ends_and_pages_stay(spark):
    rows = [(d, i, t) for d, texts in PAGES.items() for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(3)
    got = {(r.doc_id, r.page_no): (r.text, r.n_removed) for r in template.strip_phrases(pages, PHRASES).collect()}
    want = {d: walk(texts) for d, texts in PAGES.items()}
    assert got == {(d, i): (t, n) for d, (texts, n) in want.items() for i, t in enumerate(texts)}
    assert want[1][1] == 1 and want[2][1] == 2 and want[4][1] == 2 and "course" not in got[1, 1][0]
    assert template.strip_phrases(pages.limit(0), PHRASES).count() == 0
    assert template.strip_phrases(pages, []).where("n_removed = 0").count() == len(rows)
