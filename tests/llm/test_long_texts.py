import time

import numpy as np

from gradeloom.llm.line_dedup import _lines, dedup_lines


def test_lines_leave_a_text_of_many_lines_in_proportion(spark):
    """A text that drops every second of 100,000 lines, beside its first, last and all lines dropped."""
    many = "\n".join(f"record {i:06d} of the log" if i % 2 == 0 else "the same line over and over" for i in range(100_000))
    short = [(2, "the same line over and over\nkept line of text two"), (3, "kept line of text three\nthe same line over and over"), (4, "the same line over and over"), (5, None), (6, "\n")]
    docs = spark.createDataFrame([(1, many), *short], "doc_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: r for r in dedup_lines(docs, least_chars=100).collect()}
    took = time.monotonic() - began
    lines = many.split("\n")
    assert found[1].text == "\n".join([*lines[:2], *lines[2::2]])
    assert (found[1].n_lines, found[1].n_dropped) == (100_000, 49_999)
    assert {k: found[k].text for k in (2, 3, 4, 5, 6)} == {2: "kept line of text two", 3: "kept line of text three", 4: "", 5: None, 6: "\n"}
    assert took < 120


def test_texts_that_end_in_a_break_keep_their_numbers():
    """Slices of texts with breaks at either end, empty ones among them, against a plain split."""
    for texts in (["a\n", "b\nc"], ["a\n"], ["", "\n", "\n\n", "", "x\n", ""], ["\nä\n\nö\n", "ü", "\n"], ["", ""]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        owner, number, start, end, points, found = _lines(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        want = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line.strip()]
        assert list(zip(owner.tolist(), number.tolist(), [f.decode() for f in found], strict=True)) == want
        assert ["".join(map(chr, points[a:b])) for a, b in zip(start, end, strict=True)] == [w[2] for w in want]


def test_lines_behind_a_text_that_ends_in_a_break_go_at_their_own_places(spark):
    texts = ["one line of some length\n", "another line of its own\none line of some length\nlast line that is here\n", "one line of some length\n\nnew line of this text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert found == {0: texts[0], 1: "another line of its own\nlast line that is here\n", 2: "\nnew line of this text"}
