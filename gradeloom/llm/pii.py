"""Personal data: fixed patterns, and further spans by a conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import batch, crf

BASE = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*BASE, *crf.KINDS))}

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by code points; every pattern in time linear in the text."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return in_order(out)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def labelled_examples(spark: SparkSession | None = None, *, rows: int = 1200, seed: int = 3):
    """The small labelled table that the field learns from: text and its marked spans.

    Texts are built from phrases by rule; the spans are positions of what was filled in.
    With a session, a DataFrame (text, spans); without one, a list.
    """
    draw = random.Random(seed)
    given, family = ("Anna", "Jonas", "Marie", "Pablo", "Greta", "Louis", "Ines", "Peter"), ("Weber", "Martin", "Garcia", "Novak", "Smith", "Dupont", "Keller", "Rossi")
    parts = ("tion", "er", "an", "the", "re", "on", "lich", "eau", "mente", "ar", "ung", "os", "ing", "éle", "ç", "ñar", "ü")
    pick = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
    mixed = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))

    def prose(n):
        out = []
        for _ in range(n):
            w = word()
            roll = draw.random()
            w = w.capitalize() if roll < 0.15 else w.upper() + "!!" if roll < 0.2 else w + draw.choice("***$$$&&&%%%###") if roll < 0.24 else w
            out.append(w + draw.choice(("", "", "", "", ",", ".")))
        return " ".join(out)

    marked = {
        "name": lambda: draw.choice((f"{draw.choice(given)} {draw.choice(family)}", draw.choice(family))),
        "tel": lambda: draw.choice((f"{pick(3)}-{pick(3)}-{pick(4)}", f"({pick(3)}) {pick(3)} {pick(4)}", f"{pick(3)} {pick(4)} {pick(4)}", f"{pick(5)} {pick(6)}")),
        "national_id": lambda: draw.choice((f"{pick(3)}-{pick(2)}-{pick(4)}", f"X{pick(7)}", pick(8), f"{pick(8)}Z")),
        "secret": lambda: draw.choice((mixed(40), mixed(32), mixed(24))),
    }
    before = {
        "name": ("Mr. ", "Mrs. ", "Dr. ", "Prof. ", "My name is ", "my name is ", "Name: ", "signed, ", "Herr ", "Frau ", "Monsieur ", "Sr. ", "Sra. ", "contact "),
        "tel": ("call ", "call me at ", "tel: ", "phone ", "Phone: ", "fax ", "mobile ", "by phone at "),
        "national_id": ("SSN ", "ssn: ", "passport ", "DNI ", "DNI: ", "passport no. ", "passport number "),
        "secret": ('token = "', 'secret = "', "password: ", 'key = "', "apikey=", "token: "),
    }
    plain = (
        lambda: pick(draw.randint(1, 6)), lambda: pick(16), lambda: f"{pick(3)}.{pick(2)}.{pick(3)}.{pick(1)}", lambda: f"+1 ({pick(3)}) {pick(3)}-{pick(4)}",
        lambda: f"{word()}.{pick(2)}@mail{pick(1)}.example.com", lambda: f"version {pick(1)}.{pick(1)}", lambda: f"20{pick(2)}-{pick(2)}-{pick(2)}", lambda: f"$ {pick(1)},{pick(3)}.{pick(2)}",
        lambda: "Licensed under the Apache License, Version 2.0.", lambda: "a key part of the name", lambda: "the token of the call", lambda: f"{word()} | {word()} | {word()}",
        lambda: f"{word().capitalize()} {word().capitalize()}", lambda: f"({word()})", lambda: f"{word()}: {word()} - {word()}", lambda: f'"{word()} {word()}"', lambda: "is called", lambda: f"{pick(3)} {pick(3)}",
        lambda: f"{word().upper()} {word().upper()}", lambda: f"{mixed(8)}", lambda: f"http://www.{word()}.com/{pick(3)}",
    )
    table = []
    for i in range(rows):
        lead_in = prose(draw.randint(0, 9))
        text, spans = lead_in + " " * bool(lead_in), []
        for _ in range(draw.randint(0, 2) * draw.randint(0, 1)):
            text += draw.choice(plain)() + " " + prose(draw.randint(1, 5)) + " "
        if i % 2:
            kind = draw.choice(crf.KINDS)
            lead = draw.choice(before[kind])
            fill = marked[kind]()
            start = len((text + lead).encode())
            text += lead + fill
            spans.append((kind, start, start + len(fill.encode())))
            text += ('"' if lead.endswith('"') else "") + draw.choice(("", " " + prose(draw.randint(1, 6)), ". " + prose(draw.randint(1, 6)), ", " + prose(draw.randint(1, 6))))
        table.append((text, spans))
    if spark is None:
        return table
    return spark.createDataFrame([(t, [dict(kind=k, start=a, end=b) for k, a, b in s]) for t, s in table], "text string, spans array<struct<kind:string,start:long,end:long>>")


_DIGITS = re.compile(rb"[0-9@]")


def find(texts: pa.Array, field: crf.Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, (kind, start, end) by code points.

    A span that the field adds gives way to base spans that it meets.
    """
    out = []
    for _, data, offsets in batch.slices(texts):
        row, start, end, cls = crf.tokens(data, offsets)
        more: dict[int, list] = {}
        for r, kind, a, b in crf.spans(row, start, end, field.decode(row, cls)):
            more.setdefault(r, []).append((kind, a - int(offsets[r]), b - int(offsets[r])))
        for r in range(len(offsets) - 1):
            raw = data[offsets[r] : offsets[r + 1]].tobytes()
            base = base_spans(raw.decode()) if _DIGITS.search(raw) else []
            every = list(base)
            if r in more:
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
                for kind, a, b in more[r]:
                    a, b = int(chars[a]), int(chars[b])
                    if not any(a < y and x < b for _, x, y in base):
                        every.append((kind, a, b))
            out.append((base, in_order(every)))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: crf.Field) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) over whole texts, null being empty.

    Positions are code points, ends exclusive; order is by start, then kind. Texts without
    personal data have empty arrays. Other columns are not looked at.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = find(b.column(1), field)
            sides = [pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in f[i]] for f in found], type=kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *sides], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


_FIELDS: dict[int, crf.Field] = {}


def trained_field(spark: SparkSession) -> crf.Field:
    """The field fitted to the labelled table, once a process: fitting takes many passes over the same rows."""
    table = [(r["text"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in labelled_examples(spark).collect()]
    key = hash(tuple(table))
    if key not in _FIELDS:
        _FIELDS[key] = crf.train(table, penalty=5e-4)
    return _FIELDS[key]


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, trained_field(spark))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count_of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count_of(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
