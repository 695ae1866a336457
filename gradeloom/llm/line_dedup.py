"""Line deduplication by a deletion-neighbourhood join.

Equal lines collapse first. A line's deletion neighbourhood is itself and every form of
it with one code point left out; lines within one edit share a form, so their hashes
meet in a join, and the edit distance is then verified. The neighbourhood of a line is
as large as the line, so lines that cannot have a partner are told apart before: within
one edit, lines agree on all but one of q blocks, so a line whose q block keys nobody
else has needs no neighbourhood. That is asked with two blocks of all lines, then with
sixteen of those that are left. No line with a partner is lost by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import batch, bloom
from gradeloom.llm.common import materialise

#: Lines of fewer code points match only if equal, unless the caller says otherwise: one edit changes too much of them.
LEAST_CHARS = 16
HALVES, BLOCKS = 2, 16
_TABLE = batch.mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _prefix(points: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes over code points."""
    value = _TABLE[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        value[high] = batch.mix64(points[high].astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(value * batch.powers(len(points) + 1)[0][: len(points)], out=out[1:])
    return out


def _part(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * batch.powers(len(prefix))[1][start]


def block_keys(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: int) -> np.ndarray:
    """(lines, 2 * blocks) keys of what is left of a line without one of its blocks.

    For two lines of which the longer has m code points and which are within one edit,
    common prefix and common suffix add up to m - 1 at least. With cuts 0 = c0 < ... < cq = m
    there is a j for which both have the same first c_j and last m - c_(j+1) code points.
    Each line takes both its own length and one more for m.
    """
    n = end - start
    out = np.zeros((len(n), 2 * blocks), dtype=np.uint64)
    for k, m in enumerate((n, n + 1)):
        for j in range(blocks):
            lo, hi = j * m // blocks, (j + 1) * m // blocks
            head, tail = _part(prefix, start, start + lo), _part(prefix, end - (m - hi), end)
            out[:, k * blocks + j] = batch.mix64(batch.mix64(head + np.uint64(j + 1)) + tail + m.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def deletion_keys(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
    """Keys of the line and of each of its forms without one code point, in their order."""
    at = np.arange(start, end)
    inverse = np.uint64(batch._INVERSE)
    head = prefix[at] - prefix[start]
    tail = (prefix[end] - prefix[at + 1]) * inverse
    forms = np.append(prefix[end : end + 1] - prefix[start], head + tail)
    return batch.mix64(forms * batch.powers(len(prefix))[1][start])


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Lines of a slice that are not blank: (row, number, start, end, code points, texts as bytes)."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = at[offsets]
    breaks = np.flatnonzero(points == 10)
    begin = np.concatenate([rows[:-1], breaks + 1])
    # A line is its break's: behind a text's last break begins its empty last line, not the next text.
    owner = np.concatenate([np.arange(len(rows) - 1), np.searchsorted(rows, breaks, side="right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    stop = np.append(begin[1:] - 1, len(points))
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = rows[owner[last] + 1]
    number = np.arange(len(begin)) - np.searchsorted(owner, owner, side="left")
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    byte = np.append(byte, len(data))
    texts = [raw[a:b] for a, b in zip(byte[begin], byte[stop], strict=True)]
    keep = np.array([bool(t.strip()) for t in texts], dtype=bool)
    return owner[keep], number[keep], begin[keep], stop[keep], points, [t for t, k in zip(texts, keep, strict=True) if k]


def _keys_as_arrow(keys: np.ndarray) -> pa.Array:
    return pa.array(list(keys.view(np.int64)), type=pa.list_(pa.int64()))


def row_key() -> Column:
    """Tells rows of one doc_id apart, the same whenever and however a table is read."""
    return F.xxhash64("doc_id", "text")


def _grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: shuffled at every size, so that plans do not change with it."""
    return df.hint("merge")


def occurrences(docs: DataFrame, with_text: bool, least_chars: int = LEAST_CHARS) -> DataFrame:
    """A row for each line that is not blank: doc_id, row, line_no, line (128-bit key), halves or text."""

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(2)):
                owner, number, start, end, points, texts = _lines(data, offsets)
                keys = pa.array([xxhash.xxh3_128_digest(t) for t in texts], type=pa.binary())
                if with_text:
                    extra = pa.array([t.decode() for t in texts], type=pa.string())
                else:
                    halves = [None] * len(texts)
                    long = np.flatnonzero(end - start >= least_chars)
                    for i, k in zip(long, block_keys(_prefix(points), start[long], end[long], HALVES).view(np.int64), strict=True):
                        halves[i] = k
                    extra = pa.array(halves, type=pa.list_(pa.int64()))
                ids = [b.column(i).slice(lo, len(offsets) - 1).take(pa.array(owner)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(number), keys, extra], names=["doc_id", "row", "line_no", "line", "extra"])

    kind = "string" if with_text else "array<long>"
    return docs.where("doc_id is not null").select("doc_id", row_key().alias("row"), "text").mapInArrow(run, f"doc_id long, row long, line_no long, line binary, extra {kind}")


def _of_texts(texts: DataFrame, kind: str) -> DataFrame:
    """Lines (line, text) by their block keys; or (line, text, places) by their deletion forms.

    A form is emitted for the places (see block_keys) in which a line met another: as the
    longer line, without each code point of that block; as the shorter one, whole.
    """
    columns = ["line", "text"] if kind == "blocks" else ["line", "text", "places"]

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(1)):
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
                cuts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
                prefix = _prefix(points)
                lines = b.column(0).slice(lo, len(offsets) - 1)
                if kind == "blocks":
                    keys = block_keys(prefix, cuts[:-1], cuts[1:], BLOCKS)
                    owner, place, keys = np.repeat(np.arange(len(keys)), keys.shape[1]), np.tile(np.arange(keys.shape[1]), len(keys)), keys.ravel()
                else:
                    owner, place, keys = [], [], []
                    met = b.column(2).slice(lo, len(offsets) - 1)
                    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        every, n = deletion_keys(prefix, int(a), int(z)), int(z - a)
                        js = np.array(met[i].as_py())
                        use = [np.zeros(1, dtype=np.int64)] if (js >= BLOCKS).any() else []
                        use += [1 + np.arange(j * n // BLOCKS, (j + 1) * n // BLOCKS) for j in js[js < BLOCKS]]
                        use = np.unique(np.concatenate(use))
                        owner.append(np.full(len(use), i))
                        place.append(use - 1)
                        keys.append(every[use])
                    owner, place, keys = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owner, np.int64), (place, np.int64), (keys, np.uint64)))
                yield pa.RecordBatch.from_arrays([lines.take(pa.array(owner)), pa.array(keys.view(np.int64)), pa.array(place)], names=["line", "key", "place"])

    return texts.select(*columns).mapInArrow(run, "line binary, key long, place long")


def near_links(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (line, other) of different lines within one edit, in stars, both ways.

    ``lines`` has line and at (its earliest place), ``texts`` line, text and places. Forms equal in
    key and place left out differ in one code point there: any two of their lines are within
    one edit, so each is linked with the earliest alone. A line that equals a form of
    another is one code point shorter.
    """
    forms = materialise(_of_texts(texts, "forms").join(_grown(lines.select("line", "at")), "line"), "forms")
    own = forms.where("place = -1").select("key", F.col("line").alias("other"))
    cut = forms.where("place >= 0")
    group = cut.groupBy("key", "place").agg(F.min(F.struct("at", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    swap = cut.join(_grown(group), ["key", "place"]).select("line", F.col("first.line").alias("other"))
    drop = cut.join(_grown(own), "key").select("line", "other")
    pairs = swap.union(drop).where("line <> other").distinct()
    one, two = texts.select("line", F.col("text").alias("_t")), texts.select(F.col("line").alias("other"), F.col("text").alias("_o"))
    near = pairs.join(_grown(one), "line").join(_grown(two), "other").where(F.levenshtein("_t", "_o", 1).between(0, 1)).select("line", "other")
    return near.union(near.select(F.col("other").alias("line"), F.col("line").alias("other")))


def _likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``, by a Bloom filter, and few others."""
    slots = bloom.slots_for(keys.count(), bits_per_row=16, functions=2, max_bits=1 << 31)
    return bloom.flag(rows, F.col(key), bloom.bitmaps(keys, key, slots, 2), slots, 2, "_maybe").where("_maybe").drop("_maybe")


def _holding(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``; a Bloom filter goes first, so that few others shuffle."""
    return _likely(rows, keys, key).join(_grown(keys.select(key)), key, "left_semi")


def line_keepers(docs: DataFrame, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """All occurrences (doc_id, row, line_no, line), and (line, at, keep) of lines that repeat or have a like one.

    at is the earliest place (doc_id, row, line_no) of the line, keep the earliest of lines equal
    to it or within one edit of it.
    """
    found = materialise(occurrences(docs, False, least_chars), "lines")
    at = F.struct("doc_id", "row", "line_no")
    distinct = materialise(found.groupBy("line").agg(F.min(at).alias("at"), F.count("*").alias("copies"), F.min("extra").alias("halves")), "distinct")
    halves = distinct.where("halves is not null").select("line", F.explode(F.array_distinct("halves")).alias("key"))
    shared = materialise(halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    maybe = materialise(_holding(halves, shared, "key").select("line").distinct(), "maybe")
    slots = bloom.slots_for(maybe.count(), bits_per_row=16, functions=2, max_bits=1 << 31)
    filters = bloom.bitmaps(maybe, "line", slots, 2)
    texts = bloom.flag(occurrences(docs, True).withColumnRenamed("extra", "text"), F.col("line"), filters, slots, 2, "_maybe").where("_maybe").drop("_maybe")
    first = _grown(maybe).join(distinct.select("line", "at.doc_id", "at.row", "at.line_no"), "line")
    texts = materialise(texts.join(_grown(first), ["line", "doc_id", "row", "line_no"], "left_semi").select("line", "text").dropDuplicates(["line"]), "texts")
    blocks = materialise(_of_texts(texts, "blocks"), "blocks")
    close = materialise(blocks.groupBy("key").agg(F.count_distinct("line").alias("n")).where("n > 1").select("key"), "close")
    met = _holding(blocks, close, "key").groupBy("line").agg(F.collect_set("place").alias("places"))
    survivors = materialise(texts.join(_grown(met), "line"), "survivors")
    links = materialise(near_links(distinct.select("line", "at"), survivors).distinct(), "links")
    best = links.join(_grown(distinct.select(F.col("line").alias("other"), F.col("at").alias("near"))), "other").groupBy("line").agg(F.min("near").alias("near"))
    keep = distinct.join(_grown(best), "line", "left").where("copies > 1 or near is not null")
    return found.drop("extra"), materialise(keep.select("line", "at", F.least("at", F.coalesce("near", "at")).alias("keep")), "keep")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows of ``docs`` with repeated lines taken out of text, plus n_lines, n_dropped, n_near.

    Lines are parted by newlines. Of lines that are equal, or within one edit (insertion,
    deletion or substitution of a code point) and both of at least ``least_chars`` code points,
    the earliest by doc_id and line stays (rows of one doc_id with different texts are told apart
    by a hash of the text); a line goes if an earlier one is that near. Blank lines stay. n_near
    counts the lines that went though no earlier line equals them. Texts without a dropped line,
    null ones among them, are unchanged; a null or empty text has no lines. Rows without doc_id
    are returned as they are. Rows that are equal in doc_id and text count as one and
    have one result. Columns of ``docs`` with the added names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "n_near")
    places, keep = line_keepers(docs, least_chars)
    place = F.struct("doc_id", "row", "line_no")
    # A common line's places meet its one row of keep in a single join, which Spark can split.
    hit = _likely(places, keep, "line").join(_grown(keep), "line").where(place != F.col("keep"))
    changes = hit.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("_gone"), F.count_if(place == F.col("at")).alias("_near"))
    changes = materialise(changes.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_gone", "_near"), "changes")
    slots = bloom.slots_for(changes.count(), bits_per_row=16, functions=2, max_bits=1 << 31)
    filters = bloom.bitmaps(changes, "_row", slots, 2)
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    marked = bloom.flag(docs.withColumns({"n_lines": lines, "_key": row_key()}), F.col("_key"), filters, slots, 2, "_maybe")
    zero = F.lit(0).cast("long")
    same = marked.where("not _maybe").drop("_maybe", "_key").withColumns({"n_dropped": zero, "n_near": zero})
    joined = marked.where("_maybe").join(_grown(changes), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    gone = F.array_sort(F.transform("_gone", lambda x: x.cast("int")))
    # The stretches between dropped lines, so that a text of many lines takes time in proportion to
    # them; the lines are bound to a lambda's variable, or each stretch would split the text again.
    stretches = lambda ls: F.zip_with(F.concat(F.array(F.lit(-1)), "_g"), F.concat("_g", F.array(F.size(ls))), lambda a, b: F.slice(ls, a + 2, b - a - 1))
    kept = F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(F.flatten(stretches(ls)), "\n"))[0]
    joined = joined.withColumn("_g", gone).withColumn("text", F.when(F.size("_g") > 0, kept).otherwise(F.col("text")))
    joined = joined.withColumns({"n_dropped": F.coalesce(F.size("_g"), F.lit(0)).cast("long"), "n_near": F.coalesce("_near", zero)})
    return same.unionByName(joined.select(*same.columns))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "n_near", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = """
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line
  from documents where text <> ''),
d as materialized (select line, min((doc_id, line_no)) as at from l where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' group by line),
p as materialized (select a.line, min(b.at) as near from (select *, length(line) as n from d) a join (select *, length(line) as n from d) b
  on a.n >= 16 and b.n >= 16 and a.n between b.n - 1 and b.n + 1 and a.line <> b.line
  and (left(a.line, (greatest(a.n, b.n) // 2)::int) = left(b.line, (greatest(a.n, b.n) // 2)::int)
    or right(a.line, (greatest(a.n, b.n) - greatest(a.n, b.n) // 2)::int) = right(b.line, (greatest(a.n, b.n) - greatest(a.n, b.n) // 2)::int))
  where levenshtein(a.line, b.line) <= 1 group by a.line),
k as (select l.doc_id, l.line_no, l.line, coalesce((l.doc_id, l.line_no) = least(d.at, coalesce(p.near, d.at)), true) as stays, (l.doc_id, l.line_no) = d.at as first
  from l left join d using (line) left join p using (line)),
g as (select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped, count(*) filter (not stays and first) as n_near, coalesce(string_agg(line, chr(10) order by line_no) filter (stays), '') as kept from k group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, coalesce(n_near, 0) as n_near, length(coalesce(kept, '')) as kept_chars, sha256(coalesce(kept, '')) as kept_sha256
from documents left join g using (doc_id)
"""
