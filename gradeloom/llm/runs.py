"""Periodic runs of words, found on a harmonic grid with constant-time common extensions.

For every period p, anchors stand at the words 0, p, 2p, ... A run of length 4p holds three
anchors in a row whose word equals that of the next anchor (elsewhere the common extension is
none), so such places are asked how far the words at jp and (j+1)p agree to the right and to the
left: two range minima over the common prefix lengths of the suffix arrays of the words and of the
reversed words. Both arrays are made, for the texts that have such a place, by prefix doubling; the
common lengths come along with it.

A grid has n/1 + n/2 + ... anchors, so a text of n words takes n log n steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import batch
from gradeloom.llm.common import WORD

#: Anchors that are looked at together.
ANCHORS = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_FAR = np.int32((1 << 31) - 1)


class RangeMin:
    """Minima of stretches of an array: prefix and suffix minima of blocks, a sparse table over whole ones."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        self.values = values
        grid = np.full(-(-max(1, len(values)) // self.BLOCK) * self.BLOCK, _FAR, dtype=values.dtype)
        grid[: len(values)] = values
        grid = grid.reshape(-1, self.BLOCK)
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.onwards = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        rows = [grid.min(axis=1)]
        for k in range(len(grid).bit_length() - 1):
            last, half = rows[-1], 1 << k
            rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
        self.table = np.stack(rows)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo] .. values[hi], both included."""
        a, b = lo // self.BLOCK, hi // self.BLOCK
        out = np.minimum(self.onwards[lo], self.upto[hi])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, n = a[wide] + 1, b[wide] - a[wide] - 1
            k = np.frexp(n)[1] - 1
            out[wide] = np.minimum(out[wide], np.minimum(self.table[k, first], self.table[k, first + n - (1 << k)]))
        same = np.flatnonzero(a == b)
        if len(same):
            at, end = lo[same], hi[same]
            least = self.values[at]
            for _ in range(self.BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[same] = least
        return out


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes ascending, and how many symbols each shares with the one before.

    No two suffixes may agree to the end: the last symbol stands nowhere else. Suffixes that agree
    in h symbols are a group; a step orders each group by the groups of what follows those symbols.
    Where a group parts, the common length is h and what those two groups have in common.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = ids[order[1:]] != ids[order[:-1]]
    common = np.where(first, 0, _FAR).astype(np.int32)
    rank, h = np.empty(n, dtype=np.int64), 1
    while True:
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        several = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(several):
            return order, common
        who = order[several]
        key = rank[who] * n + rank[who + h]
        by = np.argsort(key, kind="stable")
        order[several], key = who[by], key[by]
        parts = several[1:][(key[1:] != key[:-1]) & ~first[several[1:]]]
        left, right = rank[order[parts - 1] + h], rank[order[parts] + h]
        common[parts] = h + RangeMin(common)(left + 1, right)
        first[parts] = True
        h *= 2


class Extensions:
    """How far the symbols from two places on are alike; no two suffixes of ``ids`` may agree to the end."""

    def __init__(self, ids: np.ndarray):
        order, common = suffix_array(ids)
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[order] = np.arange(len(ids))
        self.least = RangeMin(common)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x], self.rank[y]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def _anchors(ids: np.ndarray, base: np.ndarray, n: np.ndarray, rows: np.ndarray, exponent: int):
    """(row, place, period) of anchors from which on exponent - 1 in a row have the next one's word, some ANCHORS looked at together."""
    row = np.repeat(rows, n[rows] // exponent)
    period = batch.ragged(np.ones(len(rows), dtype=np.int64), n[rows] // exponent)
    size = (n[row] - 1) // period
    upto = np.cumsum(size)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ANCHORS, side="right")))
        many = size[lo:hi]
        j = batch.ragged(np.zeros(hi - lo, dtype=np.int64), many)
        step = np.repeat(period[lo:hi], many)
        at = np.repeat(base[row[lo:hi]], many) + j * step
        alike = ids[at] == ids[at + step]
        k = np.flatnonzero(alike)
        k = k[j[k] + exponent - 1 <= np.repeat(many, many)[k]]
        for t in range(1, exponent - 1):
            k = k[alike[k + t]]
        yield np.repeat(row[lo:hi], many)[k], at[k], step[k]
        lo = hi


def _distinct(row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every stretch once, with its least period."""
    by = np.lexsort((period, length, start))
    found = [v[by] for v in (row, start, length, period)]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (found[1][1:] != found[1][:-1]) | (found[2][1:] != found[2][:-1])
    return tuple(v[new] for v in found)


def find_runs(ids: np.ndarray, counts: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) by row, start and period; ids are the words of all rows, counts of each."""
    base = np.cumsum(counts) - counts
    rows = np.flatnonzero(counts >= least_length)
    asked = np.unique(np.concatenate([rows[:0], *[row for row, _, _ in _anchors(ids, base, counts, rows, least_exponent)]]))
    found = (asked[:0],) * 4
    if not len(asked):
        return found
    # The texts that are asked about, side by side, with a symbol of its own before, between and behind them.
    many = counts[asked]
    joined = np.empty(int(many.sum()) + len(asked) + 1, dtype=np.int64)
    new = np.cumsum(many + 1) - many
    stops = np.append(new - 1, len(joined) - 1)
    joined[stops] = int(ids.max()) + 1 + np.arange(len(stops))
    joined[batch.ragged(new, many)] = ids[batch.ragged(base[asked], many)]
    right, left = Extensions(joined), Extensions(joined[::-1].copy())
    for row, at, p in _anchors(ids, base, counts, asked, least_exponent):
        x = at + (new - base[asked])[np.searchsorted(asked, row)]
        back = left(len(joined) - x, len(joined) - x - p)
        length = back + p + right(x, x + p)
        enough = length >= np.maximum(least_length, least_exponent * p)
        own = (row[enough], (at - back)[enough], length[enough], p[enough])
        found = _distinct(*[np.concatenate(v) for v in zip(found, own, strict=True)])
    row, start, length, p = found
    by = np.lexsort((p, start))
    return row[by], (start - base[row])[by], length[by], p[by]


def periodic_runs(docs: DataFrame, *, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` plus runs and collapsed.

    runs: the stretches of consecutive words (start, length, period; words count from 0) with that
    smallest period, of least_length words and least_exponent periods at least, that no neighbouring
    word extends; by start, then period. collapsed: the words that no run repeats, joined by one
    space: a run keeps its first ``period`` words unless another run repeats them. Words are compared
    as they stand. A null, empty or blank text has no runs and an empty collapsed text. Rows are
    worked on one by one, so ids may be missing or repeat; columns runs and collapsed of ``docs``
    are replaced. A task holds a few times 1 MB of text, or the one longer text it is at.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its period: least_exponent is 2 or more")
    docs = docs.drop("runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    text, names = docs.columns.index("text"), schema.names

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(text)):
                words, counts = batch.split_words(data, offsets)
                ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                row, start, length, period = find_runs(ids, counts, least_length, least_exponent)
                base = np.cumsum(counts) - counts
                change = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(change, base[row] + start + period, 1)
                np.add.at(change, base[row] + start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                cuts = np.searchsorted(np.flatnonzero(kept), np.append(base, len(ids)))
                texts = pc.binary_join(pa.LargeListArray.from_arrays(cuts, words.filter(pa.array(kept))), pa.scalar(b" ", pa.large_binary()))
                runs = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, len(counts)) for c in b.columns], runs, texts.cast(pa.string())], names=names)

    return docs.mapInArrow(run, schema)


def plant_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of every tenth document, by the hash of its id, made periodic from one of its words on; null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("_h div 10")
    chosen = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("_words").cast("long")
    sized = chosen.withColumn("_n", F.when(F.col("_words").isNotNull() & (n > 0), n)).withColumn("_a", g % F.col("_n")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _h div 10 % 8)"))
    number = lambda c: F.col(c).cast("int")
    rest = number("_n") - number("_a")
    times = F.ceil(rest / number("_p")).cast("int")
    block = F.slice("_words", number("_a") + 1, number("_p"))
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), number("_a")), tail), " ")
    return sized.select(*[F.when(F.col("_n").isNotNull(), text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def strongest(runs: Column) -> Column:
    """The run of the greatest length to period, compared exactly; of equals the first one of ``runs``; null without any."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = plant_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("_top", strongest(F.col("runs")))
    top = F.col("_top")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda s: F.concat(s, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
