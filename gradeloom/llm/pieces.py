"""SentencePiece encoding and decoding over a lattice of pieces.

Texts fall into parts at every place that no piece of the model crosses: before spaces,
around newlines and wherever two neighbours stand together in no piece. Neither merges nor
a best path cross such a place, so parts can be encoded one by one. The lattice of a part has
an edge for each of its substrings, of bounded length, that is a piece. A model of kind unigram
takes the path of the best total score (Viterbi). A model of kind BPE does not define its
result by a path's score: the fold applies merges, the best-ranked edge over two neighbouring
symbols first, the leftmost of equals.

``encode_words`` builds and folds the lattice with Spark joins and higher-order functions
for a table of parts. ``encode`` takes a corpus' distinct parts through it and joins their
ids back to the documents. ``encode_distinct`` is the same with numpy: ``encode`` leaves it
the parts of more than LONG code points, and tests compare the two.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import batch
from gradeloom.llm.common import materialise
from gradeloom.llm.line_dedup import _part, _prefix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of more code points are merged one by one with a heap instead of all at once.
LONG = 96
#: Bytes of text that are cut into parts at once.
STRETCH = batch.WINDOW // 2
#: Rows of a chunk, as a power of two: a task holds one chunk's texts at once.
CHUNK_BITS = 11
#: Level of zstd at which texts move to their chunks.
PACKED_LEVEL = 3
#: Parts whose ids are sent to all tasks; they are looked for in a share of the rows, and so many at most.
COMMON_PARTS, SAMPLED_SHARE, SAMPLED_ROWS = 1 << 20, 0.25, 60_000


@dataclass(frozen=True, eq=False)
class Model:
    """Pieces by id. rank orders BPE merges (smaller first), score is for Viterbi; kind is bpe or unigram."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_id: tuple[int, ...]
    unknown: int
    kind: str = "bpe"

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, n in zip(self.pieces, self.normal, strict=True) if n), default=1)


def load(path: str = MODEL, kind: str = "bpe") -> Model:
    """Read a model file: at most a few ten thousand pieces, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    pieces = tuple(sp.id_to_piece(i) for i in ids)
    normal = tuple(not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in ids)
    at = {p: i for i, p in enumerate(pieces)}
    return Model(pieces, tuple(sp.get_score(i) for i in ids), normal, tuple(at.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)), sp.unk_id(), kind)


@lru_cache(maxsize=1)
def _tables(model: Model):
    """Sorted hashes of the pieces, and per id: first and last code point, rank, bytes."""
    ids = np.array([i for i, n in enumerate(model.normal) if n])
    points = [np.array([ord(c) for c in model.pieces[i]], dtype=np.uint32) for i in ids]
    flat = np.concatenate(points)
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in points])])
    h = _part(_prefix(flat), cuts[:-1], cuts[1:])
    order = np.argsort(h)
    first, last = np.zeros(len(model.pieces), np.uint32), np.zeros(len(model.pieces), np.uint32)
    first[ids], last[ids] = flat[cuts[:-1]], flat[cuts[1:] - 1]
    rank = np.empty(len(model.pieces), dtype=np.int64)
    rank[np.lexsort((np.arange(len(rank)), -np.array(model.scores)))] = np.arange(len(rank))
    text = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(model.pieces, model.normal, strict=True)]
    for b, i in enumerate(model.byte_id):
        if i != model.unknown:
            text[i] = bytes([b])
    data = np.frombuffer(b"".join(text), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    return h[order], ids[order], first, last, rank, data, starts, np.array(model.scores)


@lru_cache(maxsize=1)
def _maybe(model: Model) -> np.ndarray:
    """Whether some piece's hash has these first 20 bits."""
    out = np.zeros(1 << 20, dtype=bool)
    out[(batch.mix64(_tables(model)[0]) >> np.uint64(44)).astype(np.int64)] = True
    return out


def lattice(points: np.ndarray, cuts: np.ndarray, model: Model) -> np.ndarray:
    """edges[l - 1, p]: the id of the piece that is the l code points from p on, within a word; or -1."""
    known, ids, first, last, *_ = _tables(model)
    stop = np.repeat(cuts[1:], np.diff(cuts))
    prefix, at, maybe = _prefix(points), np.arange(len(points)), _maybe(model)
    edges = np.full((model.longest, len(points)), -1, dtype=np.int32)
    for n in range(1, model.longest + 1):
        p = at[at + n <= stop]
        if not len(p):
            break
        h = _part(prefix, p, p + n)
        some = maybe[(batch.mix64(h) >> np.uint64(44)).astype(np.int64)]
        p, h = p[some], h[some]
        where = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[where] == h
        p, piece = p[hit], ids[where[hit]]
        right = (first[piece] == points[p]) & (last[piece] == points[p + n - 1])
        edges[n - 1, p[right]] = piece[right]
    return edges


def fold_merges(edges: np.ndarray, cuts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the symbols that are left when no edge spans two neighbours; all words at once."""
    longest, total = edges.shape
    starts = np.arange(total)
    word = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    done, live, of = [], starts, word
    while len(live) > 1:
        left, right = live[:-1], live[1:]
        end = np.append(live[2:], total)
        end = np.where(np.append(of[2:], -1) == of[1:], end, cuts[of[1:] + 1])
        size = end - left
        pair = (of[:-1] == of[1:]) & (size <= longest)
        piece = np.where(pair, edges[np.minimum(size, longest) - 1, left], -1)
        key = np.where(piece >= 0, rank[piece] * np.int64(total + 1) + left, np.iinfo(np.int64).max)
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        low = np.minimum.reduceat(np.append(key, np.iinfo(np.int64).max), begin)
        some = low < np.iinfo(np.int64).max
        count = np.diff(np.append(begin, len(live)))
        busy = np.repeat(some, count)
        done.append(live[~busy])
        gone = np.zeros(len(live), dtype=bool)
        gone[1:] = (key == np.repeat(low, count)[:-1]) & (piece >= 0)
        stay = busy & ~gone
        live, of = live[stay], of[stay]
    return np.sort(np.concatenate([*done, live]))


def fold_one(edges: np.ndarray, a: int, z: int, rank: np.ndarray) -> np.ndarray:
    """The same for one long word, with a heap of pairs."""
    longest = len(edges)
    after, before, alive = dict(zip(range(a, z), range(a + 1, z + 1), strict=True)), {p + 1: p for p in range(a, z - 1)}, [True] * (z - a)
    heap: list = []

    def offer(p):
        q = after[p]
        if q < z and after[q] - p <= longest and (piece := int(edges[after[q] - p - 1, p])) >= 0:
            heapq.heappush(heap, (int(rank[piece]), p, q, after[q]))

    for p in range(a, z):
        offer(p)
    while heap:
        _, p, q, r = heapq.heappop(heap)
        if not alive[p - a] or after[p] != q or not alive[q - a] or after[q] != r:
            continue
        alive[q - a] = False
        after[p] = r
        if r < z:
            before[r] = p
        offer(p)
        if p > a:
            offer(before[p])
    return a + np.flatnonzero(alive)


def fold_viterbi(edges: np.ndarray, cuts: np.ndarray, scores: np.ndarray, unknown: float) -> np.ndarray:
    """Starts of the pieces on the path of the best total score, by position of all words at once."""
    longest, total = edges.shape
    size = np.diff(cuts)
    best, step = np.full(total + len(size), -np.inf), np.zeros(total + len(size), dtype=np.int64)
    base = cuts[:-1] + np.arange(len(size))
    best[base] = 0
    for end in range(1, int(size.max(initial=0)) + 1):
        w = np.flatnonzero(size >= end)
        for n in range(1, min(longest, end) + 1):
            piece = edges[n - 1, cuts[w] + end - n]
            gain = np.where(piece >= 0, scores[piece], unknown if n == 1 else -np.inf)
            score = best[base[w] + end - n] + gain
            better = score > best[base[w] + end]
            best[(base[w] + end)[better]] = score[better]
            step[(base[w] + end)[better]] = n
    starts, at, w = [], size.copy(), np.flatnonzero(size > 0)
    while len(w):
        at[w] -= step[base[w] + at[w]]
        starts.append(cuts[w] + at[w])
        w = w[at[w] > 0]
    return np.sort(np.concatenate(starts)) if starts else np.zeros(0, dtype=np.int64)


def encode_distinct(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cuts): the ids of word i are ids[cuts[i]:cuts[i + 1]]; words have SPACE for spaces."""
    _, _, _, _, rank, _, _, scores = _tables(model)
    out, counts = [], []
    lo = 0
    while lo < len(words):
        hi, chars = lo, 0
        while hi < len(words) and (hi == lo or chars + len(words[hi]) <= 150_000):
            chars += len(words[hi])
            hi += 1
        part = words[lo:hi]
        points = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in part])
        cuts = np.concatenate([[0], np.cumsum(size)])
        edges = lattice(points, cuts, model)
        if model.kind == "unigram":
            symbols = fold_viterbi(edges, cuts, scores, float(scores.min()) - 10)
        else:
            wide = np.flatnonzero(size > LONG)
            merged = [fold_one(edges, int(cuts[i]), int(cuts[i + 1]), rank) for i in wide]
            if len(wide):
                keep = np.repeat(size <= LONG, size)
                place = np.flatnonzero(keep)
                merged.append(place[fold_merges(edges[:, keep], np.concatenate([[0], np.cumsum(size[size <= LONG])]), rank)] if keep.any() else place)
                symbols = np.sort(np.concatenate(merged))
            else:
                symbols = fold_merges(edges, cuts, rank)
        ends = np.append(symbols[1:], len(points))
        piece = edges[ends - symbols - 1, symbols]
        word = np.searchsorted(cuts, symbols, side="right") - 1
        lone = np.flatnonzero(piece < 0)
        if len(lone):
            raw = [chr(points[symbols[i]]).encode() for i in lone]
            n = np.ones(len(symbols), dtype=np.int64)
            n[lone] = [len(r) for r in raw]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            piece = np.repeat(piece, n)
            piece[batch.ragged(first[lone], n[lone])] = np.array(model.byte_id)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            word = np.repeat(word, n)
        out.append(piece)
        counts.append(np.bincount(word, minlength=len(part)))
        lo = hi
    sizes = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=1)
def _neighbours(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each code point (0: in no piece), and by two numbers whether some piece has them as neighbours."""
    pieces = [np.array([ord(c) for c in p], dtype=np.int64) for p, n in zip(model.pieces, model.normal, strict=True) if n]
    used = np.unique(np.concatenate(pieces))
    number = np.zeros(0x110000, dtype=np.int32)
    number[used] = np.arange(1, len(used) + 1)
    n = len(used) + 1
    beside = np.zeros(n * n, dtype=bool)
    beside[np.concatenate([number[p[:-1]] * np.int64(n) + number[p[1:]] for p in pieces])] = True
    return number, beside, n


def parts_of(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, start, end, row): code points, with SPACE for spaces and one put before each text, and the parts in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    some = np.flatnonzero(np.diff(at) > 0)
    points = np.insert(points, at[some], ord(SPACE))
    points[points == 32] = ord(SPACE)
    first = at[some] + np.arange(len(some))
    number, beside, n = _neighbours(model)
    k = number[points]
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = ~beside[k[:-1] * np.int64(n) + k[1:]]
    begins[first] = True
    start = np.flatnonzero(begins)
    return points, start, np.append(start[1:], len(points)), some[np.searchsorted(first, start, side="right") - 1] if len(start) else start


def _as_words(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, end, strict=True)]


@dataclass(frozen=True)
class Known:
    """Ids of some parts by the hashes of their code points: a table with open places, then id lists."""

    place: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(words: list[str], ids: np.ndarray, cuts: np.ndarray) -> Known:
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        hashes = batch.span_hashes(_prefix(points), at[:-1], at[1:])
        place = np.full(1 << max(4, (2 * len(words)).bit_length()), -1, dtype=np.int32)
        left, probe = np.arange(len(words)), 0
        while len(left):
            slot = ((hashes[left] + np.uint64(probe)) & np.uint64(len(place) - 1)).astype(np.int64)
            free = place[slot] < 0
            place[slot[free]] = left[free]
            left, probe = left[place[slot] != left], probe + 1
        return Known(place, hashes, ids, cuts)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Which part has this hash; -1 for none."""
        out = np.full(len(h), -1, dtype=np.int64)
        left, probe = np.arange(len(h)), 0
        while len(left):
            at = self.place[((h[left] + np.uint64(probe)) & np.uint64(len(self.place) - 1)).astype(np.int64)]
            left, at = left[at >= 0], at[at >= 0]
            same = self.hashes[at] == h[left]
            out[left[same]] = at[same]
            left, probe = left[~same], probe + 1
        return out


def _found(points: np.ndarray, start: np.ndarray, end: np.ndarray, known: Known) -> np.ndarray:
    at = known.find(batch.span_hashes(_prefix(points), start, end))
    at[end - start > LONG] = -1
    return at


def encode_texts(texts: pa.Array, model: Model, known: Known | None = None, distinct: Callable = encode_distinct) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cuts): the ids of text i are ids[cuts[i]:cuts[i + 1]]; a null or empty text has none.

    ``distinct`` gives the ids of the distinct parts that are not ``known``.
    """
    known = known or Known.of([], np.zeros(0, np.int32), np.zeros(1, np.int64))
    out, counts = [], []
    for _, data, offsets in batch.slices(texts, STRETCH):
        points, start, end, row = parts_of(data, offsets, model)
        at = _found(points, start, end, known)
        new = np.flatnonzero(at < 0)
        words = pc.dictionary_encode(pa.array(_as_words(points, start[new], end[new]), type=pa.string()))
        ids, cuts = distinct(words.dictionary.to_pylist(), model)
        at[new] = len(known.cuts) - 1 + words.indices.to_numpy()
        begin = np.concatenate([known.cuts[:-1], len(known.ids) + cuts[:-1]])
        size = np.concatenate([np.diff(known.cuts), np.diff(cuts)])[at]
        out.append(np.concatenate([known.ids, ids])[batch.ragged(begin[at], size)])
        counts.append(np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64))
    sizes = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])


def decode_ids(ids: np.ndarray, cuts: np.ndarray, model: Model) -> list[str]:
    """The text of each run of ids: pieces in a row, byte pieces as bytes, without the space put before it."""
    *_, data, starts, _ = _tables(model)
    texts, lo = [], 0
    while lo < len(cuts) - 1:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + batch.WINDOW // 4, side="right")) - 1)
        part = np.asarray(ids[cuts[lo] : cuts[hi]], dtype=np.int64)
        sizes = starts[part + 1] - starts[part]
        raw = data[batch.ragged(starts[part], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[cuts[lo : hi + 1] - cuts[lo]]
        texts += [raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        lo = hi
    return texts


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts) of a column of lists; null is empty."""
    lists = pa.concat_arrays(column.chunks or [pa.array([], pa.list_(pa.int32()))]) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _parts(texts: DataFrame, model: Model, known=None) -> DataFrame:
    """The distinct (word, n) of texts, the last column, that are not known; by the other columns, which are numbers, and stretch."""

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(b.num_columns - 1), STRETCH):
                points, start, end, row = parts_of(data, offsets, model)
                if known is not None:
                    new = np.flatnonzero(_found(points, start, end, known.value) < 0)
                    start, end, row = start[new], end[new], row[new]
                kept = [c.slice(lo, len(offsets) - 1).take(pa.array(row)) for c in b.columns[:-1]]
                group = sum((batch.mix64(c.to_numpy()) for c in kept), np.zeros(len(row), np.uint64))
                _, one, n = np.unique(batch.span_hashes(_prefix(points), start, end) + group, return_index=True, return_counts=True)
                kept = [c.take(pa.array(one)) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(_as_words(points, start[one], end[one]), type=pa.string()), pa.array(n)], names=[*names, "word", "n"])

    *names, _ = texts.columns
    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:-1], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))


def common_parts(docs: DataFrame, model: Model, share: float = SAMPLED_SHARE, rows: int = SAMPLED_ROWS, parts: int = COMMON_PARTS) -> Known:
    """The ids of the parts that are most frequent in a share of the rows, about ``rows`` at most; at most ``parts`` of them.

    They spare most parts of the corpus the join and change no result.
    """
    some = docs.sample(min(share, rows / max(1, docs.count())), 7)
    seen = _parts(some.select("text"), model).where(F.length("word") <= LONG)
    top = seen.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "word").limit(parts)
    found = encode_words(_spread(top.select("word")), model).select("word", "ids").toArrow()
    return Known.of(found.column("word").to_pylist(), *_lists(found.column("ids")))


def _spread(words: DataFrame) -> DataFrame:
    # Few bytes but much work: by a number of its own, so that it is not put into fewer tasks.
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def _splits_alike(docs: DataFrame) -> bool:
    """Whether the plan is a table of files, or rows of the driver, with columns chosen, so that each reading has the same partitions."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.children().head()
    return plan.getClass().getSimpleName() in ("LogicalRelation", "LocalRelation")


def _packed(docs: DataFrame) -> DataFrame:
    """(_chunk, _first, rows) of docs: runs of its rows as compressed Arrow streams, which are smaller to move than rows are."""

    def run(batches):
        for b in batches:
            at, table = b.column(0).to_numpy(), pa.Table.from_batches([b]).drop_columns(["_at"])
            cuts = [0, *np.flatnonzero(np.diff(at >> CHUNK_BITS)) + 1, len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACKED_LEVEL))) as stream:
                    stream.write_table(table.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([at[lo] >> CHUNK_BITS]), pa.array([at[lo]]), pa.array([out.getvalue().to_pybytes()], type=pa.binary())], names=["_chunk", "_first", "rows"])

    # Its columns have names of their own, as those of docs may be any.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(F.monotonically_increasing_id().alias("_at"), "*")
    return numbered.mapInArrow(run, "_chunk long, _first long, rows binary")


def _unpacked(packed: pa.Table) -> pa.Table:
    """The rows of a chunk in order."""
    order = pc.sort_indices(packed.column("_first"))
    return pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in packed.column("rows").take(order)])


def encode(docs: DataFrame, model: Model, and_decode: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` plus ids (array of ints) of column text; and decoded, their text, if asked for.

    A null or empty text has an empty array. U+2581 in a text is a space to the model, so it
    decodes to one. Columns ids and decoded of ``docs`` are replaced, others may have any name; rows of equal
    id or text each keep their own row. ``docs`` is read three times and has to be split alike each time, as
    a table of files is; anything else (a shuffle, a join, a filter) is written to the shared folder first. A chunk
    is up to 2**CHUNK_BITS rows of one partition, in whose order they stay. The distinct parts of all texts go through ``encode_words``, the most
    frequent ones first: these are sent to all tasks, at most COMMON_PARTS of them. The ids of
    the others are joined to the chunks they are in, and the chunks' rows move there as compressed batches.
    """
    docs, spark = docs.drop("ids", "decoded"), docs.sparkSession
    if not _splits_alike(docs):
        docs = materialise(docs, "texts")
    known = spark.sparkContext.broadcast(common_parts(docs, model))
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    used = materialise(_parts(docs.select(chunk.alias("_chunk"), "text"), model, known).select("_chunk", "word"), "words")
    used = _spread(used)
    # The chunk is asked for, so that both sides of the join below need the same columns and one shuffle.
    words = used.groupBy("word").agg(F.min("_chunk").alias("_first")).where("_first is not null").select("word")
    short = encode_words(words.where(F.length("word") <= LONG), model).select("word", "ids")
    coded = short.unionByName(_encode_long(words.where(F.length("word") > LONG), model))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * and_decode]
    schema, text = T.StructType([*docs.schema.fields, *added]), docs.columns.index("text")
    names = schema.names

    def run(packed: pa.Table, own: pa.Table) -> pa.Table:
        rows = _unpacked(packed)
        values = pa.concat_arrays(own.column("word").chunks or [pa.array([], pa.string())])
        flat, at = _lists(own.column("ids"))

        def look_up(words: list[str], _: Model) -> tuple[np.ndarray, np.ndarray]:
            where = pc.index_in(pa.array(words, type=values.type), value_set=values)
            if where.null_count:
                raise ValueError("docs were split differently when they were read again")
            where = where.to_numpy().astype(np.int64)
            sizes = at[where + 1] - at[where]
            return flat[batch.ragged(at[where], sizes)], np.concatenate([[0], np.cumsum(sizes)])

        ids, cuts = encode_texts(rows.column(text), model, known.value, look_up)
        columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(ids, type=pa.int32()))]
        return pa.table(columns + [pa.array(decode_ids(ids, cuts, model), type=pa.string())] * and_decode, names=names)

    own = used.join(coded, "word").select("_chunk", "word", "ids")
    return _packed(docs).groupBy("_chunk").cogroup(own.groupBy("_chunk")).applyInArrow(run, schema)


def _encode_long(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of words whose fold would take the square of their length."""

    def run(batches):
        for b in batches:
            ids, cuts = encode_distinct(b.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(ids, type=pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """All rows and columns plus decoded, the text of column ids; null ids decode to null."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def run(batches):
        for b in batches:
            ids, cuts = _lists(b.column(at))
            texts = decode_ids(ids, cuts, model)
            decoded = pc.if_else(pc.is_valid(b.column(at)), pa.array(texts, type=pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], names=names)

    return encoded.mapInArrow(run, schema)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, rank, score) of the pieces that texts can hold."""
    rank = _tables(model)[4]
    rows = [(p, i, int(rank[i]), float(model.scores[i])) for i, p in enumerate(model.pieces) if model.normal[i]]
    return spark.createDataFrame(rows, "piece string, id int, rank long, score double")


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, pieces, ids): the pieces of each word, of which ``words`` has every one once, by Spark joins and folds alone.

    Substrings of bounded length are exploded, joined to the piece table, grouped by word
    and folded. A code point that is no piece stands for itself and has the ids of its bytes. Words
    have SPACE for spaces.
    The piece table is broadcast; it is as large as the model, not as the data.
    """
    table = F.broadcast(piece_table(words.sparkSession, model))
    n = F.length("word")
    at = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("p"))
    parts = at.select("word", "p", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("p") + 1))).alias("l"))
    edges = parts.select("word", "p", "l", F.substring("word", F.col("p"), F.col("l")).alias("piece")).join(table, "piece", "left").where("id is not null or l = 1")
    value = F.coalesce("rank", F.lit((1 << 40))).cast("double") if model.kind == "bpe" else F.coalesce("score", F.lit(min(model.scores) - 10.0))
    entry = F.struct((F.col("p") * 4096 + F.col("l")).alias("k"), F.struct(value.alias("v"), "id").alias("e"))
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(entry)).alias("edge"))
    fold = _spark_merges if model.kind == "bpe" else _spark_viterbi
    # A column of its own: inside a lambda the fold would run again for each piece.
    folded = grouped.select("word", "edge", fold(F.col("word"), F.col("edge"), model.longest).alias("cuts"))
    begin, size = (lambda i: F.element_at("cuts", i)), (lambda i: F.element_at("cuts", i + 1) - F.element_at("cuts", i))
    each = F.sequence(F.lit(1), F.size("cuts") - 1)
    of_byte = F.array(*[F.lit(i) for i in model.byte_id])
    spelt = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda j: F.element_at(of_byte, F.conv(F.substring(F.hex(c), j * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))
    piece = lambda i: F.substring("word", begin(i), size(i))
    known = lambda i: F.try_element_at("edge", begin(i) * 4096 + size(i))["id"]
    ids = F.flatten(F.transform(each, lambda i: F.when(known(i).isNull(), spelt(piece(i))).otherwise(F.array(known(i)))))
    return folded.select("word", F.transform(each, piece).alias("pieces"), ids.alias("ids"))


def _spark_merges(word, edge, longest):
    start = F.struct(F.sequence(F.lit(1), F.length(word) + 1).alias("cuts"), F.lit(0).alias("last"))

    def merge(acc, _):
        cuts = acc["cuts"]
        ways = F.transform(F.sequence(F.lit(1), F.size(cuts) - 2), lambda i: F.struct(F.try_element_at(edge, F.element_at(cuts, i) * 4096 + F.element_at(cuts, i + 2) - F.element_at(cuts, i))["v"].alias("v"), i.alias("i")))
        best = F.array_min(F.filter(ways, lambda w: w["v"] < float(1 << 40)))
        # Bound to a lambda's variable, or the filter would look for it again at each cut.
        next_ = F.transform(F.array(best), lambda b: F.when(b.isNull(), F.struct(cuts.alias("cuts"), F.lit(1).alias("last"))).otherwise(
            F.struct(F.filter(cuts, lambda c, k: k != b["i"]).alias("cuts"), F.lit(0).alias("last"))))[0]
        return F.when((acc["last"] == 1) | (F.size(cuts) < 3), acc).otherwise(next_)

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, merge)["cuts"]


def _spark_viterbi(word, edge, longest):
    begin = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("l")))

    def step(best, end):
        ways = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), end)), lambda n: F.struct((F.element_at(best, end - n + 1)["s"] + F.try_element_at(edge, (end - n + 1) * 4096 + n)["v"]).alias("s"), (-n).alias("l")))
        top = F.array_max(F.filter(ways, lambda w: w["s"].isNotNull()))
        return F.concat(best, F.array(F.struct(top["s"].alias("s"), (-top["l"]).alias("l"))))

    best = F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step)
    back = F.aggregate(
        F.sequence(F.lit(1), F.length(word)), F.struct(F.length(word).alias("p"), F.array(F.length(word) + 1).alias("out")),
        lambda acc, _: F.when(acc["p"] <= 0, acc).otherwise(F.struct(
            (acc["p"] - F.element_at(best, acc["p"] + 1)["l"]).alias("p"),
            F.concat(F.array(acc["p"] - F.element_at(best, acc["p"] + 1)["l"] + 1), acc["out"]).alias("out"))),
    )
    return back["out"]


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (ids as text, comma-joined), round_trip."""
    both = encode(docs.select("doc_id", "text"), model, and_decode=True)
    text = F.coalesce("text", F.lit(""))
    return both.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == F.replace(text, F.lit(SPACE), F.lit(" "))).alias("round_trip"),
    )


def op10_sentencepiece(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(model_path))
