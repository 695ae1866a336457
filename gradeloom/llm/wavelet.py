"""Token ids in binary shards: a wavelet matrix of each, in one compressed file a task.

A matrix has a plane of bits for each binary digit of an id, the highest first; below a plane the
ids with a 0 come before those with a 1, both in their order. Counts of ones before every 512th bit
give rank, a search in them select. From these come the id at a place, how often an id stands before
a place, and the places of an id, without unpacking; all ids come back plane by plane.

``write`` deals documents to tasks by ranges of their id, so that shards follow each other in its order.
A shard is a row: part and seq (its place among all), the documents' ids and sizes, and the matrix
as bytes; readers of headers or counts need not read the rest. It has SHARD ids, or one document if that is longer.
"""

from __future__ import annotations

import os
import struct
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm import batch
from gradeloom.llm.common import new_folder
from gradeloom.session import small

TOKENIZER = "word_bpe_49k.json"
#: Ids of a shard, and the id that ends a document.
SHARD, END = 1 << 21, 2
MOST_HEADERS = 100_000
#: Bytes of text that are encoded at once, and how many words' ids a worker keeps.
STRETCH, KEPT_WORDS = 4 << 20, 3 << 19
#: Words that are encoded as one text, and the control character that stands between them.
JOINED, APART = 200, "\x01"
MAGIC = b"WMX1"
SHARDS = "part int, seq int, n_docs long, n_tokens long, doc_ids array<long>, sizes array<long>, matrix binary"
COLUMNS = [column.split()[0] for column in SHARDS.split(", ")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- the matrix


class WaveletMatrix:
    """Of ``n`` ids below 2**levels; planes is (levels, bytes), a multiple of 64 bytes with 64 to spare."""

    def __init__(self, n: int, levels: int, zeros: np.ndarray, planes: np.ndarray):
        self.n, self.levels, self.zeros, self.planes = n, levels, zeros, planes
        self.words = planes.view("<u8")
        ones = np.bitwise_count(self.words).reshape(levels, -1, 8).sum(axis=2, dtype=np.int64)
        self.ones = np.cumsum(ones, axis=1) - ones

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"an id of {int(ids.max())} does not fit {levels} bits")
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32, copy=False)
        planes = np.zeros((levels, (len(ids) // 512 + 1) * 64), dtype=np.uint8)
        zeros = np.zeros(levels, dtype=np.int64)
        for level in range(levels):
            bit = (ids & ids.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            low = np.compress(~bit, ids)
            zeros[level] = len(low)
            ids = np.concatenate([low, np.compress(bit, ids)])
        return cls(len(ids), levels, zeros, planes)

    def to_bytes(self) -> bytes:
        return b"".join((MAGIC, struct.pack("<QI", self.n, self.levels), self.zeros.astype("<i8").tobytes(), self.planes.tobytes()))

    @classmethod
    def from_bytes(cls, data) -> WaveletMatrix:
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", data, 4)
        zeros = np.frombuffer(data, dtype="<i8", count=levels, offset=16)
        planes = np.frombuffer(data, dtype=np.uint8, offset=16 + 8 * levels).reshape(levels, -1)
        return cls(n, levels, zeros, planes)

    def ids(self) -> np.ndarray:
        """All of them, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        below = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            here = np.empty_like(below)
            here[~bit] = below[: self.zeros[level]]
            here[bit] = below[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            below = here
        return below

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        words, word = self.words[level], at >> 6
        out = self.ones[level][at >> 9]
        first = at >> 9 << 3
        for k in range(7):
            out = out + np.where(first + k < word, np.bitwise_count(words[first + k]), 0)
        return out + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def _place(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Where bit number k (from 0) of a kind stands on a plane."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * 512 - self.ones[level]
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), dtype=np.int64)
        for lo in range(0, len(k), 4096):
            own = block[lo : lo + 4096]
            bits = np.unpackbits(self.planes[level].reshape(-1, 64)[own], axis=1, bitorder="little") == bit
            within = (k[lo : lo + 4096] - before[own]).astype(np.int64)
            out[lo : lo + 4096] = own * 512 + (np.cumsum(bits, axis=1, dtype=np.int32) == within[:, None] + 1).argmax(axis=1)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._ones_before(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def _stretch(self, token: int, end: int) -> tuple[int, int]:
        """Below the last plane: where the token's occurrences before ``end`` begin and end."""
        edges = np.array([0, end], dtype=np.int64)
        for level in range(self.levels):
            ones = self._ones_before(level, edges)
            edges = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def count(self, token: int, end: int | None = None) -> int:
        """How often a token stands before place ``end``."""
        if token < 0 or token >> self.levels:
            return 0
        lo, hi = self._stretch(token, self.n if end is None else end)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        if token < 0 or token >> self.levels:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(*self._stretch(token, self.n))
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at


# --- encoding


class Encoder:
    """Ids of texts by a tokenizer that drops white space: each word has its own ids wherever it stands.

    Distinct words are encoded by the library; the ids of up to KEPT_WORDS are kept for later batches.
    """

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        (self.between,) = self.model.encode(APART, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat, self.start = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words; JOINED at once, which takes half the time, with a control character in between that has an id of its own."""
        plain = [w.replace(APART, "") for w in words]
        lines = [f" {APART} ".join([*plain[i : i + JOINED], ""]) for i in range(0, len(words), JOINED)]
        coded = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(c.ids for c in coded), dtype=np.uint32)
        ends = np.flatnonzero(ids == self.between)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep words apart")
        ids, sizes = ids[ids != self.between], np.diff(ends, prepend=-1) - 1
        for i in [i for i, w in enumerate(words) if APART in w]:
            own = np.array(self.model.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32)
            at = int(sizes[:i].sum())
            ids, sizes[i] = np.concatenate([ids[:at], own, ids[at + sizes[i] :]]), len(own)
        return ids, sizes

    def words(self, words: np.ndarray) -> np.ndarray:
        """Slots of distinct words: slot i has the ids flat[start[i]:start[i + 1]]."""
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(slots < 0)
        if len(self.slots) + len(missing) > KEPT_WORDS and self.slots:
            self._clear()
            return self.words(words)
        new = [words[i] for i in missing]
        if new:
            ids, sizes = self._encoded([w.decode(errors="replace") for w in new])
            slots[missing] = np.arange(len(new)) + len(self.start) - 1
            self.flat, self.start = np.concatenate([self.flat, ids]), np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.slots.update(zip(new, slots[missing].tolist(), strict=True))
        return slots

    def texts(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of a slice's rows, each with the end id behind it."""
        words, counts = batch.split_words(data, offsets)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        slots = self.words(coded.dictionary.to_numpy(zero_copy_only=False))
        begin, many = self.start[slots], self.start[slots + 1] - self.start[slots]
        sizes = many[at]
        words_before = np.append(0, np.cumsum(counts))
        ids_before = np.append(0, np.cumsum(sizes))[words_before]
        flat = self.flat[batch.ragged(begin[at], sizes)]
        return np.insert(flat, ids_before[1:], end), np.diff(ids_before) + 1


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    """One a worker process, which Spark reuses."""
    if hash(model) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[hash(model)] = Encoder(model)
    return _ENCODERS[hash(model)]


def _borders(docs: DataFrame, parts: int) -> list:
    """Ids that cut the documents into ``parts`` of about as many rows; at most parts - 1 of them reach the driver."""
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("b")).head().b if shares else None
    return sorted(found or [])


def write(docs: DataFrame, folder: str, *, path: str | None = None, end: int = END, parts: int | None = None, shard: int = SHARD) -> None:
    """Encode column text (null: empty) of every row by the tokenizer file at ``path``; write shards in ascending doc_id order.

    doc_id is an integer; null ids come first. Rows of one id are put in order by their texts' hash and ids, so
    reruns agree; many rows of one id are dealt to several tasks by that hash. ``parts`` tasks
    (the session's shuffle partitions unless given) write a file each. Other columns are not kept.
    Each document ends with the id ``end``. A task holds one shard.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(path or tokenizer_path()) as file:
        model = file.read()
    from tokenizers import Tokenizer

    levels = max(1, max(Tokenizer.from_str(model).get_vocab_size(True) - 1, end).bit_length())
    sent = spark.sparkContext.broadcast(model)
    borders = np.array(_borders(docs, parts), dtype=np.int64)
    kind = np.dtype("<u2" if levels <= 16 else "<u4")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")

    def encoded(batches):
        coder = _encoder(sent.value)
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = np.where(known, b.column(0).fill_null(0).to_numpy(), np.iinfo(np.int64).min)
            tie = b.column(1).to_numpy()
            first = np.searchsorted(borders, ids, side="left")
            part = first + tie % (np.searchsorted(borders, ids, side="right") - first + 1)
            for lo, data, offsets in batch.slices(b.column(2), STRETCH):
                flat, sizes = coder.texts(data, offsets, end)
                n = len(sizes)
                ends = np.append(0, np.cumsum(sizes * kind.itemsize)).astype(np.int64)
                coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(part[lo : lo + n].astype(np.int32)), coded], names=["doc_id", "tie", "part", "ids"])

    def shards(batches):
        part, seq, docs_of, held, size = None, 0, [], [], 0

        def made():
            ids = np.frombuffer(b"".join(held), dtype=kind)
            matrix = WaveletMatrix.of(ids, levels).to_bytes()
            names, sizes = pa.array([docs_of], pa.list_(pa.int64())), pa.array([[len(x) // kind.itemsize for x in held]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()), names, sizes, pa.array([matrix], pa.binary())], names=COLUMNS)

        for b in batches:
            for doc_id, own, ids in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("ids"), strict=True):
                ids = ids.as_py()
                if held and (own != part or size + len(ids) > shard * kind.itemsize):
                    yield made()
                    docs_of, held, size, seq = [], [], 0, seq + 1
                part = own
                docs_of.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield made()
        batch.give_back()

    dealt = rows.mapInArrow(encoded, "doc_id long, tie long, part int, ids binary").repartitionById(parts, F.col("part"))
    placed = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    # Rows are large: the writer looks at its size after each one.
    options = {"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    placed.mapInArrow(shards, SHARDS).write.options(**options).parquet(folder)


def open_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder plus start, the number of ids before each.

    The sums of the parts, as many rows as tasks wrote, go through the driver; a window adds up the
    shards of each part, from their headers alone. They are broadcast to the shards if they are at
    most MOST_HEADERS.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)
    headers = shards.select("part", "seq", "n_tokens")
    sums = sorted((r.part, r.n) for r in headers.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in sums:
        rows.append((part, before))
        before += n
    parts = spark.createDataFrame(rows, "part int, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    starts = headers.join(F.broadcast(parts), "part").select("part", "seq", (F.col("before") + within).alias("start"))
    return shards.join(small(starts, MOST_HEADERS), ["part", "seq"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a folder in the file's words: the number of ids before it, how many it has, and them as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column("sizes").slice(i, 1).flatten().to_numpy()
                matrix = b.column("matrix")[i].as_buffer()
                ids = WaveletMatrix.from_bytes(memoryview(matrix)).ids()
                if int(sizes.sum()) != len(ids):
                    raise ValueError("a shard's sizes and its ids differ")
                names, upto = b.column("doc_ids").slice(i, 1).flatten(), np.append(0, np.cumsum(sizes))
                at = int(b.column("start")[i].as_py())
                # Some rows at a time: as many bytes as a slice of text has.
                lo = 0
                while lo < len(sizes):
                    hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + batch.WINDOW, side="right")) - 1)
                    part = ids[upto[lo] : upto[hi]].astype("<u4")
                    coded = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((upto[lo : hi + 1] - upto[lo]) * 4), pa.py_buffer(part)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array(at + upto[lo:hi]), pa.array(sizes[lo:hi]), coded], names=["doc_id", "start", "n_tokens", "ids"])
                    lo = hi
        batch.give_back()

    return open_shards(spark, folder).select("start", "doc_ids", "sizes", "matrix").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n) of each of some distinct tokens: how often it stands in all shards, from ranks alone; absent ones count 0."""
    asked = sorted({int(t) for t in tokens})

    def run(batches):
        for b in batches:
            for matrix in b.column(0):
                found = WaveletMatrix.from_bytes(memoryview(matrix.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([found.count(t) for t in asked], pa.int64())], names=["token", "n"])

    shards = spark.read.schema(SHARDS).parquet(folder).select("matrix")
    none = spark.createDataFrame([(t, 0) for t in asked], "token long, n long")
    return shards.mapInArrow(run, "token long, n long").union(none).groupBy("token").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place, at): every occurrence of some tokens: its place in its document and among all ids."""
    asked = sorted({int(t) for t in tokens})

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                matrix = WaveletMatrix.from_bytes(memoryview(b.column("matrix")[i].as_buffer()))
                names, sizes = b.column("doc_ids").slice(i, 1).flatten(), b.column("sizes").slice(i, 1).flatten().to_numpy()
                begins, start = np.cumsum(sizes) - sizes, int(b.column("start")[i].as_py())
                for token in asked:
                    at = matrix.occurrences(token)
                    row = np.searchsorted(begins, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), names.take(pa.array(row)), pa.array(at - begins[row]), pa.array(at + start)], names=["token", "doc_id", "place", "at"])

    shards = open_shards(spark, folder).select("start", "doc_ids", "sizes", "matrix")
    return shards.mapInArrow(run, "token long, doc_id long, place long, at long")


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, shard: int = SHARD) -> DataFrame:
    """(at, token): the token at each distinct place (column at of ``places``, counted among all ids); others have none.

    Places meet shards by stretches of ``shard`` ids, of which a shard crosses two, or as many as a
    longer document has; each shard answers its own places, at most as many as it has ids.
    """
    shards = open_shards(spark, folder)
    stretch = F.explode(F.sequence(F.expr(f"start div {shard}"), F.expr(f"(start + n_tokens - 1) div {shard}"))).alias("stretch")
    heads = shards.select("part", "seq", "start", "n_tokens", stretch)
    asked = places.select("at").distinct().withColumn("stretch", F.expr(f"at div {shard}"))
    own = asked.join(heads, "stretch").where("at >= start and at < start + n_tokens").groupBy("part", "seq").agg(F.first("start").alias("start"), F.collect_list("at").alias("places"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at = b.column("places").slice(i, 1).flatten()
                found = WaveletMatrix.from_bytes(memoryview(b.column("matrix")[i].as_buffer())).access(at.to_numpy() - int(b.column("start")[i].as_py()))
                yield pa.RecordBatch.from_arrays([at, pa.array(found)], names=["at", "token"])

    joined = spark.read.schema(SHARDS).parquet(folder).select("part", "seq", "matrix").join(own, ["part", "seq"]).select("start", "places", "matrix")
    return joined.mapInArrow(run, "at long, token long")


def op13_token_output(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-shards")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
