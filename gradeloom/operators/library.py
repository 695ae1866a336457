"""A library of passages: chunks, vectors, exact nearest passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import small

#: Vectors of a block; two blocks are compared by one product of matrices.
BLOCK = 1024


def chunks(pages: DataFrame, size: int = 900, least: int = 120) -> DataFrame:
    """Lines of a page gathered up to ``size`` characters; pieces of ``least`` and fewer go.

    pages: book, page, text. Lines are trimmed and keep their inner spacing, blank ones go. A piece
    closes when the next line would make it, with the space before each line, too long.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc, p):
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) > size)
        return F.struct(
            F.concat(F.when(full, "").otherwise(acc["open"]), F.lit(" "), p).alias("open"),
            F.when(full, F.concat(acc["done"], F.array(F.substr(acc["open"], F.lit(2))))).otherwise(acc["done"]).alias("done"),
        )

    whole = F.aggregate(lines, start, step, lambda acc: F.concat(acc["done"], F.array(F.substr(acc["open"], F.lit(2)))))
    each = pages.select("book", "page", F.posexplode(F.filter(whole, lambda c: F.length(c) > least)).alias("n", "text"))
    return each.select(F.concat_ws("_", "book", F.concat(F.lit("p"), "page"), "n").alias("id"), "book", "page", "text")


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def fragments_per_book(passages: DataFrame) -> DataFrame:
    return passages.groupBy("book").agg(F.count("*").alias("fragments"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _regular(vector: str, size: int) -> Column:
    """Whether a vector has ``size`` components, all of them finite numbers."""
    plain = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & plain, F.lit(False))


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, flat): BLOCK rows of (key, vector) at a time, as bytes of longs and doubles; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pydict({f"{key}s": [ids.tobytes()], f"{key}_flat": [flat.reshape(-1, size).tobytes()]})

    return rows.select(F.col(key).cast("long"), "vector").mapInArrow(run, f"{key}s binary, {key}_flat binary")


def _block_best(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, similarity): the k best rows of p for each of q, of equals the least id.

    The product of the matrices finds who can be among them; their similarities are added up in the components' order, as ``cosine`` does.
    """
    score = q @ p.T
    k = min(k, len(p))
    # More than the product's rounding can be off.
    slack = 1e-12 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1).max()
    near, at = np.nonzero(score >= np.partition(score, len(p) - k, axis=1)[:, len(p) - k, None] - slack)
    exact = np.zeros(len(near))
    for d in range(q.shape[1]):
        exact += q[near, d] * p[at, d]
    order = np.lexsort((ids[at], -exact, near))
    near, at, exact = near[order], at[order], exact[order]
    first = np.searchsorted(near, near)
    keep = np.arange(len(near)) - first < k
    return near[keep], at[keep], exact[keep]


def _nearest_by_blocks(queries: DataFrame, passages: DataFrame, k: int, size: int) -> DataFrame:
    """(query_id, passage_id, similarity) of regular vectors: of each two blocks the k best of every query."""
    pairs = _blocks(passages, "passage_id", size).crossJoin(small(_blocks(queries, "query_id", size), 16))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("passage_id", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, flat, asked, given in zip(*(b.column(i) for i in range(4)), strict=True):
                ids, asked = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (ids, asked))
                p, q = (np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, size) for x in (flat, given))
                near, at, exact = _block_best(q, p, ids, k)
                yield pa.RecordBatch.from_pydict({"query_id": asked[near], "passage_id": ids[at], "similarity": exact})

    found = pairs.mapInArrow(run, schema)
    return found.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("passage_id").cast(passages.schema["passage_id"].dataType), "similarity")


def _nearest_by_rows(queries: DataFrame, passages: DataFrame) -> DataFrame:
    scored = passages.select("passage_id", F.col("vector").alias("_v")).crossJoin(small(queries.select("query_id", F.col("vector").alias("_q"))))
    return scored.select("query_id", "passage_id", cosine(F.col("_q"), F.col("_v")).alias("similarity"))


def nearest(queries: DataFrame, passages: DataFrame, k: int = 2) -> DataFrame:
    """The k nearest passages (passage_id, vector) of each query (query_id, vector), exactly.

    Every query meets every passage, BLOCK by BLOCK, and each two blocks keep k a query before anything is
    shuffled. Vectors of another length than the longest query, or with components that are no numbers, and
    ids that are no whole numbers are compared row by row.
    """
    queries, passages = queries.select("query_id", "vector"), passages.select("passage_id", "vector")
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((queries, "query_id"), (passages, "passage_id")))
    size = queries.agg(F.max(F.size("vector"))).first()[0] if whole else None
    if not size or size < 1:
        return best(_nearest_by_rows(queries, passages), k)
    fits, ids = _regular("vector", size), lambda c: F.col(c).isNotNull()
    odd_queries, odd_passages = queries.where(~(fits & ids("query_id"))), passages.where(~(fits & ids("passage_id")))
    queries_, passages_ = queries.where(fits & ids("query_id")), passages.where(fits & ids("passage_id"))
    parts = _nearest_by_blocks(queries_, passages_, k, size)
    if not odd_queries.isEmpty():
        parts = parts.unionByName(_nearest_by_rows(odd_queries, passages))
    if not odd_passages.isEmpty():
        parts = parts.unionByName(_nearest_by_rows(queries_, odd_passages))
    return best(parts, k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, of equals the lesser passage_id; each of 64 parts of a query keeps k first."""
    order = [F.col("similarity").desc(), F.col("passage_id")]
    local = scored.withColumn("_part", F.pmod(F.xxhash64("passage_id"), F.lit(64)))
    local = local.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("_n") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "passage_id", "similarity", "rank")


def section_query(items: DataFrame, sections: DataFrame, criteria: int = 4) -> DataFrame:
    """The text a section is looked up by: its name and its first criteria, with the model's prefix."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "criterion"))), 1, criteria)
    texts = items.groupBy("section_id").agg(F.array_join(F.transform(first, lambda c: c["criterion"]), " ").alias("_c"))
    return sections.join(texts, "section_id").select("section_id", F.concat(F.lit("query: "), "name", F.lit(". Criterios: "), "_c").alias("query"))


def shown_passage(text: Column, book: Column, page: Column, most: int = 400) -> Column:
    """A passage as judges are shown it: its first characters, book and page."""
    return F.concat(F.lit("«"), F.substring(text, 1, most), F.lit("» ("), book, F.lit(", pág. "), page.cast("string"), F.lit(")"))
