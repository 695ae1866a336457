"""MinHash near-deduplication with odd sketches.

MinHash samples of a document's word shingles make band keys, which bring candidates
together, and fold into a parity bitmap (odd sketch): the bits in which two bitmaps
differ estimate the Jaccard similarity, best where it is high. Pairs whose estimate is
well below the threshold are left; all others are confirmed on the full shingle sets.

No bucket is expanded into its pairs. Equal sets collapse first. Then each document meets
the one of its buckets' members that shares most buckets; buckets whose members are in one
component are done. In the others, members of different components are compared inside the
task: sketch by sketch, which names the members that have a close partner, then these on
their full sets, of which only the links that join components come out. So no link that matters
is lost, and rows grow with the members of a bucket, not with its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import batch, bloom
from gradeloom.llm.common import materialise
from gradeloom.llm.components import components

#: Parity bits of a sketch, as longs.
BITS = 2048
LONGS = BITS // 64
_FACTORS = np.random.default_rng(20).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """similarity is a percentage. At 85 % a pair shares no band with probability 3e-7. All
    ``samples`` go into the sketches and the first bands * rows of them into band keys; the
    estimate has a deviation of 0.012, and estimates down to ``margin`` less are confirmed."""

    similarity: int = 85
    shingle: int = 5
    bands: int = 32
    rows: int = 6
    samples: int = 1024
    margin: float = 0.065
    block: int = 512
    bloom_bits: int = 1 << 28


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): the distinct shingles of row i are hashes[starts[i]:starts[i + 1]], sorted."""
    rows = len(offsets) - 1
    row, _, _, h = batch.words(data, offsets)
    n = len(h)
    full = max(0, n - width + 1)
    acc = np.zeros(full, dtype=np.uint64)
    for j in range(width):
        acc += h[j : j + full] * _FACTORS[j]
    whole = row[:full] == row[width - 1 :] if full else np.zeros(0, bool)
    owner, value = row[:full][whole], batch.mix64(acc[whole])
    words = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(words)])
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        sums = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = words[short] > j
            sums[has] += h[first[short[has]] + j] * _FACTORS[j]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, batch.mix64(sums + words[short].astype(np.uint64))])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    parts = [np.unique(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate(parts) if parts else value


def sketch(starts: np.ndarray, hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, bands) and odd sketches (n, LONGS) of sets, none of them empty."""
    k, n, bands, rows = s.samples, len(starts) - 1, s.bands, s.rows
    seeds = np.random.default_rng(4).integers(0, 1 << 32, (3, k), dtype=np.uint64).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((k, n), dtype=np.uint32)
    for i in range(k):
        v = (x ^ seeds[0, i]) * (seeds[1, i] | np.uint32(1))
        v ^= v >> np.uint32(15)
        v *= seeds[2, i] | np.uint32(1)
        low[i] = np.minimum.reduceat(v, starts[:-1])
    sample = batch.mix64(low.astype(np.uint64) | (np.arange(k, dtype=np.uint64)[:, None] << np.uint64(32)))
    keys = np.zeros((n, bands), dtype=np.uint64)
    for j in range(rows):
        keys += (sample[j : bands * rows : rows] * _FACTORS[j]).T
    bit = (sample & np.uint64(BITS - 1)).astype(np.int64)
    parity = np.zeros((n, BITS), dtype=np.uint8)
    for i in range(k):
        parity[np.arange(n), bit[i]] ^= 1
    return batch.mix64(keys), np.packbits(parity, axis=1, bitorder="little").view(np.uint64)


def similarity(differing, samples: int):
    """Estimated Jaccard similarity of two sketches that differ in so many bits."""
    return 1 + BITS / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def most_differing(settings: Settings) -> int:
    """Bits in which sketches may differ and still be confirmed on the sets."""
    bits = np.arange(BITS // 2)
    return int(np.flatnonzero(similarity(bits, settings.samples) >= settings.similarity / 100 - settings.margin).max())


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that stand for the set), bands, sketch."""

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(1)):
                starts, hashes = shingles(data, offsets, s.shingle)
                size = np.diff(starts)
                some = size > 0
                bands = np.zeros((len(size), s.bands), dtype=np.uint64)
                odd = np.zeros((len(size), LONGS), dtype=np.uint64)
                keys = np.zeros((len(size), 2), dtype=np.uint64)
                if some.any():
                    begin = starts[:-1][some]
                    bands[some], odd[some] = sketch(np.append(begin, starts[-1]), hashes, s)
                    keys[some, 0] = np.add.reduceat(hashes, begin)
                    keys[some, 1] = np.add.reduceat(batch.mix64(hashes + np.uint64(77)), begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, len(size)), pa.array(size), pa.array([k.tobytes() for k in keys], type=pa.binary()),
                        pa.array(list(bands.view(np.int64)), type=pa.list_(pa.int64())), pa.array(list(odd.view(np.int64)), type=pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def _close(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) with differing, the bits in which their sketches differ, at most ``limit``."""
    one = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("_sa"))
    two = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("_sb"))
    bits = sum((F.bit_count(F.col("_sa")[i].bitwiseXOR(F.col("_sb")[i])) for i in range(LONGS)), F.lit(0))
    return pairs.join(one, "a").join(two, "b").select("a", "b", bits.alias("differing")).where(F.col("differing") <= limit)


def shingle_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, hashes): the distinct shingles of whole texts, sorted."""

    def run(batches):
        for b in batches:
            for lo, data, offsets in batch.slices(b.column(1)):
                starts, hashes = shingles(data, offsets, s.shingle)
                lists = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(lists)), lists], names=["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>").where("size(hashes) > 0")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= s.similarity * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    one = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("_ha"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("_hb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "_ha", "_hb").mapInArrow(run, "a long, b long")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """Members (key, doc_id, label) of mixed buckets by the cells in which they are compared.

    A bucket of up to ``block`` members is one cell. In a larger one the members of its
    largest component need no comparison with each other: they and the others are cut into
    blocks, and a cell is a block of others with any block. With few others, as after the
    stars, that makes about two rows a member however large the bucket is.
    """
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("_main"), F.sum("n").alias("_n"), F.count("*").alias("_labels")).where("_labels > 1")
    placed = members.join(main, "key")
    whole = F.col("_n") <= block
    others = F.when(whole, 1).otherwise(F.ceil((F.col("_n") - F.col("_main.n")) / block)).cast("long")
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("_main.n") / block)).cast("long")
    is_main = ~whole & (F.col("label") == F.col("_main.label"))
    deal = F.xxhash64("doc_id")
    x = F.when(whole, F.lit(0).cast("long")).when(is_main, F.col("_others") + F.pmod(deal, F.col("_mains"))).otherwise(F.pmod(deal, F.col("_others")))
    last = F.when(is_main, F.col("_others")).otherwise(F.col("_others") + F.col("_mains")) - 1
    placed = placed.withColumns({"_others": others, "_mains": mains}).withColumns({"x": x, "_last": last})
    placed = placed.select("key", "doc_id", "label", "x", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_y"))
    return placed.select("key", F.least("x", "_y").alias("i"), F.greatest("x", "_y").alias("j"), "x", "doc_id", "label")


def _cell_by_cell(batches, columns: int):
    """The cells of batches sorted by (key, i, j), each as a list of column pieces from x on."""
    held, name = [], None
    for b in batches:
        if not b.num_rows:
            continue
        group = np.column_stack([b.column(c).to_numpy() for c in range(3)])
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(group)], strict=True):
            if held and name != tuple(group[lo]):
                yield name, held
                held = []
            name = tuple(group[lo])
            held.append([b.column(c).slice(lo, hi - lo) for c in range(3, columns)])
    if held:
        yield name, held


def _longs(held: list, column: int, width: int) -> np.ndarray:
    return np.concatenate([h[column].flatten().to_numpy(zero_copy_only=False) for h in held]).reshape(-1, width).view(np.uint64)


def _doubtful(cells: DataFrame, sketches: DataFrame, s: Settings, limit: int) -> DataFrame:
    """Members (key, i, j, x, doc_id, label) with a partner of another component whose sketch is close.

    A pair counts in the first of the buckets that both are in, so that it is settled once.
    """

    def run(batches):
        for (key, i, j), held in _cell_by_cell(batches, 8):
            x, ids, labels = (np.concatenate([h[c].to_numpy() for h in held]) for c in range(3))
            if (labels == labels[0]).all():
                continue
            bands, odd = _longs(held, 3, s.bands), _longs(held, 4, LONGS)
            left, right = (np.flatnonzero(x == i), np.flatnonzero(x == j)) if i != j else (np.arange(len(ids)), np.arange(len(ids)))
            found = np.zeros(len(ids), dtype=bool)
            for start in range(0, len(left), 32):
                part = left[start : start + 32]
                bits = np.bitwise_count(odd[part][:, None, :] ^ odd[right][None, :, :]).sum(axis=2, dtype=np.int64)
                p, q = np.nonzero((bits <= limit) & (labels[part][:, None] != labels[right][None, :]))
                if len(p):
                    one, two = part[p], right[q]
                    first = bands[one, (bands[one] == bands[two]).argmax(axis=1)].view(np.int64)
                    here = first == key
                    found[one[here]] = found[two[here]] = True
            at = np.flatnonzero(found)
            if len(at):
                same = [pa.array(np.full(len(at), v)) for v in (key, i, j)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x[at]), pa.array(ids[at]), pa.array(labels[at])], names=["key", "i", "j", "x", "doc_id", "label"])

    with_sketch = cells.join(sketches, "doc_id").select("key", "i", "j", "x", "doc_id", "label", "bands", "sketch")
    return with_sketch.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, i long, j long, x long, doc_id long, label long")


def _joining(doubtful: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) on the full sets that join components: in a cell, a forest of them at most."""

    def run(batches):
        for (_, i, j), held in _cell_by_cell(batches, 7):
            x, ids, labels = (np.concatenate([h[c].to_numpy() for h in held]) for c in range(3))
            size = np.concatenate([pc.list_value_length(h[3]).to_numpy() for h in held]).astype(np.int64)
            _, flat = np.unique(np.concatenate([h[3].flatten().to_numpy(zero_copy_only=False) for h in held]), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(size)])
            _, root = np.unique(labels, return_inverse=True)
            mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=np.uint8)
            left, right = (np.flatnonzero(x == i), np.flatnonzero(x == j)) if i != j else (np.arange(len(ids)), np.arange(len(ids)))
            edges = []
            for p in left:
                ratio = np.minimum(size[p], size[right]) * 100 >= s.similarity * np.maximum(size[p], size[right])
                others = right[(root[right] != root[p]) & ratio]
                if i == j:
                    others = others[others > p]
                if not len(others):
                    continue
                mark[flat[at[p] : at[p + 1]]] = 1
                for lo in range(0, len(others), 256):
                    some = others[lo : lo + 256]
                    cuts = np.concatenate([[0], np.cumsum(size[some])])
                    common = np.add.reduceat(mark[flat[batch.ragged(at[some], size[some])]], cuts[:-1], dtype=np.int64)
                    for q in some[100 * common >= s.similarity * (size[p] + size[some] - common)]:
                        if root[q] != root[p]:
                            root[root == root[q]] = root[p]
                            edges.append((ids[p], ids[q]))
                mark[flat[at[p] : at[p + 1]]] = 0
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    with_set = doubtful.join(sets, "doc_id").select("key", "i", "j", "x", "doc_id", "label", "hashes")
    return with_set.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (doc_id, label) after components that an edge (a, b) connects have merged."""
    la = labels.select(F.col("doc_id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    merged = components(edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "la", "lb")
    seen = edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct().join(labels, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label"))
    known = labels.unionByName(seen)
    return materialise(known.join(merged.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left").select("doc_id", F.coalesce("_to", "label").alias("label")), "labels")


def _tied(member: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after ids that stand with several texts have joined these texts' components; ids that stand once tie nothing."""
    texts = member.groupBy("doc_id").agg(F.min("rep").alias("_min"), F.max("rep").alias("_max"))
    several = texts.where("_min <> _max").select("doc_id").union(texts.join(labels, "doc_id", "left_semi").select("doc_id"))
    ties = materialise(member.join(several.distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "ties")
    return labels if ties.isEmpty() else _relabel(labels, ties)


def near_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of ``docs``.

    Documents are linked if 100 * intersection >= similarity * union of their sets of
    distinct word shingles (A-Z lower-cased; words parted by ASCII white space; a text of
    fewer words is one shingle). Null, empty and blank texts have no shingles and no links.
    component_id is the smallest doc_id reachable. Rows of one doc_id are one document of several
    texts: links of any of them hold for the id, and all of them get its component. Rows without doc_id come back with null
    component_id and are kept. Other columns of ``docs`` are not looked at.
    """
    s, spark = settings, docs.sparkSession
    limit = most_differing(s)
    sigs = materialise(signatures(docs, s), "signatures")
    usable = sigs.where("n_shingles > 0 and doc_id is not null")
    same = materialise(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "same")
    placed = usable.join(same.select("set_key", "rep"), "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    member = placed.where("doc_id <> rep").select("doc_id", "rep")
    reps = placed.where("doc_id = rep").select("doc_id", "bands", "sketch")
    keyed = reps.select("doc_id", F.explode(F.array_distinct("bands")).alias("key"))
    live = materialise(keyed.groupBy("key").agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"), F.count("*").alias("n")).where("_min <> _max").select("key", "n"), "buckets")
    met = keyed.join(live, "key")
    # The document that shares most buckets is likely the one that others were copied from.
    met = materialise(met.join(met.groupBy("doc_id").agg(F.sum("n").alias("weight")), "doc_id").select("key", "doc_id", "weight"), "members")
    ids = met.select("doc_id").distinct()
    sketches = materialise(sigs.select("doc_id", "bands", "sketch").join(ids, "doc_id", "left_semi"), "sketches")
    first = F.struct("weight", (-F.col("doc_id")).alias("minus"))
    centre = met.groupBy("key").agg(F.max(first).alias("centre"))
    stars = met.join(centre, "key").where("doc_id <> -centre.minus").groupBy("doc_id").agg(F.max("centre").alias("centre"))
    pairs = materialise(_close(stars.select(F.col("doc_id").alias("a"), (-F.col("centre.minus")).alias("b")), sketches, limit), "pairs")

    slots = bloom.slots_for(sketches.count(), bits_per_row=16, functions=2, max_bits=s.bloom_bits)
    filters = bloom.bitmaps(ids, "doc_id", slots, 2)
    needed = bloom.flag(docs.select("doc_id", "text"), F.col("doc_id"), filters, slots, 2, "_needed").where("_needed")
    sets = materialise(shingle_sets(needed, s), "sets")

    good = materialise(confirmed(pairs, sets, s), "confirmed")
    labels = _relabel(spark.createDataFrame([], "doc_id long, label long"), good)
    named = met.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    doubtful = materialise(_doubtful(_cells(named, s.block), sketches, s, limit), "doubtful")
    more = materialise(_joining(doubtful, sets, s), "joining")
    labels = _relabel(labels, more)
    labels = _tied(member, labels)
    alone = member.join(labels, "doc_id", "left_anti").join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left")
    found = materialise(alone.select("doc_id", F.coalesce("label", "rep").alias("_component")).distinct().union(labels), "components")
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs)


OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as materialized (select a, b from e union select b, a from e),
r(id, root) as (select doc_id, doc_id from documents union select u.b, r.root from r join u on u.a = r.id where r.root < u.b)
select doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, doc_id = c.component_id as kept
from documents left join n using (doc_id) join (select id as doc_id, min(root) as component_id from r group by 1) c using (doc_id)
"""
