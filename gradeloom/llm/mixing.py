"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into a fixed number of hashed blocks a source. The blocks of a source
are permuted; full passes, whole blocks of a last pass and a part of one more block
meet the source's target. A tree then deals the exact block quotas of all sources to
the output shards: each node splits its quotas between its halves by one multivariate
hypergeometric draw, and each shard takes the next disjoint run of every permutation.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import materialise, word_count

WEIGHTS = (5, 2, 1)
#: Sums by (source, block) that the driver holds; with many sources, each has fewer blocks.
PLAN_ROWS = 1 << 20
COUNTED = ("size", "source_size", "target", "copies", "shards")


def targets(sizes: dict, weights: dict, share: float = 1.5, cap: float = 2.0) -> dict:
    """Words wanted of each source: by weight, at most ``cap`` times its size, excess reshared."""
    open_, out = {s for s in sizes if sizes[s] > 0}, dict.fromkeys(sizes, 0.0)
    left = share * sum(sizes.values())
    while open_:
        whole = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / whole > cap * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / whole for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def cycled_weights(sources, cycle=WEIGHTS) -> dict:
    """5, 2, 1, 5, ... over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) blocks: the whole of ``quotas``, dealt by halving the shards again and again."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1 or not have.sum():
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals")
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _key(seed: int):
    return F.xxhash64(F.col("doc_id"), F.lit(seed))


def plan_mix(sized: DataFrame, *, weights: dict | None, share: float, cap: float, blocks: int, seed: int):
    """The mix as small tables: by source, and by source and block.

    Only sums by (source, block) reach the driver: at most ``blocks`` rows a source.
    """
    sized = sized.withColumn("block", F.pmod("rank", F.lit(blocks)))
    sums = sized.groupBy("source", "block").agg(F.sum("size").alias("words")).toPandas()
    size = defaultdict(int)
    by_source: dict = defaultdict(list)
    for s, b, w in zip(sums["source"], sums["block"], sums["words"], strict=True):
        s = None if s is None or s != s else s
        size[s] += int(w)
        by_source[s].append((int(b), int(w)))
    ordered = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    weights = cycled_weights(ordered) if weights is None else {s: float(weights.get(s, 0.0)) for s in ordered}
    wanted = targets(dict(size), weights, share, cap)
    rows, quotas, draws, gaps = [], [], [], []
    for n, s in enumerate(ordered):
        order = np.random.default_rng([seed, n]).permutation(len(by_source[s]))
        held = [sorted(by_source[s])[i] for i in order]
        passes = min(int(wanted[s] // size[s]), int(cap)) if size[s] else 0
        rest, last, part = wanted[s] - passes * size[s], set(), None
        for b, w in held:
            if passes >= cap or not size[s]:
                break
            if w > rest:
                part = b
                gaps.append((s, b, float(rest)))
                break
            last.add(b)
            rest -= w
        taken = [(p, b) for p in range(passes) for b, _ in held] + [(passes, b) for b, _ in held if b in last or b == part]
        quotas.append(len(taken))
        draws.append(taken)
        rows += [(s, b, passes + (b in last), b == part, float(wanted[s]), size[s]) for b, _ in held]
    return sized, rows, quotas, draws, gaps, wanted, ordered


def passes_of(rows) -> dict:
    """Full passes over a source: the fewest copies any of its blocks gets."""
    out: dict = {}
    for s, _, copies, _, _, _ in rows:
        out[s] = min(copies, out.get(s, copies))
    return out


#: Columns of this name in a table are out of the way while it is mixed.
WORKING = ("_source", "_block", "_base", "_part", "_cut", "_closers", "_shards", "_rank", "_at")


def mix_counts(docs: DataFrame, *, weights: dict | None = None, share: float = 1.5, cap: float = 2.0, blocks: int = 1024, words_per_shard: int = 20_000_000, seed: int = 11) -> DataFrame:
    """All rows of ``docs`` plus size, source_size, target, copies and shards (one for each copy).

    Sizes are words of ASCII-white-space-separated text; a null or empty text has none. A
    null source is a source of its own. Rows of one doc_id are drawn together. Sources
    weigh 5, 2, 1, 5, ... by code point if ``weights`` is None; a source that ``weights``
    lacks weighs nothing. No row has more than ``cap`` copies. Reruns agree. Columns of
    ``docs`` with the names above are replaced.
    """
    docs = docs.drop(*COUNTED)
    docs, spark = docs.withColumnsRenamed({c: f"{c}_own" for c in WORKING if c in docs.columns}), docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("rank")), "sizes")
    blocks = max(1, min(blocks, PLAN_ROWS // max(1, sized.select("source").distinct().count())))
    sized, rows, quotas, draws, gaps, wanted, ordered = plan_mix(sized, weights=weights, share=share, cap=cap, blocks=blocks, seed=seed)
    cuts = _cut_last_blocks(spark, sized, rows, gaps)
    shards = max(1, min(sum(quotas), int(sum(wanted.values()) // words_per_shard) + 1))
    dealt = split_quotas(np.array(quotas, dtype=np.int64), shards, seed) if quotas else np.zeros((1, 0), dtype=np.int64)
    where: dict = defaultdict(dict)
    for n, s in enumerate(ordered):
        for (p, b), shard in zip(draws[n], np.repeat(np.arange(len(dealt)), dealt[:, n]), strict=True):
            where[s, b][p] = int(shard)
    spare = {s: int(np.argmax(dealt[:, n])) if len(dealt) else 0 for n, s in enumerate(ordered)}
    table = [
        (s, b, copies, bool(part), w, z, cuts.get(s, (None, None))[0] if part else None, cuts.get(s, (None, []))[1], [where[s, b].get(p, spare[s]) for p in range(int(cap) + 1)])
        for s, b, copies, part, w, z in rows
    ]
    kind = "source string, block long, _base int, _part boolean, target double, source_size long, _cut long, _closers array<long>, _shards array<int>"
    plan = spark.createDataFrame(table, kind).withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    words = docs.withColumn("size", word_count(F.col("text"))).withColumn("_rank", _key(seed)).withColumn("_at", F.pmod("_rank", F.lit(blocks)))
    found = words.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_block")), "left")
    more = (F.coalesce(F.col("_part") & (F.col("_rank") <= F.col("_cut")), F.lit(False)) | F.coalesce(F.array_contains("_closers", F.col("_rank")), F.lit(False))).cast("int")
    found = found.withColumn("copies", F.coalesce(F.col("_base") + more, F.lit(0)))
    found = found.withColumn("shards", F.slice("_shards", F.lit(1), F.col("copies"))).select(*words.columns[:-3], "size", "source_size", "target", "copies", "shards")
    return found.withColumnsRenamed({f"{c}_own": c for c in WORKING})


def _cut_last_blocks(spark, sized: DataFrame, rows, gaps) -> dict:
    """For each source, the rank up to which its partial block is taken, and closing documents.

    A closing document is the one, of all that the last pass left out, whose size comes
    nearest to what is still missing. Rounds of them, each of at most one a source, go on until
    a source is within a thousandth of its target or no document brings it nearer. Ranks stand
    for documents; both steps aggregate.
    """
    if not gaps:
        return {}
    part = spark.createDataFrame(gaps, "source string, block long, gap double").withColumnsRenamed({"source": "_source", "block": "_block"})
    inside = sized.join(part, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    ranks = inside.groupBy("source", "gap", "rank").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranks.withColumn("_sum", F.sum("size").over(upto))
    fits = ranks.groupBy("source").agg(F.max(F.when(F.col("_sum") <= F.col("gap"), F.struct("rank", "_sum"))).alias("top"), F.first("gap").alias("gap")).collect()
    left = {r["source"]: (r["top"]["rank"] if r["top"] else None, r["gap"] - (r["top"]["_sum"] if r["top"] else 0)) for r in fits}
    passes = passes_of(rows)
    closers: dict = {s: [] for s in left}
    missing = {s: gap for s, (_, gap) in left.items()}
    while True:
        asked = [(s, b, part_, left[s][0], missing[s], closers[s]) for s, b, copies, part_, want, _ in rows if s in left and copies == passes[s] and missing[s] > 1e-3 * want]
        if not asked:
            break
        free = spark.createDataFrame(asked, "source string, block long, part boolean, cut long, gap double, closers array<long>").withColumnsRenamed({"source": "_source", "block": "_block"})
        rest = sized.join(free, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).where("not (part and cut is not null and rank <= cut) and not array_contains(closers, rank)")
        near = rest.where("abs(size - gap) < gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("rank"), F.col("size"))).alias("best")).collect()
        for r in near:
            closers[r["source"]].append(r["best"]["rank"])
            missing[r["source"]] -= r["best"]["size"]
        missing |= dict.fromkeys(left.keys() - {r["source"] for r in near}, 0.0)
    return {s: (cut, closers[s]) for s, (cut, _) in left.items()}


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each document as often as it was drawn, by shard, shuffled within it.

    Adds shard and copy to the columns of ``docs``, replacing those of these names; takes the
    options of mix_counts.
    """
    docs, seed = docs.drop("shard", "copy"), options.get("seed", 11)
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in COUNTED if c in docs.columns})
    drawn = mix_counts(own, **options).where("copies > 0").select(*own.columns, F.posexplode("shards").alias("copy", "shard"))
    drawn = drawn.withColumnsRenamed({f"_own_{c}": c for c in COUNTED})
    return drawn.repartition("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(64))).sortWithinPartitions("shard", F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(seed + 1)))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))
