"""Size-tiered shards under a versioned manifest, in Spark functions and file renames only.

Each arrival is one run: a folder of small immutable files. Runs whose files are of similar
size are one tier (powers of ``fanout``); a tier that has at least ``fanout`` files is merged
into one run of files of the target size. Every change writes the next version of the
manifest, a table of files, to a folder of its own name and then renames it, which fails if
that version is there already: readers see either the old version or the new one, and of
two writers one loses and tries again on top of the other's version.

A version's rows are read from the one folder of all runs, by a join with the runs of its
manifest, which prunes the other folders; no list of files goes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import new_folder

MANIFEST = "run string, file string, bytes long, rows long, version long, columns string"
#: Columns that ``read`` adds; those of these names in a table are left out when it is appended.
ADDED = ("shard_run", "shard", "shard_bytes")
#: How often a writer that lost tries again.
TRIES = 20


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions that are still kept, ascending."""
    fs, at = _files(spark, root), _path(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def version(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 before the first."""
    return max(versions(spark, root), default=0)


def manifest(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The files (run, file, bytes, rows, version that added them, columns) of a version, the newest by default."""
    at = version(spark, root) if at is None else at
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v{at:08d}") if at else spark.createDataFrame([], MANIFEST)


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


def commit(spark: SparkSession, root: str, files: DataFrame, at: int) -> int:
    """Make ``files`` version ``at`` by one rename."""
    staged, final = f"{root}/staged-{uuid.uuid4().hex}", f"{root}/manifest/v{at:08d}"
    files.select("run", "file", "bytes", "rows", "version", "columns").write.parquet(staged)
    fs = _files(spark, root)
    fs.mkdirs(_path(spark, f"{root}/manifest"))
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, staged), _path(spark, final), options)
    except Exception as e:
        fs.delete(_path(spark, staged), True)
        if fs.exists(_path(spark, final)):
            raise Conflict(final) from e
        raise
    return at


def _write_run(rows: DataFrame, root: str) -> tuple[str, DataFrame]:
    """Write a run; its name and the manifest rows of those of its files that have rows."""
    spark, run = rows.sparkSession, f"r{uuid.uuid4().hex}"
    folder = f"{root}/data/shard_run={run}"
    rows.write.option("compression", "zstd").parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    files = written.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return run, files.select(F.lit(run).alias("run"), "file", "bytes", "rows", F.lit(rows.schema.json()).alias("columns"))


def _commit_change(spark: SparkSession, root: str, added: DataFrame, change: Callable[[DataFrame], DataFrame | None]) -> int | None:
    """Commit what ``change`` makes of the newest manifest, plus ``added``; None if it makes nothing of it."""
    for _ in range(TRIES):
        at = version(spark, root)
        kept = change(manifest(spark, root, at))
        if kept is None:
            return None
        try:
            return commit(spark, root, kept.unionByName(added.withColumn("version", F.lit(at + 1).cast("long"))), at + 1)
        except Conflict:
            continue
    raise Conflict(f"{TRIES} tries at {root}")


def columns_of(spark: SparkSession, root: str, at: int | None = None) -> T.StructType:
    """The columns of a version: those of all its runs by name, in the order in which they came."""
    seen: dict[str, T.StructField] = {}
    kinds = manifest(spark, root, at).groupBy("columns").agg(F.min("version").alias("since")).orderBy("since", "columns")
    for row in kinds.collect():
        for field in T.StructType.fromJson(json.loads(row["columns"])).fields:
            known = seen.setdefault(field.name, T.StructField(field.name, field.dataType))
            if known.dataType != field.dataType:
                raise ValueError(f"column {field.name} is {known.dataType.simpleString()} in some runs and {field.dataType.simpleString()} in others")
    return T.StructType(list(seen.values()))


def append(docs: DataFrame, root: str) -> int:
    """Write ``docs`` as one run of small immutable shards, a file a task, and commit it.

    Nothing moves between tasks. Returns the version; without rows nothing is committed. All
    rows and values are kept, repeated and null ones too. Columns may be new: older rows have
    null in them. A column of another type than before is an error. Columns named like
    those that ``read`` adds are left out.
    """
    spark, docs = docs.sparkSession, docs.drop(*ADDED)
    at = version(spark, root)
    before = {f.name: f.dataType for f in columns_of(spark, root, at)}
    for field in docs.schema:
        if before.get(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} was {before[field.name].simpleString()}, not {field.dataType.simpleString()}")
    run, added = _write_run(docs, root)
    if added.isEmpty():
        _files(spark, root).delete(_path(spark, f"{root}/data/shard_run={run}"), True)
        return at
    return _commit_change(spark, root, added, lambda files: files)


def tiers(files: DataFrame, *, base: int, fanout: int) -> DataFrame:
    """(run, files, bytes, tier) of runs: tier 0 up to ``base`` bytes a file, one more for each factor of ``fanout``."""
    runs = files.groupBy("run").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    ratio = F.greatest(F.col("bytes") / F.col("files") / F.lit(base), F.lit(1.0))
    return runs.withColumn("tier", F.floor(F.log(float(fanout), ratio) + F.lit(1e-9)).cast("int"))


def compact(spark: SparkSession, root: str, *, target_bytes: int = 64 << 20, base: int = 1 << 20, fanout: int = 4) -> int:
    """Merge tiers until none has ``fanout`` files below the target; returns the version.

    A merge reads runs of one tier only, so its inputs are alike in size; they are packed
    into as many files as the target needs, without a shuffle. Rows neither change nor get
    lost. Runs whose files have about the target size are never rewritten. A merge whose inputs
    another writer has merged meanwhile is thrown away. Old files stay until ``vacuum``.
    """
    while True:
        files = manifest(spark, root)
        small = tiers(files, base=base, fanout=fanout).where(F.col("bytes") < 0.75 * target_bytes * F.col("files"))
        ripe = small.groupBy("tier").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).where(F.col("files") >= fanout).orderBy("tier").first()
        if ripe is None:
            return version(spark, root)
        merged = small.where(F.col("tier") == ripe["tier"]).select("run")
        out = max(1, min(ripe["files"] // 2, round(ripe["bytes"] / target_bytes)))
        run, added = _write_run(_rows(spark, root, merged, columns_of(spark, root)).drop("shard_run").coalesce(out), root)

        def without(now: DataFrame, inputs=merged, taken=merged.count()) -> DataFrame | None:
            there = now.select("run").distinct().join(inputs, "run", "left_semi").count()
            return now.join(inputs, "run", "left_anti") if there == taken else None

        if _commit_change(spark, root, added, without) is None:
            _files(spark, root).delete(_path(spark, f"{root}/data/shard_run={run}"), True)


def vacuum(spark: SparkSession, root: str, *, keep: int = 10) -> int:
    """Delete runs that only versions older than the newest ``keep`` have, then these versions.

    Runs that no version has, as those of a writer at work, are left alone. Returns the
    number of runs deleted.
    """
    every = versions(spark, root)
    old, kept = every[:-keep], every[-keep:]
    if not old:
        return 0
    runs = lambda which: spark.read.schema(MANIFEST).parquet(*[f"{root}/manifest/v{v:08d}" for v in which]).select("run").distinct()
    fs, gone = _files(spark, root), 0
    for row in runs(old).join(runs(kept), "run", "left_anti").toLocalIterator():
        gone += fs.delete(_path(spark, f"{root}/data/shard_run={row['run']}"), True)
    for v in old:
        fs.delete(_path(spark, f"{root}/manifest/v{v:08d}"), True)
    return gone


def _rows(spark: SparkSession, root: str, runs: DataFrame, columns: T.StructType) -> DataFrame:
    """The rows of some runs, with shard_run."""
    schema = T.StructType([*columns.fields, T.StructField("shard_run", T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(f"{root}/data").join(runs.select(F.col("run").alias("shard_run")).distinct(), "shard_run", "left_semi")


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The rows of a version, each with shard_run, shard (its file) and shard_bytes; none before the first."""
    at = version(spark, root) if at is None else at
    if not at:
        return spark.createDataFrame([], "shard_run string, shard string, shard_bytes long")
    columns = columns_of(spark, root, at)
    schema = T.StructType([*columns.fields, T.StructField("shard_run", T.StringType())])
    rows = spark.read.schema(schema).option("basePath", f"{root}/data").parquet(f"{root}/data")
    rows = rows.select("*", F.concat_ws("/", "shard_run", "_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
    runs = manifest(spark, root, at).select(F.col("run").alias("shard_run")).distinct()
    return rows.join(runs, "shard_run", "left_semi").select(*columns.names, *ADDED)


def op9_sharding(spark, sf_dir: str, arrivals: int = 8) -> DataFrame:
    """All documents after they arrived in uneven parts, each appended and committed, and were compacted twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = new_folder(spark, "shards")
    part = F.floor(F.sqrt(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals**2)).cast("double")))
    for n in range(arrivals):
        append(docs.where(part == n), root)
        if n % 4 == 3:
            compact(spark, root)
    at = version(spark, root)
    found = read(spark, root, at)
    return found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_chars"), "shard", "shard_bytes", F.lit(at).cast("long").alias("version"))
