"""Document fingerprints by consistent weighted sampling, in Spark functions only.

A document is a bag of terms (pairs of neighbouring words) weighted by their counts. For
each sample a term draws r and c from Gamma(2, 1) and b from U(0, 1), all of them from
hashes of the term and the sample; with t = floor(ln w / r + b) its key is
ln c - r * (t - b + 1), and the sample is (term, t) of the smallest key. Two documents
agree in a sample with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACE, materialise

#: Samples of a fingerprint: as many groups, each worked out by one row of a term. Few samples a row
#: keep the generated method small enough to be compiled.
GROUPS, PER_GROUP = 32, 4
SAMPLES = GROUPS * PER_GROUP
#: Bits of a packed sample that hold its hash; the other bits order the keys.
TAG_BITS = 24
#: Keys lie between -(22 + 45 + ln w) and 5, as ln c is at least -22 and r at most 45. Keys are told apart by 2**-31.
KEY_SHIFT, KEY_SCALE = 128.0, 2.0**31
#: The smallest of exp(key) over a text's terms is exponential with the rate of its total weight, so it is above
#: NEAR over that weight once in exp(NEAR) samples. Keys that are bound to be above are not worked out; where
#: no other key is below, the text is walked through anew (see exact_print).
NEAR = 16.0


def _uniform(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from the 32 bits above ``shift``."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) * F.lit(2.0**-32)


def draws(term: Column, sample: Column) -> dict[str, Column]:
    """What a term draws for a sample: r, the logarithm of c, b, and the hash that b is from.

    Minus the logarithm of a product of two uniform numbers is a draw from Gamma(2, 1).
    """
    h = F.xxhash64(term, sample)
    g = F.xxhash64(h)
    m = F.xxhash64(g)
    return {"r": -F.ln(_uniform(h, 0) * _uniform(h, 32)), "c": F.ln(-F.ln(_uniform(g, 0) * _uniform(g, 32))), "b": _uniform(m, 32), "m": m}


def sample_key(drawn: dict[str, Column], log_weight: Column) -> Column:
    """A long whose minimum over the terms is the sample: the key, then a tag of (term, t); null without a weight."""
    t = F.floor(log_weight / drawn["r"] + drawn["b"])
    key = drawn["c"] - drawn["r"] * (t - drawn["b"] + F.lit(1.0))
    level = ((key + F.lit(KEY_SHIFT)) * F.lit(KEY_SCALE)).cast("long")
    return F.when(log_weight.isNotNull(), F.shiftleft(level, TAG_BITS) + (drawn["m"] + t * F.lit(7919)).bitwiseAND(F.lit((1 << TAG_BITS) - 1)))


def nearby(term: Column, sample: Column, light: Column, reach: Column) -> Column:
    """False only where exp(key) times the weight is above ``reach``; found without a logarithm. light: the weight is at most 1.

    As r * (t - b) is at most the logarithm of the weight, it is at least c * exp(-r), and c * exp(-r * (1 - b)) for a weight of 1.
    """
    h = F.xxhash64(term, sample)
    g = F.xxhash64(h)
    b = _uniform(F.xxhash64(g), 32)
    power, product = _uniform(h, 0) * _uniform(h, 32), _uniform(g, 0) * _uniform(g, 32)
    # Minus the logarithm of x is at least 1 - x, and 8 * (1 - y) / (1 + y) for its fourth root y. For a below 1, x**a is
    # at least (1 + a * (1 / z - 1))**-8 for its eighth root z, as (1 + v)**a is at most 1 + a * v.
    eighth = lambda x: F.sqrt(F.sqrt(F.sqrt(x)))
    root = F.sqrt(F.sqrt(product))
    tight = eighth(8 * (1 - root) / (reach * (1 + root))) <= 1 + F.when(light, 1 - b).otherwise(1.0) * (1 / eighth(power) - 1)
    return (power * (1 - product) <= reach) & tight


def _hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))


def _terms(hashes: Column) -> Column:
    """Hashes of pairs of neighbouring words; of a single word, its own."""
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n == 1, hashes).otherwise(pairs)


def with_terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each pair of neighbouring words, as a hash, and how many there are; of a single word, its own."""
    hashed = texts.select(*keys, _hashes(F.col(text)).alias("_h"))
    return hashed.select(*keys, F.greatest(F.size("_h") - 1, F.lit(1)).alias("terms"), F.explode(_terms(F.col("_h"))).alias("term"))


def _tag(sample: Column) -> Column:
    return F.lpad(F.lower(F.hex(sample.bitwiseAND(F.lit((1 << TAG_BITS) - 1)))), 6, "0")


def exact_print(text: Column) -> Column:
    """The whole fingerprint of one text, from every term for every sample; empty without a word.

    For the few texts that ``sketches`` leaves open: it is interpreted, some microseconds a term and sample.
    """
    bound: Callable[[Column, Callable], Column] = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    # Sorted, a term's weight is how far the next one begins behind it.
    begins = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
    weighed = lambda a, at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(a))), lambda i, j: F.struct(F.get(a, i).alias("term"), F.ln((j - i).cast("double")).alias("w")))
    least = lambda bag, sample: F.array_min(F.transform(bag, lambda t: sample_key(draws(t["term"], sample), t["w"])))
    joined = lambda bag: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: _tag(least(bag, i))), "")
    of_terms = lambda a: F.when(F.size(a) == 0, F.lit("")).otherwise(bound(bound(begins(a), lambda at: weighed(a, at)), joined))
    return bound(bound(_hashes(text), lambda h: F.sort_array(_terms(h))), of_terms)


def sketches(texts: DataFrame, keys: list[str], text: str = "text", variants: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``keys`` and group of samples: part, the group's tags as hex; null where a least key may have been left out.

    Counting and sampling group by ``keys`` and the term, so a table that is partitioned by
    some of the keys already is not shuffled again. ``variants`` names several texts of one row:
    ``{"own": "text", "new": "edited"}`` gives columns own and new, null where that text has no term. What
    a term draws is worked out once for all of them, as it does not depend on the weight.
    """
    variants = variants or {"part": text}
    each = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("text")) for i, c in enumerate(variants.values())])
    single = texts.select(*keys, F.explode(each).alias("_t")).select(*keys, "_t.v", "_t.text")
    counts = [F.count_if(F.col("v") == i).cast("double").alias(f"n{i}") for i in range(len(variants))]
    totals = [F.max(F.when(F.col("v") == i, F.col("terms"))).alias(f"of{i}") for i in range(len(variants))]
    weighted = with_terms(single, [*keys, "v"], "text").groupBy(*keys, "term").agg(*counts, *totals)
    share = F.greatest(*[F.col(f"n{i}") / F.col(f"of{i}") for i in range(len(variants))], F.lit(0.0))
    # The logarithm of a count of zero is null.
    logs = [F.ln(f"n{i}").alias(f"w{i}") for i in range(len(variants))]
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(variants))], F.lit(0.0))
    # Samples below are found for sure: what is left out has a key above the logarithm of NEAR over the text's terms.
    below = [F.shiftleft(((F.lit(math.log(NEAR) + KEY_SHIFT - 1e-6) - F.ln(f"of{i}")) * F.lit(KEY_SCALE)).cast("long"), TAG_BITS).alias(f"below{i}") for i in range(len(variants))]
    # What does not depend on the sample comes before the samples, so that it is worked out once a term.
    rows = weighted.select(*keys, "term", (share * NEAR).alias("reach"), (most <= 1).alias("light"), *logs, *below)
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    rows = rows.where(nearby(F.col("term"), F.col("sample"), F.col("light"), F.col("reach")))
    drawn = draws(F.col("term"), F.col("sample"))
    limits = [f"below{v}" for v in range(len(variants))]
    found = rows.select(*keys, "sample", *limits, *[f"w{v}" for v in range(len(variants))], *[c.alias(k) for k, c in drawn.items()])
    seen = {k: F.col(k) for k in drawn}
    sampled = found.select(*keys, *limits, F.expr(f"sample div {PER_GROUP} * {PER_GROUP}").cast("int").alias("first"), (F.col("sample") % PER_GROUP).alias("i"), *[sample_key(seen, F.col(f"w{v}")).alias(f"k{v}") for v in range(len(variants))])
    mins = [F.min(F.when(F.col("i") == i, F.col(f"k{v}"))).alias(f"s{v}_{i}") for v in range(len(variants)) for i in range(PER_GROUP)]
    found = sampled.groupBy(*keys, "first").agg(*mins, *[F.max(c).alias(c) for c in limits])
    sure = [reduce(lambda a, b: a & b, [F.col(f"s{v}_{i}") < F.col(f"below{v}") for i in range(PER_GROUP)]) for v in range(len(variants))]
    return found.select(*keys, "first", *[F.when(sure[v], F.concat(*[_tag(F.col(f"s{v}_{i}")) for i in range(PER_GROUP)])).alias(name) for v, name in enumerate(variants)])


def _joined(part: Column) -> Column:
    """The groups of one text in order; null if one of them is, or is not there."""
    whole = [F.max(F.when(F.col("first") == PER_GROUP * g, part)) for g in range(GROUPS)]
    return F.concat(*whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samples of two fingerprints as bytes; two empty ones are alike, one is not."""
    same = lambda i: F.substring(a, i, F.lit(3)) == F.substring(b, i, F.lit(3))
    agree = F.size(F.filter(F.sequence(F.lit(1), F.lit(3 * SAMPLES - 2), F.lit(3)), same))
    return F.when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), (a == b).cast("double")).otherwise(agree / F.lit(float(SAMPLES)))


def fingerprints(texts: DataFrame, keys: list[str], variants: dict[str, str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried columns, texts, fingerprints): ``variants`` names the fingerprints of several texts of one row of ``keys``.

    Texts without a word have an empty fingerprint. The rows are put to their groups of samples by a union, which
    moves none of both if the table is partitioned by some of the keys, as a join by all of them would.
    """
    kept = [*carried, *variants.values()]
    both = texts.select(*keys, *kept).unionByName(sketches(texts, keys, variants=variants), allowMissingColumns=True)
    whole = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in kept], *[_joined(F.col(c)).alias(c) for c in variants])
    return whole.withColumns({name: F.coalesce(name, exact_print(F.col(text))) for name, text in variants.items()})


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the value, by looking at every 64th first."""
    below = lambda found: F.size(F.filter(found, lambda x: x <= value))
    coarse = below(_longs(cuts[::64]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 64 + below(F.slice(_longs(cuts), F.greatest(coarse - 1, F.lit(0)) * 64 + 1, 64)))


def with_bucket(docs: DataFrame, *, rows_per_bucket: int = 512, ranges: int = 4096, parts: int = 1 << 20) -> DataFrame:
    """Add hash (of text) and bucket, a long: descending buckets follow descending ids, then ascending hashes.

    Ids are cut at ``ranges`` quantiles, and a range into parts of equal width. An id that has more
    rows than a range, or none (last), is cut by the hash. So a bucket has few rows whatever
    the ids are, but for rows that are equal in id and text.
    """
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n = docs.count()
    k = max(1, min(ranges, n // rows_per_bucket))
    marks = F.percentile_approx("doc_id", [i / k for i in range(k)], 10 * ranges)
    seen = docs.agg(marks.alias("cuts"), F.max("doc_id").alias("high")).first()
    found, high = seen["cuts"] or [0], seen["high"] or 0
    hot = {x for x, y in zip(found, found[1:], strict=False) if x == y}
    cuts = sorted({*found, *(x + 1 for x in hot)})
    some = max(1, min(parts, n // k // rows_per_bucket))
    steps = [max(1, -(-(z - a) // some)) for a, z in zip(cuts, [*cuts[1:], high + 1], strict=True)]
    at = F.greatest(_range_of(F.col("doc_id"), cuts), F.lit(1))
    one_id = F.array_contains(_longs(sorted(hot) or [high + 1]), F.col("doc_id"))
    share = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * max(1, min(parts - 1, n // rows_per_bucket))).cast("long")
    by_id = F.expr("_o div _s")
    part = F.when(F.col("doc_id").isNull() | one_id, F.lit(parts - 1) - share).otherwise(by_id)
    docs = docs.withColumns({"_at": F.coalesce(at, F.lit(0)).cast("long"), "_o": F.col("doc_id") - F.get(_longs(cuts), (at - 1).cast("int")), "_s": F.get(_longs(steps), (at - 1).cast("int"))})
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("_at")) * parts + part).drop("_at", "_o", "_s")


def with_next(docs: DataFrame, **options: int) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, pos, doc_id, text, next_text) and heads (bucket, head_text, head_print).

    The next document is the one before it by doc_id; the smallest is followed by the
    largest. Null texts are empty, null ids come last, rows of one id are ordered by a hash of
    their text. Windows are over buckets (see with_bucket); where one ends, the first row
    of the next one that has rows is joined in. The buckets themselves are at most some millions.
    """
    docs = with_bucket(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), **options)
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text")]
    top = docs.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("minus"), "hash")).alias("_top"))
    down = Window.orderBy(F.col("bucket").desc())
    after = F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(down))
    follows = materialise(top.select("bucket", "_top", after.alias("_after")), "ranges")
    heads_at = follows.select(F.col("bucket").alias("_b"), (-F.col("_top.minus")).alias("_id"), F.col("_top.hash").alias("_hash"))
    first = docs.join(heads_at, (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    first = first.groupBy("bucket").agg(F.min("text").alias("text"))
    first = materialise(first, "heads")
    printed = fingerprints(first, ["bucket"], {"head_print": "text"}).withColumnsRenamed({"bucket": "_after", "text": "head_text"})
    heads = materialise(follows.join(printed, "_after").select("bucket", "head_text", "head_print"), "heads")
    inside = Window.partitionBy("bucket").orderBy(*order)
    # By a number of its own, so that all that reads the rows has the same partitions.
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    placed = docs.select("bucket", F.row_number().over(inside).alias("pos"), "doc_id", "text", F.lead("text").over(inside).alias("_next"))
    return placed.join(heads.select("bucket", "head_text"), "bucket").select("bucket", "pos", "doc_id", "text", F.coalesce("_next", "head_text").alias("next_text")), heads


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next document (see with_next, also for null ids and repeated rows). Null texts are
    empty; texts without a word have an empty fingerprint. Other columns are not looked at.
    """
    rows, heads = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    rows = rows.select("bucket", "pos", "doc_id", "text", edited.alias("edited"))
    found = fingerprints(rows, ["bucket", "pos"], {"own": "text", "new": "edited"}, carried=("doc_id",))
    found = found.select("bucket", "pos", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "new")
    found = found.withColumn("_next", F.lead("own").over(Window.partitionBy("bucket").orderBy("pos")))
    found = found.join(heads.select("bucket", "head_print"), "bucket")
    # As bytes, in which a sample is found without walking through those before it.
    found = found.withColumns({"_own": F.unhex("own"), "_new": F.unhex("new"), "_after": F.unhex(F.coalesce("_next", "head_print"))})
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("new").alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
