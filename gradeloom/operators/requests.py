"""Requests that go out in batches: a log of what happened to each, and what is to be sent next.

The log is append-only: a request is recorded, sent in a batch, the batch ends, answers are read from its
lines. A request's state is a fold of its rows: answered once a good answer is there; failed if there are only
others, so that it is asked for outside of batches; in flight while a batch of its runs or waits to be read; else
pending, as when its batches failed, expired or were cancelled. Nothing is sent of a model that has a batch running, and never more than its queue takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The service's names of a batch's states.
RUNNING, LOST, DONE = ("validating", "in_progress", "finalizing"), ("failed", "expired", "cancelled"), "completed"
#: Tokens of a prompt besides its text, and what a queue takes where no limit is known.
EXTRA_TOKENS, QUEUE = 2_500, 1_000_000
REQUESTS = "request_id string, model string, body string, tokens long, pos long"
SENT = "batch_id string, request_id string, sent_at timestamp"
BATCHES = "batch_id string, model string, status string"
ANSWERS = "request_id string, status int, error string, body string"
_LINE = "custom_id string, response struct<status_code:int, body:string>, error string, _corrupt string"


def record(log: DataFrame, new: DataFrame) -> DataFrame:
    """``log`` with the requests of ``new`` whose content it has not; the first by pos of equal ones stays."""
    first = new.groupBy("request_id").agg(F.min_by(F.struct("model", "body", "tokens", "pos"), "pos").alias("_r")).select("request_id", "_r.*")
    return log.unionByName(first.join(log.select("request_id"), "request_id", "left_anti"))


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected) of the service's JSON lines: in columns ANSWERS, and lines that are no such object, as text.

    Blank lines do not count. A line without an id is rejected. The body and the error stay JSON.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("_l"))
    good = F.col("_l").isNotNull() & F.col("_l._corrupt").isNull() & F.col("_l.custom_id").isNotNull()
    nothing = F.col("_l.error").isNull() | F.col("_l.error").isin("null", "", "{}", "[]", "false", "0")
    answers = parsed.where(good).select(F.col("_l.custom_id").alias("request_id"), F.col("_l.response.status_code").alias("status"), F.when(~nothing, F.col("_l.error")).alias("error"), F.col("_l.response.body").alias("body"))
    return answers, parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def good(answers: DataFrame) -> DataFrame:
    return answers.where("status = 200 and error is null")


def add_answers(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` with the answers to requests that it has none of; a good one of several goes before others."""
    rank = F.struct((~F.coalesce((F.col("status") == 200) & F.col("error").isNull(), F.lit(False))).alias("bad"), "status", "body")
    one = new.groupBy("request_id").agg(F.min_by(F.struct("status", "error", "body"), rank).alias("_a")).select("request_id", "_a.*")
    return known.unionByName(one.join(known.select("request_id").distinct(), "request_id", "left_anti"))


def states(requests: DataFrame, sent: DataFrame, batches: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, model, tokens, pos, state, attempts): state is answered, failed, in flight or pending; attempts counts its batches.

    A batch of which nothing is known runs.
    """
    each = sent.join(batches.select("batch_id", "status"), "batch_id", "left")
    alive = ~F.coalesce("status", F.lit(RUNNING[0])).isin(*LOST)
    flown = each.groupBy("request_id").agg(F.max(alive).alias("alive"), F.count_distinct("batch_id").alias("attempts"))
    replied = answers.groupBy("request_id").agg(F.max(F.coalesce((F.col("status") == 200) & F.col("error").isNull(), F.lit(False))).alias("good"))
    joined = requests.join(flown, "request_id", "left").join(replied, "request_id", "left")
    state = F.when(F.col("good"), "answered").when(~F.col("good"), "failed").when(F.col("alive"), "in flight").otherwise("pending")
    return joined.select("request_id", "model", "tokens", "pos", state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def next_batch(known: DataFrame, batches: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(request_id, model, tokens, pos) to send now: of each model without a running batch the first pending ones, by pos, that its queue takes.

    limits: model, tokens. Each request counts EXTRA_TOKENS besides its own. The first goes even if it alone is too large.
    """
    busy = batches.where(F.col("status").isin(*RUNNING)).select("model").distinct()
    waiting = known.where("state = 'pending'").join(busy, "model", "left_anti")
    cost = F.coalesce("tokens", F.lit(0)) + EXTRA_TOKENS
    order = Window.partitionBy("model").orderBy("pos", "request_id")
    # The requests of one model alone decide how far its queue goes; rows are ids and numbers.
    summed = waiting.withColumns({"_upto": F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    if limits is not None:
        summed = summed.join(F.broadcast(limits.select("model", F.col("tokens").alias("_limit")).limit(10_000)), "model", "left")
    else:
        summed = summed.withColumn("_limit", F.lit(None).cast("long"))
    return summed.where((F.col("_n") == 1) | (F.col("_upto") <= F.coalesce("_limit", F.lit(QUEUE)))).select("request_id", "model", "tokens", "pos")


def request_lines(batch: DataFrame, requests: DataFrame) -> DataFrame:
    """One line of JSON for each request of a batch, in its order within a model, as the service takes them: (model, pos, line)."""
    rows = batch.select("request_id", "pos").join(requests.select("request_id", "model", "body"), "request_id")
    line = F.concat(F.lit('{"custom_id": '), F.to_json(F.struct(F.col("request_id").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("request_id").alias("v")))) - 6), F.lit(', "method": "POST", "url": "/v1/chat/completions", "body": '), "body", F.lit("}"))
    return rows.select("model", "pos", line.alias("line"))


def batch_report(known: DataFrame) -> DataFrame:
    """(model, state, requests, tokens): how far each model is."""
    return known.groupBy("model", "state").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
