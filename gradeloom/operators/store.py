"""Evaluations as an append-only log, and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pendiente", "ejecutando", "completada", "error")


def current_state(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Partial updates folded by key: of each column the last value that is not null."""
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return log.groupBy(key).agg(*last, F.max(order).alias(order))


def latest_per_project(evals: DataFrame, project: str, created: str) -> DataFrame:
    """The newest rows of each project; rows of one instant all stay."""
    newest = evals.groupBy(project).agg(F.max(created).alias("_top"))
    return evals.join(newest, project).where(F.col(created) == F.col("_top")).drop("_top")


def completed_latest(evals: DataFrame, rubric: str | None = None) -> DataFrame:
    """Newest completed evaluation of each project, of one rubric if asked, in order of creation."""
    done = evals.where("state = 'completada'")
    done = done if rubric is None else done.where(F.col("rubric_id") == rubric)
    return latest_per_project(done, "project_id", "created_at").orderBy("created_at")


def upsert_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows of one key the last by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def delete_conversations(conversations: DataFrame, messages: DataFrame, evaluations: DataFrame, gone: DataFrame):
    """Without the conversations in ``gone``: their messages go too, their evaluations stay unattached."""
    ids = gone.select("conversation_id").distinct()
    kept = evaluations.join(ids.withColumn("_gone", F.lit(True)), "conversation_id", "left")
    detached = kept.withColumn("conversation_id", F.when(F.col("_gone").isNull(), F.col("conversation_id"))).drop("_gone")
    return conversations.join(ids, "conversation_id", "left_anti"), messages.join(ids, "conversation_id", "left_anti"), detached


def visible_to(rows: DataFrame, user: str) -> DataFrame:
    """Rows of one user."""
    return rows.where(F.col("user_id") == user)


def pending(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests, one of each content, without a good response (status 200, no error)."""
    good = responses.where("status = 200 and error is null").select(key).distinct()
    return requests.dropDuplicates([key]).join(good, key, "left_anti")


def import_responses(current: DataFrame, new: DataFrame, key: str = "request_id") -> DataFrame:
    return current.unionByName(new.dropDuplicates([key]).join(current.select(key), key, "left_anti"))


def request_key(body):
    """Hash of a request's canonical JSON."""
    return F.sha2(F.to_json(body), 256)


def batch_cost(requests: DataFrame, prices: DataFrame, output_tokens: int = 900, extra_input: int = 200, discount: float = 0.5) -> DataFrame:
    """Estimated dollars of requests by model at the batch discount; null without a price."""
    sums = requests.groupBy("model").agg(F.count("*").alias("requests"), F.sum(F.col("tokens") + extra_input).alias("tokens_in"))
    sums = sums.withColumn("tokens_out", F.col("requests") * output_tokens).join(prices, "model", "left")
    return sums.select("model", "requests", "tokens_in", "tokens_out", F.round((F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6 * discount, 6).alias("usd"))
