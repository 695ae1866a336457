"""Asking judges: prompts as columns, an invoker in tasks, answers checked by a schema."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import fold_accents
ANSWER = "array<struct<item_id:string,level:string,score:int,evidence:string,observation:string>>"
TRIED = "array<struct<attempt:int,error:string,seconds:double>>"


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced as they stand, never formatted."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def item_list(items: DataFrame) -> DataFrame:
    """(section_id, items): the criteria of a section as numbered lines."""
    line = F.struct("pos", F.concat(F.lit("- ["), "item_id", F.lit("] "), "criterion", F.when(F.col("reference").isNotNull(), F.concat(F.lit(" — "), "reference")).otherwise("")).alias("line"))
    return items.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("items"))


def _excerpts(sections: DataFrame, title: Column, text: Column) -> DataFrame:
    """(doc_id, context): titled texts in the order of the sections, parted by blank lines."""
    part = F.struct("pos", F.concat(F.lit("["), title, F.lit("]\n"), text).alias("part"))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("context"))


def traceability(sections: DataFrame, keys: list[str], most: int = 1200) -> DataFrame:
    """(doc_id, context): first characters of the sections whose names, without accents, hold one of the keys."""
    name = fold_accents(F.lower("name"))
    some = sections.where(F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(name, k)) & (F.coalesce("text", F.lit("")) != ""))
    return _excerpts(some, F.col("name"), F.substring("text", 1, most))


def cross_cutting(sections: DataFrame, whole: list[str], most: int = 1500) -> DataFrame:
    """(doc_id, context): present sections by id and name; the ids in ``whole`` in full, of others the first characters.

    sections: doc_id, pos, section_id, name, present, text. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.col("section_id").isin(*whole), text).otherwise(F.substring(text, 1, most))
    return _excerpts(sections.where("present"), F.concat_ws(" ", "section_id", "name"), cut)


def judge_roles(spark: SparkSession, path: str, judges: int = 3) -> DataFrame:
    """(judge, role) of a file with blocks headed ``## juezN``; just the judges 1 to ``judges``, or a ValueError.

    Of blocks with one number the last counts.
    """
    texts = spark.read.text(path, wholetext=True)
    blocks = texts.select(F.posexplode(F.split("value", r"(?m)^## juez(?=\d)")).alias("pos", "block")).where((F.col("pos") > 0) & F.col("block").rlike(r"^\d\s*\n"))
    told = blocks.select("pos", F.substring("block", 1, 1).cast("int").alias("judge"), F.trim(F.regexp_replace(F.expr("substring(block, 2)"), r"^\s+|\s+$", "")).alias("role"))
    roles = told.groupBy("judge").agg(F.max_by("role", "pos").alias("role"))
    # A panel is a handful of judges.
    found = {r.judge for r in roles.select("judge").limit(judges + 1).collect()}
    if found != set(range(1, judges + 1)):
        raise ValueError(f"{path} must describe the judges 1 to {judges}, but has {sorted(found)}")
    return roles


def _within(seconds: float, ask: Callable[[str], dict], prompt: str) -> dict:
    """What ``ask`` returns, or a TimeoutError once the seconds have gone.

    Python cannot stop a call, so one that hangs is left behind in a daemon thread of its own.
    """
    answers: queue.SimpleQueue = queue.SimpleQueue()

    def call():
        try:
            answers.put((ask(prompt), None))
        except Exception as e:  # noqa: BLE001  whatever a service raises counts as a failed attempt
            answers.put((None, e))

    Thread(target=call, daemon=True).start()
    try:
        got, error = answers.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return got


def pause(failed: int, unit: float, least: float, most: float) -> float:
    """Seconds to wait after that many failed attempts: doubling from ``unit``, held between two bounds."""
    return min(most, max(least, unit * 2 ** (failed - 1)))


def invoke(
    requests: DataFrame, ask: Callable[[str], dict], *, attempts: int = 4, timeout: float = 120.0, at_once: int = 8,
    waits: tuple[float, float, float] = (1.0, 2.0, 30.0), fatal: tuple[type[Exception], ...] = (),
) -> DataFrame:
    """request_id, status, body, error, tokens_in, tokens_out and tried of each prompt.

    ``ask`` takes a prompt and returns body, tokens_in, tokens_out. At most ``at_once`` prompts of a task
    are under way at a time, each attempt for ``timeout`` seconds (of a hanging service as many calls
    may be left behind as attempts ran out). Between attempts it waits as ``pause`` says for ``waits``; errors of the
    ``fatal`` kinds are not tried again. A prompt that fails for good gives a row with its last
    error (status 504 if that was a timeout, else 500), so one failure stops nothing else. ``tried``
    has attempt, error (null for the one that succeeded) and seconds of each attempt. A null prompt is not asked and has
    status 400. Write the result before using it twice: a task that is run again asks again.
    """

    def one(key: str, prompt: str | None) -> tuple:
        if prompt is None:
            return key, 400, None, "no prompt", 0, 0, []
        tried, status, error = [], 500, None
        for n in range(1, attempts + 1):
            began = time.monotonic()
            try:
                got, error = _within(timeout, ask, prompt), None
                result = (key, 200, got["body"], None, got.get("tokens_in", 0), got.get("tokens_out", 0))
            except Exception as e:  # noqa: BLE001
                error, status, final = f"{type(e).__name__}: {e}", 504 if isinstance(e, TimeoutError) else 500, isinstance(e, fatal)
            tried.append({"attempt": n, "error": error, "seconds": time.monotonic() - began})
            if error is None:
                return *result, tried
            if final:
                break
            if n < attempts:
                time.sleep(pause(n, *waits))
        return key, status, None, error, 0, 0, tried

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                rows = list(pool.map(one, pdf["request_id"], pdf["prompt"]))
                yield pd.DataFrame(rows, columns=["request_id", "status", "body", "error", "tokens_in", "tokens_out", "tried"]).astype({"status": "int32", "tokens_in": "int64", "tokens_out": "int64"})

    return requests.select("request_id", "prompt").mapInPandas(run, f"request_id string, status int, body string, error string, tokens_in long, tokens_out long, tried {TRIED}")


def attempts_of(responses: DataFrame) -> DataFrame:
    """The log of attempts: request_id, attempt, error, seconds."""
    return responses.select("request_id", F.explode("tried").alias("_t")).select("request_id", "_t.*")


def votes_from(responses: DataFrame, plan: DataFrame) -> DataFrame:
    """Votes of the answers that parse; others are gaps. plan: request_id, eval_id, judge, section_id."""
    parsed = responses.where("status = 200").withColumn("_a", F.from_json("body", ANSWER))
    rows = parsed.join(plan, "request_id").select("eval_id", "judge", "section_id", F.posexplode("_a").alias("ord", "_v"))
    return rows.select("eval_id", "judge", "section_id", "ord", "_v.*")


def gaps_from(responses: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned calls without an answer that parses."""
    good = responses.where("status = 200").where(F.from_json("body", ANSWER).isNotNull()).select("request_id")
    return plan.join(good, "request_id", "left_anti").select("eval_id", "judge", "section_id")
