"""Deadlines and attempts of the invoker, and analyses that fail alone."""

import time

import pytest

from gradeloom.operators import analyses, invoke

PRICES = [("m", 2.0, 8.0), ("n", 0.15, 0.6)]
CALL = "eval_id long, analysis string, pos int, model string, value string, error string, tokens_in long, tokens_out long"


def ask(prompt):
    if prompt == "hang":
        time.sleep(3)
    if prompt == "refuse":
        raise PermissionError("not allowed")
    if prompt == "bad":
        raise ValueError("no JSON")
    return {"body": prompt.upper(), "tokens_in": len(prompt), "tokens_out": 1}


def test_a_hanging_call_times_out_in_its_last_attempt_and_stops_no_other(spark):
    prompts = ["a", "hang", "bad", "refuse", "b", None, ""]
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(prompts)], "request_id string, prompt string").coalesce(1)
    got = invoke.invoke(rows, ask, timeout=0.3, waits=(0.0, 0.01, 0.05), fatal=(PermissionError,)).cache()
    seen = {r.request_id: r for r in got.collect()}
    assert [seen[str(i)].status for i in range(7)] == [200, 504, 500, 500, 200, 400, 200]
    assert (seen["0"].body, seen["4"].tokens_in, seen["6"].body) == ("A", 1, "")
    assert seen["1"].error == "TimeoutError: no answer within 0.3 s" and seen["1"].body is None
    tried = {r.request_id: r["n"] for r in invoke.attempts_of(got).groupBy("request_id").count().withColumnRenamed("count", "n").collect()}
    assert tried == {"0": 1, "1": 4, "2": 4, "3": 1, "4": 1, "6": 1}
    assert all(0.25 < t.seconds < 2 for t in seen["1"].tried) and seen["0"].tried[0].error is None
    assert invoke.invoke(rows.limit(0), ask).count() == 0


def test_prompts_of_a_task_are_asked_side_by_side(spark):
    rows = spark.createDataFrame([(str(i), "x") for i in range(16)], "request_id string, prompt string").coalesce(1)

    def slow(prompt):
        time.sleep(0.5)
        return {"body": str(time.monotonic())}

    ends = sorted(float(r.body) for r in invoke.invoke(rows, slow, at_once=8).collect())
    assert ends[7] - ends[0] < 0.4 and ends[8] - ends[7] > 0.1 and len(ends) == 16


@pytest.mark.parametrize(("failed", "seconds"), [(1, 2.0), (2, 2.0), (3, 4.0), (4, 8.0), (9, 30.0)])
def test_pause(failed, seconds):
    assert invoke.pause(failed, 1.0, 2.0, 30.0) == seconds


def test_an_analysis_fails_alone(spark):
    calls = [
        (1, "a", 2, "m", "late", None, 1000, 10), (1, "a", 1, "m", "early", None, 500, 10), (1, "b", 0, "m", "x", None, 7, 7), (1, "b", 3, "m", None, "second", 9, 9), (1, "b", 1, "m", None, "first", 9, 9),
        (2, "a", 0, "free", "v", None, 10, 20), (3, "b", 0, "n", None, None, None, 100), (9, "a", 0, "m", "of no result", None, 1, 1), (None, "a", 0, "m", "z", None, 1, 1), (4, "a", 0, "m", None, "e", 5, 5),
    ]
    found = analyses.outcomes(spark.createDataFrame(calls, CALL), spark.createDataFrame(PRICES, "model string, usd_in double, usd_out double"))
    results = spark.createDataFrame([(1, 88, 5, 6, 0.5), (2, 70, 0, 0, None), (3, 60, None, 1, 0.1), (4, 50, 1, 1, 0.2), (5, None, 1, 2, None)], "eval_id long, score int, tokens_in long, tokens_out long, usd double")
    got = {r.eval_id: r for r in analyses.attach(results, found, ["a", "b"]).collect()}
    assert {k: r.score for k, r in got.items()} == {1: 88, 2: 70, 3: 60, 4: 50, 5: None}
    assert (got[1].a, got[1].b, got[1].b_error, got[1].a_error) == (["early", "late"], None, "first", None)
    assert (got[1].tokens_in, got[1].tokens_out, got[1].usd) == (1505, 26, 0.50316)
    assert (got[2].a, got[2].tokens_in, got[2].usd) == (["v"], 10, None)
    assert (got[3].b, got[3].tokens_in, got[3].tokens_out, got[3].usd) == ([None], 0, 101, 0.10006)
    assert (got[4].a, got[4].a_error, got[4].tokens_in, got[4].usd) == (None, "e", 1, 0.2)
    assert (got[5].a, got[5].a_error, got[5].tokens_out, got[5].usd) == (None, None, 2, None)
    assert sorted((r.eval_id, r.analysis) for r in analyses.failures(found).collect()) == [(1, "b"), (4, "a")]
    assert analyses.attach(results, found.limit(0), ["a"]).where("a is null").count() == 5 and analyses.attach(results.limit(0), found, ["a"]).count() == 0
