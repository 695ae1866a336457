"""Batches of requests: states over several rounds, lines with faults, queues by model."""

import json

from gradeloom.operators import requests


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def made(spark, schema, *given):
    return spark.createDataFrame(list(given), schema)


def test_failed_and_expired_requests_are_pending_again(spark):
    log = requests.record(made(spark, requests.REQUESTS), made(spark, requests.REQUESTS, *[(f"r{i}", "m", "{}", 10, i) for i in range(6)], ("r0", "m", "{}", 10, 99)))
    assert rows(log, "request_id", "pos")[0] == ("r0", 0) and requests.record(log, log).count() == 6
    sent = [("b1", f"r{i}", None) for i in range(5)]
    state = lambda sent, batches, answers=(): dict(rows(requests.states(log, made(spark, requests.SENT, *sent), made(spark, requests.BATCHES, *batches), made(spark, requests.ANSWERS, *answers)), "request_id", "state"))
    assert state([], [])["r0"] == "pending"
    assert state(sent, []) == {f"r{i}": "in flight" for i in range(5)} | {"r5": "pending"}
    for lost in requests.LOST:
        assert set(state(sent, [("b1", "m", lost)]).values()) == {"pending"}
    answers = [("r0", 200, None, "{}"), ("r1", 500, None, None), ("r2", 200, '{"code": 1}', None), ("r3", None, None, None)]
    after = state(sent, [("b1", "m", "completed")], answers)
    assert after == {"r0": "answered", "r1": "failed", "r2": "failed", "r3": "failed", "r4": "in flight", "r5": "pending"}
    again = [*sent, ("b2", "r1", None), ("b2", "r4", None)]
    assert state(again, [("b1", "m", "failed"), ("b2", "m", "validating")]) == {r: "in flight" if r in ("r1", "r4") else "pending" for r in (f"r{i}" for i in range(6))}
    assert state(again, [("b1", "m", "failed"), ("b2", "m", "expired")])["r4"] == "pending"
    counted = requests.states(log, made(spark, requests.SENT, *again), made(spark, requests.BATCHES), made(spark, requests.ANSWERS))
    assert dict(rows(counted, "request_id", "attempts")) == {"r0": 1, "r1": 2, "r2": 1, "r3": 1, "r4": 2, "r5": 0}


def test_a_queue_is_filled_in_order_and_busy_models_wait(spark):
    known = made(spark, "request_id string, model string, tokens long, pos long, state string, attempts long", *[(f"{m}{i}", m, n, i, "pending", 0) for m in "abc" for i, n in enumerate((5000, 500, 60_000, 1))], ("a9", "a", 1, -1, "answered", 1))
    batches = made(spark, requests.BATCHES, ("x", "c", "finalizing"), ("y", "a", "failed"))
    limits = made(spark, "model string, tokens long", ("a", 12_000), ("b", 3))
    got = requests.next_batch(known, batches, limits)
    assert rows(got, "request_id") == [("a0",), ("a1",), ("b0",)]
    assert rows(requests.next_batch(known, batches), "request_id") == [(f"{m}{i}",) for m in "ab" for i in range(4)]
    assert rows(requests.batch_report(known), "model", "state", "requests") == [("a", "answered", 1), ("a", "pending", 4), ("b", "pending", 4), ("c", "pending", 4)]


def test_lines_are_read_with_their_faults_and_added_once(spark, tmp_path):
    lines = [
        {"custom_id": "r1", "response": {"status_code": 200, "body": {"choices": [{"a": "ñ"}], "usage": {"prompt_tokens": 3}}}, "error": None},
        {"custom_id": "r2", "response": {"status_code": 429, "body": {}}, "error": None},
        {"custom_id": "r3", "response": None, "error": {"code": "expired"}},
        {"custom_id": "r1", "response": {"status_code": 500, "body": {}}, "error": None},
        {"response": {"status_code": 200, "body": {}}},
    ]
    path = tmp_path / "answers.jsonl"
    path.write_text("\n".join([*map(json.dumps, lines), "", "   ", '{"custom_id": "r9", "resp', "[1]"]) + "\n")
    answers, rejected = requests.read_answers(spark, str(path))
    assert rows(answers, "request_id", "status") == [("r1", 200), ("r1", 500), ("r2", 429), ("r3", None)]
    assert rejected.count() == 3 and rows(requests.good(answers), "request_id") == [("r1",)]
    known = requests.add_answers(made(spark, requests.ANSWERS), answers)
    assert rows(known, "request_id", "status") == [("r1", 200), ("r2", 429), ("r3", None)]
    assert json.loads(requests.good(known).first().body)["choices"] == [{"a": "ñ"}]
    later = requests.add_answers(known, made(spark, requests.ANSWERS, ("r2", 200, None, "{}"), ("r4", 200, None, "{}")))
    assert rows(later, "request_id", "status") == [("r1", 200), ("r2", 429), ("r3", None), ("r4", 200)]


def test_lines_of_a_batch(spark):
    log = made(spark, requests.REQUESTS, ('r"1', "m", '{"model": "m"}', 1, 1))
    line = requests.request_lines(log.select("request_id", "pos"), log).first().line
    assert json.loads(line) == {"custom_id": 'r"1', "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m"}}
