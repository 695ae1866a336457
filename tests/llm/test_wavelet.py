"""Token shards against the tokenizer itself and against plain lists of ids."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import wavelet
from tests.conftest import SF

AWKWARD = [
    "", None, " \n\t ", "Hello, World!", "it's we'll THEY'VE 'tis don't", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "é é ́x ﬁ Å Σας ΣΑΣ", "漢字 かな 😀👍🏽", "12 345 6.7e-8",
    "no break space　wide", "x" * 5000, "ab " * 30_000, "…!?.,;: «q» ''s 's", "İstanbul ǅ ŉ", "\x00 \x01\x1c\x1d y\x85z \x01 a\x01 \x01\x01\x01b", "a\x01b",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(wavelet.tokenizer_path())


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, wavelet.END]


@pytest.mark.parametrize("n, levels", [(0, 3), (1, 1), (511, 5), (512, 5), (513, 9), (5000, 16), (3000, 20)])
def test_matrix(n, levels):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), (1 << levels) - 1) if n else np.zeros(0, dtype=np.int64)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids, levels).to_bytes())
    assert list(matrix.ids()) == list(ids)
    at = rng.permutation(n)
    assert list(matrix.access(at)) == list(ids[at])
    for token in {*ids[:20].tolist(), 0, (1 << levels) - 1, 1 << levels, -1}:
        places = np.flatnonzero(ids == token)
        assert list(matrix.occurrences(token)) == list(places) and matrix.count(token) == len(places)
        for end in (0, n // 2, n):
            assert matrix.count(token, end) == (ids[:end] == token).sum()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.of(np.array([1 << levels]), levels)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"WMX0" + bytes(40))


def read(spark, folder):
    return sorted(((r.start, r.doc_id, r.n_tokens, list(np.frombuffer(r.ids, "<u4"))) for r in wavelet.read_documents(spark, folder).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("shard", [50, wavelet.SHARD])
def test_round_trip_and_lookups(spark, tokenizer, tmp_path, shard):
    rng = random.Random(4)
    rows = [((i * 7) % 41 - 20, t, "c", "x") for i, t in enumerate(AWKWARD)] + [(None, "null id", "c", "x"), (None, None, "c", "x")]
    rows += [(5, rng.choice(["many", "rows of one id", "Same ID!"]), "c", "x") for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, start string")
    found = []
    for k, given in enumerate((docs.repartition(5), docs.repartition(2))):
        wavelet.write(given, f"{tmp_path}/{k}", parts=6, shard=shard)
        found.append(read(spark, f"{tmp_path}/{k}"))
    assert found[0] == found[1]
    got = found[0]
    flat = [t for r in got for t in r[3]]
    assert [r[0] for r in got] == list(np.cumsum([0, *[r[2] for r in got]])[:-1]) and all(r[2] == len(r[3]) for r in got)
    order = [(r[1] is not None, r[1] or 0) for r in got]
    assert order == sorted(order)
    by_row = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r[1], r[3]) for r in got), key=by_row) == sorted(((d, expected(tokenizer, t)) for d, t, *_ in rows), key=by_row)

    folder, asked = f"{tmp_path}/0", [flat[3], flat[40], wavelet.END, 49405, 70_000]
    assert {r.token: r.n for r in wavelet.token_counts(spark, folder, asked).collect()} == {t: flat.count(t) for t in asked}
    places = sorted((r.token, r["at"], r.doc_id, r.place) for r in wavelet.token_places(spark, folder, asked[1:]).collect())
    assert [p[:2] for p in places] == sorted((t, i) for i, t in enumerate(flat) if t in asked[1:])
    doc_of = {r[0]: r for r in got}
    assert all(at - place in doc_of and doc_of[at - place][1] == d for _, at, d, place in places)
    at = [0, 1, len(flat) - 1, *range(0, len(flat), 97), len(flat), -1, 1, None]
    tokens = {r["at"]: r.token for r in wavelet.tokens_at(spark, folder, spark.createDataFrame([(a, "z") for a in at], "at long, token string"), shard).collect()}
    assert tokens == {a: flat[a] for a in at if a is not None and 0 <= a < len(flat)}
    sizes = [(r.n_docs, r.n_tokens) for r in wavelet.open_shards(spark, folder).select("n_docs", "n_tokens").collect()]
    assert all(n <= shard or docs_in == 1 for docs_in, n in sizes) and sum(n for _, n in sizes) == len(flat)


def test_no_rows(spark, tmp_path):
    wavelet.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert wavelet.read_documents(spark, f"{tmp_path}/e").count() == 0
    assert wavelet.token_counts(spark, f"{tmp_path}/e", [2]).head().n == 0


def test_kept_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "KEPT_WORDS", 4)
    encoder = wavelet.Encoder(tokenizer.to_str())
    for text in ("one two three four five six", "two three", "seven eight nine two"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, sizes = encoder.texts(data, np.array([0, len(data)]), 2)
        assert list(ids) == expected(tokenizer, text) and list(sizes) == [len(ids)]


def test_query_against_the_tokenizer(spark, tokenizer):
    before, plain = 0, []
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = expected(tokenizer, d.text)
        plain.append((d.doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(tuple(r) for r in wavelet.op13_token_output(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == plain
