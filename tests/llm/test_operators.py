"""Every operator against a plain version of itself, on small tables with awkward rows."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm import chat, crf, exact_dedup, fingerprints, line_dedup, minhash, mixing, pieces, pii, quality, registry, sharding
from tests.conftest import SF, assert_same
from tests.llm.pii_sentences import SEEN, UNSEEN

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    BASE, BASE.replace("w59", "other"), BASE.upper(), "", None, "  \n ", "one two", "One  Two", "é ñ 漢字 😀 text", BASE + " tail",
    "a line that is long enough\nshort\na line that is long enough", "a line that is long enougH\nfresh words on this line here", "word " * 30_000,
]
KIND = "doc_id long, text string, lang string, source string, size string, kept string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


def test_exact_dedup(docs, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(low(t), []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    for twice in (docs.union(docs), docs.withColumn("doc_id", F.lit(None).cast("long")).repartition(3)):
        assert exact_dedup.exact_dedup(twice).where("kept").count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def near_brute(texts, least=85):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= least * len(sets[a] | sets[b]) and root[a] != root[b]:
                low_, high = sorted((root[a], root[b]))
                root = [low_ if r == high else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_near_components(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect()}
    assert got == near_brute(TEXTS)
    assert minhash.near_components(empty).count() == 0


def test_chains_and_large_groups_are_whole(spark):
    words = [f"v{i}" for i in range(80)]
    texts = [" ".join(words[:20] + [f"x{j}" for j in range(i)] + words[20 + i :]) for i in range(12)] * 3
    got = minhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), minhash.Settings(block=8))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_brute(texts)


def test_targets_are_capped_and_reshared():
    got = mixing.targets({"a": 100, "b": 1000, "c": 0}, {"a": 5.0, "b": 2.0, "c": 1.0})
    assert got == {"a": 200.0, "b": 1450.0, "c": 0.0}


def test_quota_tree_deals_everything():
    dealt = mixing.split_quotas(np.array([7, 0, 23]), 5, 3)
    assert dealt.sum(axis=0).tolist() == [7, 0, 23] and (dealt >= 0).all()
    assert (dealt == mixing.split_quotas(np.array([7, 0, 23]), 5, 3)).all()


def test_mixing(spark, docs, empty):
    many = spark.createDataFrame([(i, "word " * (1 + i % 7), f"s{i % 4}" if i % 9 else None) for i in range(3000)], "doc_id long, text string, source string")
    one, two = ({r.doc_id: (r.copies, r.size, r.source_size, r.target, tuple(r.shards)) for r in mixing.mix_counts(many).collect()} for _ in range(2))
    assert one == two
    taken, want = Counter(), {}
    for i, (copies, size, source_size, target, shards) in one.items():
        key = f"s{i % 4}" if i % 9 else None
        assert 0 <= copies <= 2 and size == 1 + i % 7 and len(shards) == copies
        taken[key] += copies * size
        want[key] = target
    assert all(abs(taken[k] - want[k]) <= max(7, 0.01 * want[k]) for k in want)
    assert mixing.mix(many).count() == sum(v[0] for v in one.values())
    clash = many.withColumns({"shard": F.lit("x"), "copy": F.lit("y"), "size": F.lit("z")})
    mixed = mixing.mix(clash)
    assert mixed.columns == ["doc_id", "text", "source", "size", "copy", "shard"] and {r.size for r in mixed.select("size").distinct().collect()} == {"z"}
    assert mixing.mix_counts(many.union(many)).where("copies > 2").count() == 0
    assert mixing.mix_counts(docs).count() == len(TEXTS)
    assert mixing.mix_counts(empty).count() == 0


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines_brute(texts, least=16):
    seen, out = [], []
    for t in texts:
        kept, near_only = [], 0
        for line in (t or "").split("\n"):
            near = [s for s in seen if s == line or (len(s) >= least and len(line) >= least and edit_within_one(s, line))]
            gone = bool(near and line.strip())
            near_only += gone and line not in near
            if line.strip():
                seen.append(line)
            if not gone:
                kept.append(line)
        out.append(("\n".join(kept), near_only))
    return out


LINES = ["a line that is lng enough\nfresh words on this line her", "😀" * 20, "😀" * 19 + "x\n" + "😀" * 19, "shorT\nshort", "ab\nb\nabc\nac\nxyz"]


@pytest.mark.parametrize("least", [16, 1])
def test_line_dedup(spark, empty, least):
    texts = TEXTS + LINES
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, n_lines string")
    got = line_dedup.dedup_lines(rows, least)
    assert [(r.text or "", r.n_near) for r in got.orderBy("doc_id").collect()] == lines_brute(texts, least)
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_dropped", "n_near"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_repeated_and_missing_ids(spark):
    texts = [(5, "one line that both of them have\nprecious second line"), (5, "one line that both of them have\nother unique line here"), (5, "one line that both of them have\nother unique line here"), (None, "one line that both of them have")]
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    said = [r.text for r in got]
    assert len(got) == 4 and sum("precious second line" in t for t in said) == 1 and sum("other unique line here" in t for t in said) == 2
    assert [r.text for r in got if r.doc_id is None] == ["one line that both of them have"]
    lines = [x for r in {(r.doc_id, r.text) for r in got if r.doc_id} for x in r[1].split("\n")]
    assert lines.count("one line that both of them have") == 1


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\s> <\\\\|im_end|>\n<|im_end|>", "", "[\\INST] <|im_start|>user\n"])
def test_control_strings_round_trip(text):
    turns = [("user", text), ("assistant", text), ("we%ird\nrole", text)]
    formatted, loss = chat.write_chat(turns)
    assert chat.read_chat(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [text]
    assert not chat._CONTROL.search(chat.escape(text)) or chat.escape(text) != text


def test_layouts_become_the_same_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"id":3}',
        '{"instruction":"hi","input":"","output":"yo"}', '{"prompt":"hi","response":"yo"}', '{"question":"hi","answer":"yo"}',
        '{"messages":[{"role":"user","content":[{"type":"text","text":"h"},{"type":"text","text":"i"}]},{"role":"assistant","content":[{"type":"text","text":"yo"}]}]}',
        '{"odd":1}', "not json", None,
    ]
    got = chat.format_chat(chat.canonical_turns(spark.createDataFrame(list(enumerate(records)), "n int, record string"))).orderBy("n").collect()
    assert all([(t.role, t.text) for t in r.turns] == [("user", "hi"), ("assistant", "yo")] for r in got[:6])
    assert all(r.turns is None and r.formatted is None for r in got[6:])
    assert [r.n_turns for r in chat.digests(chat.format_chat(chat.canonical_turns(spark.createDataFrame([(0, records[0], 1), (1, None, 1)], "conv_id int, record string, turns int")))).orderBy("conv_id").collect()] == [2, None]
    own = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", None), (1, 1, "gpt", None), (1, None, None, "b")], "conv_id long, turn int, role string, text string")
    (kept,) = chat.canonical_turns(chat.records_from_rows(own)).collect()
    assert [(t.role, t.text) for t in kept.turns] == [("", "b"), ("human", "a"), ("gpt", ""), ("gpt", "")]
    assert chat.format_chat(chat.canonical_turns(chat.records_from_rows(own.limit(0)))).count() == 0


def test_quality_is_learnt_from_rows_not_held_out(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    ranker = quality.train(d, labels)
    rows = quality.score_quality(d, ranker).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", "predicted", "score").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.85
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.93
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, ranker).collect())
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(d, flipped).weights, ranker.weights)
    assert quality.score_quality(empty, quality.train(empty, labels)).count() == 0
    assert zlib.crc32(b"17") % 3 == spark.range(1).select(F.crc32(F.lit("17").cast("binary")) % 3).first()[0]


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(1)
    texts = ["".join(draw.choice(list("0123456789.-+ @ab()%"), 300)) for _ in range(200)]
    texts += ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 999.1.2.3 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +1", "é ana@x.pe ñ 10.0.0.1", ""]
    for text in texts:
        want = [(k, m.start(), m.end()) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, text) if ok(m[0])]
        assert pii.base_spans(text) == pii.in_order(want)


def viterbi_brute(field, row, cls):
    near = crf.around(row, cls)
    score = sum(field.emit[i][near[i]] for i in range(len(crf.NEAR)))
    best, back = score[0] + field.move[0], []
    for t in range(1, len(cls)):
        ways = best[:, None] + field.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + score[t]
    at = int((best + field.move[:, 0]).argmax())
    path = [at]
    for step in reversed(back):
        at = int(step[at])
        path.append(at)
    return path[::-1]


def test_field_finds_what_patterns_do_not(spark, docs, empty):
    field = crf.train(pii.labelled_examples(rows=300), rounds=80)
    text = 'Please call 555-123-4567 or ask Dr. Jonas Weber, DNI 12345678Z, token = "0123456789abcdef0123456789abcdef" today'
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    row, start, end, cls = crf.tokens(data, np.array([0, len(data)]))
    assert field.decode(row, cls).tolist() == viterbi_brute(field, row, cls)
    (base, every), = pii.find(pa.array([text]), field)
    assert base == [] and {"tel", "name"} <= {k for k, _, _ in every}
    assert pii.find_pii(docs, field).count() == len(TEXTS) and pii.find_pii(empty, field).count() == 0


@pytest.mark.parametrize("sentences", [SEEN, UNSEEN], ids=["seen", "unseen"])
def test_field_on_hand_written_sentences(spark, sentences):
    texts, gold = [], []
    for line in sentences.strip().split("\n"):
        text, marked = "", set()
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            kind, _, said = part.strip("{}").partition(":") if part.startswith("{") else (None, "", part)
            if kind:
                marked.add((kind, len(text), len(text) + len(said)))
            text += said
        texts.append(text)
        gold.append(marked)
    found = [{s for s in every if s[0] in crf.KINDS} for _, every in pii.find(pa.array(texts), pii.trained_field(spark))]
    for kind in crf.KINDS:
        of = lambda spans: {(i, *s) for i, x in enumerate(spans) for s in x if s[0] == kind}  # noqa: B023, E731
        right = len(of(found) & of(gold))
        assert right >= 0.9 * len(of(found)) and right >= 0.9 * len(of(gold)), kind


def test_fingerprints(spark, docs):
    texts = [BASE, BASE, BASE + " tail", "", None, "nothing alike in here at all", "é😀 " * 7]
    rows = fingerprints.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for i, r in enumerate(rows):
        text, other = texts[i] or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[0].fingerprint == rows[1].fingerprint and rows[1].near_next == 1
    assert rows[3].fingerprint == "" and rows[4].near_next == 1
    assert rows[2].near_next > 0.8 and rows[6].near_next == 0


def test_next_document_whatever_the_ids_are(spark):
    ids = [0, -7, 10**12, *range(500, 560), *[77] * 40, *[None] * 30]
    rows = [(i, f"text {n} of {i}" if n % 9 else None, "x") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    hashed = [(r.doc_id, r.text or "", r.h) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    want = Counter((r[0], r[1], nxt[1]) for r, nxt in zip(order, order[1:] + order[:1], strict=True))
    placed, heads = fingerprints.with_next(docs, rows_per_bucket=4, ranges=16)
    assert Counter((r.doc_id, r.text, r.next_text) for r in placed.collect()) == want
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 20 and heads.count() > 15
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0


def test_likeness_is_near_the_generalised_jaccard(spark):
    draw = np.random.default_rng(3)
    texts = []
    for i in range(60):
        a = [f"w{k}" for k in draw.integers(0, 12, 80)]
        b = [f"v{k}" if change else w for w, k, change in zip(a, draw.integers(0, 12, 80), draw.random(80) < i / 120, strict=True)]
        texts += [" ".join(a), " ".join(b)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.near_next for r in fingerprints.compare_with_next(rows).collect()}
    errors = []
    for i in range(1, len(texts), 2):
        a, b = (Counter(itertools.pairwise(t.split())) for t in (texts[i], texts[i - 1]))
        errors.append(abs(found[i] - sum((a & b).values()) / sum((a | b).values())))
    # 128 samples err by 0.044 (one deviation) at most.
    assert np.mean(errors) < 0.045 and max(errors) < 0.16
    assert fingerprints.SAMPLES >= 128


def _plain_fingerprint(text):
    """Consistent weighted sampling of one text, term by term."""
    hashed = lambda x, kind, seed=42: xxhash.xxh64_intdigest(struct.pack(kind, x), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text)]
    terms = [signed(hashed(b, "<q", hashed(a, "<q"))) for a, b in itertools.pairwise(words)] or words
    out = []
    for i in range(fingerprints.SAMPLES if terms else 0):
        best = None
        for term, w in Counter(terms).items():
            h = hashed(i, "<i", hashed(term, "<q"))
            g = hashed(signed(h), "<q")
            m = hashed(signed(g), "<q")
            u = [((x >> s & 0xFFFFFFFF) + 0.5) / 2**32 for x in (h, g, m) for s in (0, 32)]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), u[5]
            t = math.floor(math.log(w) / r + b)
            key = math.log(c) - r * (t - b + 1)
            best = min(best or (math.inf, 0), (key, (m + t * 7919) & 0xFFFFFF))
        out.append(f"{best[1]:06x}")
    return "".join(out)


def test_fingerprints_equal_plain_sampling(spark):
    texts = [BASE, "a b " * 40 + BASE, "one", "", None, "é 漢 é 漢 é x", "to be or not to be " * 9, "z " * 3000 + BASE]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(rows).collect()}
    for i, text in enumerate(texts):
        text, other = text or "", texts[i - 1] or ""
        half = len(text) // 2
        assert got[i].fingerprint == _plain_fingerprint(text)
        assert got[i].edited_fingerprint == _plain_fingerprint(text[: len(text) - half] + other[:half])


@pytest.mark.parametrize(("heavy", "single", "other"), [(50, 100, 1), (16, 100, 1), (8, 15, 1), (2, 1, 1), (300, 40, 20)])
def test_agreement_is_the_generalised_jaccard_for_uneven_weights(spark, heavy, single, other):
    """One term of weight ``heavy`` beside ``single`` terms of weight 1, against a bag that has it ``other`` times."""
    sample = spark.range(40_000).select(F.col("id").cast("int").alias("sample"))
    won = {}
    for name, weight in (("a", heavy), ("b", other)):
        terms = spark.createDataFrame([(0, float(weight)), *[(k, 1.0) for k in range(1, single + 1)]], "term long, w double")
        keyed = sample.crossJoin(F.broadcast(terms)).select("sample", fingerprints.sample_key(fingerprints.draws(F.col("term"), F.col("sample")), F.ln("w")).alias("k"))
        won[name] = keyed.groupBy("sample").agg((F.min("k").bitwiseAND(F.lit(0xFFFFFF))).alias(name))
    agree = won["a"].join(won["b"], "sample").agg(F.avg((F.col("a") == F.col("b")).cast("double"))).first()[0]
    want = (min(heavy, other) + single) / (max(heavy, other) + single)
    assert abs(agree - want) < 3 * (want * (1 - want) / 40_000) ** 0.5


@pytest.mark.parametrize(("weight", "total"), [(1.0, 2000.0), (40.0, 2000.0), (1.0, 3.0)])
def test_only_keys_that_cannot_be_least_are_left_out(spark, weight, total):
    """Every key within reach is worked out, and in a long text few others are."""
    reach = fingerprints.NEAR * weight / total
    rows = spark.range(200_000).select(F.col("id").alias("term"), F.lit(5).alias("sample"), F.lit(weight).alias("w"))
    key = F.shiftright(fingerprints.sample_key(fingerprints.draws(F.col("term"), F.col("sample")), F.ln("w")), fingerprints.TAG_BITS) / F.lit(fingerprints.KEY_SCALE) - F.lit(fingerprints.KEY_SHIFT)
    near = fingerprints.nearby(F.col("term"), F.col("sample"), F.col("w") <= 1, F.lit(reach))
    within = F.exp(key) * F.col("w") <= reach
    seen = rows.select(near.alias("near"), within.alias("within")).agg(F.count_if("within").alias("within"), F.count_if("near").alias("near"), F.count_if(F.col("within") & ~F.col("near")).alias("lost")).first()
    assert seen.lost == 0 and seen.within > 0
    assert total < 10 or weight > 1 or seen.near < 10_000


def test_sharding(spark, tmp_path):
    """Against a list of rows: every version reads as what had been appended by then."""
    root = f"file://{tmp_path}/store"
    assert sharding.read(spark, root).count() == 0 and sharding.compact(spark, root) == 0
    held, by_version = [], {0: 0}
    for n in range(6):
        rows = [(i, None if i % 4 == 0 else "é" * i) for i in range(10 * n, 10 * n + 10)] + [(1, "again")]
        kind = "doc_id long, text string"
        if n >= 4:
            rows, kind = [(*r, "new") for r in rows], kind + ", extra string"
        at = sharding.append(spark.createDataFrame(rows, kind).withColumn("shard", F.lit("clash")).coalesce(1), root)
        held += [(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows]
        by_version[at] = len(held)
        if n == 3:
            at = sharding.compact(spark, root, target_bytes=1 << 20, base=1 << 10, fanout=4)
            by_version[at] = len(held)
            assert sharding.manifest(spark, root).count() == 1
    assert sharding.append(spark.createDataFrame([], "doc_id long, text string, extra string"), root) == at == sharding.version(spark, root)
    got = sharding.read(spark, root)
    assert sorted(((r.doc_id, r.text, r.extra) for r in got.collect()), key=str) == sorted(held, key=str)
    sizes = {(f"{r.run}/{r.file}", r.bytes): r.rows for r in sharding.manifest(spark, root).collect()}
    assert {(r.shard, r.shard_bytes): r["count"] for r in got.groupBy("shard", "shard_bytes").count().collect()} == sizes
    assert all(sharding.read(spark, root, v).count() == n for v, n in by_version.items())
    with pytest.raises(sharding.Conflict):
        sharding.commit(spark, root, sharding.manifest(spark, root), at)
    with pytest.raises(ValueError):
        sharding.append(spark.createDataFrame([("x",)], "doc_id string"), root)
    lost = tmp_path / "store" / "data" / "shard_run=rwriteratwork"
    lost.mkdir()
    assert sharding.vacuum(spark, root, keep=3) == 4 and lost.exists()
    assert sharding.read(spark, root).count() == len(held) and sharding.versions(spark, root) == [at - 2, at - 1, at]


MODELS = pytest.importorskip("os").path.exists(pieces.MODEL)


@pytest.mark.skipif(not MODELS, reason="no tokenizer files here")
def test_pieces_match_the_reference_tokenizer(spark, docs):
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    texts = [t for t in TEXTS if t is not None] + ["  two  spaces\nand\tlines ", "x" * 300, "▁odd▁"]
    ids, cuts = pieces.encode_texts(pa.array(texts), model)
    for text, a, z in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert ids[a:z].tolist() == sp.encode(text), text[:40]
    rows = pieces.digests(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)


@pytest.mark.skipif(not MODELS, reason="no tokenizer files here")
@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_spark_fold_agrees_with_the_batched_one(spark, kind):
    model = pieces.load(kind=kind)
    words = ["▁hello", "▁tokenization", "▁x9é", "▁the", "▁straße"]
    ids, cuts = pieces.encode_distinct(words, model)
    got = {r.word: r.pieces for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w, a, z in zip(words, cuts[:-1], cuts[1:], strict=True):
        if (ids[a:z] >= 0).all() and all(model.normal[i] for i in ids[a:z]):
            assert got[w] == [model.pieces[i] for i in ids[a:z]]


@pytest.mark.skipif(not MODELS, reason="no tokenizer files here")
def test_documents_are_encoded_by_joins_and_folds(spark, monkeypatch):
    import sentencepiece

    sp, model, seen = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load(), []
    by_joins = pieces.encode_words
    monkeypatch.setattr(pieces, "encode_words", lambda words, m: seen.append(1) or by_joins(words, m))
    texts = [None, "", " a", "  two  spaces\nand\tlines ", "x" * 300, "▁odd▁ straße 日本語 \U0001f600 z\n\n", "\n", "the same the same"]
    rows = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = [(r.text, r.ids) for r in pieces.encode(rows, model).collect()]
    assert seen and got == [(t, sp.encode(t or "")) for t in texts]
    back = {(r.text, r.decoded) for r in pieces.decode(pieces.encode(rows, model), model).collect()}
    assert back == {(r.text, r.decoded) for r in pieces.encode(rows, model, and_decode=True).collect()} and (" a", " a") in back


def test_encode_takes_shuffled_rows_and_columns_of_any_name(spark, tmp_path):
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    texts = [f"text {i % 50} of {'many ' * (i % 7)}words{i}" if i % 11 else None for i in range(600)]
    rows = spark.createDataFrame([(i % 40, t, i, "c", "w") for i, t in enumerate(texts)], "doc_id long, text string, _row long, _CHUNK string, word string")
    rows.repartition(3).write.parquet(f"{tmp_path}/rows")
    read = spark.read.parquet(f"{tmp_path}/rows")
    assert pieces._splits_alike(read.select("doc_id", "text"))
    for docs in (read, read.repartition(7).where("_row % 5 <> 2"), read.join(spark.range(30).withColumnRenamed("id", "doc_id"), "doc_id"), read.withColumn("r", F.rand())):
        assert docs is read or not pieces._splits_alike(docs)
        got = sorted((r["_row"], r.text, r.ids) for r in pieces.encode(docs, model).collect())
        assert got == [(r["_row"], r.text, sp.encode(r.text or "")) for r in docs.orderBy("_row").collect()]
    assert pieces.encode(read, model).columns == [*read.columns, "ids"]


def test_pipeline_keeps_what_its_stages_keep(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, kept = docs.count(), out.count()
        assert kept > 0 and (kept <= before or name == "source mixing")
        docs = pipeline.materialise(out, "test")
    encoded = pipeline.STAGES[4][1](spark, docs, SF)
    assert encoded.count() == docs.count()


@pytest.mark.skipif(not MODELS, reason="no tokenizer files here")
def test_pipeline_run_against_plain_python(spark, tmp_path):
    """run() over a table with awkward rows, stage by stage against plain versions of the stages."""
    import sentencepiece

    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    clean = base.where("length(text) > 400").orderBy("doc_id").limit(60)
    copies = clean.limit(9).selectExpr("doc_id + 100000 as doc_id", "upper(text) as text", "lang", "source", "n_chars")
    near = clean.limit(7).selectExpr("doc_id + 200000 as doc_id", "concat(text, ' and one more tail of words') as text", "lang", "cast(null as string) as source", "n_chars")
    odd = spark.createDataFrame([(300001, None, "en", "s", 0), (300002, "", "en", "s", 0), (300003, "  \n", None, None, None)], base.schema)
    docs = base.unionByName(copies).unionByName(near).unionByName(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    ranker = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = ranker.score(quality.features(pa.array([t for _, t, _, _ in rows], type=pa.string())))
    good = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    assert 0 < len(good) < len(rows)
    last = {}
    for r in sorted(good):
        last[low(r[1])] = r
    single = sorted(last.values())
    component = near_brute([r[1] for r in single], 80)
    kept = {r[0]: r for i, r in enumerate(single) if component[i][1] == i}
    times = Counter(r.doc_id for r in out)
    assert times.keys() <= kept.keys() and max(times.values()) <= 2
    size = {i: len(WORD.findall(r[1] or "")) for i, r in kept.items()}
    by_source = Counter()
    for i, r in kept.items():
        by_source[r[3]] += size[i]
    want = mixing.targets(dict(by_source), mixing.cycled_weights(by_source))
    for s in want:
        taken = sum(n * size[i] for i, n in times.items() if kept[i][3] == s)
        assert abs(taken - want[s]) <= max(0.02 * want[s], max(size[i] for i in kept if kept[i][3] == s))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in out:
        assert (r.ids, r.n_tokens, r.lang, r.source) == ((ids := sp.encode(kept[r.doc_id][1] or "")), len(ids), kept[r.doc_id][2], kept[r.doc_id][3])


def test_pipeline_takes_near_copies_from_four_fifths_on(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(100)]
    copy = lambda n: " ".join(words[: 100 - n] + [f"x{n}y{i}" for i in range(n)])
    texts = [copy(0), copy(10), copy(12)]  # 86 of 106 shingles are shared, 84 of 108, and 84 of 108
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_stage(spark, docs, "").collect()) == [0, 2]
