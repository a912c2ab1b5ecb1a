"""Whitening, clustering and chat formatting against brute force, with the edge cases their docstrings define."""

import hashlib
import itertools
import json
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import centroids, chat, whiten

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = ("_id", "_x", "_v", "cluster", "n", "component", "distance")


def vector_rows(n, dim, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in draw.normal(size=dim) * np.linspace(1, 2, dim) * spread], 1) for i in range(n)]


def odd_rows(dim):
    """Nulls, holes, other lengths, infinities; two copies of a vector under other ids, a repeated row, a null id."""
    base = [0.25] * dim
    hole = [None] + base[1:]
    return [(900, None, 1), (901, hole, 1), (902, [float("nan")] + base[1:], 1), (903, [float("inf")] + base[1:], 1), (904, [], 1),
            (905, base[1:], 1), (906, base, 1), (907, base, None), (907, base, None), (None, base, 2), (908, [0.0] * dim, 1),
            (909, [-0.0] * dim, 1), (910, [1e30] + base[1:], 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ODD}).repartition(3)


def kept(rows, dim, scale, bound):
    """(id, grid vector) of the rows that take part."""
    out = []
    for i, v, _ in rows:
        if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and abs(c * scale) < bound for c in v):
            out.append((i, [int(np.floor(scale * float(np.float32(c)))) for c in v]))
    return out


# --- whitening


def test_whitening(spark):
    dim = 20
    rows = vector_rows(300, dim, 1) + odd_rows(dim)
    got = whiten.whiten(frame(spark, rows)).collect()
    grid = kept(rows, dim, 64, 2**50)
    fit = sorted({tuple(x) for _, x in grid})
    n, sums = len(fit), [sum(c) + len(fit) * 10**6 for c in zip(*fit, strict=True)]
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        (i is None, i or 0, c) for i, _ in grid for c in range(1, 17))
    assert {r.n for r in got} == {n}
    deviation = {i: sum((n * (v + 10**6) - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in grid}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    y = np.array([[float(v + 10**6 - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    by_id = {i: np.array([float(v + 10**6 - Fraction(s, n)) for v, s in zip(x, sums, strict=True)]) for i, x in grid}
    signs = {}
    for r in got:
        want = by_id[r.vec_id] @ directions[:, r.component - 1] / np.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            sign = signs.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened == pytest.approx(sign * want, rel=1e-7, abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-10


def test_whitening_of_few_and_none(spark):
    assert whiten.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten.whiten(frame(spark, odd_rows(6)[:5])).collect() == []
    one = whiten.whiten(frame(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]))
    assert one.collect() == [] and one.columns[0] == "vec_id"
    two = whiten.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 3.0], 1), (3, [1.0, 3.0], 1)])).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(r.whitened), r.explained) for r in two) == [
        (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]
    # far from the origin and far apart: sums beyond a double's 53 bits stay exact, a deviation beyond a long is null
    far = whiten.whiten(frame(spark, [(1, [2.0**28, 1.0], 1), (2, [-(2.0**28), 2.0], 1), (3, [2.0**28, 3.0], 1)])).collect()
    assert len(far) == 6 and all(r.deviation is None and r.identity_error < 1e-6 for r in far)


def wide_residual(a, values, x):
    a = np.asarray(a, np.longdouble)
    return max(np.abs(a @ x - x * values).max(), np.abs(x.T @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("planted", [
    [9, 7, 5, 3, 2, 1], [1, 1 + 1e-9, 1 + 2e-9, 1 - 1e-9, 5, 5 + 1e-7, 0.1, 1e-6], [2] * 4 + [3] * 3 + [1], [1, 0, 0, 0, 0],
    [1e12, 1e12 + 1, 1, 1 + 1e-3, 1 + 1e-4], [4] * 30 + [4 + 1e-8] * 10,
])
def test_refined_eigenvectors(planted):
    planted = np.array(planted, np.longdouble)
    draw = np.random.default_rng(3)
    q = np.linalg.qr(draw.normal(size=(len(planted),) * 2))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q + q @ (np.eye(len(q)) - q.T @ q) / 2
    a = (q * planted) @ q.T
    a = (a + a.T) / 2
    values, x = whiten.refined_eigenvectors(a)
    assert wide_residual(a, values, x) < 1e-16 * max(1, planted.max())
    assert np.abs(values - np.sort(planted)[::-1]).max() < 1e-16 * planted.max()
    for i, v in enumerate(planted):
        gap = np.abs(np.delete(planted, i) - v).min()
        if gap > 1e-10 * planted.max():  # a direction of its own
            j = int(np.abs(values - v).argmin())
            assert 1 - abs(x[:, j] @ q[:, i]) < 1e-9 and np.abs(np.abs(x[:, j]) - np.abs(q[:, i])).max() < 1e-17 * planted.max() / gap


def test_eigenvectors_of_nothing():
    values, x = whiten.refined_eigenvectors(np.zeros((3, 3)))
    assert not values.any() and (x == np.eye(3)).all()


# --- clustering


def clustered(grid, k, rounds):
    def key(row):
        return row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest() if row[0] is not None else "", np.array(row[1], "<i8").tobytes()

    middle = [x for _, x in sorted(grid, key=key)[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(middle))

    for _ in range(rounds):
        members = {}
        for _, x in grid:
            members.setdefault(near(x)[1], []).append(x)
        for c, xs in members.items():
            middle[c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in grid]
    of = {c: sum(d for _, e, d in found if e == c) for _, c, _ in found}
    return [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in found]


def test_clusters(spark):
    rows = vector_rows(150, 64, 2, 0.1) + odd_rows(64)
    got = [tuple(r) for r in centroids.cluster(frame(spark, rows)).collect()]
    want = clustered(kept(rows, 64, 256, 2**27), 40, 5)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_clusters_of_few_and_none(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i, [float(i % 2)] * 4, 1) for i in range(6)]  # equal centroids: the smaller number has all, the others stay empty
    got = [tuple(r) for r in centroids.cluster(frame(spark, rows), dim=4).collect()]
    assert sorted(got) == sorted(clustered(kept(rows, 4, 256, 2**27), 40, 5))


@pytest.mark.parametrize("dim,k,n", [(1, 40, 300), (3, 40, 700), (64, 40, 80), (5, 1, 20), (4, 7, 0)])
def test_threshold_walk(dim, k, n):
    draw = np.random.default_rng(dim)
    x, middle = draw.integers(-30, 30, (n, dim)), draw.integers(-30, 30, (k, dim))  # small values: many ties
    found, distance, worked = centroids.nearest_centroids(x, middle)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(2).reshape(n, k)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert worked <= n * k and (dim > 3 or worked < n * k / 2)  # in few dimensions the walk stops early


# --- chats


RECORDS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":7}', "messages", [("user", "hi"), ("assistant", "yo")]),
    ('{"id":1,"prompt":"p","messages":[{"role":"user","content":null},{"content":"x"},{"role":"tool"}]}', "messages",
     [("user", ""), ("", "x"), ("tool", "")]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]},'
     '{"role":"assistant","content":"c"}]}', "message_parts", [("user", "ab"), ("assistant", "c")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"system":"be brief"}', "shared",
     [("system", "be brief"), ("user", "q"), ("assistant", "a")]),
    ('{"dialog":{"turns":[{"speaker":"bot","utterance":"hello"}]}}', "dialog", [("assistant", "hello")]),
    ('{"instruction":"add","input":"1 2","output":"3"}', "instruction", [("user", "add\n\n1 2"), ("assistant", "3")]),
    ('{"instruction":"add","input":"","output":"3","system":""}', "instruction", [("user", "add"), ("assistant", "3")]),
    ('{"instruction":"add","response":"3"}', "instruction_response", [("user", "add"), ("assistant", "3")]),
    ('{"question":"q","response":"r","system_prompt":"s"}', "question", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ('{"question":"q","answer":"r","context":"c"}', "question_answer", [("user", "c\n\nq"), ("assistant", "r")]),
    ('{"prompt":"p","completion":null}', "completion", [("user", "p"), ("assistant", "")]),
    ('{"prompt":"p","response":3}', "prompt_response", [("user", "p"), ("assistant", "3")]),
    ('{"data":{"prompt":{"text":"p"},"response":{"text":"r"}}}', "nested", [("user", "p"), ("assistant", "r")]),
    ('{"data":{"prompt":"p"}}', None, None), ('{"messages":[]}', None, None), ("[1, 2]", None, None), ("not json", None, None), (None, None, None),
    ('{"messages":"text"}', None, None), ("{}", None, None),
]


def test_layouts(spark):
    rows = spark.createDataFrame([(i, j, 1) for i, (j, _, _) in enumerate(RECORDS)], "id long, json string, turns int")
    rows = rows.withColumns({"a.b": F.lit(1), "Layout": F.lit(2)}).withColumn("record", F.try_parse_json("json"))
    out = chat.format_chats(chat.canonical_turns(rows))
    assert out.columns == ["id", "json", "a.b", "record", "fingerprint", "layout", "turns", "formatted", "loss_mask"]
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("read")).collect()
    for r in sorted(read, key=lambda r: r.id):
        _, layout, turns = RECORDS[r.id]
        assert (r.layout, r.turns and [tuple(t) for t in r.turns]) == (layout, turns), r.id
        assert r.read == r.turns and (r.formatted is None) == (turns is None)
    prints = {r.id: r.fingerprint for r in read}
    assert prints[0] != prints[1] and prints[17] is None and prints[13] == prints[14]
    assert chat.canonical_turns(rows.limit(0)).collect() == []


def test_fingerprints_name_one_layout():
    table = chat.layout_table(chat.LAYOUTS)
    assert set(table.values()) == {x.name for x in chat.LAYOUTS}
    assert len(table) == sum(2 ** len(x.optional) for x in chat.LAYOUTS)


def test_format_and_back(spark):
    draw = random.Random(4)
    bits = ["<|", "|>", "<|end|>", "<|*end|>", "<|turn|>", "<|***text|>", "<", "|", "*", "end", "text", "\n", "é", "\U0001f600", "\\", "$1", " ", "user", ""]
    chats = [[(draw.choice(["user", "assistant", "system", "", "<|end|>", "a\nb", None]),
               draw.choice([None, "".join(draw.choices(bits, k=draw.randrange(12)))])) for _ in range(draw.randrange(1, 9))] for _ in range(300)]
    chats.append([("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")])
    rows = [(c, t, role, text, 1) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m int").repartition(3)
    out = chat.format_chats(chat.canonical_turns(chat.gather(table)))
    out = out.select("conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"),
                     chat.learned_texts(F.col("formatted"), F.col("loss_mask")).alias("learned")).collect()
    assert len(out) == len(chats)
    undo = {f"<|*{s}{w}|>": f"<|{s}{w}|>" for s in ("", "*", "**", "***", "****") for w in ("turn", "text", "end")}
    for r in out:
        turns = [(role or "", text or "") for role, text in chats[r.conv_id]]
        assert [tuple(t) for t in r.turns] == turns
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == r.formatted.count("<|text|>") == len(turns)
        assert r.learned == [text for role, text in turns if role == "assistant" and text]
        at, spans = 0, []
        for m in r.loss_mask:  # the mask against the formatted text, by plain offsets
            spans.append(r.formatted[at + m.skip : at + m.skip + m.take])
            at += m.skip + m.take
        assert len(r.formatted) - at == len(chat.END)
        for span, (role, text) in zip(spans, turns, strict=True):
            for starred, plain in sorted(undo.items(), key=lambda p: len(p[0])):
                span = span.replace(starred, "\0" + plain[2:])
            assert span.replace("\0", "<|") == (text if role == "assistant" else "")


def test_gather_orders_ties_and_nulls(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (1, None, "c", "z"), (None, 0, "user", None), (1, 1, "a", "y")]
    got = chat.canonical_turns(chat.gather(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got.collect()} == {
        1: [("c", "z"), ("a", "y"), ("a", "y"), ("b", "x")], None: [("user", "")]}
    empty = chat.gather(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.format_chats(chat.canonical_turns(empty)).collect() == []


def test_records_as_json_round_trip():
    assert all(json.loads(j) is not None for j, layout, _ in RECORDS if layout)
    assert len(list(itertools.chain.from_iterable(x.required for x in chat.LAYOUTS))) == 2 * len(chat.LAYOUTS)
