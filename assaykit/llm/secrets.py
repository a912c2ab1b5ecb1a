"""Secrets in texts: rules, and a small character network over every long token with its surroundings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import discard, prepare, stored

# The base rules, in this order, with the least length of a finding (group 2 for the first).
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEFT, BODY, RIGHT = 24, 48, 12
SPAN = LEFT + BODY + RIGHT
DRIVER_TOKENS = 6000
LEAST_TOKENS = 20
BATCHES, EPOCHS = 16, 6
MIN_RECALL = 0.98


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, leftmost and without overlap within a kind, short ones dropped."""
    out = []
    small = text.lower()
    if any(w in small for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run of 24 is a maximal run of the rule's class that is long enough
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, picture) of every long token with its context, in a frame of fixed width.

    The frame holds ``LEFT`` characters before it, up to ``BODY`` of its own and ``RIGHT`` after it, padded with \\x00 so that the
    token always starts at the same place. A longer token is seen whole, in frames that overlap by half.
    """
    for m in CANDIDATE.finditer(text):
        i, end = m.span()
        while end > i and text[end - 1] in ".-=":
            end -= 1
        if end - i < 16:
            continue
        while True:
            j = min(end, i + BODY)
            yield i, j, text[max(0, i - LEFT) : i].rjust(LEFT, "\0") + text[i:j].ljust(BODY, "\0") + text[j : j + RIGHT].ljust(RIGHT, "\0")
            if j == end:
                break
            i = min(i + BODY // 2, end - BODY)


def touched(spans: list[tuple[int, int]], found: list[tuple[int, int]]) -> list[bool]:
    """Does each span meet one of ``found``? Both in order of their start: one pass over the two, whatever their number."""
    out, at, reach = [], 0, -1
    for i, j in spans:
        while at < len(found) and found[at][0] < j:
            reach = max(reach, found[at][1])
            at += 1
        out.append(reach > i)
    return out


def encode(pictures: list[str]) -> np.ndarray:
    """Character numbers 0..97: 0 padding, 1..95 printable ASCII, 96 white space, 97 anything else."""
    points = np.array([[ord(c) for c in p] for p in pictures], dtype=np.int64).reshape(-1, SPAN)
    return np.select([points == 0, (points > 32) & (points < 127), (points == 32) | ((points > 8) & (points < 14))],
                     [0, points - 32, 96], 97)


class Adam:
    """Steps down the gradients of the parameters ``p``, which it changes in place."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.steps = p, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in gradients.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def platt(measure: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], least_step: float = 0.0) -> np.ndarray:
    """Scale and shift by damped Newton steps; ``measure`` gives loss, gradient and curvature at a scale and shift."""
    a = np.array([1.0, 0.0])
    loss, slope, curve = measure(a)
    for _ in range(50):
        step, size = np.linalg.solve(curve + 1e-3 * np.eye(2), slope), 1.0
        there = measure(a - step)
        while size > 1e-6 and there[0] > loss * (1 + 1e-12):
            size /= 2
            there = measure(a - size * step)
        a, (loss, slope, curve) = a - size * step, there
        if np.abs(size * step).max() < least_step:
            break
    return a


def platt_targets(found: int, other: int) -> tuple[float, float]:
    """What a found and another token are fitted to."""
    return (found + 1) / (found + 2), 1 / (other + 2)


class CharNet:
    """Character embedding, one convolution of width 5, max and mean pooling over the token and over its context, logistic."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "e": draw.normal(0, 0.5, (98, self.EMBED)),
            "w": draw.normal(0, 0.2, (self.WIDTH * self.EMBED, self.FILTERS)), "b": np.zeros(self.FILTERS),
            "v": draw.normal(0, 0.1, 3 * self.FILTERS), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        inside = np.zeros(SPAN - self.WIDTH + 1, bool)
        inside[LEFT - 2 : LEFT + BODY - 2] = True
        self.inside = inside

    def _forward(self, x: np.ndarray) -> tuple:
        p, n = self.p, len(x)
        windows = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)
        cols = p["e"][windows].reshape(n, windows.shape[1], -1)
        act = np.maximum(cols @ p["w"] + p["b"], 0)
        own, around = act[:, self.inside], act[:, ~self.inside]
        top, near = own.argmax(1), around.argmax(1)
        pooled = np.concatenate([own.max(1), own.mean(1), around.max(1)], axis=1)
        return windows, cols, act, top, near, pooled, pooled @ p["v"] + p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 1024])[-1] for i in range(0, len(x), 1024)] or [np.zeros(0)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> CharNet:
        """Adam on the logistic loss, classes weighted alike."""
        draw, adam = np.random.default_rng(seed), Adam(self.p, rate)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), 128):
                some = order[i : i + 128]
                adam.step(self._gradients(x[some], y[some], weight[some]))
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        windows, cols, act, top, near, pooled, z = self._forward(x)
        n, f = len(x), self.FILTERS
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n
        dpool = dz[:, None] * self.p["v"]
        dact = np.zeros_like(act)
        own, around = np.flatnonzero(self.inside), np.flatnonzero(~self.inside)
        rows, lanes = np.arange(n)[:, None], np.arange(f)[None, :]
        dact[rows, own[top], lanes] += dpool[:, :f]
        dact[:, own] += dpool[:, None, f : 2 * f] / len(own)
        dact[rows, around[near], lanes] += dpool[:, 2 * f :]
        dact *= act > 0
        flat, dflat = cols.reshape(-1, cols.shape[2]), dact.reshape(-1, f)
        dcols = (dflat @ self.p["w"].T).reshape(-1, self.EMBED)
        dembed = np.zeros_like(self.p["e"])
        np.add.at(dembed, windows.reshape(-1), dcols)
        return {"e": dembed, "w": flat.T @ dflat, "b": dflat.sum(0), "v": pooled.T @ dz, "c": dz.sum(keepdims=True)}

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float = MIN_RECALL) -> CharNet:
        """Platt scaling by damped Newton steps, then a threshold that ``min_recall`` of the findings pass.

        Among thresholds with that recall the most precise one counts; if none of the other tokens stands between it and a lower
        score, it moves halfway down to the next of them (in log odds), never below even odds.
        """
        z = self.logits(x)
        target = np.where(y == 1, *platt_targets(int(y.sum()), int((1 - y).sum())))
        basis = np.stack([z, np.ones_like(z)], axis=1)

        def measure(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            odds = basis @ a
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            return float((np.logaddexp(0, odds) - target * odds).sum()), basis.T @ (p - target), basis.T @ (basis * (p * (1 - p))[:, None])

        self.scale, self.shift = map(float, platt(measure))
        odds = self.scale * z + self.shift
        found, other = np.sort(odds[y == 1]), odds[y == 0]
        edge = found[int((1 - min_recall) * len(found))]
        below = other[other < edge]
        self.set_threshold(edge, below.max() if len(below) else None)
        return self

    def set_threshold(self, edge: float, below: float | None) -> None:
        """Between the log odds ``edge`` that may still pass and the next ones ``below`` it that need not."""
        self.threshold = float(1 / (1 + np.exp(-max(0.0, edge if below is None else (edge + below) / 2))))


SPANS = "array<struct<kind:string,start:long,end:long>>"
FOUND = f"found {SPANS}, tokens array<struct<start:long,end:long,picture:string,label:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
TOKEN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("picture", pa.string()), ("label", pa.int32())]))


def read_findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored once per document: ``_id``, base findings, and every long token with its picture and whether a rule found it."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"_id {source.schema['_id'].dataType.simpleString()}, {FOUND}"

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tokens = [], []
            for cell in batch.column("_text"):
                value = cell.as_py()
                base = base_findings(value)
                found.append([{"kind": k, "start": i, "end": j} for k, i, j in base])
                long = list(candidates(value))
                labels = touched([t[:2] for t in long], [f[1:] for f in base])
                tokens.append([{"start": i, "end": j, "picture": p, "label": int(y)} for (i, j, p), y in zip(long, labels, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(found, SPAN_TYPE), pa.array(tokens, TOKEN_TYPE)], names=["_id", "found", "tokens"])

    return stored(source.mapInArrow(kernel, schema), "secret-tokens")


def _characters(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SPAN).astype(np.int64)


def _blanked(x: np.ndarray) -> np.ndarray:
    """The tokens without their context."""
    blank = x.copy()
    blank[:, :LEFT] = blank[:, LEFT + BODY :] = 0
    return blank


def token_table(tokens: DataFrame) -> DataFrame:
    """Stored: ``x`` (character numbers as bytes), ``y`` (label), ``held`` (three tenths, by hash) and ``batch`` of each token."""
    key = F.xxhash64("picture")
    source = tokens.select("picture", "label", (F.pmod(key, F.lit(10)) >= 7).alias("held"),
                           F.pmod(F.xxhash64("picture", F.lit(1)), F.lit(BATCHES)).cast("int").alias("batch"))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tobytes() for row in encode(batch.column("picture").to_pylist()).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *batch.columns[1:]], names=["x", "y", "held", "batch"])

    return stored(source.mapInArrow(kernel, "x binary, y int, held boolean, batch int"), "secret-training")


def gradient_sum(rows: DataFrame, net: CharNet, weights: tuple[float, float]) -> tuple[dict[str, np.ndarray], int]:
    """Gradients of the weighted loss summed over all ``rows`` (x, y), each with and without its context, and the number of terms.

    Each task sums its own; one set of gradients, some 15 kB, leaves it.
    """
    names, shapes = list(net.p), [v.shape for v in net.p.values()]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(sum(v.size for v in net.p.values())), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = _characters(part.column(0)), part.column(1).to_numpy()
                x, y = np.concatenate([x, _blanked(x)]), np.concatenate([y, y])
                found = net._gradients(x, y, np.where(y == 1, *weights))
                total += np.concatenate([found[k].ravel() for k in names]) * len(y)
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["g", "n"])

    parts = rows.select("x", "y").mapInArrow(kernel, "g binary, n long").collect()
    flat = sum((np.frombuffer(r.g) for r in parts), np.zeros(sum(v.size for v in net.p.values())))
    cut = np.split(flat, np.cumsum([v.size for v in net.p.values()])[:-1])
    return {k: v.reshape(shape) for k, v, shape in zip(names, cut, shapes, strict=True)}, sum(r.n for r in parts)


def kth_smallest(rows: DataFrame, column: str, k: int, at_once: int = 10_000) -> float:
    """The value with ``k`` others before it in order, exactly: its range is narrowed by counts until few values are left."""
    value = F.col(column)
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    while low < high and n > at_once:
        number = F.least(F.floor((value - low) / (high - low) * 1000), F.lit(999))
        for r in rows.where(value.between(low, high)).groupBy(number.alias("b")).agg(
                F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("b").collect():
            if k < r.n:
                break
            k -= r.n
        low, high, n = r.lo, r.hi, r.n
    return low if low == high else sorted(r[0] for r in rows.where(value.between(low, high)).select(column).collect())[k]


def train_by_tasks(tokens: DataFrame) -> CharNet:
    """A network from all ``tokens`` (picture, label), which stay where they are: gradients, curvatures and counts leave the tasks.

    Seven tenths by hash train it in ``BATCHES`` batches, ``EPOCHS`` times, the others calibrate it. If either part lacks a class,
    all tokens serve in its place.
    """
    table = token_table(tokens)
    counts = {(r.held, r.y): r.n for r in table.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}

    def part(held: bool) -> tuple[DataFrame, int, int]:
        if counts.get((held, 1)) and counts.get((held, 0)):
            return table.where(F.col("held") == held), counts[held, 1], counts[held, 0]
        return table, *[sum(n for (_, y), n in counts.items() if y == label) for label in (1, 0)]

    rows, found, other = part(held=False)
    weights = 0.5 * (found + other) / found, 0.5 * (found + other) / other
    net = CharNet()
    adam = Adam(net.p, rate=0.02)
    for _ in range(EPOCHS):
        for batch in range(BATCHES):
            gradients, n = gradient_sum(rows.where(F.col("batch") == batch), net, weights)
            if n:
                adam.step({k: g / n for k, g in gradients.items()})

    rows, found, other = part(held=True)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(net.logits(_characters(batch.column(0))), pa.float64())], names=["y", "z"])

    logits = stored(rows.select("x", "y").mapInArrow(kernel, "y int, z double"), "secret-logits")
    target = F.when(F.col("y") == 1, platt_targets(found, other)[0]).otherwise(platt_targets(found, other)[1])

    def measure(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z, odds = F.col("z"), F.lit(float(a[0])) * F.col("z") + F.lit(float(a[1]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))
        miss, w = p - target, p * (1 - p)
        loss, gz, g, hzz, hz, h = logits.agg(F.sum(F.greatest(odds, F.lit(0.0)) + F.log1p(F.exp(-F.abs(odds))) - target * odds), F.sum(miss * z),
                                             F.sum(miss), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        return loss, np.array([gz, g]), np.array([[hzz, hz], [hz, h]])

    net.scale, net.shift = map(float, platt(measure, least_step=1e-6))
    odds = logits.select("y", (F.lit(net.scale) * F.col("z") + F.lit(net.shift)).alias("odds"))
    edge = kth_smallest(odds.where("y = 1"), "odds", int((1 - MIN_RECALL) * found))
    net.set_threshold(edge, odds.where((F.col("y") == 0) & (F.col("odds") < edge)).agg(F.max("odds")).first()[0])
    discard(table)
    discard(logits)
    return net


def train(read: DataFrame, driver_tokens: int = DRIVER_TOKENS) -> CharNet | None:
    """A network from all distinct tokens, those that a rule found against the others. None if either class has fewer than 20.

    Up to ``driver_tokens`` of them are trained on in one place, more where they lie. Seven tenths train it, each also with its context
    blanked so that the token alone counts as well; the rest calibrates.
    """
    tokens = read.select(F.explode("tokens").alias("t")).select("t.picture", "t.label").distinct()
    tokens = stored(tokens, "secret-pictures")
    counts = {r.label: r.n for r in tokens.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(y, 0) for y in (0, 1)) < LEAST_TOKENS:
        net = None
    elif sum(counts.values()) > driver_tokens:
        net = train_by_tasks(tokens)
    else:
        order = F.xxhash64("picture")
        rows = [r for y in (1, 0) for r in tokens.where(F.col("label") == y).orderBy(order, "picture").collect()]
        x, y = encode([r.picture for r in rows]), np.array([r.label for r in rows])
        test = np.arange(len(y)) % 10 >= 7
        net = CharNet().fit(np.concatenate([x[~test], _blanked(x[~test])]), np.concatenate([y[~test], y[~test]])).calibrate(x[test], y[test])
    discard(tokens)
    return net


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and ``spans`` (kind, start, end in code points, end exclusive), by start, then kind.

    Kinds are ``assign``, ``access``, ``hex`` and ``model``: tokens of 16 characters or more, or the frames of longer ones, that no
    rule touches and that the network finds at its threshold. Every such token trains or calibrates the network and is scored, every
    character of it. With fewer than 20 distinct tokens of a class there is nothing to train on, and the rules alone decide. Null and empty texts have no spans;
    repeated rows and null ids are returned each; other columns are not read; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    read = read_findings(docs, id_col, text)
    net = train(read)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [list(map(tuple, map(dict.values, row))) for row in batch.column("found").to_pylist()]
            rows = batch.column("tokens").to_pylist()
            where = [(n, t) for n, row in enumerate(rows) for t in row if not t["label"]]
            if net is not None and where:
                passed = net.probabilities(encode([t["picture"] for _, t in where])) >= net.threshold
                for (n, t), ok in zip(where, passed, strict=True):
                    if ok and spans[n] and spans[n][-1][0] == "model" and t["start"] < spans[n][-1][2]:
                        spans[n][-1] = ("model", spans[n][-1][1], t["end"])  # a further frame of the same token
                    elif ok:
                        spans[n].append(("model", t["start"], t["end"]))
            ordered = [sorted(row, key=lambda s: (s[1], (*KINDS, "model").index(s[0]))) for row in spans]
            listed = [[{"kind": k, "start": i, "end": j} for k, i, j in row] for row in ordered]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(listed, SPAN_TYPE)], names=[id_col, "spans"])

    schema = f"`{id_col}` {read.schema['_id'].dataType.simpleString()}, spans {SPANS}"
    return read.select("_id", "found", "tokens").mapInArrow(kernel, schema)


def listed(spans: Column | str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
