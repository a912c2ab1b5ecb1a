"""Every operator of assaykit.llm against brute force on small fixtures, with the edge cases its docstring defines."""

import collections
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm import (
    common, components, decontam, elias_fano, graph_search, langid, licenses, near_copies, pfair, secrets, simhash, suffix_tree, winnow,
)

bpe = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["_id", "_text", "row", "_n", "_lines", "removed", "words"]


def words(n, seed, size=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Rows with nulls in every column, empty and long texts, repeated rows, ties, near copies and shared runs of lines."""
    base = " ".join(words(300, 1))
    near = base.replace("w1", "w2", 1)
    lines = "\n".join(" ".join(words(6, i)) for i in range(100, 108))
    rows = [(i, " ".join(words(20 + 7 * i, i)), "en", f"s{i % 3}", 1) for i in range(2, 30)]
    rows += [(40, base, "en", "s0", 1), (41, base, "en", "s1", 1), (42, near, "en", None, 1), (42, near, "en", None, 1)]
    rows += [(50, lines, "fr", "s0", 1), (51, "x y z\n" + lines + "\nlast one", None, "s0", None), (52, lines, "fr", "s0", 1)]
    rows += [(60, "", "en", "s1", 0), (61, None, "en", "s1", None), (None, "alone\nwith\nno id", "de", "s2", 3), (62, " \t\n ", "de", "s2", 3),
             (63, " ".join(words(30_000, 9)), "en", "s0", 1), (64, "é" * 5000, "fr", "s0", 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).withColumns({c: F.lit(7) for c in ODD}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = tokens(text)
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


# --- components and SimHash


def classes(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    links += [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    expected = classes(range(300), [x for x in links if None not in x])
    assert {(r.node, r.root) for r in got.collect()} == {(n, r) for n, r in expected.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_documents(docs, empty, corpus):
    got = simhash.near_duplicates(docs).collect()
    prints = {(i, t): fingerprint(t) for i, t, *_ in corpus}
    links = [(a, b) for a, b in itertools.combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 2]
    root = classes(set(prints.values()), links)
    low = {}
    for (i, _), f in prints.items():
        low[root[f]] = min((x for x in (low.get(root[f]), i) if x is not None), default=None)
    expected = sorted((str(i), f, str(low[root[f]])) for i, f in ((i, prints[i, t]) for i, t, *_ in corpus))
    assert sorted((str(r.doc_id), r.f0 % 2**64, str(r.component_id)) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [1, 32])
def test_close_links_lose_no_component(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = random.Random(2)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for c in centres for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "f long")).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in links)
    close = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 2]
    assert classes(signed, [(r.a, r.b) for r in links]) == classes(signed, close)


def test_near_copies(docs, empty, corpus):
    left = near_copies.drop_near_copies(docs)
    assert left.columns == docs.columns and near_copies.drop_near_copies(empty).count() == 0
    ids = collections.Counter(r.doc_id for r in left.select("doc_id").collect())
    kept = set(range(2, 30)) | {40, 50, 60, 63, 64, None}  # 51 holds 50 and five more words
    assert set(ids) == kept and max(ids.values()) == 1


def jaccard_groups(texts):
    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    close = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(texts, 2)}
    root = classes(set(texts), [p for p, s in close.items() if s >= 0.8])
    low = {}
    for i in texts:
        low[root[i]] = min(low.get(root[i], i), i)
    return set(low.values()), [s for s in close.values() if 0.8 <= s < 1]


def near_copies_left(spark, texts):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in near_copies.drop_near_copies(table).collect()}


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_copies_in_crowded_keys(spark, monkeypatch, crowd):
    """Most of every text is one of two common passages, so that strangers stand with each pair wherever it meets."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    draw, texts = random.Random(8), {}
    passages = [words(240, 31, 5000), words(240, 32, 5000)]
    own = {}
    for i in range(160):
        own[i] = [f"own{i}x{j}" for j in range(70 + i % 9)]
        texts[i] = " ".join([*passages[i % 2], *own[i]])
    for i in range(60):
        mine = own[100 + i].copy()
        for _ in range(2 + i % 7):
            mine[draw.randrange(len(mine))] = f"new{draw.randrange(10**9)}"
        texts[200 + i] = " ".join([*passages[i % 2], *mine])
    expected, close = jaccard_groups(texts)
    assert near_copies_left(spark, texts) == expected and len(close) >= 30


def test_near_copies_of_one_passage_do_not_meet(spark, monkeypatch):
    """Texts 0.65 to 0.75 alike by a common passage, and a few of 0.9: candidates grow with the texts, not with their square."""
    met, likely = [], near_copies.likely
    monkeypatch.setattr(near_copies, "likely", lambda pairs, texts: met.append(pairs.distinct().count()) or likely(pairs, texts))
    passage, texts = words(160, 61, 10**6), {}
    for i in range(300):
        own = words(36 + i % 5, 7000 + i, 10**6)
        texts[i] = " ".join([*passage, *own])
        if i % 30 == 0:
            texts[1000 + i] = " ".join([*passage, *own[:-4], "some", "other", "end"])
    texts[2000] = " ".join(passage)
    texts |= {2001 + i: " ".join([*passage, *words(3 + i, 8000 + i, 10**6)]) for i in range(12)}
    expected, close = jaccard_groups(texts)
    assert near_copies_left(spark, texts) == expected and len(close) >= 20
    assert sum(met) < 10 * len(texts)


def test_suffix_tree_kernels():
    """Ids, rarer tokens and found codes agree with plain loops, with and without an id for the end."""
    texts = [[], [b"a"], [b"x", b"a", b"y", b"x"], [b"b", b"\xff"], []]
    for known in ({b"a": 1, b"b": 2}, {suffix_tree.END: 0, b"a": 1, b"b": 2}):
        x, first = suffix_tree.flatten(known, texts)
        tokens = [[suffix_tree.END, *words, suffix_tree.END] for words in texts]
        assert x.tolist() == [known.get(w, -1) for t in tokens for w in t] and first.tolist() == [0, 2, 5, 11, 15]
        plain = [collections.Counter(w for w in t[1:] if w not in known) for t in tokens]
        assert suffix_tree.rarer(x, first, texts) == plain
    codes, wanted = np.array([2, 5, 9, 1 << 60]), np.array([9, -1, 2, 3, 1 << 60, 9, 10])
    assert suffix_tree.find(codes, wanted).tolist() == [2, -1, 0, -1, 3, 2, -1]
    assert suffix_tree.find(codes, wanted[:0]).tolist() == [] and suffix_tree.find(codes[:0], wanted).tolist() == [-1] * 7


def test_near_copies_by_simhash(spark, monkeypatch):
    """SimHash alone finds a long text that differs in its last word; two bits do not stand for 0.8, which the texts decide."""
    monkeypatch.setattr(near_copies, "set_links", lambda nodes, texts, shingle, known: known)
    texts = {i: " ".join(words(2000, 40 + i, 10**6)) for i in range(3)}
    texts |= {10: texts[0] + " end", 11: texts[1], 12: "a b c d", 13: "a b c d e"}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3))[0] for i, t in texts.items()}
    assert ((prints[0] ^ prints[10]) % 2**64).bit_count() <= 2
    assert near_copies_left(spark, texts) == {0, 1, 2, 12, 13}


def test_workers_give_memory_back(spark):
    """A kernel starts without what another operator kept in the worker, and still hands on all its rows."""
    def fill(batches):
        common.kept_in_worker("other", 1, lambda: np.ones(10))
        yield from batches

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._KEPT)] * batch.num_rows, pa.int64())], names=["kept"])

    rows = spark.range(0, 100, 1, 1)
    assert rows.mapInArrow(common.tidy(fill, keeps=True), "id long").count() == 100
    assert {r.kept for r in rows.mapInArrow(common.tidy(left), "kept long").collect()} == {0}


def test_near_copies_by_bands(spark):
    """Pairs just above and just below 0.8, from 5 to 300 words, and texts that only a much repeated line makes alike."""
    draw, texts = random.Random(4), {}
    for i in range(240):
        text = words(draw.choice([9, 40, 64, 200, 300]), 1000 + i, 10**6)
        changed = text[: len(text) - max(1, round(len(text) * draw.uniform(0.02, 0.26)))]
        texts[2 * i], texts[2 * i + 1] = " ".join(text), " ".join(changed + words(draw.randrange(3), 2000 + i, 10**6))
    texts |= {1000 + i: "the same line again " * 300 + " ".join(words(60, 3000 + i, 10**6)) for i in range(6)}
    texts |= {1100 + i: " ".join(words(5, 4000 + i % 2, 10**6)) for i in range(4)}
    expected, close = jaccard_groups(texts)
    assert near_copies_left(spark, texts) == expected
    assert all(sum(lo <= s < lo + 0.05 for s in close) >= 15 for lo in (0.8, 0.85, 0.9))


# --- decontamination


def test_contained_items(spark, docs, empty, corpus):
    long = corpus[-2][1].split()
    items = [(1, " ".join(long[9000:9040])), (2, " ".join(long[20:29])), (3, "not in any of the documents at all"), (4, None), (5, ""),
             (6, "ALONE with"), (7, " ".join([*long[500:545], *words(5, 77, 9)])), (7, " ".join(long[20:29])), (None, "x y z"),
             (8, " ".join(long[i] for i in range(30)) + " " + " ".join(words(30, 78)))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    expected = []
    for (i, t, *_), (item, x) in itertools.product(corpus, items):
        want = set(shingles(x, min(5, len(tokens(x)))))
        have = shingles(t, min(5, len(tokens(x)))) if len(tokens(t)) >= min(5, len(tokens(x))) else []
        shared = want & set(have)
        if want and len(shared) >= 0.8 * len(want):
            expected.append((i, item, len(want), len(shared), len(shared) / len(want), min(have.index(s) for s in shared)))
    got = decontam.contained_items(docs, table)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected)) and len(expected) >= 5
    bad = collections.Counter((i, t) for i, t, *_ in corpus if not any(i == e[0] for e in expected))
    left = decontam.drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()) == bad
    assert decontam.contained_items(empty, table).count() == 0
    assert decontam.contained_items(docs, table.limit(0)).count() == 0


# --- mixing


def check_mix(rows, weights, blocks):
    slots = {}
    for r in rows:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots.setdefault(r.mix_slot, set()).add((r.source or "", r.mix_block))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    taken = dict.fromkeys(blocks, 0)
    for slot in range(len(slots)):
        (s, _), = slots[slot]
        taken[s] += 1
        assert all(abs(n - weights[x] * (slot + 1) / sum(weights.values())) < 1 for x, n in taken.items())
        if any(taken[x] == blocks[x] for x in blocks):
            break


def test_mix_keeps_all_and_stays_within_a_block(spark, docs, empty, corpus):
    rows = [(i, s) for s, n in (("a", 300), ("b", 90), ("c", 40), (None, 20)) for i in range(n)]
    mixed = pfair.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=8,
                      weights={"a": 4, "b": 3, "c": 2, "": 2}).collect()
    assert collections.Counter((r.doc_id, r.source) for r in mixed) == collections.Counter(rows)
    check_mix(mixed, {"a": 4, "b": 3, "c": 2, "": 2}, {"a": 38, "b": 12, "c": 5, "": 3})
    assert sorted(r.mix_place for r in mixed if r.source == "c") == sorted(i % 8 for i in range(40))
    whole = pfair.mix(docs)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.count() == len(corpus)
    assert pfair.mix(empty).count() == 0
    with pytest.raises(ValueError):
        pfair.mix(docs, weights={"s0": 1}).count()


def test_period_is_exact():
    for weights in ({"x": 1}, {"x": 5, "y": 3, "z": 9}, {str(i): 1 + i % 4 for i in range(17)}):
        taken = pfair.period_slots(weights)
        whole = sum(weights.values())
        assert sorted(itertools.chain(*taken.values())) == list(range(whole))
        for t in range(whole + 1):
            assert all(abs(sum(x < t for x in taken[s]) - w * t / whole) < 1 for s, w in weights.items())


# --- token output


def test_elias_fano_round_trip():
    draw = np.random.default_rng(3)
    for values in ([], [0], [5], [0, 0, 0], [7] * 1500, np.cumsum(draw.integers(0, 3000, 5000)), [1, 1 << 40]):
        code = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.encode(np.array(values, dtype=np.int64)).to_bytes())
        assert code.values().tolist() == list(values)
        assert [code.select(i) for i in range(0, len(values), 97)] == list(values)[::97]
        for i in range(0, len(values), 301):
            assert code.select_range(i, min(len(values), i + 700)).tolist() == list(values)[i : i + 700]
        if len(values) > 1000:
            assert len(code.to_bytes()) * 8 / len(values) < 3.5 + math.log2(max(2, values[-1] / len(values)))
    with pytest.raises(ValueError):
        elias_fano.EliasFano.encode(np.array([3, 2]))


def test_token_files(spark, docs, empty, corpus, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe)
    path = str(tmp_path / "t")
    elias_fano.write_segments(docs, path, bpe, segment_ids=2000)
    got = sorted(map(tuple, elias_fano.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert spark.read.parquet(path).count() > 5
    start, key = 0, lambda r: (r[0] is not None, r[0] or 0)
    assert [key(r) for r in got] == sorted(map(key, corpus))
    by_id = collections.defaultdict(collections.Counter)
    for i, t, *_ in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        by_id[i][len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for i, begin, n, crc in got:
        assert begin == start and by_id[i][n, crc] > 0
        by_id[i][n, crc] -= 1
        start += n
    some = elias_fano.read_ids(spark, path, [5, 42, 61, 63, 12345]).collect()
    assert sorted(r.doc_id for r in some) == [5, 42, 42, 61, 63]
    starts = {(r[0], r[1]) for r in got}
    for r in some:
        assert (r.doc_id, r.start) in starts
        assert r.ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus if i == r.doc_id]
    assert elias_fano.read_ids(spark, path, []).count() == 0
    elias_fano.write_segments(empty, str(tmp_path / "e"), bpe)
    assert elias_fano.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_chunks_encode_like_whole_texts(monkeypatch):
    monkeypatch.setattr(elias_fano, "CACHED", 300)
    rule = open(bpe, encoding="utf-8").read()
    encoder = elias_fano.ChunkEncoder(rule)
    assert encoder.by_space
    draw = random.Random(1)
    parts = ["a", "B", " ", " word", " others,", " two.\nLines", "  ", "\n", "\t", "é", " été", " слово.", " e\u0301", "'s", "1", ".", "...",
             "<|endoftext|>", "\xa0", "\u2003", "\x85", "\x1c", "日", "\0", "ing", "\r\n", " the"]
    for _ in range(5):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(1500)]
        for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.numbers) == encoder.count == 300 and list(encoder.encode(pa.array([], pa.string()))) == []
    other = json.loads(rule)
    other["pre_tokenizer"]["add_prefix_space"] = True  # another splitting rule: whole texts
    encoder = elias_fano.ChunkEncoder(json.dumps(other))
    assert not encoder.by_space
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# --- suffix tree


def test_suffix_tree(spark, empty):
    draw = random.Random(8)
    chorus = "the quick brown fox jumps over the lazy dog again and again".split()
    rows = []
    for i in range(300):
        body = words(25, i, 60)
        at = draw.randrange(20)
        rows.append((i, " ".join(body[:at] + chorus + body[at:])))
    rows += [(301, None), (None, "the quick"), (302, ""), (303, "unheard " + "z" * 5000), (5, rows[5][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    got = suffix_tree.score(table).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    seen = collections.Counter(w for i, t in rows if not held[i] for w in [*tokens(t), b"\n"])
    total, kinds = sum(seen.values()), len(seen)
    expected = collections.Counter()
    for i, t in rows:
        toks = [*tokens(t), b"\n"]
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in toks)
        expected[i, held[i], len(toks), sum(w in seen for w in toks), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    out = [r for r in got if r.held_out and r.n_tokens > 30]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.8
    assert suffix_tree.score(empty).count() == 0


def test_suffix_tree_is_a_distribution(spark):
    text = " ".join(words(4000, 3, 5)) + " a b c" * 200
    train = spark.createDataFrame([(text,)] * 3, "t string").select(F.col("t").cast("binary").alias("_text"))
    vocab = suffix_tree.count_words(train)
    total, kinds = vocab.agg(F.sum("n"), F.count("*")).first()
    tree = suffix_tree.learn(vocab, train, total, kinds)
    ids = tree.ids()
    assert any(tree.keep[d].any() for d in tree.keep)
    for history in ("a", "a b", "b c", "w1 w2", "c a b"):
        mass = 0.5 / (total + 0.5 * (kinds + 1))  # the one word never seen
        x, first = suffix_tree.flatten(ids, [[*history.encode().split(), b"never"]])
        mass = 10 ** (math.log10(mass) + suffix_tree.gains(tree, x, first)[1][-2])
        for w in tree.words:
            x, first = suffix_tree.flatten(ids, [[*history.encode().split(), w]])
            mass += 10 ** suffix_tree.gains(tree, x, first)[1][-2]
        assert mass == pytest.approx(1)


# --- graph search


def test_graph_search(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(8, 12))
    data = (centres[draw.integers(0, 8, 1500)] + 0.5 * draw.normal(size=(1500, 12))).astype(np.float32)
    data[100:400] = data[99]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    extra = [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (5060, [None] * 12), (None, data[3].tolist()), (5080, []),
             (5100, [1.0, 2.0]), (5101, [3.0, 1.0]), rows[7]]
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = graph_search.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=600).toPandas()
    exact, found = data.astype(np.float64), 0
    assert set(got.query_id) == {*range(0, 1500, 20), 5100}
    for query, part in got[got.query_id < 1500].groupby("query_id"):
        scores = exact @ exact[query]
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != query][:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and query not in set(part.vec_id)
        assert np.allclose(part.score, scores[part.vec_id])
        assert part[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        found += len(set(order) & set(part.vec_id))
    assert found >= 0.95 * 20 * 75
    assert got[got.query_id == 5100][["rank", "vec_id", "score"]].values.tolist() == [[1, 5101, 5.0]]
    assert graph_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("lengths", ["unit", "gaussian", "log-normal"])
def test_graph_search_recall_by_lengths(spark, lengths):
    """At least 0.9 of the exact neighbours are found, whatever the lengths of the vectors, and most by graphs where they help."""
    draw = np.random.default_rng(3)
    data = draw.normal(size=(3000, 64))
    if lengths != "gaussian":
        data /= np.linalg.norm(data, axis=1, keepdims=True)
    if lengths == "log-normal":
        data *= draw.lognormal(size=(3000, 1))
    data = data.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = graph_search.nearest(table, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    exact = data.astype(np.float64)
    scores = exact[::50] @ exact.T
    scores[np.arange(60), np.arange(0, 3000, 50)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    found = got.vec_id.to_numpy().reshape(60, 20)
    recall = np.mean([len(set(a) & set(b)) for a, b in zip(want.tolist(), found.tolist(), strict=True)]) / 20
    print(lengths, recall)
    assert recall >= 0.9


# --- line dedup


def removed_lines(rows, window=2, long_words=50):
    seen, out = set(), {}
    for key in sorted({(i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (
            xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), t or "") for i, t in rows}):
        lines, gone = key[3].split("\n"), set()
        for at in range(len(lines) - window + 1):
            part = tuple(lines[at : at + window])
            if any(x.strip(" ") for x in part):
                if part in seen:
                    gone |= set(range(at, at + window))
                seen.add(part)
        for at, line in enumerate(lines):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= long_words:
                if ("", line) in seen:
                    gone.add(at)
                seen.add(("", line))
        out[key[0] and key[1] if key[0] else None, key[3]] = gone
    return out


def test_line_dedup(docs, empty, corpus):
    got = winnow.without_repeats(docs).select("doc_id", "text", "kept_text", "n_lines", "n_removed", "removed_runs").collect()
    gone = removed_lines([(i, t) for i, t, *_ in corpus])
    assert len(got) == len(corpus)
    for r in got:
        lines, out = (r.text or "").split("\n"), gone[r.doc_id, r.text or ""]
        assert r.kept_text == "\n".join(x for n, x in enumerate(lines) if n not in out)
        assert (r.n_lines, r.n_removed) == (len(lines), len(out))
        runs = [range(int(a), int(b) + 1) for a, b in (x.split("-") for x in r.removed_runs.split(",") if x)]
        assert sorted(itertools.chain(*runs)) == sorted(out)
    assert sum(r.n_removed for r in got) >= 16
    assert winnow.without_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [1, 3])
def test_line_dedup_windows(spark, window):
    draw = random.Random(window)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "", " ", "d"]) for _ in range(draw.randrange(1, 12)))) for i in range(60)]
    got = winnow.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    gone = removed_lines(rows, window, 10**9)
    assert all(r.n_removed == len(gone[r.doc_id, r.text]) for r in got)


def test_single_long_lines(spark):
    """A long line between differing lines, whole documents of one line, and lines one word too short."""
    line, short = " ".join(words(80, 1)), " ".join(words(49, 2))
    rows = [(1, line), (2, line), (3, f"a\n{line}\nb"), (4, f"c\n{line}  \nd\n{line}"), (5, f"x\n{short}\ny"), (6, f"z\n{short}\nw"),
            (7, f"p\n{short}\tend\nq"), (8, f"r\n{short}\tend\ns"), (9, f"a\n{line}")]
    got = {r.doc_id: r for r in winnow.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = removed_lines(rows)
    assert {i: r.n_removed for i, r in got.items()} == {i: len(gone[i, t]) for i, t in rows} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1, 9: 2}
    assert got[3].kept_text == "a\nb" and got[4].removed_runs == "3-3" and got[2].kept_text == ""
    few = winnow.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), long_words=49).collect()
    assert {r.doc_id: r.n_removed for r in few}[6] == 1


# --- licences


def test_license_scan(spark, docs, empty, corpus):
    filler = " ".join(words(80, 5))
    rows = [(1, "Released UNDER the  MIT License. " + filler), (2, filler + " Apache License, Version 2.0; under the mit\nlicense"),
            (3, "CC BY-NC 4.0, CC-BY nc"), (4, filler + "\nThis work is licensed under the GNU General Public License, version 3."),
            (5, "the general public version of a license"), (6, None), (7, "under the MIT Kelvin K license É"), (7, "CC BY 4.0"),
            (None, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction")]
    rows += [(i, " ".join(words(40, i))) for i in range(100, 400)]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = pattern.findall(low)
        places = sorted((label, at) for label, phrase, _ in licenses.BASE for at in range(len(w))
                        if w[at : at + len(phrase.split())] == phrase.split())
        assert sorted((p.label, p.word) for p in got[i, len(w)].places) == places
    found = {i: sorted(r.found) for (i, _), r in got.items() if r.found}
    assert found[4] == ["gpl-3"] and found[None] == ["mit"] and "apache-2" in found[2] and 5 not in found
    assert [r.coverage for (i, _), r in got.items() if i == 4] == [1.0]
    assert licenses.scan(docs).count() == len(corpus) and licenses.scan(empty).count() == 0


def test_standard_headers(spark):
    """The headers as projects ship them, identifiers, and a notice with words put in."""
    foundation = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published "
                  "by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    rows = {
        "gpl-3": foundation.format("program", "", "3"), "lgpl-2.1": foundation.format("library", "Lesser ", "2.1"),
        "gpl-2": foundation.format("really nice program of ours", "", "2").replace("any later", "(and this we like best) any later"),
        "agpl-3": foundation.format("program", "Affero ", "3"),
        "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at x",
        "bsd": "// SPDX-License-Identifier: BSD-3-Clause", "mpl-2": "# SPDX-License-Identifier: MPL-2.0",
        "apache-2": "SPDX-License-Identifier: Apache-2.0 OR nothing", "mit": "/* SPDX-License-Identifier: MIT */",
        "none": "the terms of the general public, either version 4 of the software; license identifier: 3.0",
    }
    filler = " ".join(words(60, 8))
    table = [(name, f"{filler}\n{text}\n{filler}") for name, text in rows.items()]
    found = {r.doc_id: r.found for r in licenses.scan(spark.createDataFrame(table, "doc_id string, text string")).collect()}
    assert found == {name: [] if name == "none" else [name] for name in rows}


@pytest.mark.parametrize("size, share", [(30, 2), (200, 100)])
def test_licences_in_many_files(spark, size, share):
    """Notices in a large share of the files, and a file of several notices among other licence words."""
    notice = {label: text for label, text, _ in licenses.TEMPLATES}
    rows = [(i, " ".join(words(40, i)) + " " + (notice["gpl-3"] if i < share else "")) for i in range(size)]
    many = ["bsd", "isc", "lgpl-3", "mpl-2", "cc0", "unlicense", "epl-2", "gpl-3"]
    stray = "dedication mozilla eclipse domain affero unencumbered universal documentation conditions redistribution "
    rows += [(1000, stray.join(notice[x] + " " for x in many)), (1001, stray * 3 + notice["agpl-3"] + " " + stray)]
    found = {r.doc_id: sorted(r.found) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: ["gpl-3"] if i < share else [] for i in range(size)} | {1000: sorted(many), 1001: ["agpl-3"]}


# --- secrets


def plain_findings(text):
    out = [("assign", *m.span()) for m in re.finditer(
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda f: (f[1], secrets.KINDS.index(f[0])))


def test_touched_and_frames():
    draw = random.Random(2)
    spans = sorted((a, a + draw.randint(1, 9)) for a in draw.choices(range(300), k=60))
    found = sorted((a, a + draw.randint(1, 30)) for a in draw.choices(range(300), k=12))
    for some in (found, [], found[:1]):
        assert secrets.touched(spans, some) == [any(a < j and i < b for a, b in some) for i, j in spans]
    for n in (15, 16, 48, 49, 72, 73, 400):
        token = "".join(draw.choices("abcXYZ019", k=n))
        frames = list(secrets.candidates(f"see {token} there"))
        assert {x for i, j, _ in frames for x in range(i, j)} == (set(range(4, 4 + n)) if n >= 16 else set())
        assert all(p[secrets.LEFT :][: j - i] == token[i - 4 : j - 4] and len(p) == secrets.SPAN and j - i <= secrets.BODY for i, j, p in frames)
        assert all(a[0] < b[0] < a[1] for a, b in itertools.pairwise(frames))


def test_many_findings_in_one_text(spark):
    """Labelling is linear in the findings of a text."""
    text = " ".join(f"token={'ab12cd34' * 3}{i}" for i in range(16_000))
    base, long = secrets.base_findings(text), list(secrets.candidates(text))
    began = time.perf_counter()
    labels = secrets.touched([t[:2] for t in long], [f[1:] for f in base])
    assert time.perf_counter() - began < 1 and all(labels) and len(base) >= 16_000


def test_secret_scan(spark, docs, empty, corpus):
    draw = random.Random(5)
    hexa = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, " ".join(words(30, i)) + f" é {draw.choice(['token', 'PASSWORD', 'api_key'])} = \"{hexa(40)}\" and so on") for i in range(80)]
    rows += [(i, f"long {draw.choice(['internationalisation', 'counterrevolutionary', 'uncharacteristically'])}{draw.choice('abcdefgh')}"
                 f"{draw.choice('stuvwxyz')} word {' '.join(words(9, i))}") for i in range(100, 300)]
    rows += [(400, "Passwd: abc, secret: 'a.b=c/d+', AKIA" + "Q7" * 8 + " x"), (401, None), (None, hexa(24)), (402, "ſecret=abcdefgh toKen=12"),
             (403, "auth " + hexa(40).upper() + " end"), (404, "a" * 200_000), (400, "token=1")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))).collect()
    expected = collections.Counter((i, tuple(plain_findings(t or ""))) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind != "model")) for r in got) == expected
    model = {r.doc_id for r in got if any(s.kind == "model" for s in r.spans)}
    assert not model & set(range(100, 300))
    assert secrets.find_secrets(docs).count() == len(corpus) and secrets.find_secrets(empty).count() == 0


def test_network_learns_and_keeps_recall():
    draw = random.Random(3)
    found = ["".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    other = ["".join(draw.choice(["th", "er", "on", "an", "re"]) for _ in range(12)) for _ in range(300)]
    pictures = [p for t in found + other for _, _, p in secrets.candidates(f"some text {t} follows")]
    x, y = secrets.encode(pictures), np.array([1] * 300 + [0] * 300)
    test = np.arange(600) % 3 == 0
    net = secrets.CharNet().fit(x[~test], y[~test]).calibrate(x[test], y[test])
    p = net.probabilities(x[test]) >= net.threshold
    assert p[y[test] == 1].mean() >= 0.98 and p[y[test] == 0].mean() <= 0.02


def test_network_is_trained_on_every_token(spark, monkeypatch):
    """Beyond what one place takes, gradients and the threshold come from all tokens where they lie."""
    monkeypatch.setattr(secrets, "BATCHES", 4)
    draw = random.Random(4)
    found = ["".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(400)]
    other = ["".join(draw.choice(["th", "er", "on", "an", "re"]) for _ in range(12)) for _ in range(400)]
    rows = [(p, y) for y, some in ((1, found), (0, other)) for t in some for _, _, p in secrets.candidates(f"some text {t} follows")]
    tokens = spark.createDataFrame(rows, "picture string, label int").repartition(3)
    x, y = secrets.encode([p for p, _ in rows]), np.array([y for _, y in rows])

    table = secrets.token_table(tokens)
    assert table.count() == len(rows) and table.select("batch").distinct().count() == 4
    net = secrets.CharNet()
    sums, n = secrets.gradient_sum(table, net, (2.0, 0.5))
    both, labels = np.concatenate([x, secrets._blanked(x)]), np.concatenate([y, y])
    whole = net._gradients(both, labels, np.where(labels == 1, 2.0, 0.5))
    assert n == 2 * len(rows) and all(np.allclose(sums[k] / n, whole[k]) for k in whole)

    values = [draw.choice([draw.gauss(0, 1), 0.5, 1e9]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(secrets.kth_smallest(frame, "v", k, 20) == sorted(values)[k] for k in (0, 10, 250, 499))

    read = tokens.select(F.array(F.struct("picture", "label")).alias("tokens"))
    net = secrets.train(read, driver_tokens=100)
    passed = net.probabilities(x) >= net.threshold
    assert passed[y == 1].mean() >= 0.97 and passed[y == 0].mean() <= 0.03


# --- language


def test_language(spark, docs, empty, corpus):
    kinds = {"en": ["the", "and", "of", "with", "thing"], "de": ["der", "und", "nicht", "über", "schön"], "fr": ["le", "et", "où", "avec", "très"]}
    draw = random.Random(7)
    text = lambda k, n: " ".join(draw.choice(kinds[k]) for _ in range(n))
    labelled = spark.createDataFrame([(text(k, 60), k) for k in kinds for _ in range(30)] + [("x", None), (None, "en")], "text string, lang string")
    profiles = langid.learn_profiles(labelled)
    rows = [(i, f"<html lang=\"{k}\"><head><script>var und = 1</script></head><body>{text(k, 12)}</body></html>", f"http://a{i}.{k}host.org/x")
            for i, k in enumerate(list(kinds) * 20)]
    rows += [(100, "<html><body>12 34</body></html>", "http://a.enhost.org/"), (101, None, None), (102, f"<p>{text('de', 9)}</p>", "not a url"),
             (102, f"<p>{text('de', 9)}</p>", "http://1.dehost.org")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("ll", F.lit(2))
    got = langid.identify(pages, profiles, ["page_id", "ll"], F.col("html"), langid.host_of(F.col("url")), langid.declared_in(F.col("html")), markup=True)
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.page_id].append(r.language)
    assert all(found[i] == [k] for i, k in enumerate(list(kinds) * 20))
    assert found[100] == found[101] == ["und"] and found[102] == ["de", "de"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in corpus if any(c.isalpha() for c in t or "")}
    assert langid.keep_identified(empty).count() == 0


def test_unknown_languages_are_rejected(spark):
    """Foreign texts and letter junk are of no language, whatever is declared; short clean texts stay."""
    syllables = {"en": "th er on an re he in ed nd ha", "de": "sch ei ung ich der en be ge au st", "es": "que ci ón de la ar os es ad per"}
    draw = random.Random(3)

    def text(k, n):
        return " ".join("".join(draw.choices(syllables[k].split(), k=draw.randint(1, 4))) for _ in range(n))

    labelled = spark.createDataFrame([(text(k, 80), k) for k in syllables for _ in range(60)], "text string, lang string")
    strange = ["Tämä on suomenkielinen teksti joka kertoo pitkästä talvesta ja kesästä järven rannalla missä ihmiset viettävät aikaa",
               "これは日本語の文章です。長い冬と短い夏について書かれています。", "Это русский текст о долгой зиме и коротком лете у озера",
               "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=200)), "qwzx " * 40]
    rows = [(i, t, draw.choice(list(syllables)), "h.org") for i, t in enumerate(strange)]
    rows += [(100 + i, text(k, n), k, "h.org") for i, (k, n) in enumerate([(k, n) for k in syllables for n in (1, 2, 5, 30, 300)])]
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = langid.identify(table, langid.learn_profiles(labelled), ["id"], F.col("text"), F.col("host"), F.col("declared"))
    found = {r.id: r.language for r in got.collect()}
    assert all(found[i] == "und" for i in range(len(strange))) and all(found[r[0]] == r[2] for r in rows if r[0] >= 100)
    nothing = langid.learn_profiles(labelled.where("false"))
    assert {r.language for r in langid.identify(table, nothing, ["id"], F.col("text")).collect()} == {"und"}


def test_evidence_decides_a_short_text(spark):
    """A text of one shared letter follows its declared language and host."""
    labelled = spark.createDataFrame([("aa bb cc " * 20, "x"), ("aa dd ee " * 20, "y")] * 20, "text string, lang string")
    rows = [(i, "bb cc" if i % 2 else "dd ee", "x" if i % 2 else "y", f"h{i % 2}.org") for i in range(60)] + [(100, "aa", "x", "h1.org"), (101, "aa", "y", "h0.org")]
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = langid.identify(table, langid.learn_profiles(labelled), ["id"], F.col("text"), F.col("host"), F.col("declared"))
    found = {r.id: (r.language, r.confidence) for r in got.collect()}
    assert found[100][0] == "x" and found[101][0] == "y" and min(found[100][1], found[101][1]) > 0.9
