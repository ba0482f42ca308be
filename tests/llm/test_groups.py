"""Packing, the conversation trie and clustering against plain versions."""
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawdown.llm import clusters as C, packing as P, trie as R


def plain_clusters(rows, dims, k, rounds, scale=64):
    """Python integers throughout."""
    sound = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(sound, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    now = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in sound]
        now = [[sum(c) // len(c) for c in zip(*members)] if (members := [q for (_, q), a in zip(sound, at) if a == n]) else c for n, c in enumerate(now)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in sound), key=str), now


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, .2) for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, [float(rng.randint(-2, 2)) / 64 for _ in range(5)]) for i in range(200)]  # ties
    rows += [(900, None), (901, []), (902, [.1] * 4), (903, [.1] * 6), (904, [None, .1, .1, .1, .1]), (905, [float("nan")] * 5), (906, [float("inf"), 0., 0., 0., 0.]), (None, [.5] * 5), (None, [.25] * 5),
             (7, rows[7][1]), (7, [.75] * 5), (907, [3e5, 0., 0., 0., -3e5]), (908, [1e7, 1., 1., 1., 1.])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    for k, width in ((6, 2), (1, 5), (600, 3)):
        found, centroids = C.cluster(df, dims=5, k=k, width=width)
        want, plain = plain_clusters(rows, 5, k, 3)
        assert centroids == plain and sorted(map(tuple, found.collect()), key=str) == want
    none, centroids = C.cluster(df.filter("vec_id = 901"), dims=5)
    assert none.columns == ["vec_id", "cluster", "distance"] and none.count() == 0 and centroids == []


def test_distances_that_leave_64_bits():
    entries, codes = C.encode(np.array([[C.MOST, 1, 0], [-C.MOST, 0, 0], [5, 5, 5]]), 2)
    best, far = C.nearest(entries, codes, np.array([[5, 5, 4], [C.MOST, 0, 0]]))
    assert best.tolist() == [1, 0, 0] and far.tolist() == [1, C.FAR, 1]


def test_packing(spark):
    rng = random.Random(5)
    words = ["alpha", "Bär", "  two", "\n\n", "123", "<|endoftext|>", "it's", "漢字", "🙂", "x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200, 900]))) for _ in range(150)] + [None, "", "", "end <|endoftext|>", " ", "a b  ", "long " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id"), (None, "null id")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, ids long").repartition(2)
    tokenizer = Tokenizer.from_file(P.TOKENIZER)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for capacity, window in ((1024, P.WINDOW), (64, 5000)):
        got = P.pack(df, capacity=capacity, window=window).collect()
        sequences, docs = defaultdict(list), defaultdict(list)
        for r in got:
            assert len(r.ids) == 4 * r.length > 0
            sequences[r.sequence_id].append(r)
            docs[r.doc_id].append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
        for held in sequences.values():
            at = 0
            for r in sorted(held, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= capacity and at & (at - 1) == 0  # nothing is padded
            assert len({r.sequence_cost for r in held}) == 1 and held[0].sequence_cost == sum(P.LINEAR * r.length + P.QUADRATIC * r.length ** 2 for r in held)
        for i, whole in want.items():
            pieces = sorted(docs[i])
            assert sum(len(p[2]) for p in pieces) == sum(map(len, whole))
            if len(whole) == 1:
                assert [t for p in pieces for t in p[2]] == whole[0] and all(p[1] == len(whole[0]) for p in pieces)
        assert set(docs) == set(want)
    assert P.pack(df.limit(0)).count() == 0
    row = P.pack(df).filter("doc_id = 5").withColumn("c", F.crc32("ids")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_dealing_prefers_the_cheapest_sequence_with_room():
    pieces, cost = P.deal(np.array([30, 30, 20, 20, 14, 14]), 64)
    assert pieces == [(0, 0, 30, 0, 0), (1, 0, 30, 1, 0), (2, 0, 20, 0, 30), (3, 0, 20, 1, 30), (4, 0, 14, 0, 50), (5, 0, 14, 1, 50)] and cost[0] == cost[1]
    pieces, _ = P.deal(np.array([60, 60, 8]), 64)
    assert pieces == [(0, 0, 60, 0, 0), (1, 0, 60, 1, 0), (2, 0, 4, 0, 60), (2, 4, 4, 1, 60)]  # cut where no sequence has room for all of it
    assert P.rooms(777, 256) == [256, 256, 256, 8, 1]


def plain_trie(rows):
    turns = defaultdict(list)
    for c, no, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((no is not None, no or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        head = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:head] + own[head:])
    members, children = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[:d - 1]].add(p[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie(spark, monkeypatch):
    """Null and clashing columns, ties, repeated rows, missing families, and conversations of one or many segments."""
    rng = random.Random(2)
    rows = []
    for c in [*range(45), -3, -20, 1000, 2000, 10 ** 17]:
        base = rng.randint(0, 2)
        rows += [(c, rng.choice([i, i, i, None]), rng.choice(["user", None, "a"]), rng.choice(["", None, "hi there", "x  y\tz", f"b{base} {i}"])) for i in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))]
    for c in (3, 20, 23, 24, 41):
        rows += [(c, i, "u", f"w{i} x") for i in range(rng.choice([63, 64, 65, 70, 70]))]
    rows += [(None, 1, "a", "b"), (5, 1, "a", "b"), (5, 1, "a", "b")]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(5)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = plain_trie(rows)
    for segment, shard in ((1024, 1 << 16), (8, 20), (1, 3)):
        monkeypatch.setattr(R, "SEGMENT", segment)
        monkeypatch.setattr(R, "SHARD", shard)
        assert sorted(map(tuple, R.trie(df).select(columns).collect()), key=str) == want
    assert R.trie(df.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    table = R.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert ((R.PerfectHash(keys[:1]).slots(keys) == 0) | (R.PerfectHash(keys[:1]).slots(keys) == -1)).all()
