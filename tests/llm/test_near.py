"""Lines, fingerprints, components and repeated strings against plain versions."""
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from drawdown.llm import components as G, lines as L, simhash as H, suffixes as S


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 4)):
        i, k = rng.randint(0, len(s)), rng.random()
        if k < .4:
            s.insert(i, rng.choice("abé"))
        elif i < len(s) and k < .7:
            del s[i]
        elif i < len(s):
            s[i] = rng.choice("abé")
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(4)
    for edits in (1, 2, 3):
        rows = [(a, changed(rng, a)) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 25))) for _ in range(500))]
        got = {(r.a, r.b) for r in L.within(spark.createDataFrame(rows, "a string, b string"), edits).collect()}
        assert got == {(a, b) for a, b in rows if edit(a, b) <= edits}


def test_line_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(14, 40))) for _ in range(30)]
    rows = [(i, "\n".join(changed(rng, rng.choice(base)) for _ in range(rng.randint(0, 5)))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, place int")
    first, seen = {}, []
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= 16:
                seen.append((i, p, line))
                first.setdefault(line, (i, p))
    near = {a: [b for b in first if a != b and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2] for a in first}
    gone = {(i, p) for i, p, line in seen if first[line] != (i, p) or any(first[m] < first[line] for m in near[line])}
    links = {}
    for i, _, line in seen:
        links[i] = links.get(i, 0) + len(near[line])
    out = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert L.dedup_lines(df).columns == df.columns and any(near.values())
    for i, t in rows:
        assert out[i] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone))
    found = {r.doc: r.n_links for r in L.removals(df).collect()}
    assert all(found.get(i, 0) == n for i, n in links.items())
    assert L.dedup_lines(df.limit(0)).count() == 0
    # rows with one id and text are one place; null ids come first
    twice = spark.createDataFrame([(1, "the very same line of text"), (1, "the very same line of text"), (None, "the very same line of text")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in L.dedup_lines(twice).collect()) == [("1", ""), ("1", ""), ("None", "the very same line of text")]


def test_short_lines_that_repeat_exactly_go(spark, tmp_path):
    rows = [(1, "Home\nalpha\n\nthe first long line of text"), (2, "Home\nHone\n\nx"), (3, "x\nthe first long line of texts\nHome\nHome")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: "Hone\n\nx", 3: ""}
    assert {r.doc_id: r.text for r in L.dedup_lines(df, exact=L.EXACT).collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_judged, r.n_exact, r.n_near, r.removed) for r in L.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, 0, ""), 2: (3, 1, 0, "0"), 3: (4, 3, 1, "0,1,2,3")}


def test_lines_of_one_template(spark, monkeypatch):
    """Lines that share most of their text are linked only where they are near, whether their common pieces count as hot or not."""
    rng = random.Random(11)
    lines = ["Order shipped to depot: %012d" % rng.choice([rng.randrange(10 ** 12), rng.randrange(100)]) for _ in range(150)]
    lines += ["".join(rng.choice(["", c, c, c, c, c, c, "é"]) for c in x) for x in rng.sample(lines, 60)] + ["Order shipped to depot:" + x for x in ("", " 7", " 8", "  9")]
    lines = sorted({x for x in lines if len(x) >= 16})
    want = {(x, y) for x in lines for y in lines if x < y and abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    of = {r.key: r.line for r in L.judged(df, "doc_id", "text", 16).collect()}
    for hot in (1024, 4):
        monkeypatch.setattr(L, "HOT", hot)
        got = L.near_lines(L.judged(df, "doc_id", "text", 16), 2).collect()
        assert {tuple(sorted((of[r.a], of[r.b]))) for r in got} == want and len(got) == len(want) > 20


def test_line_classes_and_clashing_names(spark, tmp_path):
    rows = [(5, "alpha beta gamma delta 1\nHome"), (2, "alpha beta gamma delta 22\nunlike all the others here"), (9, "alpha beta gamma delta 22\nHome"), (None, "Home")]
    df = spark.createDataFrame([(i, t, "k", 3, 4, 5) for i, t in rows], "doc_id long, text string, __key string, gone int, doc int, mark int")
    got = L.dedup_lines(df, exact=1)
    assert got.columns == df.columns and {(r.doc_id, r.text, r["__key"], r.gone, r.doc, r.mark) for r in got.collect()} == {
        (None, "Home", "k", 3, 4, 5), (2, rows[1][1], "k", 3, 4, 5), (5, "", "k", 3, 4, 5), (9, "", "k", 3, 4, 5)}
    classes = {r.doc: [(c["place"], c["class"]) for c in r.classes] for r in L.removals(df, exact=1).collect()}
    assert classes == {None: [(0, None)], 2: [(0, 2)], 5: [(0, 2), (1, None)], 9: [(0, 2), (1, None)]}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.classes for r in L.op1_line_dedup(spark, str(tmp_path)).collect()} == {None: "0:", 2: "0:2", 5: "0:2,1:", 9: "0:2,1:"}


def plain_fp(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "Ünder", "x", "y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(250)] + [None, "", "\u00a0"]
    fps = [plain_fp(t or "") for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(top(i), top(j))] = min(top(i), top(j))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in H.near_duplicates(df).collect()}
    assert got == {i: (fps[i], top(i)) for i in range(len(texts))}
    kept = H.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {top(i) for i in range(len(texts))}
    assert H.near_duplicates(df.limit(0)).count() == 0
    h = spark.createDataFrame([("alpha beta gamma",)], "s string").select(F.xxhash64("s")).first()[0]
    assert h & (1 << 64) - 1 == plain_fp("alpha beta gamma")


def test_one_row_of_a_group_stays(spark):
    """Rows are judged, not ids: null and repeated ids, repeated rows, and names of helper columns."""
    rows = [(5, "a b c d e f"), (7, "a b c d e f"), (5, "quite another text is this"), (5, "quite another text is this"), (None, "a b c d e f"), (None, "only null ids have these words"), (None, "only null ids have these words"), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, k, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __gone int, fp int, mark int, c0 int")
    kept = H.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "a b c d e f"), (5, "quite another text is this"), (None, "only null ids have these words"), (8, None)], key=str)
    assert H.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def test_suffix_order_and_runs():
    rng = random.Random(9)
    for _ in range(120):
        data = np.array([rng.choice([97, 98]) for _ in range(rng.randint(1, 200))], np.uint8)
        depth, b = rng.choice([8, 16, 40, 64]), data.tobytes()
        order = S.suffix_order(data, depth).tolist()
        assert [b[i:i + depth] for i in order] == sorted(b[i:i + depth] for i in range(len(b))) and sorted(order) == list(range(len(b)))
    for _ in range(120):
        n, base = rng.choice([10, 12, 20]), bytes(rng.choice(b"ab") for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 8)):
            x = bytearray(base[rng.randint(0, 20):])
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = 99
            texts.append(bytes(x))
        places = np.array([rng.randint(1, len(x) - n + 1) for x in texts])
        got, want = {}, {}
        for a, b, c in zip(*(x.tolist() for x in S.runs_of(texts, places, n))):
            got.setdefault(c, set()).add((a, b))
        for k, t in enumerate(texts):
            for p in range(places[k]):
                want.setdefault(t[p:p + n], set()).add((k, p))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def plain_repeats(texts, n):
    count = {}
    for t in texts:
        for p in range(len(t) - n + 1):
            count[t[p:p + n]] = count.get(t[p:p + n], 0) + 1
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if count[t[p:p + n]] > 1:
                gone[p:p + n] = True
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])


def test_repeated_strings(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé ") for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(100):
        x = ""
        for _ in range(rng.randint(0, 4)):
            k, c = rng.random(), rng.choice(base)
            if k < .3:
                a = rng.randint(0, 60)
                c = c[a:a + rng.randint(5, 60)]
            elif k < .5:
                c = "".join(rng.choice("abcé ") for _ in range(30))
            elif k < .6:
                c = rng.choice(["ab", "a", "xyz"]) * rng.randint(1, 60)
            x += c
        rows.append(x if i % 17 else None)
    rows += [*rows[:5], ""]
    want = list(plain_repeats([(t or "").encode() for t in rows], 40))
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, kept string")
    for per, size in ((2, 300), (512, 1 << 19)):  # split over shards, and not
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, length=40, gram=8, per_shard=per, shard_bytes=size).collect()}
        assert [got[i] for i in range(len(rows))] == want
    assert S.remove_repeats(df.limit(0), length=40, gram=8).count() == 0
    same = spark.createDataFrame([(None, base[0])] * 2 + [(1, base[1])], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.remove_repeats(same, length=40, gram=8).collect()) == [0, len(base[0].encode()), len(base[0].encode())]
