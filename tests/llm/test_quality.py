"""URL model, classifier, quality rules and the pipeline."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from drawdown.llm import decontaminate as D, quality as Q, rules as R, urlmodel as U
from drawdown.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host):]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), next((path[:i] for i, c in enumerate(path) if c in "?#"), path)


def plain_rule(host, path):
    fits = [r for r, _ in U.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_url_rules_and_model(spark):
    rng = random.Random(1)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'a.', ''])}{rng.choice(['good', 'spam', 'Shop'])}{rng.randint(0, 99)}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(0, 999)}" for _ in range(400)]
    odd = [None, "", "no scheme", "://", "http://", "HTTP://A.Com", "http://a.com?x=/en/", "http://a.com#f", "x://y://z.com/p?q", "http://example.com/en/\n#", made[0], made[0], "http://ÄB.net/es/é"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made + odd)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(df, ["page_id"]).collect()}
    verdict = dict(U.RULES)
    for i, u in enumerate(made + odd):
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (rule is None or got[i].verdict == verdict[rule])
    assert U.judge(df.limit(0), ["page_id"]).count() == 0
    free = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in U.judge(free, ["page_id"]).collect()} == {"allow"}  # nothing to learn from


def test_url_scores_equal_plain_counting():
    """Counts by dictionary instead of hashed tables."""
    train = [("http://good.com/en/1", 0), ("http://good.com/en/2", 0), ("http://bad.net/fr/1", 1)]
    counts = np.zeros((U.ORDER + 1, 2, 2, 1 << U.BITS), np.float32)
    table_ = [Counter(), Counter()]
    for url, bad in train:
        data, starts, real = U.as_bytes([url])
        for order, (ctx, joint) in enumerate(U.contexts(data, starts)):
            np.add.at(counts[order, bad, 0], ctx[real].astype(int), 1)
            np.add.at(counts[order, bad, 1], joint[real].astype(int), 1)
        text = b"\0" + url.encode()
        for i in range(1, len(text)):
            for order in range(U.ORDER + 1):
                c = (order, text[max(0, i - order):i], i >= order)
                table_[bad][c] += 1
                table_[bad][(*c, text[i])] += 1
    urls = ["http://good.com/fr/3", "", "http://bad.net/"]
    want = []
    for url in urls:
        text, total = b"\0" + url.encode(), 0.0
        for i in range(1, len(text)):
            p = [1 / 256, 1 / 256]
            for order in range(U.ORDER + 1):
                for m in (0, 1):
                    c = (order, text[max(0, i - order):i], i >= order)
                    p[m] = (table_[m][(*c, text[i])] + U.STRENGTH * p[m]) / (table_[m][c] + U.STRENGTH)
            total += np.log(p[0]) - np.log(p[1])
        want.append(total / max(1, len(text) - 1))
    assert np.allclose(U.scores(urls, counts), want, atol=1e-6)


def test_url_contexts_are_counted_exactly_however_many_there_are(spark):
    """More different contexts than a table of 2**17 hashed slots can tell apart; scores equal counting by dictionary."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    urls = [f"http://{'good.com' if i % 2 else 'bad.net'}/{'' if i % 2 else 'fr/'}{word(24)}" for i in range(16000)] + [f"http://{word(8)}.org/{word(9)}" for _ in range(20)] + ["http://é.org/\0", "", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = U.judge(df, ["page_id"]).collect()
    learnt = {r.page_id for r in df.filter("pmod(xxhash64(coalesce(url, '')), 5) != 0").collect()}
    counts, keys = [Counter(), Counter()], set()
    for r in rows:
        if r.rule and r.page_id in learnt:
            text, bad = b"\0" + urls[r.page_id].encode(), dict(U.RULES)[r.rule] == "block"
            for i in range(1, len(text)):
                for order in range(U.ORDER + 1):
                    c = (order, text[max(0, i - order):i])
                    counts[bad][c] += 1
                    counts[bad][(*c, text[i])] += 1
                    keys.add((*c, text[i]))
    assert sum(k[0] == U.ORDER for k in keys) > 2 << U.BITS
    got = {r.page_id: r.score for r in rows}
    assert len(rows) == len(urls)
    for k in [*range(0, 16000, 500), *range(16000, len(urls))]:
        text, total = b"\0" + (urls[k] or "").encode(), 0.0
        for i in range(1, len(text)):
            p = [1 / 256, 1 / 256]
            for order in range(U.ORDER + 1):
                c = (order, text[max(0, i - order):i])
                p = [(counts[m][(*c, text[i])] + U.STRENGTH * p[m]) / (counts[m][c] + U.STRENGTH) for m in (0, 1)]
            total += np.log(p[0]) - np.log(p[1])
        assert got[k] == pytest.approx(total / max(1, len(text) - 1), abs=1e-9), urls[k]


def test_factorisation_machine_scores_pairs_exactly():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.1, rng.normal(0, 1, Q.SIZE).astype(np.float32), rng.normal(0, .3, (Q.SIZE, Q.RANK)).astype(np.float32))
    for text in ("", "a b c a", "one two ### three\nfour"):
        index, value = Q.features(text, 5)
        pairs = sum(float(m.vectors[i] @ m.vectors[j]) * x * y for k, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[:k])
        want = 0.1 + float((m.weight[index] * value).sum()) + pairs
        assert m.score([(index, value)])[0] == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-4)


def test_classifier_learns_and_ignores_the_held_out_third(spark):
    rng = random.Random(2)
    good, bad = ["river", "stone", "tree", "light"], ["###", "win$$$", "click%%%", "tree"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60)), None if i % 9 == 0 else 300, i % 2) for i in range(300)] + [(900, None, None, None), (901, "", 0, None), (None, "river", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality int")
    labels = docs.filter("quality is not null").select("doc_id", "quality")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    lies = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if held(r.doc_id) else r.quality)).toDF("doc_id long, quality int")
    out = {}
    for name, given in (("truth", labels), ("lies", lies)):
        got = Q.score(docs, Q.fit(docs, given, sample=150), ["doc_id"]).select("doc_id", Q.held_out().alias("held"), "score").collect()
        out[name] = {r.doc_id: r.score for r in got}
        assert len(got) == len(rows) and all(r.held == held(r.doc_id) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert out["truth"] == out["lies"]
    assert np.mean([(out["truth"][i] >= .5) == bool(i % 2) for i in range(300) if held(i)]) > 0.98
    none = Q.score(docs, Q.fit(docs, labels.limit(0)), ["doc_id"])
    assert none.count() == len(rows) and Q.score(docs.limit(0), Q.fit(docs, labels.limit(0)), ["doc_id"]).count() == 0


def test_classifier_on_documents(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = Q.op3_quality_classifier(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    assert docs.count() == 1000 and np.mean([r.predicted == r.quality for r in found]) > 0.95


def plain_base(text):
    ws = " \t\n\x0b\x0c\r"
    cut = lambda s: [w for w in "".join(" " if c in ws else c for c in s).split(" ") if w]
    w, lines = cut(text), [x for x in text.split("\n") if cut(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}


def test_rule_figures_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(800):
        s = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\u00a0", "#", "|", "x y z ", "\x0b", "日"]) for _ in range(rng.randint(0, 60)))
        assert R.measures(s.encode())[0] == plain_base(s), repr(s)


def plain_em(votes):
    """One text at a time instead of one pattern at a time."""
    prior, n = R.START_GOOD, len(votes[0])
    p = [[[R.START_ACCURACY, 1 - R.START_ACCURACY], [1 - R.START_ACCURACY, R.START_ACCURACY]] for _ in range(n)]
    for _ in range(R.STEPS):
        post = []
        for v in votes:
            odds = np.log(prior / (1 - prior)) + sum(np.log(p[r][0][c == "-"] / p[r][1][c == "-"]) for r, c in enumerate(v) if c != "0")
            post.append(1 / (1 + np.exp(-odds)))
        q = []
        for r in range(n):
            t = [[R.SMOOTH + sum(w for w, v in zip(ws, votes) if v[r] == s) for s in "+-"] for ws in (post, [1 - x for x in post], [1] * len(votes))]
            g, b, a = ([x / sum(row) for x in row] for row in t)
            q.append([a, a] if g[0] < b[0] else [g, b])
        prior, p = min(max(sum(post) / len(post), .5), .99), q
    return prior, [[np.log(p[r][0][k] / p[r][1][k]) for k in (0, 1)] for r in range(n)]


def test_em_equals_a_plain_version():
    rng = random.Random(4)
    votes = ["".join(rng.choices("+0-", (8, 1, 1) if i % 5 else (2, 2, 6))[0] for _ in range(4)) for i in range(300)]
    prior, odds = R.fit(Counter(votes))
    want = plain_em(votes)
    assert prior == pytest.approx(want[0], abs=1e-5) and np.allclose(odds, want[1], atol=1e-3)


def test_judged_rows(spark):
    prose = "The quick brown fox jumps over the lazy dog while many other animals look at it from the hill.\n"
    rng = random.Random(5)
    words = "river stone tree light field house garden window morning evening letter winter summer".split()
    fine = [" ".join(rng.choice(words) for _ in range(80)) + "." for _ in range(40)]
    junk = [" ".join(w + "###" for w in rng.choices(words, k=80)) for _ in range(8)]
    rows = [(i, t, "c") for i, t in enumerate([*fine, *junk, None, "", prose * 30, fine[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    got = {r.doc_id: r for r in R.judge(df, ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 51)) and got[51].kept
    assert got[48].base_failed and got[50].base_failed and got[48].n_words == 0
    kept = R.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 41
    assert R.judge(df.limit(0), ["doc_id"]).count() == 0


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against the operators' own plain versions on a small table."""
    from test_near import edit, plain_fp
    from test_texts import plain_hits
    docs = table(spark, SMALL, "documents")
    bench = {r.item_id: r.text for r in table(spark, SMALL, "benchmark").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SMALL).cache()
        assert now.columns == docs.columns, name
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "quality_rules":
            assert {i for i, t in before.items() if R.base_failed(R.measures(t.encode())[0])}.isdisjoint(after) and len(after) > 0.7 * len(before)
        elif name == "line_dedup":
            first, place = {}, [(i, p, x) for i in sorted(before) for p, x in enumerate(before[i].split("\n")) if x]
            for i, p, x in place:
                first.setdefault(x, (i, p))
            by_size = {}
            for x in first:
                by_size.setdefault(len(x), []).append(x)
            near = lambda x: any(first[y] < first[x] and edit(x, y) <= 2 for d in range(-2, 3) for y in by_size.get(len(x) + d, []) if len(y) >= 16 and y != x and sum((Counter(x) - Counter(y)).values()) <= 2)
            gone = {(i, p) for i, p, x in place if first[x] != (i, p) or len(x) >= 16 and near(x)}
            assert after == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before.items()}
        elif name == "near_duplicates":
            ids, fp = sorted(before), {i: plain_fp(t) for i, t in before.items()}
            root = {i: i for i in ids}
            for _ in ids:
                new = {i: min(root[j] for j in ids if (fp[i] ^ fp[j]).bit_count() <= 2) for i in ids}
                if new == root:
                    break
                root = new
            assert set(after) == {i for i in ids if root[i] == i}
        else:
            assert set(after) == {i for i, t in before.items() if not plain_hits(t, list(bench.values()), D.WINDOW)[1]}
        before = after
    coded = P.STAGES[-1][1](spark, now, SMALL)
    from drawdown.llm.bytebpe import decode
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode(coded).collect()} == before
    assert {r.doc_id: r.decoded_sha256 for r in coded.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}
    assert P.run(spark, SMALL).count() == len(before)
