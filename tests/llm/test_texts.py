"""Tokens, counts, secrets and contamination against plain versions."""
import base64
import json
import random
import re

import numpy as np
import pytest
import regex
import tiktoken

from drawdown.llm import bytebpe as B, decontaminate as D, prefixcounts as C, secrets as S

PARTS = [" ", " ", "\n", "a", "bé", "'s", "'r", "e", "!", "\t", "7", "\x1c", "\u00a0", "\u3000", "x", "\x85", "re", "'", "the", "tion", "日本", "🙂", "l", "ll", "   "]


@pytest.fixture(scope="module")
def enc():
    return B.encoding(B.RANKS, B.PATTERN)


def some(rng, n, parts=PARTS):
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))


def test_words_give_the_ids_of_the_library(enc):
    words = B.Words(lambda t: np.array(enc.encode_ordinary(t), "<u4").tobytes(), most=50)
    rng = random.Random(3)
    for _ in range(4000):
        s = some(rng, 14)
        assert b"".join(B.by_words(s, words)) == np.array(enc.encode_ordinary(s), "<u4").tobytes(), repr(s)


def test_stitched_pieces_give_the_ids_of_the_whole(enc):
    pattern, rng, cut = regex.compile(B.PATTERN), random.Random(4), 0
    for _ in range(400):
        s = some(rng, 300)
        at = B.cuts(pattern, s, 16, 8)
        cut += len(at) > 2
        assert sum([enc.encode_ordinary(s[a:b]) for a, b in zip(at, at[1:])], []) == enc.encode_ordinary(s)
    assert cut > 100
    assert B.cuts(pattern, "x" * 100, 16, 8) == [0, 100]  # no place to stitch: one piece


def test_encode_and_decode(spark, enc):
    rng = random.Random(5)
    texts = [None, "", "a b", "a b", "x" * 90, *(some(rng, 400) for _ in range(30))]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), bytes(r.ids), r.n_tokens) for r in B.encode(df, chunk=40, overlap=12).collect())
    want = sorted((str(None if i == 3 else i // 2), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    assert got == want
    back = B.decode(B.encode(df, chunk=40, overlap=12)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in texts)
    twice = spark.createDataFrame([(1, "long text " * 20)] * 3, "doc_id long, text string")
    assert B.encode(twice, chunk=40, overlap=12).count() == 3
    assert B.digests(df.limit(0)).count() == 0


def test_prefix_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    t, c, rng = Tokenizer.from_file(C.TOKENIZER), C.counter(C.TOKENIZER), random.Random(5)
    rows = []
    for _ in range(400):
        s = some(rng, 16, [*PARTS, "<|endoftext|>", "<|end"])
        want = [len(t.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert c.prefix(s).tolist() == want, repr(s)
        assert c.count(s) == want[-1]
        for budget in (0, 1, 3, 8):
            assert c.longest_within(s, budget) == max(i for i, n in enumerate(want) if n <= budget)
        rows.append((s, want))
    long = " ".join(s for s, _ in rows)
    assert c.count(long) == len(t.encode(long, add_special_tokens=False).ids)
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows[:40])] + [(None, None), (7, "")], "doc_id long, text string")
    got = {(r.doc_id): list(r.counts) for r in C.prefix_counts(df.limit(40)).collect()}
    assert all(got[i] == rows[i][1] for i in range(40))
    few = C.count_tokens(df, budgets=(2,)).collect()
    assert len(few) == 42 and all(r.cuts[0] <= max(1, r.n_bytes) for r in few)
    assert [r.n_tokens for r in few if r.doc_id is None] == [0]


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body


def plain_base(text):
    """The contract's patterns with the regex module, one kind at a time."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [("assign", "(" + word + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in regex.finditer(p, text) if len(m[g]) >= n]
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_base_spans_and_confirmation(spark):
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "APIKEY", "ſecret", "=", ": ", "'", '"', "AKIA", "ABCDEFGHIJKL1234", "deadbeef" * 4, "abc", "x" * 9, "\n", "é", " "]
    for _ in range(2000):
        s = some(rng, 12, bits)
        assert S.joined(S.spans(s)[0]) == plain_base(s), repr(s)
    key = der(0x30, der(2, b"\0") + der(2, b"\x7f" * 200) + der(2, b"\1\0\1"))
    body = base64.b64encode(key).decode()
    lines = "\n".join(body[i:i + 64] for i in range(0, len(body), 64))
    part = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).rstrip(b"=").decode()
    no_alg = base64.urlsafe_b64encode(json.dumps({"typ": "JWT!"}).encode()).rstrip(b"=").decode()
    assert [S.KINDS[k] for _, k, _ in S.spans(f"-----BEGIN\n{lines}\nprose goes on")[1]] == ["der"]
    assert [S.KINDS[k] for _, k, _ in S.spans("k " + key.hex())[1]] == ["der"]
    assert not S.spans("k " + key.hex() + "00")[1] and not S.spans("k " + base64.b64encode(b"z" * 60).decode())[1]
    assert [S.KINDS[k] for _, k, _ in S.spans(f"x {part}.{part}.abc y")[1]] == ["jwt"] and not S.spans(f"x {no_alg}.{part}.abc y")[1]
    ssh = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-ed25519", b"k" * 32))
    assert [S.KINDS[k] for _, k, _ in S.spans("ssh-ed25519 " + base64.b64encode(ssh).decode())[1]] == ["ssh"]
    df = spark.createDataFrame([(1, "token = 12345678"), (1, "token = 12345678"), (2, None), (None, "")], "doc_id long, text string")
    assert sorted((r.n_assign, r.spans) for r in S.find_secrets(df).collect()) == [(0, ""), (0, ""), (1, "assign:0:16"), (1, "assign:0:16")]
    assert S.find_secrets(df.limit(0)).count() == 0


def test_secret_keys_in_their_usual_places():
    key = der(0x30, der(2, b"\0") + der(2, b"\x7f" * 200) + der(2, b"\1\0\1"))
    body = base64.b64encode(key).decode()

    def found(text):
        return [(S.KINDS[k], text[a:b]) for a, k, b in S.spans(text)[1]]

    for before in ("PRIVATE_KEY=", "ssl_key=", "-----BEGIN PRIVATE KEY-----", "key-", "x" * 40 + "="):
        assert found(f"{before}{body}-----END") == [("der", body)], before
    mixed = der(0x30, der(2, b"\0") + der(2, b"A" * 60 + b"\xfb\xef\xbe\xff\xff\xff" * 20) + der(2, b"\1\0\1"))
    safe = base64.urlsafe_b64encode(mixed).decode()
    assert next(i for i, c in enumerate(safe) if c in "-_") > 32
    for before in ("k ", "key=", "key-", "key_"):
        assert found(f"{before}{safe} y") == [("der", safe)], before
    for indent in ("  ", "\t", ""):
        lines = f"\n{indent}".join(body[i:i + 64] for i in range(0, len(body), 64))
        assert found(f"tls:\n{indent}{lines}\n{indent}prose goes on") == [("der", lines)]
    fields = lambda *f: b"".join(len(x).to_bytes(4, "big") + x for x in f)
    public = base64.b64encode(fields(b"ssh-ed25519", b"k" * 32)).decode()
    for after in ("", " me@host", "\nword goes on", "\nssh\nmore", "\r\n  word", " \nword"):
        assert found(f"ssh-ed25519 {public}{after}") == [("ssh", public)], after
    assert not found("ssh-ed25519 " + base64.b64encode(fields(b"ssh-ed25519", b"k" * 32)[:-1]).decode() + "\nword")
    private = base64.b64encode(S.MAGIC + fields(b"none", b"none", b"") + b"\0\0\0\1" + fields(b"p" * 51, b"s" * 121)).decode().rstrip("=")
    assert found(f"BEGIN-----\n{private}\nword goes on") == [("ssh", private)]
    assert found(f"k=0x{key.hex()};") == [("der", key.hex())]
    assert not found("A" * 4000 + "\n" + "\n".join(["A" * 76] * 500))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_hits(text, items, window):
    w, hit, got = WORD.findall(low(text)), set(), set()
    for k, item in enumerate(items):
        v = WORD.findall(low(item))
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit.update(range(j, j + n))
                    got.add(k)
    return len(w), hit, got


def test_wu_manber_equals_plain_search():
    rng = random.Random(2)
    for _ in range(250):
        mk = lambda n: "".join(rng.choice(["a", "b", "Bé", "c1", "日"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, n)))
        items, texts, window = [mk(8) for _ in range(4)], [mk(40) for _ in range(7)], rng.choice([2, 3, 4])
        n, hits, found = D.scan([t.encode() for t in texts], D.build([x.encode() for x in items], window), 4)
        for j, t in enumerate(texts):
            assert (n[j], {x for a, b in D.merge(hits[j]) for x in range(a, b)}, found[j]) == plain_hits(t, items, window)


def test_contamination_in_one_pass_or_many(spark):
    rng = random.Random(8)
    mk = lambda n: " ".join(rng.choice(["a", "b", "c", "dé"]) for _ in range(rng.randint(0, n)))
    items = {i: mk(9) for i in range(12)}
    texts = [mk(60) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([*items.items(), (None, "a b c"), (99, None)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        n, hit, got = plain_hits(t or "", list(items.values()), 4)
        want[i] = (n, len(hit), ",".join(sorted(str(k) for k in got)))
    for size in (1 << 20, 400):
        got = D.digests(D.find_contamination(docs, bench, ["doc_id"], window=4, block_bytes=size)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"])) for r in got} == want
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert D.find_contamination(docs, bench.limit(0), ["doc_id"]).filter("size(hits) > 0").count() == 0
    assert D.find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0
