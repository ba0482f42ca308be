"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Texts and benchmark items become sequences of word codes. A shift table over blocks of two words says how far a window may move before any
pattern can end there, so most words are never looked at; where the shift is zero, the suffix hash of the window selects the patterns to
compare, and the words themselves are compared before an occurrence is reported. All positions of a batch of texts move in step in numpy.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import col, map_texts, schema, stored, table, text_of

WINDOW = 10
#: Bytes of benchmark text searched for at once. A larger benchmark is searched in as many passes as it needs.
BLOCK_BYTES = 16 << 20
#: Words per block of the shift table, and bits of the table's index.
BLOCK, BITS = 2, 18
LANES = 4096

#: Word bytes: digits, letters and all bytes of other characters; and lower case for A-Z.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9)
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        with np.errstate(over="ignore"):
            _power = np.multiply.accumulate(np.full(max(n, 2 * len(_power)), MULTIPLIER))
    return _power


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit code of every word of lower-cased bytes."""
    inside = IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(np.append(0, end), np.diff(np.concatenate([[0], end, [len(data)]])))
    gap = start - np.append(0, end[:-1])
    with np.errstate(over="ignore"):
        term = (data.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 2)[place]
        term[~inside] = 0
        code = np.add.reduceat(term, start)
        # places count from the end of the word before, so take the gap out again: multiply by the inverse power of the gap
        code *= inverse_powers(int(gap.max()) + 1)[gap]
        code ^= code >> np.uint64(31)
        code *= MIX
        code ^= code >> np.uint64(29)
    code[code < 2] += np.uint64(2)  # 0 and 1 are kept for the places between texts
    return start, end, code


_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        with np.errstate(over="ignore"):
            one = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            _inverse = np.append(np.uint64(1), np.multiply.accumulate(np.full(max(n, 2 * len(_inverse)), one)))
    return _inverse


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a * MULTIPLIER + b) * MIX) >> np.uint64(64 - BITS)


@dataclass
class Patterns:
    """All patterns of one length, in words, with their Wu-Manber tables."""

    length: int
    shift: np.ndarray  # by slot of a block
    suffix: np.ndarray  # sorted suffix hashes of the patterns
    order: np.ndarray  # pattern numbers in that order
    codes: np.ndarray  # patterns x words
    words: list[tuple[bytes, ...]]
    items: list[list[int]]  # numbers of the items that hold the pattern


def build(items: list[bytes], window: int = WINDOW) -> list[Patterns]:
    """Patterns by length: every window of ``window`` consecutive words of an item, or the whole item if it is shorter but not empty."""
    found: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, list[int]]]] = {}
    for number, text in enumerate(items):
        data = LOWER[np.frombuffer(text, np.uint8)]
        start, end, code = words_of(data)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            held = found.setdefault(n, {}).setdefault(tuple(words[i:i + n]), (code[i:i + n], []))[1]
            if not held or held[-1] != number:
                held.append(number)
    out = []
    for n, patterns in sorted(found.items()):
        codes = np.stack([c for c, _ in patterns.values()])
        block = min(BLOCK, n)
        shift = np.full(1 << BITS, n - block + 1, np.int64)
        for end in range(block - 1, n):  # nearer to the end of the pattern: a smaller shift
            slot = pair_slot(codes[:, end - block + 1], codes[:, end])
            np.minimum.at(shift, slot, n - 1 - end)
        suffix = suffix_hash(codes)
        order = np.argsort(suffix, kind="stable")
        out.append(Patterns(n, shift, suffix[order], order, codes, list(patterns), [i for _, i in patterns.values()]))
    return out


def suffix_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the last words of windows (rows), up to four."""
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(0, codes.shape[1] - 4), codes.shape[1]):
            h = (h ^ codes[:, k]) * MULTIPLIER
            h ^= h >> np.uint64(32)
    return h


def candidates(code: np.ndarray, p: Patterns) -> np.ndarray:
    """Places of the last words of all windows that the shift table does not rule out."""
    n, m = len(code), p.length
    if n < m:
        return np.empty(0, np.int64)
    block = min(BLOCK, m)
    lanes = int(min(LANES, max(1, n // 64)))
    edge = np.linspace(m - 1, n, lanes + 1).astype(np.int64)
    at, stop = edge[:-1].copy(), edge[1:].copy()
    hits = []
    while True:
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
        if not len(at):
            break
        step = p.shift[pair_slot(code[at - block + 1], code[at])]
        zero = step == 0
        if zero.any():
            hits.append(at[zero])
        at += np.where(zero, 1, step)
    return np.concatenate(hits) if hits else np.empty(0, np.int64)


def occurrences(code: np.ndarray, spell, p: Patterns) -> Iterator[tuple[int, int]]:
    """(place of the first word, pattern) of every occurrence; ``spell(i)`` gives the bytes of word i."""
    last = np.sort(candidates(code, p))
    if not len(last):
        return
    window = code[last[:, None] + np.arange(1 - p.length, 1)]
    h = suffix_hash(window)
    low, high = np.searchsorted(p.suffix, h, "left"), np.searchsorted(p.suffix, h, "right")
    for i in np.flatnonzero(high > low).tolist():
        for k in p.order[low[i]:high[i]].tolist():
            if (p.codes[k] == window[i]).all():
                first = int(last[i]) - p.length + 1
                if all(spell(first + j) == w for j, w in enumerate(p.words[k])):
                    yield first, k


def scan(texts: list[bytes], groups: list[Patterns], n_items: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Per text: number of words, hit words as (first, end) rows, and the numbers of the items found."""
    sizes = np.array([len(t) for t in texts])
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    start, end, code = words_of(data)
    first_byte = np.cumsum(sizes + 1) - sizes - 1
    bound = np.searchsorted(start, np.append(first_byte, len(data) + 1))  # texts' first words
    # a word that no pattern has stands between texts
    owner = np.repeat(np.arange(len(texts)), np.diff(bound))
    gapped = np.ones(len(code) + len(texts), np.uint64)
    gapped[np.arange(len(code)) + owner] = code
    raw = data.tobytes()
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    begin = bound[:-1] + np.arange(len(texts))

    def spell(i: int) -> bytes:
        d = int(np.searchsorted(begin, i, "right")) - 1
        w = i - d
        return raw[start[w]:end[w]]

    for p in groups:
        for at, k in occurrences(gapped, spell, p):
            d = int(np.searchsorted(begin, at, "right")) - 1
            local = at - int(begin[d])
            hits[d].append((local, local + p.length))
            items[d].update(p.items[k])
    return np.diff(bound).tolist(), hits, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """The benchmark in blocks of about ``block_bytes``, and whether a block is the last; only one is in the driver's memory at a time."""
    items = benchmark.select(col(item_col).cast("string").alias("item"), text_of(text_col).alias("text")).filter(F.col("item").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 64), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield k + 1 == count, [(r["item"], r["text"].encode("utf-8", "surrogatepass")) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` plus n_words, hits (array of word numbers: first, end, first, end …, merged) and items (sorted ids as strings) per input row.

    The benchmark is broadcast in blocks of a fixed size; with more than one block the texts are read once a block and each pass adds to what the
    last one found. Null and empty texts and items have no words; items with a null id are not looked for; items that repeat count once by id; an
    empty benchmark finds nothing; an empty table gives an empty result; repeated rows repeat.
    """
    out = schema("n_words bigint, hits array<int>, items array<string>")
    keep = [c for c in keep if c.lower() not in {"n_words", "hits", "items"}]
    now = docs.select(*[col(c) for c in keep], text_of(text_col).alias("__text"), F.array().cast("array<int>").alias("__hits"), F.array().cast("array<string>").alias("__items"))
    passes = 0
    for last, block in blocks(benchmark, item_col, item_text, block_bytes):
        names = [n for n, _ in block]
        sent = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def make(names=names, sent=sent):
            groups = build(sent.value, window)

            def work(values: list[dict]) -> dict[str, list]:
                n, hits, items = scan([v["t"].encode("utf-8", "surrogatepass") for v in values], groups, len(names))
                hits = [merge(h + list(zip(v["h"][::2], v["h"][1::2]))) for h, v in zip(hits, values, strict=True)]
                return {"n_words": n, "hits": [[x for s in h for x in s] for h in hits],
                        "items": [sorted({names[i] for i in found} | set(v["i"])) for found, v in zip(items, values, strict=True)]}

            return work

        if passes:
            now = stored(now)
        passes += 1
        value = F.struct(F.col("__text").alias("t"), F.col("__hits").alias("h"), F.col("__items").alias("i"))
        found = map_texts(now, keep if last else [*keep, "__text"], value, out, make, F.octet_length("__text"))
        now = found if last else found.withColumnsRenamed({"hits": "__hits", "items": "__items"})
    return now.select(*[col(c) for c in keep], "n_words", "hits", "items")


def digests(found: DataFrame) -> DataFrame:
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("bigint"))
    n_hit = F.aggregate(signed, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs, with its columns."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[col(c).alias(n) for c, n in names.items()])
    return find_contamination(renamed, benchmark, list(names.values()), names[text_col]).filter(F.size("hits") == 0).select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
