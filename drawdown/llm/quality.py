"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors. The sum over all pairs is half the difference of the squared sum and
the sum of squares, so a text is scored in time linear in its features.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import col, map_texts, schema, table, text_of

#: Labelled rows that are learned from at most; of more, those with the smallest hash of their id.
SAMPLE = 12_000
#: Bits of the index of hashed words, and length of a feature's vector.
BITS, RANK = 15, 8
EPOCHS, ROWS, RATE, DECAY, SEED = 6, 128, 0.05, 1e-5, 7
#: Edges of the bins of each structure statistic and of the metadata (characters as stored with the document).
EDGES: list[tuple[str, list[float]]] = [
    ("words", [1, 10, 50, 200, 1000, 5000]),
    ("symbols_per_word", [0.001, 0.02, 0.1, 0.3, 1.0]),
    ("upper_share", [0.005, 0.03, 0.1, 0.3, 0.6]),
    ("distinct_share", [0.1, 0.3, 0.5, 0.7, 0.9]),
    ("top_share", [0.04, 0.08, 0.15, 0.25, 0.5]),
    ("word_length", [3, 4, 5, 6, 8, 12]),
    ("odd_share", [0.001, 0.01, 0.05, 0.15, 0.3]),
    ("digit_share", [0.001, 0.02, 0.1, 0.3]),
    ("lines_per_word", [0.01, 0.03, 0.1, 0.3]),
    ("distinct_lines", [0.3, 0.6, 0.9, 0.999]),
    ("n_chars", [0, 1, 100, 500, 2000, 10000, 50000]),
]
OFFSETS = np.cumsum([1 << BITS] + [len(e) + 1 for _, e in EDGES]).tolist()
SIZE = OFFSETS[-1]
SYMBOLS, DIGITS, UPPER = b"#*$%&|<>@^~=+_\\{}[]", b"0123456789", bytes(range(65, 91))
PLAIN = UPPER + bytes(range(97, 123)) + bytes(range(128, 256)) + DIGITS + b".,;:!?'\"-()"


def features(text: str, n_chars: int | None) -> tuple[list[int], np.ndarray]:
    """Feature numbers and their values: one per hashed distinct word, scaled to unit length together, and one bin per statistic."""
    data = text.encode("utf-8", "surrogatepass")
    counts = Counter(data.split())
    n = sum(counts.values())
    flat = len(data) or 1
    lines = data.split(b"\n")
    wide = sum(len(w) * c for w, c in counts.items())
    without = lambda chars: len(data) - len(data.translate(None, chars))
    numbers = [
        n, without(SYMBOLS) / max(1, n), without(UPPER) / flat, len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n), wide / max(1, n),
        len(data.translate(None, PLAIN + b" \t\r\n")) / flat, without(DIGITS) / flat, len(lines) / max(1, n), len(set(lines)) / len(lines), -1 if n_chars is None else n_chars,
    ]
    mask = (1 << BITS) - 1
    crc = zlib.crc32
    index = [crc(w) & mask for w in counts]
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= np.sqrt((value * value).sum()) or 1
    index += [o + bisect_right(e, x) for o, (_, e), x in zip(OFFSETS, EDGES, numbers, strict=False)]
    return index, np.append(value, np.full(len(EDGES), 0.5, np.float32)).astype(np.float32)


class Machine:
    def __init__(self, bias: float, weight: np.ndarray, vectors: np.ndarray):
        self.bias, self.weight, self.vectors = bias, weight, vectors

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, with what training needs again: the scaled vectors and their sums by row."""
        scaled = self.vectors[index] * value[:, None]
        total = np.add.reduceat(scaled, start)
        squares = np.add.reduceat(scaled * scaled, start)
        linear = np.add.reduceat(self.weight[index] * value, start)
        return self.bias + linear + 0.5 * (total * total - squares).sum(1), scaled, total

    def score(self, rows: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        index, value, start = packed(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, start)[0].astype(float), -40, 40)))


def packed(rows: list[tuple[list[int], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([np.asarray(i, np.int32) for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def train(rows: list[tuple[list[int], np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad over shuffled blocks of rows; both classes weigh the same in total. Without rows of both classes: the share of ones."""
    rng = np.random.default_rng(SEED)
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    ones = labels.sum()
    if not len(rows) or ones in (0, len(rows)):
        machine.bias = 4.0 * (2 * ones / len(rows) - 1) if len(rows) else 0.0
        machine.vectors[:] = 0
        return machine
    balance = np.where(labels == 1, len(rows) / (2 * ones), len(rows) / (2 * (len(rows) - ones))).astype(np.float32)
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), ROWS):
            block = order[k:k + ROWS]
            index, value, start = packed([rows[i] for i in block])
            raw, scaled, total = machine.raw(index, value, start)
            slope = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[block]) * balance[block]).astype(np.float32) / len(block)
            owner = np.repeat(np.arange(len(block)), np.diff(np.append(start, len(index))))
            by_w = slope[owner] * value
            by_v = by_w[:, None] * (total[owner] - scaled)
            used, place = np.unique(index, return_inverse=True)
            g_w = np.bincount(place, by_w, len(used)).astype(np.float32) + DECAY * machine.weight[used]
            g_v = np.stack([np.bincount(place, by_v[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) + DECAY * machine.vectors[used]
            g_b = float(slope.sum())
            seen_w[used] += g_w * g_w
            seen_v[used] += g_v * g_v
            seen_b += g_b * g_b
            machine.weight[used] -= RATE * g_w / np.sqrt(seen_w[used])
            machine.vectors[used] -= RATE * g_v / np.sqrt(seen_v[used])
            machine.bias -= RATE * g_b / seen_b ** 0.5
    return machine


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: by the checksum of its id as text."""
    return F.coalesce(F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` labelled ids outside the held-out third, those with the smallest hashes.

    Labels other than 0 and 1, and null ids, are left out. An id counts once: by its smaller label, and by its text with the smallest hash. So no more
    than ``sample`` rows reach the driver. Empty tables give a model that scores everything alike.
    """
    usable = labels.select(col(id_col).alias("id"), col(label_col).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    chosen = usable.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"), col(chars_col).cast("bigint").alias("n")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("mark", F.xxhash64("text", "n"))
    # features of one row an id: copies of an id are settled by their hashes before texts are read
    first = rows.groupBy("id").agg(F.min("mark").alias("mark"))
    rows = rows.join(first, ["id", "mark"], "left_semi").dropDuplicates(["id"])

    def make():
        def work(values: list[dict]) -> dict[str, list]:
            got = [features(v["text"], v["n"]) for v in values]
            return {"index": [i for i, _ in got], "value": [v.astype("<f4").tobytes() for _, v in got]}

        return work

    found = map_texts(rows, ["id", "y"], F.struct("text", "n"), schema("index array<int>, value binary"), make, F.octet_length("text")).toPandas()
    found = found.sort_values("id", kind="stable")
    data = [(list(i), np.frombuffer(v, "<f4")) for i, v in zip(found["index"], found["value"])]
    return train(data, found["y"].to_numpy(np.int64))


def score(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``keep`` plus score (probability of quality 1) for every row, null and empty texts included. The model that is broadcast has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.vectors))

    def make():
        model = Machine(*sent.value)
        return lambda values: {"score": model.score([features(v["text"], v["n"]) for v in values]).tolist()}

    value = F.struct(text_of(text_col).alias("text"), col(chars_col).cast("bigint").alias("n"))
    return map_texts(docs, keep, value, schema("score double"), make, F.octet_length(text_of(text_col)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
