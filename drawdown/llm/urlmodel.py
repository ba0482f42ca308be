"""URL filter by a character language-model ratio.

Rules decide some URLs. The rest is judged by two smoothed variable-order Markov models of characters, one of the URLs that the rules allow and
one of those that they block: the difference of the log-likelihoods per character, against a threshold calibrated on URLs that the models have not seen.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, pieces, stored, table

#: Rules of the registered query: fixed values.
RULES: list[tuple[str, str]] = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Longest context in bytes, bits of a byte in the exact key of a context with its character, and log2 of the most URLs of a chunk.
ORDER, WIDTH, CHUNK = 5, 9, 11
#: Bits of a slot in the hashed version of the counts, which only :func:`contexts` and :func:`scores` use.
BITS = 17
#: Share of labelled URLs that calibrate instead of training: every FOLDS-th, by a hash of the URL.
FOLDS = 5
#: Bins of the histograms of scores from which the threshold is taken, over SCORES.
BINS, SCORES = 2000, (-10.0, 10.0)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, lower case) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"(?s)\A([^?#]*)", 1)
    return lower_az(host), path


def ruled(df: DataFrame, keep: list[str], url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``keep`` plus the url as text, host, path, rule and ruling; the longest rule that fits wins, rule and ruling are null if none does.

    A rule is ``host/path``: it fits its host and all subdomains when the url's path starts with the rule's.
    """
    url = col(url_col).cast("string")
    host, path = parts(url)
    out = df.select(*[col(c) for c in keep if c.lower() not in {"host", "path", "rule", "ruling", "score", "verdict", "__row", "__url"}], F.coalesce(url, F.lit("")).alias("__url"), host.alias("host"), path.alias("path"))
    rule = ruling = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    none = F.lit(None).cast("string")
    return out.withColumn("rule", none if rule is None else rule).withColumn("ruling", none if ruling is None else ruling)


def contexts(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every order: the slot of the context of each character, and the slot of the context with the character.

    ``data`` holds the URLs' bytes with one zero before each, ``starts`` the place of that zero for every character; a context does not reach past it.
    """
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - starts
        h = np.full(len(data), 1, np.uint64)
        chars = data.astype(np.uint64) + np.uint64(1)
        for order in range(ORDER + 1):
            if order:
                before = np.concatenate([np.zeros(order, np.uint64), chars[:-order]]) if order < len(chars) else np.zeros(len(chars), np.uint64)
                h = (h + np.where(place >= order, before, np.uint64(0))) * MULTIPLIER
                h ^= h >> np.uint64(29)
            joint = (h * MULTIPLIER + chars) * MULTIPLIER
            joint ^= joint >> np.uint64(32)
            joint *= MULTIPLIER
            yield (h * MULTIPLIER) >> np.uint64(64 - BITS), joint >> np.uint64(64 - BITS)


def as_bytes(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a zero before each URL, the place of that zero by byte, and the bytes that are characters to predict."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    data = np.frombuffer(b"".join(b"\0" + r for r in raw), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    head = np.cumsum(sizes) - sizes
    starts = np.repeat(head, sizes)
    return data, starts, np.arange(len(data)) != starts


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every byte, it and up to ORDER bytes before it as one integer, WIDTH bits each: the zero before a URL is 1, its bytes are 2 to 257, nothing is 0.

    The byte itself is lowest, so the lowest ``order + 1`` places are the context of that order with its character: exact keys, nothing is hashed.
    """
    place = np.arange(len(data)) - starts
    code = np.where(place > 0, data.astype(np.int64) + 2, 1)
    out = code.copy()
    for order in range(1, min(ORDER, len(data) - 1) + 1):
        before = np.concatenate([np.zeros(order, np.int64), code[:-order]])
        out |= np.where(place >= order, before, 0) << (WIDTH * order)
    return out


def gather(base: DataFrame) -> DataFrame:
    """The different grams of every chunk of URLs: chunk, gram, n0 and n1 (how often URLs that the allowed and the blocked model learn from hold it).

    All rows count; ``model`` is null for the URLs that are only scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, [len(u) for u in batch.column(1).to_pylist()]):
                data, starts, real = as_bytes(b.column(1).to_pylist())
                sizes = np.diff(np.append(np.flatnonzero(~real), len(data)))
                gram, chunk, model = grams(data, starts)[real], *(np.repeat(x, sizes)[real] for x in (b.column(0).to_numpy(), b.column(2).fill_null(-1).to_numpy()))
                for c in np.unique(chunk):
                    mine = chunk == c
                    key, at = np.unique(gram[mine], return_inverse=True)
                    n = [np.bincount(at[model[mine] == m], minlength=len(key)).astype(np.int64) for m in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int64)), *map(pa.array, (key, *n))], names=["chunk", "gram", "n0", "n1"])

    return base.select("chunk", "__url", "model").mapInArrow(run, "chunk bigint, gram bigint, n0 bigint, n1 bigint")


def scores(urls: list[str], counts: np.ndarray) -> np.ndarray:
    """Log-likelihood under the allowed model less that under the blocked one, per character, from hashed counts of :func:`contexts`. Empty: zero.

    The query counts exactly (:func:`fitted`); this is the plain version for tables small enough that no two contexts share a slot. Each order's estimate is blended with the next shorter one's in proportion to how often the context was seen.
    """
    data, starts, real = as_bytes(urls)
    p = np.full((2, len(data)), 1 / 256)
    for order, (ctx, joint) in enumerate(contexts(data, starts)):
        for model in (0, 1):
            seen, both = counts[order, model, 0][ctx], counts[order, model, 1][joint]
            both = np.minimum(both, seen)
            p[model] = (both + STRENGTH * p[model]) / (seen + STRENGTH)
    gain = np.where(real, np.log(p[0]) - np.log(p[1]), 0.0)
    owner = np.flatnonzero(~real)
    size = np.diff(np.append(owner, len(data))) - 1
    return np.add.reduceat(gain, owner) / np.maximum(size, 1) if len(owner) else np.empty(0)


#: Weight of the shorter context's estimate, in occurrences.
STRENGTH = 4.0


def fitted(found: DataFrame) -> DataFrame:
    """Per gram of any URL, the gain of its last character: the log of its probability in the allowed model less that in the blocked one.

    ``found`` are the grams of :func:`gather`. Their counts are summed into a stored table that grows with the input; shorter contexts are sums over it.
    A key meets its estimate in the next shorter order and the count of its context, each of which at most 257 keys share, so no join has a large group.
    """
    S = F.lit(STRENGTH)
    level = stored(found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))).withColumnRenamed("gram", "key")
    levels = [level]
    for order in range(ORDER - 1, -1, -1):
        level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << WIDTH * (order + 1)) - 1)).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        levels.insert(0, level)
    known = None
    for order, level in enumerate(levels):
        context = F.shiftright("key", WIDTH).alias("context")
        level = level.select("key", "n0", "n1", context)
        seen = level.groupBy("context").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
        level = level.join(seen, "context")
        if known is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            parent = F.col("key").bitwiseAND(F.lit((1 << WIDTH * order) - 1))
            level = level.withColumn("parent", parent).join(known, "parent")
        known = level.select(F.col("key").alias("parent"), *[((F.col(f"n{m}") + S * F.col(f"q{m}")) / (F.col(f"s{m}") + S)).alias(f"q{m}") for m in (0, 1)])
    return known.select(F.col("parent").alias("gram"), (F.log("q0") - F.log("q1")).alias("gain"))


def scored(base: DataFrame, found: DataFrame, gains: DataFrame) -> DataFrame:
    """Row and score of every URL of ``base``: the mean gain of its characters, zero if it has none.

    A chunk asks for each of its grams once, so a gram that every URL holds is asked for once a chunk, and gets the gains of its own grams back.
    """

    def run(key: tuple, urls: pa.Table, known: pa.Table) -> pa.Table:
        gram, gain = known.column("gram").to_numpy(), known.column("gain").to_numpy()
        order = np.argsort(gram)
        gram, gain = gram[order], gain[order]
        out = [np.empty(0)]
        for batch in urls.combine_chunks().to_batches():
            texts = batch.column("__url").to_pylist()
            for b in pieces(batch, [len(u) for u in texts]):
                data, starts, real = as_bytes(b.column("__url").to_pylist())
                each = np.zeros(len(data))
                each[real] = gain[np.searchsorted(gram, grams(data, starts)[real])] if real.any() else 0.0
                owner = np.flatnonzero(~real)
                out.append(np.add.reduceat(each, owner) / np.maximum(np.diff(np.append(owner, len(data))) - 1, 1))
        return pa.table({"__row": urls.column("__row"), "score": np.concatenate(out)})

    asked = found.select("chunk", "gram").join(gains, "gram").select("chunk", "gram", "gain")
    return base.select("chunk", "__row", "__url").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, "__row bigint, score double")


def threshold(held: DataFrame) -> float:
    """The score that best separates held-out URLs by balanced accuracy; of equals the one nearest to zero. Zero if a class is missing."""
    low, high = SCORES
    width = (high - low) / BINS
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") - low) / width))).cast("int")
    got = held.groupBy(at.alias("bin"), (F.col("ruling") == "block").alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((2, BINS + 1))
    for r in got:
        n[int(r["bad"]), r["bin"] + 1] += r["n"]
    if not n.sum(1).all():
        return 0.0
    below = np.cumsum(n, 1) / n.sum(1, keepdims=True)
    gain = below[1] - below[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = low + width * best
    return float(edges[np.argmin(np.abs(edges))])


def judge(df: DataFrame, keep: list[str], url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``keep`` plus host, path, rule, score and verdict (allow or block): the rule's, else the method's.

    The models learn from all rows that a rule decides, but for every FOLDS-th (by a hash of the URL), which set the threshold. Null urls and urls without ``://`` have
    an empty host and path; an empty or null url scores zero. If the rules decide no url of one kind, the models say nothing and all else is allowed. Rows
    repeat as in ``df`` and repeated URLs count as often as they occur; an empty table gives an empty result.
    """
    rows = stored(ruled(df, keep, url_col, rules).withColumn("__row", F.monotonically_increasing_id()))
    learns = F.pmod(F.xxhash64("__url"), F.lit(FOLDS)) != 0
    base = rows.withColumns({"chunk": F.shiftright("__row", CHUNK), "model": F.when(learns, (F.col("ruling") == "block").cast("int"))})
    found = gather(base)
    score = stored(scored(base, found, fitted(found)))
    kinds = {r["ruling"] for r in rows.filter(F.col("ruling").isNotNull()).groupBy("ruling").count().collect()}
    cut = threshold(rows.filter(F.col("ruling").isNotNull() & ~learns).join(score, "__row"))
    silent = F.lit(len(kinds) < 2)
    verdict = F.coalesce("ruling", F.when(silent | (F.col("score") >= cut), "allow").otherwise("block"))
    return rows.join(score, "__row").withColumn("verdict", verdict).drop("ruling", "__row", "__url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "rule", "verdict", "score")
