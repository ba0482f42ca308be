"""Removal of long repeated byte strings by suffix arrays.

Whether the LENGTH bytes from a place occur elsewhere is decided in shards. Every place belongs to one anchor, the least of the hashes of the
grams inside its LENGTH bytes, so equal strings have equal anchors at equal distances and meet in one shard. Only regions around anchors that
occur more than once, and differ around it, need a suffix array: it is refined by doubling (Larsson-Sadakane), common prefixes are
counted in text order (Kasai), and strings that share LENGTH bytes stand in a row. An anchor with more regions than a shard takes is dealt to several
shards, whose sorted strings are merged by binary search.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import col, map_texts, pieces, schema, stored, table, text_of

#: Length of a repeated string, and of the grams that anchor it.
LENGTH, GRAM = 400, 64
#: Regions of one anchor in a shard at most, and bytes of regions that a shard is meant to hold.
REGIONS, SHARD_BYTES = 512, 512 << 10
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _tables.get(int(base))
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = _tables[int(base)] = np.append(np.uint64(1), np.multiply.accumulate(np.full(n, base)))
    return held[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes, by differences of one running sum."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n), out=total[1:])
        h = (total[gram:] - total[:-gram]) * powers(INVERSE, n - gram + 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For every run of places with one anchor: text number, first place, places, distance of the anchor from the first, hash of the anchor,
    and hash of the region (all bytes that strings from these places cover)."""
    width = length - gram + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    empty = np.empty(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty, empty
    first = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    bits = np.uint64(len(h).bit_length())
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_least(((h >> bits) << bits) | place, width)
    count = np.maximum(sizes - length + 1, 0)
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    if not len(at):
        return empty, empty, empty, empty, empty, empty
    anchor = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo, n, p = at[cut], np.diff(np.append(cut, len(at))), anchor[cut]
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    r = np.fromiter((digest(view[a:a + b + length - 1], o) for a, b, o in zip(lo.tolist(), n.tolist(), (p - lo).tolist())), np.uint64, len(lo))
    doc = np.searchsorted(first + sizes, lo, "right")
    return doc, lo - first[doc], n, p - lo, h[p].view(np.int64), r.view(np.int64)


def anchored(df: DataFrame, length: int, gram: int) -> DataFrame:
    """All regions of all texts: doc, mark, anchor, region, and span (first place, number of places and distance in one long)."""
    kind = df.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, [len(x) for x in batch.column(2).to_pylist()]):
                doc, lo, n, off, anchor, region = regions([t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()], length, gram)
                for k in range(0, len(doc), 50_000):
                    s = slice(k, k + 50_000)
                    who = pa.array(doc[s])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(anchor[s]), pa.array(region[s]), pa.array(lo[s] << 20 | n[s] << 10 | off[s])],
                                                     names=["doc", "mark", "anchor", "region", "span"])

    return df.select("doc", "mark", "text").mapInArrow(run, f"doc {kind}, mark bigint, anchor bigint, region bigint, span bigint")


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least. Each round sorts the groups that are still tied by the ranks that stand
    as far behind as the order is deep already, which doubles its depth."""
    n = len(data)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:k + n]
    order = np.argsort(key, kind="stable")
    same = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(same, np.arange(n), 0))
    edge = np.append(np.flatnonzero(same), n)
    open_ = np.repeat(np.diff(edge) > 1, np.diff(edge))
    at = np.flatnonzero(open_)
    h = 8
    while h < depth and len(at):
        members = order[at]
        behind = rank[np.minimum(members + h, n)]
        key2 = rank[members] * (n + 1) + behind + 1
        by = np.argsort(key2, kind="stable")
        order[at] = members[by]
        key2 = key2[by]
        new = np.append(True, key2[1:] != key2[:-1])
        edge = np.append(np.flatnonzero(new), len(at))
        rank[order[at]] = at[np.repeat(edge[:-1], np.diff(edge))]
        at = at[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        h *= 2
    return order


def high_byte(x: np.ndarray) -> np.ndarray:
    """Number, from 0 at the low end, of the highest byte that is not zero."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x >> np.uint64(8 * k) > 0
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, start: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """What the suffixes of ``order`` have in common with the one before them, up to ``most``, by Kasai's rule for many stretches of text at once:
    it is at most one less for the next suffix, as long as the neighbour's next suffix takes part too and comes before it."""
    n = len(data)
    previous, stands = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    previous[order[1:]] = order[:-1]
    stands[order] = np.arange(len(order))
    wide = np.zeros(n + 16, np.uint64)
    wide[:n] = data
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | wide[k:k + n + 8]
    out = np.zeros(n, np.int32)
    i, stop, h = start.copy(), start + count, np.zeros(len(start), np.int64)
    while True:
        live = i < stop
        if not live.all():
            i, stop, h = i[live], stop[live], h[live]
        if not len(i):
            return out
        j = previous[i]
        none = j < 0
        at = np.where(none, 0, j)
        differ = word[np.minimum(i + h, n)] ^ word[np.minimum(at + h, n)]
        equal = np.full(len(i), 8)
        some = np.flatnonzero(differ)
        equal[some] = 7 - high_byte(differ[some])
        h = np.where(none, 0, np.minimum(h + equal, most))
        done = none | (equal < 8) | (h >= most)
        out[i[done]] = h[done]
        h = np.where(done, np.where(~none & (stands[at + 1] >= 0) & (stands[at + 1] < stands[i + 1]), np.maximum(h - 1, 0), 0), h)
        i = i + done


def runs_of(texts: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that take part (the first ``places[k]`` of each text) in order: text number, place in it, and number of the run of equal strings."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(data)) - start[owner]
    mine = inside < places[owner]
    order = suffix_order(data, length)
    order = order[mine[order]]
    shared = common_prefixes(data, order, start, places, length)
    run = np.cumsum(shared[order] < length) - 1
    return owner[order], inside[order], run


ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("region", "<i8"), ("place", "<i4")])
FLAGS = "anchor bigint, region bigint, part int, starts array<int>, entries binary"


def intervals(places: np.ndarray) -> list[int]:
    """First and end of every stretch of consecutive places, in one list."""
    places = np.unique(places)
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.column_stack([places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + 1]).ravel().tolist()


def shard(texts: list[bytes], places: np.ndarray, anchor: np.ndarray, region: np.ndarray, parts: np.ndarray, length: int) -> dict[str, list]:
    """What one shard finds: places of each region whose string repeats in it; and, for anchors with regions in other shards, the fingerprints of its strings in order."""
    owner, place, run = runs_of(texts, places, length)
    size = np.bincount(run, minlength=1)
    again = size[run] > 1
    out: dict[str, list] = {k: [] for k in ("anchor", "region", "part", "starts", "entries")}

    def add(*values) -> None:
        for k, v in zip(out, values, strict=True):
            out[k].append(v)

    hit, at = owner[again], place[again]
    by = np.argsort(hit, kind="stable")
    edge = np.flatnonzero(np.diff(hit[by], prepend=-1, append=-1)) if len(hit) else []
    for a, b in zip(edge[:-1], edge[1:]):
        k = int(hit[by[a]])
        add(int(anchor[k]), int(region[k]), -1, intervals(at[by[a:b]]), None)
    wide = np.flatnonzero(parts[owner] > 1)
    # one string stands for each run; only strings that are alone here want an answer
    wide = wide[np.unique(run[wide], return_index=True)[1]] if len(wide) else wide
    if len(wide):
        digest = xxhash.xxh3_128_intdigest
        full = [digest(texts[o][p:p + length]) for o, p in zip(owner[wide].tolist(), place[wide].tolist())]
        entries = np.empty(len(wide), ENTRY)
        entries["a"] = [f >> 64 for f in full]
        entries["b"] = [f & (1 << 64) - 1 for f in full]
        entries["region"], entries["place"] = region[owner[wide]], np.where(again[wide], -1, place[wide])
        key, n = anchor[owner[wide]], parts[owner[wide]]
        part = (entries["a"] % n.astype(np.uint64)).astype(np.int64)
        by = np.lexsort((entries["b"], entries["a"], part, key))
        entries, key, part = entries[by], key[by], part[by]
        cut = np.append(np.flatnonzero((np.diff(key, prepend=key[0] - 1) != 0) | (np.diff(part, prepend=-1) != 0)), len(entries))
        for a, b in zip(cut[:-1], cut[1:]):
            add(int(key[a]), 0, int(part[a]), None, entries[a:b].tobytes())
    return out


def merge(runs: list[np.ndarray]) -> dict[int, list[int]]:
    """Regions and places whose string stands in more than one shard, by binary search of every sorted run in all of them."""
    if len(runs) < 2:
        return {}
    whole = np.concatenate(runs)
    whole = whole[np.lexsort((whole["b"], whole["a"]))]
    found: dict[int, list[int]] = {}
    for run in runs:
        low, high = np.searchsorted(whole["a"], run["a"], "left"), np.searchsorted(whole["a"], run["a"], "right")
        for k in np.flatnonzero((high - low > 1) & (run["place"] >= 0)).tolist():
            if (whole["b"][low[k]:high[k]] == run["b"][k]).sum() > 1:
                found.setdefault(int(run["region"][k]), []).append(int(run["place"][k]))
    return found


def in_shards(cut: DataFrame, length: int) -> DataFrame:
    """Answers of all shards (FLAGS) over regions with their bytes."""

    def one(group: pa.Table) -> pa.Table:
        # repeated rows with one id bring their regions more than once
        keys = np.column_stack([group["anchor"].to_numpy(), group["region"].to_numpy()])
        group = group.take(pa.array(np.unique(keys, axis=0, return_index=True)[1]))
        texts = group["bytes"].to_pylist()
        got = shard(texts, group["n"].to_numpy().astype(np.int64), group["anchor"].to_numpy(), group["region"].to_numpy(), group["parts"].to_numpy(), length)
        return pa.table([pa.array(got["anchor"], pa.int64()), pa.array(got["region"], pa.int64()), pa.array(got["part"], pa.int32()), pa.array(got["starts"], pa.list_(pa.int32())), pa.array(got["entries"], pa.binary())],
                        names=["anchor", "region", "part", "starts", "entries"])

    return cut.groupBy("shard").applyInArrow(one, FLAGS)


def across(entries: DataFrame) -> DataFrame:
    """Answers for anchors whose regions are in several shards."""

    def one(group: pa.Table) -> pa.Table:
        anchor = group["anchor"][0].as_py()
        got = merge([np.frombuffer(e, ENTRY) for e in group["entries"].to_pylist()])
        return pa.table([pa.array([anchor] * len(got), pa.int64()), pa.array(list(got), pa.int64()), pa.array([intervals(np.array(p)) for p in got.values()], pa.list_(pa.int32()))], names=["anchor", "region", "starts"])

    return entries.groupBy("anchor", "part").applyInArrow(one, "anchor bigint, region bigint, starts array<int>")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, per_shard: int = REGIONS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, mark and starts: first and end of all stretches of places whose strings of ``length`` bytes start elsewhere too. ``docs``: doc, mark, text."""
    spark = docs.sparkSession
    lo, n = F.shiftrightunsigned("span", 20), F.shiftrightunsigned("span", 10).bitwiseAND(F.lit(1023))
    all_ = stored(anchored(docs.filter(F.octet_length("text") >= length), length, gram))
    # stored, so that the join deals both sides itself and can split an anchor that very many regions have
    known = stored(all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("region") != F.max("region")).alias("mixed")).filter("n > 1").drop("n"))
    hits = stored(all_.join(known, "anchor"))
    # equal regions need no comparison; of each only one goes on to be compared with different ones around the same anchor
    distinct = stored(hits.filter("mixed").groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "mark", "span")).alias("one")))
    total = distinct.agg(F.coalesce(F.sum(F.shiftrightunsigned("one.span", 10).bitwiseAND(F.lit(1023)) + length - 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    many = stored(distinct.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / per_shard).cast("int").alias("parts")).filter("parts > 1"))
    dealt = distinct.join(many, "anchor", "left").select("one.doc", "one.mark", "one.span", "anchor", "region", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("anchor", F.pmod("region", "parts")), F.lit(shards)))
    asked = dealt.groupBy("doc", "mark").agg(F.collect_list(F.struct(lo.cast("int").alias("lo"), n.cast("int").alias("n"), "anchor", "region", "parts", "shard")).alias("ask"))
    a, d = asked.alias("a"), docs.alias("d")
    data = F.encode("d.text", "UTF-8")
    bytes_of = F.transform("a.ask", lambda x: F.struct(x["shard"].alias("shard"), x["anchor"].alias("anchor"), x["region"].alias("region"), x["parts"].alias("parts"), x["n"].alias("n"),
                                                       F.substring(data, x["lo"] + 1, x["n"] + (length - 1)).alias("bytes")))
    cut = d.join(a, F.col("d.doc").eqNullSafe(F.col("a.doc")) & (F.col("d.mark") == F.col("a.mark"))).select(F.inline(bytes_of))
    found = stored(in_shards(cut, length))
    flags = found.filter("part < 0").select("anchor", "region", "starts").union(across(found.filter("part >= 0").select("anchor", "part", "entries")))
    equal = distinct.filter("copies > 1").select("anchor", "region", F.lit(None).cast("array<int>").alias("starts"))
    single = flags.join(distinct.filter("copies = 1").select("anchor", "region"), ["anchor", "region"])
    answers = single.union(equal)
    mixed = hits.filter("mixed").join(answers, ["anchor", "region"])
    plain = hits.filter("not mixed").withColumn("starts", F.lit(None).cast("array<int>"))
    every = mixed.select("doc", "mark", "span", "starts").union(plain.select("doc", "mark", "span", "starts"))
    spans = F.when(F.col("starts").isNull(), F.array(lo, lo + n)).otherwise(F.transform("starts", lambda x: x + lo))
    return every.groupBy("doc", "mark").agg(F.flatten(F.collect_set(spans)).alias("starts"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, per_shard: int = REGIONS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per input row ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, what is left of the UTF-8 text).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, overlaps and the same text included. Null texts count as
    empty; texts shorter than ``length`` stay whole; null ids are kept and told apart by their text; rows with the same id and text repeat each other, so
    they go as any copies do; an empty table gives an empty result.
    """
    if not 8 <= gram < length <= 1023 + gram - 1:
        raise ValueError("the gram must be at least 8 bytes, and at most 1023 grams fit into the length")
    docs = df.select(col(id_col).alias("doc"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    r = repeated(docs, length, gram, per_shard, shard_bytes).alias("r")
    d = docs.alias("d")
    joined = d.join(r, F.col("d.doc").eqNullSafe(F.col("r.doc")) & (F.col("d.mark") == F.col("r.mark")), "left").select(F.col("d.doc").alias(id_col), F.col("d.text").alias("t"), F.col("r.starts").alias("s"))

    def make():
        def work(values: list[dict]) -> dict[str, list]:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for v in values:
                data = v["t"].encode("utf-8", "surrogatepass")
                s = v["s"] or []
                gone: list[list[int]] = []
                for a, b in sorted(zip(s[::2], s[1::2])):
                    b += length - 1
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                for k, x in zip(out, (len(data), len(data) - len(left), len(gone), left), strict=True):
                    out[k].append(x)
            return out

        return work

    return map_texts(joined, [id_col], F.struct("t", "s"), schema("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"), make, F.octet_length("t"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))
