"""Prefix trie of conversations over node tables with minimal perfect hashing.

Conversations, cut into segments of at most SEGMENT turns, are dealt into shards. A shard enumerates its distinct prefix digests, gives each a slot by a
minimal perfect hash that is verified against what the slot holds, and scatters its counts into flat arrays. Slots of one digest meet once, so that every node has its
counts over all shards; the shard of a node's smallest member then accounts for the node, and adds leaves and savings up through the array of parent slots,
deepest first. As a node's whole path lies in that shard, or in earlier segments of the same conversation, the shards' sums are parts of the whole sums.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import col, stored, table

#: Turns of a segment, and of all segments of a shard, at most.
SEGMENT, SHARD = 1024, 1 << 16
#: Digest of the empty sequence.
ROOT = hashlib.sha256(b"").digest()[:16]
#: Positions a key in a level of the hash; fewer levels for more bits.
SPREAD = 2
#: Conversations share the head of the one their number is a multiple of.
FAMILY, HEADS = 20, 4


def chained(before: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(before + turn).digest()[:16]


def stand_in(digest: bytes) -> bytes:
    return bytes(b ^ 255 for b in digest)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 128-bit keys (two columns) for one level."""
    with np.errstate(over="ignore"):
        x = (keys[:, 0] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ keys[:, 1] ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys. In every level, keys that are alone at their position stay there and the others go on to the
    next; a slot is the number of taken positions before the key's. The levels are bits only, keys are not kept."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        total, left = 0, keys
        while len(left):
            size = max(2, SPREAD * len(left))
            at = (mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            self.before.append(total + np.cumsum(alone) - alone)
            total += int(alone.sum())
            left = left[~alone[at]]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that was not given gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = (mixed(keys[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


def as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def node_table(segments: list[dict]) -> dict[str, list]:
    """The nodes of a shard by slot: digest, parent (slot, -1 if none), above (the parent's digest), depth, words, n (members), least (smallest member), ends (members that end there).

    A segment (conv, no, start: digest before it, turns, words, whole: digest of a full segment, last) whose number is not 0 also brings a stand-in for the node
    before it, with a key of its own and without members, so that sums end there.
    """
    digest, above, depth, words, conv, counts, end = [], [], [], [], [], [], []
    for s in segments:
        now, d = s["start"], s["no"] * SEGMENT
        if d:
            now = stand_in(now)
        digest.append(now)
        above.append(b"")
        depth.append(d)
        words.append(0)
        conv.append(s["conv"])
        counts.append(int(d == 0))
        end.append(d == 0 and not s["turns"])
        for i, (turn, n) in enumerate(zip(s["turns"], s["words"], strict=True)):
            above.append(now)
            now = s["whole"] if i + 1 == SEGMENT else chained(now if i else s["start"], turn)
            digest.append(now)
            depth.append(d + i + 1)
            words.append(n)
            conv.append(s["conv"])
            counts.append(1)
            end.append(False)
        end[-1] = s["last"]
    keys = as_keys(digest)
    distinct = np.unique(keys, axis=0)
    table_ = PerfectHash(distinct)
    held = np.zeros_like(distinct)
    held[table_.slots(distinct)] = distinct
    slot = table_.slots(keys)
    if (held[slot] != keys).any():  # a slot must hold the very key that asked for it
        raise RuntimeError("a slot holds another digest")
    size = len(distinct)
    flat = lambda fill: np.full(size, fill, np.int64)
    parent, deep, said, n, least = flat(-1), flat(0), flat(0), np.bincount(slot, counts, size).astype(np.int64), flat(np.iinfo(np.int64).max)
    child = np.array([bool(a) for a in above])
    real = np.flatnonzero(child)
    up = table_.slots(as_keys([above[i] for i in real.tolist()])) if len(real) else np.zeros(0, np.int64)
    parent[slot[real]], deep[slot], said[slot[real]] = up, depth, np.array(words, np.int64)[real]
    if (parent[slot[real]] != up).any() or (deep[slot] != depth).any() or (said[slot[real]] != np.array(words)[real]).any():
        raise RuntimeError("two sequences of turns have one digest")
    np.minimum.at(least, slot, np.array(conv, np.int64))
    ends: list[list[int]] = [[] for _ in range(size)]
    for i in np.flatnonzero(end).tolist():
        ends[slot[i]].append(conv[i])
    of = [b""] * size
    for s, k, c in zip(slot.tolist(), digest, counts):
        of[s] = k if c else stand_in(k)
    return {"slot": list(range(size)), "digest": of, "parent": parent.tolist(), "above": [of[p] if p >= 0 else None for p in parent.tolist()], "depth": deep.tolist(), "words": said.tolist(), "n": n.tolist(),
            "least": least.tolist(), "ends": [sorted(e) for e in ends]}


NODES = pa.schema([("slot", pa.int32()), ("digest", pa.binary()), ("parent", pa.int32()), ("above", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("least", pa.int64()),
                   ("ends", pa.list_(pa.int64()))])


def positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``at``, the rank of a row from 0 among those of its key in the given order. Rows are dealt by ranges of key and order together, so that a key
    with very many rows lies in many tasks; what meets of it elsewhere is one count a task."""
    rows = stored(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    parts = rows.groupBy(key, "part").agg(F.min("row").alias("from"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    return rows.join(parts, [key, "part"]).withColumn("at", F.col("row") - F.col("from") + F.col("before")).drop("row", "part", "from", "before")


def original(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, at (place from 0), turn (digest of role and text) and words of every row with a conversation number."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = df.filter(col(id_col).isNotNull()).select(col(id_col).cast("bigint").alias("conv"), col(turn_col).alias("no"), F.unhex(F.substring(F.sha2(both, 256), 1, 32)).alias("turn"),
                                                     F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    return positions(rows, "conv", ["no", "turn"]).select("conv", "at", "turn", "words")


def rebuilt(turns: DataFrame, head: Column) -> DataFrame:
    """conv, at, turn and words after every conversation got the first ``head`` turns of its family's first conversation for its own first ones; a
    conversation left without turns has one row, whose turn is null."""
    each = turns.select("conv").distinct().withColumn("head", head)
    heads = turns.filter(F.col("at") < HEADS - 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "words"))).alias("first"))
    families = each.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).join(heads.withColumnRenamed("conv", "family"), "family", "left")
    families = families.select("conv", "head", F.slice(F.coalesce("first", F.array().cast("array<struct<at:bigint,turn:binary,words:bigint>>")), F.lit(1), F.col("head")).alias("first"))
    one = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("words"))
    # the row without a turn is kept for each conversation, and goes where turns follow
    front = families.select("conv", F.explode(F.concat(F.array(one), "first")).alias("t")).select("conv", "t.at", "t.turn", "t.words")
    sizes = families.select("conv", "head", F.size("first").alias("got"))
    own = turns.join(sizes, "conv").filter(F.col("at") >= F.col("head")).select("conv", (F.col("at") - F.col("head") + F.col("got")).alias("at"), "turn", "words")
    return front.union(own)


def segments(turns: DataFrame) -> DataFrame:
    """conv, no, start, turns, words, whole and last of every segment, in the order of conv and no."""
    no = F.floor(F.col("at") / SEGMENT)
    made = stored(turns.groupBy("conv", no.alias("no")).agg(F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("at", "turn", "words")))).alias("t"))
                  .select("conv", "no", F.col("t.turn").alias("turns"), F.col("t.words").alias("words")))
    # only conversations of several segments are chained; a segment is one digest there
    inner = F.sha2(F.concat(F.lit("segment:"), F.array_join(F.transform("turns", lambda x: F.hex(x)), "")), 256)
    full = made.filter((F.col("no") == 0) & (F.size("turns") == SEGMENT)).select("conv")
    many = made.join(full, "conv", "left_semi").select("conv", "no", inner.alias("inner"), F.size("turns").alias("n"))
    chain = many.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("no", "inner"))).alias("c"), F.max("no").alias("final"))
    digests = F.aggregate("c", F.array(F.lit(ROOT.hex())), lambda done, x: F.concat(done, F.array(F.substring(F.sha2(F.concat(F.element_at(done, -1), x["inner"]), 256), 1, 32))))
    linked = chain.select("conv", "final", digests.alias("d")).select("conv", "final", "d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("final"))).alias("no"))
    linked = linked.select("conv", "no", "final", F.get("d", F.col("no").cast("int")).alias("start"), F.get("d", F.col("no").cast("int") + 1).alias("whole"))
    out = made.join(linked, ["conv", "no"], "left")
    hexed = lambda c: F.unhex(F.col(c))
    return out.select("conv", "no", F.coalesce(hexed("start"), F.lit(ROOT)).alias("start"), "turns", "words", hexed("whole").alias("whole"), (F.coalesce("final", F.lit(0)) == F.col("no")).alias("last"))


def local_nodes(parts: DataFrame) -> DataFrame:
    """The node tables of all shards, one row a node and shard. Shards are ranges of conversation numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and size + len(row["turns"]) + 1 > SHARD:
                    yield from rows(held, shard)
                    shard, held, size = shard + 1, [], 0
                held.append(row)
                size += len(row["turns"]) + 1
        if held:
            yield from rows(held, shard)

    def rows(held: list[dict], shard: int) -> Iterator[pa.RecordBatch]:
        nodes = pa.table([pa.array(v, NODES.field(k).type) for k, v in node_table(held).items()], schema=NODES)
        yield from nodes.append_column("shard", pa.array([shard] * len(nodes), pa.int64())).to_batches(8192)

    placed = parts.repartitionByRange("conv", "no").sortWithinPartitions("conv", "no")
    return stored(placed.mapInArrow(run, "slot int, digest binary, parent int, above binary, depth bigint, words bigint, n bigint, least bigint, ends array<bigint>, shard bigint"))


def whole_nodes(local: DataFrame, parts: DataFrame) -> DataFrame:
    """Per node over all shards: digest, n_convs, owner (smallest member), n_children, and what later segments of conversations add at a segment's end (later_leaves, later_saved)."""
    real = local.filter("n > 0")
    nodes = real.groupBy("digest").agg(F.sum("n").alias("n_convs"), F.min("least").alias("owner"), F.max("above").alias("above"), F.max("depth").alias("depth"), F.max("words").alias("words"))
    nodes = stored(nodes)
    children = nodes.filter(F.col("above").isNotNull()).groupBy("above").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("above", "digest")
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    owned = nodes.filter(F.col("depth") > SEGMENT).groupBy(F.col("owner").alias("conv"), F.floor((F.col("depth") - 1) / SEGMENT).alias("no")).agg(
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    behind = Window.partitionBy("conv").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    later = parts.filter("no > 0").select("conv", "no", "start").join(owned, ["conv", "no"], "left").select(F.col("start").alias("digest"), F.sum("leaves").over(behind).alias("l"), F.sum("saved").over(behind).alias("s"))
    later = later.groupBy("digest").agg(F.sum("l").alias("later_leaves"), F.sum("s").alias("later_saved"))
    none = F.lit(0).cast("bigint")
    return nodes.join(later, "digest", "left").select("digest", "n_convs", "owner", "n_children", F.coalesce("later_leaves", none).alias("later_leaves"), F.coalesce("later_saved", none).alias("later_saved"))


def accumulated(shard: pa.Table) -> pa.Table:
    """Leaves and savings of the nodes that the shard owns, added up through the parent slots, deepest first."""
    shard = shard.sort_by("slot")
    get = lambda c: np.asarray(shard[c], np.int64)
    parent, depth, owner = get("parent"), get("depth"), get("owner")
    own = (get("least") == owner) & (get("n") > 0)
    leaves = np.where(own, (get("n_children") == 0) + get("later_leaves"), 0)
    saved = np.where(own, (get("n_convs") - 1) * get("words") + get("later_saved"), 0)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(owner[parent], mask=~own | (parent < 0))
    out = pa.table({"digest": shard["digest"], "depth": depth, "owner": owner, "n_convs": shard["n_convs"], "n_children": shard["n_children"], "parent_owner": above, "leaves": leaves, "saved": saved})
    return out.filter(pa.array(get("n") > 0))


def end_digests(local: DataFrame) -> DataFrame:
    """digest and the SHA-256 of the numbers of the conversations that end at the node.

    Shards are ranges of numbers, so each has already joined its own; the joined texts, one a shard, stream through the hash in order.
    """
    texts = local.filter(F.size("ends") > 0).select("digest", F.col("ends")[0].alias("first"), F.array_join(F.col("ends").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest == now:
                    state.update(b",")
                else:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["digest", "ends_sha256"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    return texts.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(run, "digest binary, ends_sha256 string")


def shared_head(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: digest (of the path), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn_col``, null first, and equal ones by the digest of role and text; null roles and texts are empty ones. Rows without a
    conversation number belong to none and are left out. Repeated rows are turns of their own; a conversation without turns is a member of the root; an
    empty table gives no node. Other columns are not looked at. A conversation may have any number of turns: it is worked on by segments.
    """
    turns = stored(original(df, id_col, turn_col, role_col, text_col))
    parts = stored(segments(rebuilt(turns, shared_head(F.col("conv")))))
    local = local_nodes(parts)
    known = local.drop("above", "ends").join(whole_nodes(local, parts), "digest")
    sums = known.groupBy("shard").applyInArrow(accumulated, "digest binary, depth bigint, owner bigint, n_convs bigint, n_children bigint, parent_owner bigint, leaves bigint, saved bigint")
    nodes = sums.groupBy("digest").agg(F.max("depth").alias("depth"), F.max("owner").alias("conv_id"), F.max("parent_owner").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
                                       F.max("n_children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_digests(local), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
