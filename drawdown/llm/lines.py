"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within EDITS of each other share, in one of EDITS + 1 even segments of the shorter one, a piece that no edit touched. Every distinct line
is indexed by its segments and probes, for each shorter length, the few substrings that can meet them there; lines that meet are compared by banded bit-parallel
edit distance over what is left between their common prefix and suffix. A piece that more than HOT lines have, as in lines made from one template, is
not paired: those lines are indexed anew, within the piece, by FINE times as many segments, of which only the rare ones count.
"""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, stored, table, text_of
from .components import components

#: Lines are near copies at up to this many edited characters; shorter lines than LEAST characters have none. The query and the pipeline remove
#: exact repeats from EXACT characters on: all but empty lines.
EDITS, LEAST, EXACT = 2, 16, 1
#: Lines that one piece pairs at most with a probe, and how much finer the segments are beyond that.
HOT, FINE = 1024, 3
#: Frequent letters that are counted in every line; an edit changes at most two of the counts by one.
COUNTED = "enatirs"
#: Hashes of 8 bytes that are sent to all lines at most, instead of dealing the lines.
BROADCAST = 1_000_000
#: Steps of the search for common prefixes and suffixes; they reach twice the largest.
STEPS = [1 << k for k in range(30, -1, -1)]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segment(length: Column, n: int, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of n even ones of a line: the last ones are a character longer where it doesn't come out even."""
    base = F.floor(length / n).cast("int")
    short = F.lit(n) - length % n
    return base * i + F.greatest(F.lit(0), i - short), base + (i >= short).cast("int")


def offsets(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, offset) of all substrings of a longer line that can meet a segment of a shorter one: segment i has at most i
    edits before it, and at most ``edits - i`` behind it."""
    return [(d, i, o) for d in range(edits + 1) for i in range(edits + 1) for o in range(-edits, 2 * edits + 1) if abs(o) <= i and abs(o - d) <= edits - i]


def fine_offsets(edits: int) -> list[tuple[int, int, int]]:
    """The same for finer segments, any of which may be the one that no edit touched."""
    return [(d, i, o) for d in range(edits + 1) for i in range(FINE * (edits + 1)) for o in range(-edits, edits + 1) if abs(o) <= i and abs(o) + abs(d - o) <= edits]


def piece(wide: Column, start: Column, size: Column, *more: Column) -> Column:
    """Hash of a substring. ``wide`` has four bytes a character, so that its place is found without reading what stands before it."""
    return F.xxhash64(F.substring(wide, start * 4 + 1, size * 4), *more)


def with_wide(lines: DataFrame) -> DataFrame:
    wide = F.encode("line", "UTF-32")
    return lines.withColumn("wide", wide).withColumn("size", (F.octet_length("wide") / 4).cast("int"))


def index_keys(edits: int) -> list[Column]:
    wide, size = F.col("wide"), F.col("size")
    return [piece(wide, *segment(size, edits + 1, F.lit(i)), F.lit(i), size) for i in range(edits + 1)]


def probe_keys(edits: int) -> list[Column]:
    """Keys of the substrings that can meet another line's segments, but for the line's own segments, which :func:`index_keys` gives."""
    wide, size, out = F.col("wide"), F.col("size"), []
    for d, i, o in offsets(edits):
        if d or o:
            start, n = segment(size - d, edits + 1, F.lit(i))
            out.append(piece(wide, start + o, n, F.lit(i), size - d))
    return out


def fine_keys(edits: int, probe: bool) -> Column:
    """Keys of the finer segments, or of what can meet them, within the piece ``group``; null where a substring would not lie in the line."""
    wide, size, n = F.col("wide"), F.col("size"), FINE * (edits + 1)
    wanted = fine_offsets(edits) if probe else [(0, i, 0) for i in range(n)]

    def key(e: Column) -> Column:
        start, long = segment(size - e["d"], n, e["i"])
        return F.when((start + e["o"] >= 0) & (start + e["o"] + long <= size), piece(wide, start + e["o"], long, e["i"], size - e["d"], F.col("group")))

    return F.transform(F.from_json(F.lit(json.dumps([{"d": d, "i": i, "o": o} for d, i, o in wanted])), "array<struct<d:int,i:int,o:int>>"), key)


def bag(line: Column, size: Column) -> Column:
    """The numbers of the counted letters and the length, each modulo 256, in one long."""
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit(""))) for x in COUNTED]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(n.bitwiseAND(F.lit(255)).cast("bigint"), 8 * k) for k, n in enumerate([*counts, size])])


def bags_within(x: Column, y: Column, edits: int) -> Column:
    """Whether two bags can belong to lines at most ``edits`` apart: neither has more than that many characters too many."""
    part = lambda v, k: F.shiftrightunsigned(v, 8 * k).bitwiseAND(F.lit(255))
    apart = [(part(x, k) - part(y, k) + 128).bitwiseAND(F.lit(255)) - 128 for k in range(len(COUNTED) + 1)]
    apart[-1] = apart[-1] - sum(apart[1:-1], apart[0])  # all other characters
    more, less = (sum(v[1:], v[0]) for v in ([F.greatest(a, F.lit(0)) for a in apart], [F.greatest(-a, F.lit(0)) for a in apart]))
    return (more <= edits) & (less <= edits)


def common(a: Column, b: Column, most: Column, end: bool) -> Column:
    """Length of the common prefix, or suffix, up to ``most``, by doubling steps from large to small."""

    def search(w: Column) -> Column:
        def longer(n: Column, k: Column) -> Column:
            x, y = (a.substr(w["la"] - n - k + 1, k), b.substr(w["lb"] - n - k + 1, k)) if end else (a.substr(n + 1, k), b.substr(n + 1, k))
            return F.when((n + k <= w["most"]) & (x == y), n + k).otherwise(n)

        return F.aggregate(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k <= w["most"]), F.lit(0), longer)

    return let(F.struct(F.length(a).alias("la"), F.length(b).alias("lb"), most.alias("most")), search)


def bit(x: Column, place: Column | int) -> Column:
    return F.call_function("shiftright", x, place if isinstance(place, Column) else F.lit(place)).bitwiseAND(F.lit(1))


def banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``edits``; more than ``edits`` if it is more.

    Bit k of the band stands for row ``j - edits + k`` of column j, so the band moves down its diagonal as the columns are read.
    """
    band = (1 << 2 * edits + 1) - 1
    lost = 1 << 20
    pad = "\x01" * (edits + 1)  # the same start on both sides: the pattern is then longer than the band is deep
    both = F.struct(F.split(F.concat(F.lit(pad), a), "").alias("rows"), F.split(F.concat(F.lit(pad), b), "").alias("columns"),
                    (F.length(a) + len(pad)).alias("m"), (F.length(b) + len(pad)).alias("n"))
    start = F.struct(F.lit(((1 << edits + 1) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("far"))

    def inverse(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(band))

    def column(w: Column, state: Column, j: Column) -> Column:
        vp, vn, far, m, n = state["vp"], state["vn"], state["far"], w["m"], w["n"]
        hits = let(F.get(w["columns"], j), lambda c: reduce(lambda x, y: x + y, [F.when(F.get(w["rows"], j + (k - edits)) == c, 1 << k).otherwise(0) for k in range(2 * edits + 1)]))

        def after(match: Column) -> Column:
            diagonal = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(band))
            return let(diagonal, moved)

        def moved(d0: Column) -> Column:
            return let(F.struct(vn.bitwiseOR(inverse(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"), F.shiftright(d0, 1).alias("down"), d0.alias("d0")), scored)

        def scored(h: Column) -> Column:
            last = F.lit(2 * edits - 1) - (j - (m - edits))
            walked = far + F.when(j < m - edits, F.lit(1) - bit(h["d0"], 2 * edits)).otherwise(bit(h["hp"], last) - bit(h["hn"], last))
            hopeless = (j < m - edits) & (walked > F.lit(2 * edits) + n - m)
            return F.struct(h["hn"].bitwiseOR(inverse(h["down"].bitwiseOR(h["hp"]))).alias("vp"), h["down"].bitwiseAND(h["hp"]).alias("vn"), F.when(hopeless, lost).otherwise(walked).alias("far"))

        return F.when(far >= lost, state).otherwise(let(hits, after))

    return let(both, lambda w: F.aggregate(F.sequence(F.lit(0), w["n"] - 1), start, lambda state, j: column(w, state, j), lambda state: state["far"]))


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (columns a and b hold lines) at most ``edits`` apart."""
    a, b = F.col("a"), F.col("b")
    la, lb = F.length(a), F.length(b)
    shorter = F.least(la, lb)

    def cores(head: Column, tail: Column) -> Column:
        return F.struct(a.substr(head + 1, la - head - tail).alias("a"), b.substr(head + 1, lb - head - tail).alias("b"))

    def near(c: Column) -> Column:
        wide, narrow = F.greatest(F.length(c["a"]), F.length(c["b"])), F.least(F.length(c["a"]), F.length(c["b"]))
        return F.when(wide <= edits, True).when(narrow == 0, False).otherwise(banded(c["a"], c["b"], edits) <= edits)

    trimmed = let(common(a, b, shorter, False), lambda head: let(common(a, b, shorter - head, True), lambda tail: let(cores(head, tail), near)))
    return pairs.filter((F.abs(la - lb) <= edits) & trimmed)


def judged(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row per line of at least ``least`` characters: doc and mark (which tell rows apart), place in the text, line and its hash."""
    rows = df.select(col(id_col).alias("doc"), text_of(text_col).alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rows.filter(F.length("line") >= least).withColumn("key", F.xxhash64("line"))


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """Links between different lines at most ``edits`` apart, by their hashes: a < b.

    Up to the pairs, a line is its hash and the hashes of its pieces; texts are read again for the lines of pairs only.
    """
    own, other = index_keys(edits), probe_keys(edits)
    names = [f"k{i}" for i in range(len(own) + len(other))]
    # one row a line: whole numbers only, so repeats fall together where they are read
    made = [bag(F.col("line"), F.col("size")).alias("bag"), *[k.alias(n) for n, k in zip(names, [*own, *other])]]
    distinct = with_wide(lines.select("key", "line")).select("key", *made).distinct()
    mine, theirs = (F.explode(F.array(*n)).alias("at") for n in (names[:len(own)], names[len(own):]))
    # a piece answers once: with its line if it belongs to one, as most do, and else with the number of its lines
    pieces = distinct.select("key", mine).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    answers = pieces.select("at", "n", F.when(F.col("n") == 1, F.col("key")).alias("key"))
    asked = distinct.select(F.col("key").alias("other"), "bag", mine, F.lit(True).alias("own")).union(distinct.select(F.col("key").alias("other"), "bag", theirs, F.lit(False).alias("own")))
    met = stored(asked.join(answers.hint("shuffle_hash"), "at").filter(F.col("key").isNull() | (F.col("key") != F.col("other"))))
    pairs = met.filter(F.col("key").isNotNull()).select(F.least("key", "other").alias("ka"), F.greatest("key", "other").alias("kb"))
    shared = met.filter(F.col("key").isNull()).select("at", F.col("other").alias("key"), "bag", "own", "n")
    # letter counts rule out most lines that only share a piece before a pair is made of them
    few = shared.filter(F.col("n") <= HOT)
    one, two = few.filter("own").select("at", F.col("key").alias("x"), F.col("bag").alias("bx")), few.select("at", F.col("key").alias("y"), F.col("bag").alias("by"), "own")
    both = one.join(two, "at").filter(((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") != F.col("y")))) & bags_within(F.col("bx"), F.col("by"), edits))
    pairs = pairs.union(both.select(F.least("x", "y").alias("ka"), F.greatest("x", "y").alias("kb")))
    hot = shared.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        pairs = pairs.union(hot_pairs(lines, hot.filter("own").select("at", "key"), hot.select("at", "key").distinct(), edits))
    pairs = stored(pairs.distinct())
    text = stored(texts_of(lines, pairs.select(F.explode(F.array("ka", "kb")).alias("key"))))
    a, b = text.select(F.col("key").alias("ka"), F.col("line").alias("a")), text.select(F.col("key").alias("kb"), F.col("line").alias("b"))
    return within(pairs.join(a, "ka").join(b, "kb"), edits).select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and line of the wanted lines. Two lines with one 64-bit hash count as the smaller of them. Up to BROADCAST hashes go to the lines; beyond, both are dealt by hash."""
    wanted = stored(wanted.distinct())
    few = wanted.count() <= BROADCAST
    return lines.select("key", "line").join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.min("line").alias("line"))


def hot_pairs(lines: DataFrame, hot: DataFrame, reached: DataFrame, edits: int) -> DataFrame:
    """Pairs (ka, kb) of lines that meet on a hot piece and again on a finer segment there.

    Of a line's finer segments, ``edits`` can be touched, so any ``edits + 1`` rare ones are enough to meet on; only a line with fewer uses all of them. There lines
    meet that differ in a few characters of a long common text; the join makes a row only of those whose letter counts allow it.
    """
    group = F.col("at").alias("group")
    known = stored(texts_of(lines, reached.select("key")))
    known = with_wide(known).withColumn("bag", bag(F.col("line"), F.col("size")))
    made = lambda rows, probe: rows.select("key", group).join(known, "key").select("key", "group", "bag", F.explode(fine_keys(edits, probe)).alias("fine"))
    fine = stored(made(hot, False))
    rare = fine.groupBy("fine").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= HOT).select("fine")
    chosen = stored(fine.join(rare, "fine"))
    enough = chosen.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > edits).select("key", "group")
    index = chosen.join(enough, ["key", "group"], "left_semi").unionByName(fine.join(enough, ["key", "group"], "left_anti"))
    probe = made(reached, True).select(F.col("key").alias("other"), "fine", F.col("bag").alias("theirs"))
    met = probe.join(index.select("key", "fine", "bag"), "fine").filter((F.col("key") != F.col("other")) & bags_within(F.col("bag"), F.col("theirs"), edits))
    return met.select(F.least("key", "other").alias("ka"), F.greatest("key", "other").alias("kb"))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """Per distinct row with a judged line that repeats or has near copies: doc, mark, exact and near (places of removed lines), n_links and classes.

    A line of ``exact`` characters or more (default: ``least``) is removed if it occurs before, in the order of id, hash of the text and place (exact), and
    one of ``least`` or more also if a different one at most ``edits`` apart occurs first before it (near). n_links sums, over the row's lines, the different lines that each is linked to.
    classes holds, for each of these lines, its place and its class: the id of the first document with a line that repeats and links lead to.
    """
    lines = judged(df, id_col, text_col, least if exact is None else exact)
    links = stored(near_lines(lines.filter(F.length("line") >= least), edits))
    light = stored(lines.select("doc", "mark", "place", "key"))
    firsts = stored(light.groupBy("key").agg(F.min(F.struct("doc", "mark", "place")).alias("first"), F.count(F.lit(1)).alias("n")))
    both = links.select("a", "b").union(links.select("b", "a"))
    own, other = firsts.select(F.col("key").alias("a"), F.col("first").alias("fa")), firsts.select(F.col("key").alias("b"), F.col("first").alias("fb"))
    linked = both.join(own, "a").join(other, "b").groupBy(F.col("a").alias("key")).agg(F.max(F.col("fb") < F.col("fa")).alias("later"), F.count(F.lit(1)).alias("links"))
    known = stored(firsts.join(linked, "key", "left").filter((F.col("n") > 1) | F.col("links").isNotNull()))
    rooted = known.filter(F.col("links").isNotNull()).join(components(links), F.col("key") == F.col("node")).select("key", "root", "first")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("top")), "root").select("key", "top")
    known = stored(known.join(classes, "key", "left").withColumn("class", F.coalesce("top", "first")["doc"]).drop("top"))
    # known is stored, so that the join deals both sides itself and can split a line that very many rows have
    found = light.join(known, "key").withColumn("again", ~F.struct("doc", "mark", "place").eqNullSafe(F.col("first")))
    gone = F.when(F.col("again"), F.lit("exact")).when(F.col("later"), F.lit("near"))
    return found.withColumn("gone", gone).groupBy("doc", "mark").agg(
        F.sort_array(F.collect_set(F.when(F.col("gone") == "exact", F.col("place")))).alias("exact"),
        F.sort_array(F.collect_set(F.when(F.col("gone") == "near", F.col("place")))).alias("near"),
        F.sum(F.coalesce("links", F.lit(0))).alias("n_links"),
        F.sort_array(F.collect_set(F.struct("place", "class"))).alias("classes"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """``df`` with the removed lines taken out of the text; every row stays, a text may become empty.

    A null text stays null and an empty one empty. Null ids come first in the order. Rows with the same id and text count as one place, so they do not
    remove each other's lines. Lines shorter than ``exact`` (default: ``least``) and all others keep their order and line ends. Long lines are compared whole. Other columns are carried along,
    whatever their names; an empty table gives an empty result.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    id_, text = names[id_col], names[text_col]
    rows = df.select(*[col(c).alias(n) for c, n in names.items()])
    gone = removals(rows, id_, text, edits, least, exact).select("doc", "mark", F.array_union("exact", "near").alias("gone"))
    out = rows.withColumn("key", F.xxhash64(text_of(text))).join(gone, F.col(id_).eqNullSafe(F.col("doc")) & (F.col("key") == F.col("mark")), "left")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    left = F.when(F.size("gone") > 0, let(parts, lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))).otherwise(F.col(text))
    return out.select(*[(left if n == text else F.col(n)).alias(c) for c, n in names.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the judged ones (all but empty), removed exact and near copies, links of its lines, the removed places, and place:class of its lines that repeat or are linked."""
    docs = table(spark, sf_dir, "documents")
    gone = removals(docs, exact=EXACT)
    parts = F.split(text_of("text"), "\n")
    rows = docs.select("doc_id", F.xxhash64(text_of("text")).alias("mark"), F.size(parts).cast("bigint").alias("n_lines"), F.size(F.filter(parts, lambda x: F.length(x) >= EXACT)).cast("bigint").alias("n_judged"))
    out = rows.join(gone, rows.doc_id.eqNullSafe(gone.doc) & (rows.mark == gone.mark), "left")
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    classes = F.array_join(F.transform(F.coalesce("classes", F.array().cast(gone.schema["classes"].dataType)), lambda x: F.concat_ws(":", x["place"].cast("string"), F.coalesce(x["class"].cast("string"), F.lit("")))), ",")
    return out.select("doc_id", "n_lines", "n_judged", F.size(exact).cast("bigint").alias("n_exact"), F.size(near).cast("bigint").alias("n_near"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.array_join(F.sort_array(F.array_union(exact, near)).cast("array<string>"), ",").alias("removed"), classes.alias("classes"))
