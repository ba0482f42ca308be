"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks. Around every cut two readers pre-tokenise an overlap, one that started well before the cut and
one that starts at the cut; the first place where both have a boundary, after a non-space and before a space, is where the readers
have resynchronised and the text is stitched. Pieces between such places are encoded independently, in parallel over the cluster.
"""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import col, map_texts, schema, table, text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CHUNK = 16384
OVERLAP = 512
#: The longest alternative that looks ahead in the pattern; a boundary this near to the end of a window is not relied on.
MARGIN = 3


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def boundaries(compiled: regex.Pattern, text: str, start: int, end: int) -> set[int]:
    """Ends of the pre-tokens of ``text[start:end]``, read from ``start``, that do not depend on what follows the window."""
    sure = end if end == len(text) else end - MARGIN
    return {p for m in compiled.finditer(text, start, end) if (p := m.end()) <= sure}


def cuts(compiled: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where to stitch: at most one place a chunk; a cut without resynchronisation inside its overlap joins its two chunks."""
    found = [0]
    for at in range(chunk, len(text), chunk):
        end = min(len(text), at + overlap)
        before = boundaries(compiled, text, max(0, at - overlap), end)
        for p in sorted(before & boundaries(compiled, text, at, end)):
            if at <= p < len(text) and p > found[-1] and text[p] == " " and not text[p - 1].isspace():
                found.append(p)
                break
    return [*found, len(text)]


class Words(dict):
    """What ``value`` gives for a space and a word, remembered for short words; emptied when full."""

    def __init__(self, value, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.value, self.most, self.longest = value, most, longest

    def __missing__(self, word: str):
        got = self.value(" " + word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


#: A space after white space; elsewhere the place before a space is a boundary, whatever stands on either side.
WIDE = re.compile(r"\s ")


def by_words(text: str, words: Words) -> list:
    """The values of the parts of ``text`` between the boundaries before its spaces, in order."""
    if WIDE.search(text) is None and text[:1] != " ":
        first, *rest = text.split(" ")
        return [words.value(first), *map(words.__getitem__, rest)] if text else []
    out, start = [], 0
    for m in HARD.finditer(text):
        out.append(words.value(text[start:m.end()]))
        start = m.end()
    return [*out, words.value(text[start:])] if start < len(text) else out


#: A non-space before a space.
HARD = re.compile(r"\S(?= )")


def _ids(ranks: str, pattern: str, back: bool = False):
    def make():
        enc = encoding(ranks, pattern)
        words = Words(lambda t: np.array(enc.encode_ordinary(t), "<u4").tobytes())
        decoded = decoder(ranks, pattern) if back else None

        def work(texts: list[str]) -> dict[str, list]:
            ids = [b"".join(by_words(t, words)) for t in texts]
            out = {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return out | {"decoded_sha256": [hashlib.sha256(decoded(x)).hexdigest() for x in ids]} if back else out

        return work

    return make


def decoder(ranks: str, pattern: str):
    """A function from ids (little-endian unsigned 32-bit) to the bytes they stand for, concatenated."""
    enc = encoding(ranks, pattern)
    tokens = [b""] * (max(enc._mergeable_ranks.values()) + 1)
    for data, i in enc._mergeable_ranks.items():
        tokens[i] = data
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    size = np.array([len(x) for x in tokens], np.int32)
    start = (np.cumsum(size) - size).astype(np.int32)

    def decoded(v: bytes) -> bytes:
        ids = np.frombuffer(v, "<u4")
        n = size[ids]
        end = np.cumsum(n)
        return flat[np.repeat(start[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()

    return decoded


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, back: bool = False) -> DataFrame:
    """Token ids of every whole text: ``id_col``, n_tokens (long), ids (binary, little-endian unsigned 32-bit integers); with ``back`` also decoded_sha256, lowercase hex of
    what the ids decode to.

    One row per input row. A null or empty text has no tokens; a null id stays null; repeated rows give repeated results; an empty
    table gives an empty result; further columns of ``df`` are not looked at. The pattern must be one in which no match goes on from
    a non-space character into a space, as in all byte-level BPE patterns. Texts up to one chunk are encoded where they are read;
    pieces of longer ones are spread over the cluster and only their ids come together again, per text.
    """
    out = schema("n_tokens bigint, ids binary" + (", decoded_sha256 string" if back else ""))
    texts = df.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    short = map_texts(texts.filter(F.length("text") <= chunk), ["id"], F.col("text"), out, _ids(ranks, pattern, back))

    def make():
        compiled = regex.compile(pattern)

        def work(values: list[str]) -> dict[str, list]:
            at = [cuts(compiled, t, chunk, overlap) for t in values]
            return {"part": [[t[a:b] for a, b in zip(c, c[1:])] for t, c in zip(values, at, strict=True)]}

        return work

    long = texts.filter(F.length("text") > chunk).withColumn("digest", F.unhex(F.sha2("text", 256)))
    parts = map_texts(long, ["id", "digest"], F.col("text"), schema("part array<string>"), make).select("id", "digest", F.size("part").alias("n"), F.posexplode("part").alias("no", "text"))
    # the parts of one very long text go to different tasks
    parts = parts.repartition("digest", "no", "id")
    coded = map_texts(parts, ["id", "digest", "n", "no"], F.col("text"), schema("n_tokens bigint, ids binary"), _ids(ranks, pattern))
    whole = (coded.groupBy("id", "digest")
             .agg(F.array_sort(F.collect_set(F.struct("no", "ids"))).alias("parts"), (F.count(F.lit(1)) / F.first("n")).cast("int").alias("copies"))
             # joined as one string, which copies every part once
             .select("id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
             .select("id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids"))
    if back:
        whole = decode(whole, "id", "ids", ranks, pattern, ("n_tokens", "ids")).select("id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS, pattern: str = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """The bytes of every row's ids, concatenated: ``id_col``, ``keep`` and decoded (binary). Null ids decode to no bytes."""

    def make():
        decoded = decoder(ranks, pattern)
        return lambda values: {"decoded": [decoded(v) for v in values]}

    return map_texts(df, [id_col, *keep], F.coalesce(col(ids_col), F.lit(b"")), schema("decoded binary"), make)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Encode, then decode: ``id_col``, n_tokens, ids and decoded_sha256."""
    return encode(df, id_col, text_col, back=True, **how)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Encode, decode, and digest both."""
    coded = encode(df, id_col, text_col, **how).withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded, id_col, keep=("n_tokens", "ids_sha256"), **{k: how[k] for k in ("ranks", "pattern") if k in how})
    return back.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
