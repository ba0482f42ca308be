"""Cost-balanced packing of token sequences.

Reading and running a piece of n tokens costs LINEAR * n + QUADRATIC * n ** 2: the second part is its attention. Documents are tokenised where they
are read and packed in windows of a task, so nothing is shuffled. In a window the sequences have together exactly the room of its tokens; the remainders
of documents, longest first, each go to the sequence of lowest cost that has room for it, and are cut only where none has.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import col, table, text_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY, END = 1024, 0
#: Cost of a token, and of a pair of tokens of one piece: at 2048 tokens, attention costs as much as the rest.
LINEAR, QUADRATIC = 2048.0, 1.0
#: Tokens of a window: the bound of what a task holds, but for a longer document.
WINDOW = 1 << 21
#: Sequences of one task are numbered from its partition's number times this.
NUMBERS = 1 << 40
#: The tokenizer's splitting pattern, written without backtracking (fixed value, from the public byte-level BPE tokenizers).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str):
    """Token ids of a text as an unsigned 32-bit array, equal to those of the tokenizers library for ``vocabulary``; a special string in a text is one token."""
    import base64
    import json

    with open(vocabulary, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=known, special_tokens=special)
    plain = code.encode_ordinary

    def ids(text: str) -> np.ndarray:
        return np.array(code.encode(text, allowed_special="all") if any(s in text for s in special) else plain(text), np.uint32)

    return ids


def rooms(tokens: int, capacity: int) -> list[int]:
    """Room of the sequences for ``tokens`` tokens: full ones, and powers of two for what is left over, which need no padding."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def deal(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (item, start, length, sequence, offset) of items of at most ``capacity`` tokens, and the cost of every sequence."""
    room = rooms(int(sizes.sum()), capacity)
    cost = np.zeros(len(room))
    used = [0] * len(room)
    # one heap of (cost, sequence) for every room; ``least`` has the cost on top of each
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    least = np.full(capacity + 1, np.inf)
    for s, r in enumerate(room):
        heappush(heaps[r], (0.0, s))
        least[r] = 0.0
    pieces = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[item])
        while left:
            at = left + int(least[left:].argmin())
            if least[at] == np.inf:  # no sequence has room for all of it
                at = int(least[1:].argmin()) + 1
            now, s = heappop(heaps[at])
            least[at] = heaps[at][0][0] if heaps[at] else np.inf
            n = min(at, left)
            pieces.append((item, start, n, s, used[s]))
            used[s] += n
            cost[s] = now + linear * n + quadratic * n * n
            if at > n:
                heappush(heaps[at - n], (cost[s], s))
                least[at - n] = heaps[at - n][0][0]
            start, left = start + n, left - n
    return pieces, cost


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC,
         vocabulary: str = TOKENIZER, ranks: str = RANKS, window: int = WINDOW) -> DataFrame:
    """Every document's tokens and the id ``end``, in pieces: ``id_col``, start, length, doc_tokens, sequence_id, offset, sequence_cost, ids (binary, little-endian
    unsigned 32-bit integers).

    A sequence holds ``capacity`` tokens, or a power of two of them at the end of a window, so none needs padding. A null or empty text is its end id
    alone; null ids are kept; repeated rows are documents of their own; an empty table gives an empty result; other columns are not looked at. Sequences
    do not cross tasks, so a task that is run again gives the same pieces.
    """
    rows = df.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_cost double, ids binary")])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        last = np.array([end], np.uint32)
        number = TaskContext.get().partitionId() * NUMBERS
        ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            """The window's pieces: whole sequences of one document, then the dealt remainders."""
            nonlocal number, held
            size = np.array([len(d) for d in docs])
            whole = size // capacity
            doc = np.repeat(np.arange(len(docs)), whole)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
            pieces, cost = deal(size % capacity, capacity, linear, quadratic)
            item, begin, length, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            begin = begin + whole[item] * capacity
            full = linear * capacity + quadratic * capacity * capacity
            column = lambda a, b: np.concatenate([a, b])
            which, start, n = column(doc, item), column(nth * capacity, begin), column(np.full(len(doc), capacity), length)
            row = [start, n, size[which], column(number + np.arange(len(doc)), number + len(doc) + sequence), column(np.zeros(len(doc), int), offset),
                   column(np.full(len(doc), full), cost[sequence])]
            keys = pa.array(ids, pa_kind)
            for k in range(0, len(which), 4096):
                cut = slice(k, k + 4096)
                held_ids = [docs[d][a:a + b].astype("<u4").tobytes() for d, a, b in zip(which[cut].tolist(), start[cut].tolist(), n[cut].tolist())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(which[cut])), *(pa.array(c[cut]) for c in row), pa.array(held_ids, pa.binary())], names=names)
            number += len(doc) + len(cost)
            ids.clear()
            docs.clear()
            held = 0

        for batch in batches:
            pa_kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                got = np.append(encode(batch.column(1)[i].as_py()), last)
                if held and held + len(got) > window:
                    yield from closed()
                ids.append(batch.column(0)[i].as_py())
                docs.append(got)
                held += len(got)
        if held:
            yield from closed()

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost")
