"""Exact token counts by prefix dynamic programming.

For every byte prefix of a pre-token exactly one token ends its encoding: the one whose pairing with the last token of what stands before
it survives the merges. One pass over the prefixes therefore gives the last token and the count of each from shorter ones, so the count of the whole,
the count at any cut and the longest cut within a budget are all read from the same table.
"""
from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytebpe import PATTERN, Words, by_words
from .common import map_texts, schema, table, text_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
#: Contractions that the splitting pattern takes whole, but whose first two characters it splits: fixed values.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others
    for the letters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes, as the library for the vocabulary file gives them without added tokens; a special
    string inside a text is one token."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        as_bytes = lambda t: bytes(letter[c] for c in t)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = {bytes([b]): b for b in range(256)}
        for i, (a, b) in enumerate(pairs):
            ranks.setdefault(as_bytes(a) + as_bytes(b), 256 + i)
        self.tokens = ranks
        self.longest = max(map(len, ranks))
        self.merged = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(pattern)
        self.spaces = regex.compile(r"\s+")
        self.fits: dict[int, bool] = {}
        self.words = Words(self._words)
        self.known: dict[str, int] = {}

    def compatible(self, before: int, a: bytes, after: int, b: bytes) -> bool:
        """Whether the merges leave the tokens a|b as they are; nothing before (-1) is compatible with a token that the merges build."""
        key = before << 32 | after
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[key] = self.merged(a + b) == ([after] if before < 0 else [before, after])
        return got

    def table(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one pre-token.

        Only one last token is possible for a prefix, so the likely ones are tried first: the last token of the prefix one byte shorter,
        extended, then the single byte, then all others.
        """
        starts, ids, count = [0], [-1], [0]
        tokens, fits = self.tokens, self.fits
        for end in range(1, len(data) + 1):
            for start in (starts[-1], end - 1, *range(max(0, end - self.longest), end - 1)):
                token = tokens.get(data[start:end])
                if token is not None:
                    before = ids[start]
                    fit = fits.get(before << 32 | token)
                    if fit is None:
                        fit = self.compatible(before, data[starts[start]:start], token, data[start:end])
                    if fit:
                        starts.append(start)
                        ids.append(token)
                        count.append(count[start] + 1)
                        break
        return count

    def letters(self, token: str) -> list[int]:
        """Token counts of the character prefixes of one pre-token, the empty one first."""
        counts = self.table(token.encode("utf-8", "surrogatepass"))
        if token.isascii():
            return counts
        ends = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in token)])
        return [counts[i] for i in ends.tolist()]

    def _words(self, text: str) -> int:
        total, known = 0, self.known
        for t in self.pattern.findall(text):
            n = known.get(t)
            if n is None:
                n = self.table(t.encode("utf-8", "surrogatepass"))[-1]
                if len(t) <= 64:
                    if len(known) >= 1_000_000:
                        known.clear()
                    known[t] = n
            total += n
        return total

    def parts(self, text: str) -> list[str]:
        """Plain stretches of a text; between each two stands a special string."""
        return self.split_special.split(text) if self.split_special else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return sum(sum(by_words(p, self.words)) for p in parts) + len(parts) - 1

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        total, at = 0, 0
        for token in self.pattern.findall(text):
            counts = self.letters(token)
            if token in CONTRACTIONS:
                counts = [0, 1, 2, counts[-1]]  # cut after two characters, both stand alone
            out[at + 1:at + len(token) + 1] = np.array(counts[1:]) + total
            total += counts[-1]
            at += len(token)
        for m in self.spaces.finditer(text):  # white space at the end of a prefix is one pre-token
            out[m.start() + 1:m.end() + 1] = out[m.start()] + np.array(self.letters(m[0])[1:])
        if len(text):
            out[-1] = total
        return out

    def prefix(self, text: str) -> np.ndarray:
        """The exact count of ``text[:k]`` for every k from 0 to its length."""
        out, total, at = [np.zeros(1, np.int64)], 0, 0
        found = list(self.split_special.finditer(text)) if self.split_special else []
        for m in found:
            # a special string that is cut is ordinary text
            counts = self._plain(text[at:m.end() - 1]) + total
            total += self._plain(text[at:m.start()])[-1] + 1
            out += [counts[1:], np.array([total])]
            at = m.end()
        return np.concatenate([*out, (self._plain(text[at:]) + total)[1:]])

    def longest_within(self, text: str, budget: int) -> int:
        """The length of the longest prefix of at most ``budget`` tokens, found without encoding any prefix anew."""
        cut = [0, *(m.end() for m in regex.finditer(r"\S(?= )", text)), len(text)]
        if not self.special or not any(s in text for s in self.special):
            counts = [0, *np.cumsum([sum(self.words.value(text[a:b]) for a, b in [(x, y)]) for x, y in zip(cut, cut[1:])]).tolist()] if len(cut) < 64 else None
            if counts is None:
                total, counts = 0, [0]
                for x, y in zip(cut, cut[1:]):
                    piece = text[x:y]
                    total += self.words[piece[1:]] if piece[:1] == " " else self.words.value(piece)
                    counts.append(total)
                    if total > budget + 64:  # later prefixes hold all of these tokens
                        break
            k = bisect_left(counts, budget + 1)
            if k >= len(counts):
                return len(text)
            start = cut[k - 1]
            inner = self._plain(text[start:cut[min(k, len(cut) - 1)]]) + counts[k - 1]
            return start + int(np.flatnonzero(inner <= budget)[-1])
        return int(np.flatnonzero(self.prefix(text) <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str, pattern: str = PATTERN) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Sequence[int] = (LIMIT,), path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Per input row ``id_col``, n_bytes, n_tokens (long) and ``cuts``: for each budget the characters of the longest prefix within it.

    A null or empty text has no tokens; a null id stays null; repeated rows repeat; an empty table gives an empty result.
    """
    want = tuple(budgets)

    def make():
        c = counter(path, pattern)

        def work(values: list[str]) -> dict[str, list]:
            counts = [c.count(v) for v in values]
            return {"n_bytes": [len(v.encode("utf-8", "surrogatepass")) for v in values], "n_tokens": counts,
                    "cuts": [[len(v) if n <= b else c.longest_within(v, b) for b in want] for v, n in zip(values, counts, strict=True)]}

        return work

    return map_texts(df, [id_col], text_of(text_col), schema("n_bytes bigint, n_tokens bigint, cuts array<int>"), make)


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Per input row ``id_col`` and ``counts``, the token count of every character prefix, the empty one first."""

    def make():
        c = counter(path, pattern)
        return lambda values: {"counts": [c.prefix(v).tolist() for v in values]}

    return map_texts(df, [id_col], text_of(text_col), schema("counts array<int>"), make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("cuts")[0].alias("chars_within_limit"))
