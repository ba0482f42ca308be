"""Quality rules combined by weak supervision.

Each rule votes for or against a text, or abstains. The votes of all texts are counted by pattern; expectation-maximisation over the
patterns estimates how often each rule is right in both classes, and a text is kept when its posterior probability of being good reaches
a half. Good texts are taken to be the majority of those that pass the base rule.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import col, map_texts, schema, stored, table, text_of

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Per rule: name, and the bounds of its measure at or below which it votes for, and above which it votes against, a text.
RULES: list[tuple[str, float, float]] = [
    ("symbols_per_word", 0.02, 0.10),
    ("repeated_words", 0.10, 0.30),
    ("repeated_lines", 0.05, 0.30),
    ("upper_case", 0.10, 0.40),
    ("shouting_words", 0.02, 0.20),
    ("word_length_off", 2.0, 5.0),
    ("unlike_words", 0.05, 0.25),
    ("top_word", 0.12, 0.25),
    ("few_distinct", 0.60, 0.85),
    ("unclosed_lines", 0.50, 0.95),
]
#: Word length that the length rule takes for usual.
USUAL_LENGTH = 5.0
#: Before the first step rules are taken to be right this often, and this share of texts to be good.
START_ACCURACY, START_GOOD = 0.8, 0.8
#: Texts added to every count of a vote, so that no probability is zero.
SMOOTH = 0.5
STEPS = 200


def measures(data: bytes) -> tuple[dict[str, int], list[float]]:
    """The base figures of a text and one number per rule, both from the whole text."""
    words = data.split()
    n = len(words)
    flat = b"".join(words)
    chars = len(flat.translate(None, CONTINUATION))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    repeat = 0
    if len(seen) < len(grams):
        until = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeat += i + 3 - max(i, until)
                until = i + 3
    base = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    if not n:
        return base, [0.0] * len(RULES)
    counts = Counter(words)
    upper = len(flat) - len(flat.translate(None, UPPER))
    marks = sum(c for w, c in counts.items() if b"!!" in w) if b"!!" in flat else 0
    odd = len(flat.translate(None, PLAIN))
    return base, [
        symbols / n,
        repeat / n,
        dup_lines / len(lines),
        upper / len(flat),
        marks / n,
        abs(chars / n - USUAL_LENGTH),
        odd / len(flat),
        max(counts.values()) / n if n >= 20 else 0.0,
        1 - len(counts) / n,
        sum(x.rstrip()[-1:] not in (b".", b"!", b"?", b'"', b":", b";", b",") for x in lines) / len(lines),
    ]


#: Bytes that continue a UTF-8 character; capitals; what ordinary prose is made of (letters, bytes of other alphabets, stops).
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
PLAIN = UPPER + bytes(range(97, 123)) + bytes(range(128, 256)) + b".,;:!?'\"-()"


def base_failed(base: dict[str, int]) -> bool:
    return base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > 50 * base["n_words"]


def votes(numbers: list[float]) -> str:
    """One letter a rule: + for, - against, 0 abstaining."""
    return "".join("+" if x <= good else "-" if x > bad else "0" for x, (_, good, bad) in zip(numbers, RULES))


def fit(patterns: dict[str, int]) -> tuple[float, np.ndarray]:
    """Prior probability of a good text, and per rule what a vote (for, against) adds to the log-odds of being good. Abstaining adds nothing."""
    v = np.array([[c != "0" and "+-".index(c) + 1 for c in k] for k in patterns], int)
    n = np.array(list(patterns.values()), float)
    cast = np.eye(3)[v][:, :, 1:]  # patterns x rules x votes
    prior = START_GOOD
    good = np.tile([START_ACCURACY, 1 - START_ACCURACY], (v.shape[1], 1))
    bad = good[:, ::-1].copy()
    for _ in range(STEPS):
        post = posterior(cast, prior, np.log(good / bad))
        by_good, by_bad, by_all = (np.einsum("p,prv->rv", w, cast) + SMOOTH for w in (n * post, n * (1 - post), n))
        now_good, now_bad, pooled = (x / x.sum(1, keepdims=True) for x in (by_good, by_bad, by_all))
        wrong = now_good[:, 0] < now_bad[:, 0]  # a rule that speaks for the wrong class says nothing
        now_good[wrong] = now_bad[wrong] = pooled[wrong]
        share = float(np.clip((n * post).sum() / n.sum(), 0.5, 0.99))
        moved = max(np.abs(now_good - good).max(), np.abs(now_bad - bad).max(), abs(share - prior))
        good, bad, prior = now_good, now_bad, share
        if moved < 1e-9:
            break
    return prior, np.log(good / bad)


def posterior(cast: np.ndarray, prior: float, log_odds: np.ndarray) -> np.ndarray:
    odds = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", cast, log_odds)
    return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


def figures(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus the base figures, base_failed and the votes."""

    def make():
        def work(values: list[str]) -> dict[str, list]:
            got = [measures(v.encode("utf-8", "surrogatepass")) for v in values]
            out = {k: [b[k] for b, _ in got] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            return out | {"base_failed": [base_failed(b) for b, _ in got], "votes": [votes(m) for _, m in got]}

        return work

    return map_texts(df, keep, text_of(text_col), schema("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, votes string"), make)


def judge(df: DataFrame, keep: list[str], text_col: str = "text", store: bool = True) -> DataFrame:
    """``keep`` plus the base figures, base_failed, votes, quality (posterior probability of a good text) and kept.

    All rows that pass the base rule are counted when the accuracies are estimated; what reaches the driver is one count for each of at most
    3 to the power of the number of rules vote patterns. Null and empty texts have no words and fail the base rule. Rows repeat as they do in ``df``; an
    empty table gives an empty result. With ``store`` the figures are written once; without, they are computed again for the result, which is
    better where ``keep`` holds the texts.
    """
    found = figures(df, keep, text_col)
    found = stored(found) if store else found
    counted = found if store else figures(df, [], text_col)
    passed = counted.filter(~F.col("base_failed")).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = {r["votes"]: r["n"] for r in passed.collect()}
    odds = F.lit(0.0)
    if patterns:
        prior, log_odds = fit(patterns)
        odds += F.lit(float(np.log(prior / (1 - prior))))
        for i, (plus, minus) in enumerate(log_odds.tolist()):
            vote = F.substring("votes", i + 1, 1)
            odds += F.when(vote == "+", plus).when(vote == "-", minus).otherwise(0.0)
    return found.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*[col(c).alias(n) for c, n in names.items()])
    return judge(renamed, list(names.values()), names[text_col], store=False).filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
