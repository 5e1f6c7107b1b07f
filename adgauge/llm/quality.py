"""Quality rules on words, and on repeats inside a text found with a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REPEAT = 12  # words from which a repeated substring counts
MAX_COVERED = 0.3  # share of the words in repeats
MAX_LONGEST = 100  # words of the longest repeat
CHUNK = 1 << 20  # bytes of text that one pass of the arrays takes; a longer text is a pass of its own

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, covered_words long, longest_repeat long"
SYMBOLS = b"#*$%&|<>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of int symbols and the common prefix of each suffix with the one before it.

    Prefix doubling; a rank is the place of the first suffix that is alike so far, and only suffixes that
    still are alike are sorted again. The ranks of every doubling are kept, and give the common
    prefixes from the longest step down.
    """
    n = len(symbols)
    order, ranks, step = np.arange(n), [], 0
    rank, second = np.zeros(n, np.int64), symbols - symbols.min(initial=0)
    active = order
    while True:
        key = rank[active] * (second.max(initial=0) + 1) + second[active]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        place, old = np.arange(len(active)), rank[active]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))[: len(key)]
        block = np.maximum.accumulate(np.where(new_old, place, 0))
        order[old + place - block] = active
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new_key, place, 0)) - block
        ranks.append(rank)
        alike = ~(new_key & np.concatenate((new_key[1:], [True]))[: len(key)])
        active, step = active[alike], step * 2 or 1
        if not len(active):
            break
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    left, right = order[at - 1], order[at]
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(left, right) < n
        same = inside & (ranks[k][np.where(inside, left, 0)] == ranks[k][np.where(inside, right, 0)])
        move = np.where(same, 1 << k, 0)
        left, right = left + move, right + move
        common[at] += move
    return order, common


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """At each position, the length of the longest substring from there that also starts elsewhere."""
    order, common = suffix_array(symbols)
    best = np.zeros(len(symbols), np.int64)
    best[order] = np.maximum(common, np.concatenate((common[1:], [0]))[: len(common)])
    return best


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> pd.DataFrame:
    """The figures of some texts, by one suffix array over all their words.

    A mark of its own ends each text, so that no substring that repeats crosses texts; and the words
    of different texts are different symbols, so that only repeats within a text are found.
    """
    words = [t.encode().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    n = len(texts)
    out = {"n_words": counts, "word_chars": np.zeros(n, np.int64), "n_symbols": np.zeros(n, np.int64), "n_dup_lines": np.zeros(n, np.int64)}
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = t.encode()
        spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        out["word_chars"][i] = len(t) - spaces
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.split()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    codes = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
    owner = np.repeat(np.arange(n), counts + 1)
    first = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
    ends = first + counts
    symbols = np.zeros(len(owner), np.int64)
    is_word = np.ones(len(owner), bool)
    is_word[ends] = False
    width = (codes.max() + 2) if len(codes) else 1
    symbols[is_word] = owner[is_word] * width + codes + 1
    symbols[ends] = np.arange(n) * width
    best = longest_repeats(symbols)
    size = len(symbols)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n).astype(np.int64)

    three = np.flatnonzero(best >= 3)
    out["n_repeat_words"] = per_text(_covered(three, three + 3, size))
    # a repeat that starts one word earlier and ends in the same place holds this one
    maximal = (best >= min_repeat) & (np.concatenate(([0], best[:-1])) != best + 1)
    starts = np.flatnonzero(maximal)
    out["n_repeats"] = per_text(maximal)
    out["covered_words"] = per_text(_covered(starts, starts + best[starts], size))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner[starts], best[starts])
    out["longest_repeat"] = longest
    return pd.DataFrame(out)


def _measures(batches: Iterator[pd.Series], min_repeat: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts, group, size = [], [], 0
        for t in batch:
            if group and size + len(t or "") > CHUNK:
                parts.append(measure(group, min_repeat))
                group, size = [], 0
            group.append(t)
            size += len(t or "")
        parts.append(measure(group, min_repeat))
        yield pd.concat(parts, ignore_index=True)


def judge_quality(
    docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Adds the figures of `COLUMNS`, base_failed and kept to each row.

    Words are runs of characters other than space and U+0009 to U+000D. base_failed: fewer than 50 words,
    or over half of them in 3-word windows that repeat. A text that passes is kept if substrings of
    `min_repeat` words or more that occur twice or more in it cover at most `max_covered` of its words,
    and none is longer than `max_longest` words. Null and empty texts have no words and fail. Repeated
    rows are judged alike. An empty table gives no rows. Columns of the same names are replaced.
    """

    @F.pandas_udf(COLUMNS)
    def figures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _measures(batches, min_repeat)

    new = [c.split()[0] for c in COLUMNS.split(", ")] + ["base_failed", "kept"]
    rest = [c for c in docs.columns if c not in new]
    found = docs.select(*[docs[c] for c in rest], figures(docs[text]).alias("#found")).select(*[f"`{c}`" for c in rest], "`#found`.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return found.select("*", failed.alias("base_failed"), (~failed & ~repeated).alias("kept"))


def drop_poor(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    judged = judge_quality(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    return judged.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
