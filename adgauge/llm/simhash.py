"""Near-duplicates by SimHash, found with keys of the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.llm.common import keep_rows, text_key
from adgauge.session import cut

SHINGLE = 3
DISTANCE = 2
SEGMENTS = (22, 21, 21)  # bits; each is a word of the 23-bit code with zeros above
GENERATOR = 0xC75  # fixed value: generator polynomial of the (23, 12) Golay code
VOTES = 1 << 17  # shingle hashes whose bits are added up at once


def _divided(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the upper 12 bits of a word, and the error pattern of every remainder.

    The code is perfect: each of the 2048 remainders belongs to one pattern of at most three bits.
    """
    few = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    errors = np.zeros(1 << 11, np.int64)
    errors[_divided(few)] = few
    return _divided(np.arange(1 << 12) << 11), errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word; the code is linear, the lower 11 bits add as they are."""
    upper, errors = _syndromes()
    return (words ^ errors[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def golay_keys(words: np.ndarray) -> np.ndarray:
    """24 indices per word, of the codewords nearest to it and to the words one bit away; at most six differ.

    Two words at most two bits apart have a word that is at most one bit from both, and so share a key.
    """
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.int64)
    return golay_index(words[:, None] ^ flips[None, :])


def vote(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n texts: a bit is 1 if it is set in over half of the text's hashes."""
    total, ones = np.bincount(owner, minlength=n), np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), VOTES):
        bits = np.unpackbits(hashes[at : at + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + VOTES]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of every run of `shingle` words, repeats included; of all words if there are fewer."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode().lower().split() if text else []  # of bytes, only A-Z and the six ASCII spaces count
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64(b" ".join(words), 42)]
    return [xxh64(b" ".join(run), 42) for run in zip(*[words[i:] for i in range(shingle)])]


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """64-bit SimHash of a text as a long; 0 for null and for texts without words."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            rows: list[int] = []
            hashes: list[int] = []
            counts: list[int] = []
            for i, t in enumerate(batch):
                if found := shingle_hashes(t, shingle):
                    rows.append(i)
                    hashes += found
                    counts.append(len(found))
                if rows and (len(hashes) >= VOTES or i == len(batch) - 1):
                    out[rows] = vote(np.array(hashes, np.uint64), np.repeat(np.arange(len(rows)), counts), len(rows))
                    rows, hashes, counts = [], [], []
            yield pd.Series(out.view(np.int64))

    return prints(text)


def candidate_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): per segment, the segment itself with the Golay keys of the next one.

    Of three segments with two errors, one has none; the segment after it has two at most, and so
    shares a Golay key. Up to six keys a segment.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            if not len(fp):
                continue
            low, segments = 0, []
            for bits in SEGMENTS:
                segments.append((fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1))
                low += bits
            for i, own in enumerate(segments):
                near = np.sort(golay_keys(segments[(i + 1) % len(segments)]), axis=1)
                new = np.concatenate((np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
                row, column = np.nonzero(new)
                yield pd.DataFrame({"key": i << 40 | own[row] << 12 | near[row, column], "fp": fp[row]})

    return prints.select("fp").mapInPandas(keys, "key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), both ways: enough links between the distinct fingerprints `fp` to join all that are two bits or fewer apart.

    Fingerprints that share a key with another are candidates. They are verified without forming the
    pairs of a key: two fingerprints are at most two bits apart exactly if some word is at most one bit
    from both. Each candidate goes to its 65 such words, and those that meet at a word (65 at most) are linked
    to the smallest of them.
    """
    keyed = cut(candidate_keys(prints))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select("key")
    close = keyed.join(cut(shared), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    around = cut(close.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("word")))
    met = around.groupBy("word").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most")
    pairs = around.join(met.select("word", "least"), "word").filter("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node of each component. `pairs` has every link both ways.

    Each round takes the least label beside a node and then that label's own label, until none changes.
    """
    pairs = cut(pairs)
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels, changed = cut(labels), 1
    while changed:
        beside = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("beside"))
        hooked = labels.join(beside, "node").select("node", F.col("label").alias("was"), F.least("label", "beside").alias("label"))
        hooked = cut(hooked)
        owner = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut(hooked.join(owner, "label").select("node", "was", F.col("next").alias("label")))
        changed = jumped.filter("was != label").limit(1).count()
        labels = jumped.select("node", "label")
    return labels


def find_near(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, key (the `text_key`), fp (long), fingerprint (hex), component_id, label.

    A-Z are lower-cased, words joined by spaces. Fingerprints link at two differing bits or fewer; linked rows and
    rows of one fingerprint form a component, named by the smallest doc_id in it. Null doc_ids take part but do
    not name; a component without another doc_id has null. Components can share a name; `label`, their least
    fingerprint, tells them apart. Texts without words have fingerprint 0. Rows repeat as they come. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    rows = cut(docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("key"), fingerprint(docs["text"], shingle).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(prints))
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(named.join(names, "label").select("fp", "component_id", "label"))
    return rows.join(named, "fp").select("doc_id", "key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "label")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with the columns of `docs`."""
    found = cut(find_near(docs))
    # several rows of a component can have its doc_id: those of one text stay
    ours = found.filter("doc_id <=> component_id").groupBy("label", "doc_id", "key").agg(F.count("*").alias("n"))
    best = ours.groupBy("label").agg(F.min(F.struct("key", "n", "doc_id")).alias("win"))
    return keep_rows(docs, cut(best.select(F.col("win.doc_id").alias("win_id"), F.col("win.key").alias("win_key"), F.col("win.n").alias("win_rows"))))
