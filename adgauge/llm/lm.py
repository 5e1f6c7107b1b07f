"""Log-probabilities of texts under a log-bilinear model, trained with noise-contrastive estimation.

Tokens are words, then one end per text. The model predicts units: the end, the most frequent words, and groups of all
other words by their first bytes. The two units before a token give a context vector, the sum of two linear maps of
their vectors; its product with a unit's vector, plus the unit's bias, is the unit's score, and the softmax over all
units its probability. Inside a group a word has its share of the group's tokens, and words never seen share what
words seen once had. So the probabilities of all words that were seen, and of one unseen word per group, add up to 1.

Training reads the triples of units that occur, with their counts: at most the number of units to the third power,
however large the corpus. Shards of triples are trained in numpy side by side and averaged, in rounds. The normaliser of
every context is found once, by matrix products over blocks of contexts; a token then costs one short product.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import compile as pattern

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from adgauge.session import cut

FOLDS, HELD_OUT = 7, 2
END = b" "  # no word has a space
SPACE = pattern(rb"[ \t\n\x0b\x0c\r]")
PIECE = 1 << 22  # bytes of a text split into words at once
UNITS = 256  # the end, groups, and frequent words
GROUPS = 64
HEAD = 1 << 18  # most frequent words, which tasks hold with their counts
HEAD_BYTES = 64  # longer words are not among them
DIMS = 16
NOISE = 64  # noise units per batch
BATCH = 4096
ROUNDS = 4
STEPS = 48  # least number of batches per shard and round
SHARDS = 16
RATE = 0.15
DISTINCT = 1 << 19  # distinct words a task counts before it hands them on
TRIPLES = 1 << 22


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of bounded size."""
    if len(raw) <= PIECE:
        yield raw.lower().split()
        return
    at = 0
    while at < len(raw):
        end = SPACE.search(raw, min(at + PIECE, len(raw)))
        stop = end.start() if end else len(raw)
        yield raw[at:stop].lower().split()
        at = stop


def group(word: bytes) -> int:
    """The unit of a word that is not among the frequent ones."""
    return 1 + zlib.crc32(word[:2]) % GROUPS


def group_column(word: Column) -> Column:
    return (1 + F.crc32(F.substring(word, 1, 2)) % GROUPS).cast("int")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            for some in words(text.as_py()):
                seen.update(some)
            seen[END] += 1
            if len(seen) >= DISTINCT:
                yield flush()
                seen.clear()
    if seen:
        yield flush()


def _unit_texts(batches: Iterator[pa.RecordBatch], unit_of: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The units of one text after the other, the end last."""
    groups: dict[bytes, int] = {}
    for batch in batches:
        for text in batch.column("text"):
            units = []
            for some in words(text.as_py()):
                units += [unit_of.get(w) or groups.get(w[:2]) or groups.setdefault(w[:2], group(w)) for w in some]
            yield np.array([*units, 0], np.int64)


def _triples(batches: Iterator[pa.RecordBatch], unit_of: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    held, size = [], 0
    for units in _unit_texts(batches, unit_of):
        held.append(context_codes(units) * UNITS + units)
        size += len(units)
        if size >= TRIPLES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def context_codes(units: np.ndarray) -> np.ndarray:
    """The two units before each unit, as one number; before a text there are ends."""
    before = np.concatenate((np.zeros(2, np.int64), units))
    return before[:-2] * UNITS + before[1:-1]


@dataclass
class Model:
    """Vectors of context units and predicted units, maps of the two places, biases."""

    context: np.ndarray
    target: np.ndarray
    far: np.ndarray
    near: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        draw = lambda *shape: rng.normal(0, 0.3, shape)
        return Model(draw(UNITS, DIMS), draw(UNITS, DIMS) * 0.3, np.eye(DIMS) * 0.5, np.eye(DIMS), np.log(unigram))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.far, self.near, self.bias]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Context vectors of some pairs of units."""
        return self.context[codes // UNITS] @ self.far + self.context[codes % UNITS] @ self.near

    def normalisers(self, codes: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all units of exp(score), for some contexts."""
        scores = self.vectors(codes) @ self.target.T + self.bias
        top = scores.max(1, keepdims=True)
        return (top + np.log(np.exp(scores - top).sum(1, keepdims=True))).ravel()


def scattered(units: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by unit."""
    places = units[:, None] * DIMS + np.arange(DIMS)
    return np.bincount(places.ravel(), rows.ravel(), UNITS * DIMS).reshape(UNITS, DIMS)


def train(model: Model, codes: np.ndarray, n: np.ndarray, unigram: np.ndarray, seed: int, rate: float = RATE) -> Model:
    """Passes of noise-contrastive estimation over some counted triples; steps are scaled as in AdaGrad.

    A batch tells its triples from `NOISE` units drawn from the unigram shares, the same for all its triples.
    """
    rng = np.random.default_rng(seed)
    params = [a.astype(np.float32) for a in model.arrays()]
    model = Model(*params)
    squares = [np.full(a.shape, 1e-4, np.float32) for a in params]
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    batches = -(-len(codes) // BATCH)
    heavy = n.sum() / batches
    for _ in range(max(1, -(-STEPS // batches))):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            far, near, unit = codes[some] // UNITS**2, codes[some] // UNITS % UNITS, codes[some] % UNITS
            weight = (n[some] / heavy).astype(np.float32)
            noise = rng.choice(UNITS, NOISE, p=unigram)
            a, b = model.context[far], model.context[near]
            h = a @ model.far + b @ model.near
            real = (h * model.target[unit]).sum(1) + model.bias[unit] - log_noise[unit]
            false = h @ model.target[noise].T + model.bias[noise] - log_noise[noise]
            up = weight / (1 + np.exp(np.clip(real, -30, 30)))
            down = weight[:, None] / (1 + np.exp(np.clip(-false, -30, 30)))
            dh = up[:, None] * model.target[unit] - down @ model.target[noise]
            target, bias = scattered(unit, up[:, None] * h), np.bincount(unit, up, UNITS)
            np.subtract.at(target, noise, down.T @ h)
            np.subtract.at(bias, noise, down.sum(0))
            context = scattered(far, dh @ model.far.T) + scattered(near, dh @ model.near.T)
            for value, square, step in zip(params, squares, (context, target, a.T @ dh, b.T @ dh, bias), strict=True):
                square += step * step
                value += rate * step / np.sqrt(square)
    return Model(*[a.astype(np.float64) for a in params])


def _shard_trainer(packed: bytes, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Trains one shard from a common start; seeds follow from round and shard."""

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("code")
        model, unigram = pickle.loads(packed)
        shard = int(rows["shard"].iloc[0])
        model = train(model, rows["code"].to_numpy(), rows["n"].to_numpy(np.float64), unigram, seed=1000 * turn + shard, rate=RATE / (1 + turn))
        return pd.DataFrame({"shard": [shard], "n": [int(rows["n"].sum())], "model": [pickle.dumps(model)]})

    return part


def _score_rows(batches: Iterator[pa.RecordBatch], head: dict[bytes, tuple], model: Model, normaliser: np.ndarray, unseen: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per text: number of tokens, of known tokens, sums of log10 for the head's words, and the words beyond the head.

    The head has for each word: unit, log10 of the base share, log10 of its share of its unit.
    """
    groups: dict[bytes, tuple] = {}
    target, bias = model.target, model.bias
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text in batch.column("text"):
            tokens: list[list] = []
            tail: list[bytes] = []
            n = known = 0
            base = score = 0.0
            last = np.zeros(2, np.int64)
            for some in words(text.as_py()):
                tokens = [head.get(w) or groups.get(w[:2]) or groups.setdefault(w[:2], (group(w), None, 0.0)) for w in some]
                tail += [w for w, t in zip(some, tokens, strict=True) if t[1] is None]
                got, last = _sums(tokens, last, target, bias, model, normaliser)
                n, known, base, score = n + len(tokens), known + got[0], base + got[1], score + got[2]
            end = head.get(END) or (0, unseen, 0.0)
            got, last = _sums([end], last, target, bias, model, normaliser)
            for column, value in zip(out, (n + 1, known + (END in head), base + got[1], score + got[2], tail), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, f.type) for c, f in zip(out, list(schema)[3:], strict=True)]], names=schema.names)


def _sums(tokens: list[tuple], last: np.ndarray, target: np.ndarray, bias: np.ndarray, model: Model, normaliser: np.ndarray) -> tuple[tuple[int, float, float], np.ndarray]:
    """(words of the head, their base sum, score) of some tokens after the two units `last`, and the new last two."""
    if not tokens:
        return (0, 0.0, 0.0), last
    unit, base, share = zip(*tokens, strict=True)
    before = np.concatenate((last, np.array(unit, np.int64)))
    units, codes = before[2:], before[:-2] * UNITS + before[1:-1]
    logs = (model.vectors(codes) * target[units]).sum(1) + bias[units] - normaliser[codes]
    known = [b for b in base if b is not None]
    return (len(known), float(sum(known)), float(logs.sum()) / np.log(10) + float(sum(share))), before[-2:]


def _head(counts: DataFrame, most: int) -> list[Row]:
    """The most frequent words, `most` or fewer, most frequent first; words of like counts are all in it or none.

    The border comes from how many words have each count, in steps of three digits, so that the driver gets a small
    table and then the head alone.
    """
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("c")) - 2, F.lit(0)))
    floor = (F.floor(F.col("c") / step) * step).cast("long")
    sizes = counts.groupBy(floor.alias("least")).agg(F.count("*").alias("words")).collect()
    border, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["least"]):
        total += row["words"]
        if total > most:
            break
        border = row["least"]
    if border is None:
        return []
    return sorted(counts.filter(F.col("c") >= border).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def score_texts(docs: DataFrame, head_words: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose CRC-32 of the doc_id as text (null: empty) leaves 2 modulo 7 are held out; all others are learnt from, every
    token of them. A null text is empty, and has its end as any. `n_known` counts tokens that occur in learnt
    texts. `base_score` is the add-one unigram log10 probability, `score` the model's. Repeated rows count each. Without
    learnt rows the base knows no token and the model is uniform. An empty table gives no rows; other columns are not read.

    The most frequent words and their counts are sent to tasks (at most `head_words`, of at most 64 bytes); all other tokens meet
    their counts in a join. What is trained on, and the parameters, are bounded by the number of units.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    texts = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    learnt = texts.filter(~F.col("held_out")).select("text")
    counts = cut(learnt.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, scale = total["n"], float(np.log10(total["n"] + total["v"] + 1))
    end = counts.filter(F.col("word") == END).collect()  # one row, or none
    rest = counts.filter(F.col("word") != END)
    top = _head(rest.filter(F.octet_length("word") <= HEAD_BYTES), head_words)
    frequent = [bytes(r["word"]) for r in top][: UNITS - GROUPS - 1]
    unit_of = {w: 1 + GROUPS + i for i, w in enumerate(frequent)}
    shared_units = spark.sparkContext.broadcast(unit_of)
    triples = learnt.mapInArrow(lambda batches: _triples(batches, shared_units.value), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    triples = cut(triples.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(SHARDS))))

    # shares inside groups; a word never seen has what words seen once had
    others = rest.filter(~F.col("word").isin([bytearray(w) for w in frequent])) if frequent else rest
    sums = others.groupBy(group_column(F.col("word")).alias("unit")).agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("once")).collect()
    of_group = {r["unit"]: (r["tokens"], (r["once"] + 0.5) / (r["tokens"] + 1)) for r in sums}
    unseen_share = {g: float(np.log10(of_group[g][1])) if g in of_group else 0.0 for g in range(1, GROUPS + 1)}
    seen_share = {g: float(np.log10((1 - u) / t)) for g, (t, u) in of_group.items()}

    unigram = np.full(UNITS, 0.5)
    for row in triples.groupBy((F.col("code") % UNITS).cast("int").alias("unit")).agg(F.sum("n").alias("n")).collect():
        unigram[row["unit"]] += row["n"]
    unigram /= unigram.sum()
    model = Model.start(unigram)
    for i in range(rounds):
        parts = triples.groupBy("shard").applyInPandas(_shard_trainer(pickle.dumps((model, unigram)), i), "shard long, n long, model binary")
        parts = sorted(parts.collect(), key=lambda r: r["shard"])
        if not parts:
            break
        weights = np.array([r["n"] for r in parts], np.float64)
        weights /= weights.sum()
        models = [pickle.loads(r["model"]).arrays() for r in parts]
        model = Model(*[sum(w * a for w, a in zip(weights, same, strict=True)) for same in zip(*models, strict=True)])

    contexts = spark.range(0, UNITS * UNITS, 1, UNITS // 16).select(F.col("id").alias("code"))

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            codes = rows["code"].to_numpy()
            yield pd.DataFrame({"code": codes, "z": np.concatenate([model.normalisers(codes[a : a + 2048]) for a in range(0, len(codes), 2048)] or [np.zeros(0)])})

    z = contexts.mapInPandas(normalised, "code long, z double").collect()
    normaliser = np.zeros(UNITS * UNITS)
    normaliser[[r["code"] for r in z]] = [r["z"] for r in z]

    head = {}
    for row in [*end, *top]:
        word = bytes(row["word"])
        unit = 0 if word == END else unit_of.get(word) or group(word)
        head[word] = (unit, float(np.log10(row["c"] + 1)) - scale, seen_share[unit] + float(np.log10(row["c"])) if 1 <= unit <= GROUPS else 0.0)
    known = spark.sparkContext.broadcast((head, model, normaliser))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.binary()))])
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, base double, model double, tail array<binary>"
    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), "*")
    scored = cut(numbered.mapInArrow(lambda batches: _score_rows(batches, *known.value, -scale, schema), fields))

    # the words beyond the head; one that was never seen finds no count
    tail = scored.select("rid", F.explode("tail").alias("word"))
    found = tail.join(counts.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    unit = group_column(F.col("word"))
    lookup = lambda values: F.create_map(*[x for g in range(1, GROUPS + 1) for x in (F.lit(g), F.lit(values.get(g, 0.0)))])
    share = F.when(F.col("c").isNull(), lookup(unseen_share)[unit]).otherwise(F.log10("c") + lookup(seen_share)[unit])
    sums = found.groupBy("rid").agg(
        F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(scale)).alias("tail_base"), F.sum(share).alias("tail_model"),
    )
    zero = F.lit(0)
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("tail_model", F.lit(0.0))).alias("score"),
    )
