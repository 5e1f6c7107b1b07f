"""Repair of the turn structure of conversations at the least cost, shared by way of a grammar.

Each turn becomes a symbol for its role and its fault; a conversation is a sequence of symbols. Equal sequences are kept
once and compressed by Re-Pair: the most frequent pairs of neighbours become rules, in rounds over all sequences. Every
symbol and rule has one min-plus transfer matrix: for each state before and after it, the least cost and the edits that
give it, as a rope that shares the ropes of the rule's two sides. Rules are evaluated once, bottom-up; a conversation's
repair is the product of the few symbols that are left of its sequence.

States are those of `(s?(ua)+)?`: nothing yet, after a system turn, after a user turn, after an assistant turn. Edits
are K(eep), R(erole), D(elete) and I(nsert). An audit lists them in order; from its state and turn, each says by itself
which role the result has. Two audits of one cost between the same states never begin with one another, so the ASCII
order of two products is decided by the order of their factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adgauge.session import cut

START, SYSTEM, USER, ASSISTANT = range(4)
INSERT, RELABEL, REMOVE, UNFINISHED = 5, 1, 2, 5  # costs
GONE = 1  # symbol of a turn that has to go; others are 2 + 2 * role + (1 if truncated)
FIRST_RULE = 10
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
SPACE = " \t\n\x0b\x0c\r"
CHUNK = 1024  # turns of a conversation that are compressed as one sequence
ROUNDS = 12
RULES_PER_ROUND = 64  # so at most 768 rules, which is what is collected and sent to tasks
FOLD = 64  # matrices of a conversation multiplied by one call
PRIME = (1 << 89) - 1
BASE = 0x1D3B9E4F5A6C7788990F1

Entry = tuple[int, Any] | None
Matrix = tuple[Entry, ...]  # 4 x 4, by rows


class Rope:
    """Edits as a letter or as two ropes, with length and hash, so that two ropes are compared in steps of their depth."""

    __slots__ = ("left", "right", "letter", "size", "hash", "power")

    def __init__(self, letter: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.left, self.right, self.letter = left, right, letter
        if left is not None and right is not None:
            self.size = left.size + right.size
            self.power = left.power * right.power % PRIME
            self.hash = (left.hash * right.power + right.hash) % PRIME
        else:
            self.size = len(letter)
            self.power = BASE if letter else 1
            self.hash = ord(letter) if letter else 0

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.left is None:
                out.append(rope.letter)
            else:
                todo += (rope.right, rope.left)
        return "".join(out)


EMPTY = Rope()


def joined(a: Rope, b: Rope) -> Rope:
    return (Rope(left=a, right=b) if b.size else a) if a.size else b


def rope_less(a: Rope, b: Rope) -> bool:
    """ASCII order of two ropes; parts with equal hash are skipped whole."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if not p.size:
            y.append(q)
        elif not q.size:
            x.append(p)
        elif p is q or (p.size == q.size and p.hash == q.hash):
            continue
        elif p.size == q.size == 1:
            return p.letter < q.letter
        elif p.size >= q.size:
            x += (p.right, p.left)
            y.append(q)
        else:
            y += (q.right, q.left)
            x.append(p)
    return any(rope.size for rope in y)


def product(a: Matrix, b: Matrix, join: Callable = joined, less: Callable = rope_less, rows: int = 4) -> Matrix:
    """Least cost, then least edits, over the state between `a` and `b`."""
    out: list[Entry] = []
    for p in range(rows):
        for r in range(4):
            best: Entry = None
            for q in range(4):
                x, y = a[4 * p + q], b[4 * q + r]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is not None and cost > best[0]:
                    continue
                edits = join(x[1], y[1])
                if best is None or cost < best[0] or less(edits, best[1]):
                    best = (cost, edits)
            out.append(best)
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    def rope(text: str) -> Rope:
        out = EMPTY
        for letter in text:
            out = joined(out, Rope(letter))
        return out

    return tuple((entries[p, q][0], rope(entries[p, q][1])) if (p, q) in entries else None for p in range(4) for q in range(4))


def inserts() -> Matrix:
    """Any number of inserted turns; no more than two are of use."""
    steps = {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}
    return _matrix({(p, p): (0, "") for p in range(4)} | {k: (INSERT * n, "I" * n) for k, n in steps.items()})


def symbol_matrix(symbol: int) -> Matrix:
    """Insertions, then one edit of a turn."""
    entries = {(p, p): (REMOVE, "D") for p in range(4)}
    if symbol != GONE:
        role, unfinished = divmod(symbol - 2, 2)
        for p in range(4):
            follows = ASSISTANT if p == USER else USER
            more = UNFINISHED * unfinished
            if role == follows or (role == SYSTEM and p == START):
                entries[p, role] = (more, "K")
            entries.setdefault((p, follows), (RELABEL + more, "R"))
    return product(inserts(), _matrix(entries))


def evaluate(rules: list[tuple[int, int]]) -> list[Matrix | None]:
    """The matrix of every symbol: those of turns, then those of rules, each from its two sides."""
    matrices: list[Matrix | None] = [None] + [symbol_matrix(s) for s in range(1, FIRST_RULE)]
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    return matrices


def _strings(matrix: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "edits": str(e[1])} for e in matrix]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in sequences, with how often each occurs in a batch."""
    for batch in batches:
        laid = np.frombuffer(b"\0\0".join([b"", *batch.column("now").to_pylist(), b""]), np.uint16).astype(np.int64)
        pairs = (laid[:-1] << 16) | laid[1:]
        pair, n = np.unique(pairs[(laid[:-1] > 0) & (laid[1:] > 0)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def _rewritten(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Sequences with the pairs of some rules replaced, one rule after the other, from the left."""
    for batch in batches:
        laid = np.frombuffer(b"\0\0".join([*batch.column("now").to_pylist(), b""]), np.uint16)
        for left, right, symbol in rules:
            at = np.flatnonzero((laid[:-1] == left) & (laid[1:] == right))
            if left == right and len(at):  # in a run, every other one
                first = np.concatenate(([True], np.diff(at) > 1))
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if len(at):
                laid = laid.copy()
                laid[at] = symbol
                laid = np.delete(laid, at + 1)
        ends = np.flatnonzero(laid == 0)
        starts = np.concatenate(([0], ends + 1))
        now = [laid[a:b].tobytes() for a, b in zip(starts, ends, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(now, pa.binary())], names=["symbols", "now"])


def compress(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(symbols, now) of the distinct sequences, `now` written with rules as 16-bit symbols, and the rules' sides.

    A round turns the pairs that occur most often, twice at least, into rules, and replaces them in this order.
    """
    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(s, np.uint8).astype(np.uint16).tobytes() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(wide, pa.binary())], names=["symbols", "now"])

    schema = "symbols binary, now binary"
    now = cut(sequences.select("symbols").distinct().mapInArrow(widened, schema))
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        pairs = now.select("now").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = pairs.filter("n > 1").orderBy(F.desc("n"), "pair").limit(per_round).collect()
        if not found:
            break
        fresh = [(row["pair"] >> 16, row["pair"] & 0xFFFF, FIRST_RULE + len(rules) + i) for i, row in enumerate(found)]
        rules += [(left, right) for left, right, _ in fresh]
        now = cut(now.mapInArrow(lambda batches, r=fresh: _rewritten(batches, r), schema))
    return now, rules


def _matrices(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
    matrices = evaluate(rules)
    for batch in batches:
        out = []
        for now in batch.column("now").to_pylist():
            sides = [matrices[s] for s in np.frombuffer(now, np.uint16).tolist()]
            total = sides[0]
            for side in sides[1:]:
                total = product(total, side)
            out.append(_strings(total))
        yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(out, MATRIX)], names=["symbols", "matrix"])


MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string())]))
MATRIX_SQL = "array<struct<cost:bigint,edits:string>>"


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk: int) -> Iterator[pa.RecordBatch]:
    """Runs of turns of one conversation, of `chunk` at most, with counts of faults and of illegal neighbours.

    Turns come in order; a run ends with its conversation, its length or its task.
    """
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    held: pa.Table | None = None

    def rows(table: pa.Table, closed: bool) -> tuple[pa.RecordBatch, pa.Table]:
        ids = table.column("conv_id").combine_chunks()
        n = len(ids)
        same = np.zeros(n, bool)
        if n > 1:
            a, b = ids.slice(0, n - 1), ids.slice(1)
            both = np.array(a.is_null()) & np.array(b.is_null())
            same[1:] = np.array(pa.compute.fill_null(pa.compute.equal(a, b), False)) | both
        starts = np.flatnonzero(~same)
        cuts = np.concatenate([np.arange(a, b, chunk) for a, b in zip(starts, [*starts[1:], n], strict=True)])
        ends = np.append(cuts[1:], n)
        if not closed:
            ends, cuts = cuts[1:], cuts[:-1]
        role, fault, first = (table.column(c).to_numpy() for c in ("role", "fault", "rid"))
        symbol = np.where((fault == 1) | (fault == 2), GONE, 2 + 2 * role + (fault == 3)).astype(np.uint8)
        out: dict[str, list] = {k: [] for k in schema.names[1:]}
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            values = [first[a], b - a, symbol[a:b].tobytes(), *[int((fault[a:b] == k).sum()) for k in (1, 2, 3)]]
            broken = sum((int(x), int(y)) not in legal for x, y in zip(role[a : b - 1], role[a + 1 : b], strict=True))
            for k, v in zip(out, [*values, broken, role[a], role[b - 1]], strict=True):
                out[k].append(v)
        batch = pa.RecordBatch.from_arrays([ids.take(pa.array(cuts)), *[pa.array(out[f.name], f.type) for f in list(schema)[1:]]], schema=schema)
        return batch, table.slice(int(ends[-1]) if len(ends) else 0) if not closed else table.slice(n)

    for batch in batches:
        if len(batch):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            made, held = rows(held, False)
            if len(made):
                yield made
    if held is not None and len(held):
        yield rows(held, True)[0]


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the hash of conversation and turn: conv_id, turn, role, text.

    A null is one space in the hashed key, in a role and in a text; a null conv_id or turn stays null in the result.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    given = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return given.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def number_turns(turns: DataFrame) -> DataFrame:
    """A written table of the turns, with `rid` rising in the order of conv_id, turn (nulls first), role and text.

    Ranges of this order are dealt to tasks, so that a conversation of any length is spread over many.
    """
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ranged = given.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return cut(ranged.select(F.monotonically_increasing_id().alias("rid"), "*"))


def _role_state(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter == "s", SYSTEM).when(letter == "u", USER).when(letter == "a", ASSISTANT).otherwise(START)


def plan_repairs(numbered: DataFrame, chunk: int = CHUNK, fold: int = FOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    The answers do not depend on `chunk`, `fold` and `rounds`.
    """
    kind = numbered.schema["conv_id"].dataType.simpleString()
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    turns = numbered.select(
        "rid", "conv_id", F.col("role").alias("said"), _role_state(F.col("role")).alias("role"), F.unhex(F.sha2("text", 256)).alias("digest"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("unfinished"),
    )
    again = turns.groupBy(F.col("conv_id").alias("of"), F.col("said").alias("of_said"), F.col("digest").alias("of_digest")).agg(F.min("rid").alias("first"), F.count("*").alias("n"))
    again = cut(again.filter("n > 1").drop("n"))  # one row per text, however often it is said
    met = turns["conv_id"].eqNullSafe(again["of"]) & (turns["said"] == again["of_said"]) & (turns["digest"] == again["of_digest"])
    fault = F.when(F.col("blank"), 1).when(F.coalesce(F.col("rid") > F.col("first"), F.lit(False)), 2).when(F.col("unfinished"), 3).otherwise(0)
    judged = turns.join(again, met, "left").select("rid", "conv_id", "role", fault.alias("fault"))
    fields = f"conv_id {kind}, rid long, n int, symbols binary, blank long, duplicate long, truncated long, illegal long, head int, tail int"
    types = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32()]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        names = [f.split()[0] for f in fields.split(", ")]
        schema = pa.schema([pa.field(*x) for x in zip(names, [first.schema.field("conv_id").type, *types], strict=True)])
        yield from _chunks((b for part in ([first], batches) for b in part), schema, chunk)

    chunks = cut(judged.repartitionByRange("rid").sortWithinPartitions("rid").mapInArrow(chunked, fields))
    now, rules = compress(chunks, rounds)
    matrices = cut(now.mapInArrow(lambda batches: _matrices(batches, rules), f"symbols binary, matrix {MATRIX_SQL}"))
    counts = ["blank", "duplicate", "truncated", "illegal", "head", "tail"]
    one = Window.partitionBy("conv_id")
    places = cut(chunks.select("rid", (F.row_number().over(one.orderBy("rid")) - 1).alias("place"), F.count("*").over(one).alias("parts")))
    parts = cut(chunks.join(matrices, "symbols").join(places, "rid").select("conv_id", "place", "parts", "matrix", *counts))
    schema = parts.schema

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        total, row = None, rows.iloc[0].copy()
        for entries in rows["matrix"]:
            side = tuple(None if e is None else (e["cost"], e["edits"]) for e in entries)
            total = side if total is None else product(total, side, lambda a, b: a + b, lambda a, b: a < b)
        heads, tails = rows["head"].tolist(), rows["tail"].tolist()
        legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
        row["illegal"] = rows["illegal"].sum() + sum(x not in legal for x in zip(tails[:-1], heads[1:], strict=True))
        for name in ("blank", "duplicate", "truncated"):
            row[name] = rows[name].sum()
        row["tail"], row["place"], row["parts"] = tails[-1], row["place"] // fold, -(-row["parts"] // fold)
        row["matrix"] = [None if e is None else {"cost": e[0], "edits": e[1]} for e in total]
        return pd.DataFrame([row])

    whole = []
    while True:
        whole.append(parts.filter("parts = 1"))
        long = parts.filter("parts > 1")
        if long.isEmpty():
            break
        parts = cut(long.groupBy("conv_id", F.floor(F.col("place") / fold)).applyInPandas(folded, schema))
    done = whole[0]
    for more in whole[1:]:
        done = done.unionByName(more)
    # from the start, over the matrix and last insertions, to one of the two ends
    least = F.array_min(F.filter(F.array(
        F.col("matrix")[START],
        F.struct((F.col("matrix")[SYSTEM]["cost"] + 2 * INSERT).alias("cost"), F.concat(F.col("matrix")[SYSTEM]["edits"], F.lit("II")).alias("edits")),
        F.struct((F.col("matrix")[USER]["cost"] + INSERT).alias("cost"), F.concat(F.col("matrix")[USER]["edits"], F.lit("I")).alias("edits")),
        F.col("matrix")[ASSISTANT],
    ), lambda e: e["cost"].isNotNull()))
    answers = done.select(F.col("conv_id").alias("of"), *counts[:4], least["cost"].alias("cost"), least["edits"].alias("audit"))
    spans = numbered.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    gaps = F.coalesce(F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return spans.join(answers, spans["conv_id"].eqNullSafe(answers["of"])).select("conv_id", gaps.alias("gaps"), *counts[:4], "cost", "audit")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Any, list[tuple[str, str]]]]:
    """(n, conversation, repaired turns), as they come: a conversation opens with its audit (rid -1), then come its turns.

    Holds one audit and one batch. `n` counts conversations, so that a null one is told from the next.
    """
    n, conv, audit, at, state = -1, None, "", 0, START

    def until_edit() -> list[tuple[str, str]]:
        nonlocal at, state
        out = []
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            out.append(("assistant" if state == ASSISTANT else "user", ""))
            at += 1
        return out

    for batch in batches:
        for rid, conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "conv_id", "role", "text")), strict=True):
            if rid < 0:
                if n >= 0:
                    yield n, conv, until_edit()
                n, conv, audit, at, state = n + 1, conv_id, text, 0, START
                continue
            out = until_edit()
            edit = audit[at]
            at += 1
            if edit != "D":
                follows = ASSISTANT if state == USER else USER
                state = follows if edit == "R" else ROLES[role[0]]
                out.append((role if edit == "K" else "assistant" if follows == ASSISTANT else "user", text))
            yield n, conv, out
    if n >= 0:
        yield n, conv, until_edit()


def _with_audits(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns after their conversation's audit, each conversation in one stream: its digest is a chain over all its turns."""
    audits = plans.select(F.lit(-1).cast("long").alias("rid"), "conv_id", F.lit("").alias("role"), F.col("audit").alias("text"))
    return numbered.select("rid", "conv_id", "role", "text").unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "rid")


def apply_repairs(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text."""
    kind = numbered.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            ids, places, roles, texts = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places, pa.int64()), pa.array(roles), pa.array(texts)], names=["conv_id", "place", "role", "text"])

        made: list[tuple] = []
        last, place = -1, 0
        for n, conv, turns in _replayed(batches):
            place, last = (place if n == last else 0), n
            for role, text in turns:
                made.append((conv, place, role, text))
                place += 1
            if len(made) >= 4096:
                yield flush()
                made = []
        if made:
            yield flush()

    return _with_audits(numbered, plans).mapInArrow(rows, f"conv_id {kind}, place long, role string, text string")


def repaired_digests(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired `role:text` lines: conv_id, repaired_sha256."""
    kind = numbered.schema["conv_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in made]), pa.array([d for _, d in made])], names=["conv_id", "repaired_sha256"])

        made: list[tuple] = []
        last, owner, digest, empty = -1, None, hashlib.sha256(), True
        for n, conv, turns in _replayed(batches):
            if n != last:
                if last >= 0:
                    made.append((owner, digest.hexdigest()))
                last, owner, digest, empty = n, conv, hashlib.sha256(), True
            for role, text in turns:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(made) >= 4096:
                yield flush()
                made = []
        if last >= 0:
            made.append((owner, digest.hexdigest()))
            yield flush()

    return _with_audits(numbered, plans).mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `turns` are the turns to repair (conv_id, turn, role, text; other columns are not read), in the order of turn, nulls
    first; turns of one number in the order of role and text. Null roles and texts are one space. A turn is blank, or
    repeats role and text of an earlier turn, or is truncated: the first that holds counts. A conversation without turns
    has zeros, an empty audit and the digest of nothing; a null conv_id is a conversation like others. Repeated rows are
    turns like others, and so duplicates. An empty table gives no rows.

    Matrices, counts and audits of a conversation are made from chunks of 1024 turns, wherever they lie. The digest alone
    reads a conversation as one stream, which holds a batch and the audit: SHA-256 is a chain.
    """
    numbered = number_turns(turns)
    plans = cut(plan_repairs(numbered))
    digests = repaired_digests(numbered, plans).withColumnRenamed("conv_id", "of")
    found = plans.join(digests, plans["conv_id"].eqNullSafe(digests["of"])).drop("of").withColumnRenamed("conv_id", "of")
    ids = conversations.select("conv_id").distinct()
    rows = ids.join(found, ids["conv_id"].eqNullSafe(found["of"]), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return rows.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
