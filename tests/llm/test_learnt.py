"""Vector codes, conversation repair and scoring against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from adgauge.llm import codes, lm, turns
from adgauge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

# --- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label). Every part against every entry, in whole numbers of Python."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    firsts = {}
    for i, (vec_id, v, _) in enumerate(kept):
        key = (vec_id is None, vec_id or 0)
        if key not in firsts or v < kept[firsts[key]][1]:
            firsts[key] = i
    books = [[cut[firsts[k]][p] for k in sorted(firsts)[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[min((sum((x - y) ** 2 for x, y in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == j]
                    if own:
                        books[p][j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return sorted(
        (str(i), "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)
    )


def vectors(spark, rows, extra=False):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return made.selectExpr("*", "1 AS error", "'x' AS code", "vec_id AS entry", "2 AS part") if extra else made


def coded(frame, **more):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(frame, **more).collect())


def vector_rows(n=150, seed=5):
    rng = np.random.default_rng(seed)
    some = np.round(rng.normal(0, 0.3, (n, 16)), 2).astype(np.float32)
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(some)]
    return rows + rows[:3] + [(None, rows[0][1], 1), (n + 1, [0.0] * 16, None), (n + 2, [100.0] * 16, 2)]


@pytest.mark.parametrize("bits", [4, 10, 14])
def test_codes_equal_brute_force_at_any_cell_size(spark, bits):
    rows = vector_rows()
    assert coded(vectors(spark, rows, extra=True), bits=bits) == brute_codes(rows)


def test_codes_drop_what_cannot_be_coded(spark):
    good = vector_rows(20)
    bad = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [], 1), (905, [0.5] * 8, 1), (906, [0.5] * 17, 1), (907, [1e30] * 16, 1)]
    assert coded(vectors(spark, bad[:4] + good + bad[4:])) == brute_codes(good)


def test_codes_of_few_vectors_and_of_none(spark):
    rows = vector_rows(5)[:5]
    assert coded(vectors(spark, rows)) == brute_codes(rows)
    none = codes.compress(vectors(spark, []))
    assert none.columns == codes.compress(vectors(spark, rows)).columns and none.count() == 0
    assert codes.compress(vectors(spark, [(1, None, 1)])).count() == 0


def test_cells_prune_and_are_remembered():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (16, 4))
    finder = codes.Nearest(entries, bits=8, cells=50)
    points = rng.integers(-4000, 4000, (400, 4))
    for _ in range(2):
        best, distance = finder.find(points)
        want = ((points[:, None] - entries) ** 2).sum(2)
        assert (best == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert finder.evaluated < 2 * 400 * 16 / 3


def test_codes_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = duckdb.sql(codes.SQL).df()
    got = QUERIES["op11_vector_codes"](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), want[order].sort_values(order, ignore_index=True), check_dtype=False)


# --- conversation repair


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        out += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(ids, rows):
    """Least (cost, audit) over all edits, one turn after the other."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    out = []
    for c in set(ids):
        turn_rows = sorted(by[c], key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, faults = set(), []
        for _, r, x in turn_rows:
            body = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "dup" if (r, x) in seen else "trunc" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        first = [r[:1] for _, r, _ in turn_rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        known = [t for t, _, _ in turn_rows if t is not None]
        best = {"": (0, "", ())}

        def after(s):
            return "a" if s == "u" else "u"

        def put(d, k, v):
            if k not in d or v[:2] < d[k][:2]:
                d[k] = v

        def named(s):
            return "user" if s == "u" else "assistant"

        def insert(d):
            for _ in range(3):
                for s, (cost, audit, lines) in list(d.items()):
                    put(d, after(s), (cost + 5, audit + "I", (*lines, named(after(s)) + ":")))

        for (_, r, x), fault in zip(turn_rows, faults, strict=True):
            insert(best)
            new = {}
            for s, (cost, audit, lines) in best.items():
                put(new, s, (cost + 2, audit + "D", lines))
                if fault in ("blank", "dup"):
                    continue
                more = 5 * (fault == "trunc")
                if r[:1] and (r[:1] == after(s) or (r[:1] == "s" and s == "")):
                    put(new, r[:1], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                put(new, after(s), (cost + more + 1, audit + "R", (*lines, f"{named(after(s))}:{x}")))
            best = new
        insert(best)
        cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((str(c), gaps, *[faults.count(f) for f in ("blank", "dup", "trunc")], illegal, cost, audit, digest))
    return sorted(out)


def talk(spark, rows, extra=True):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return frame.selectExpr("*", "1 AS rid", "2 AS cost", "'x' AS audit", "3 AS place") if extra else frame


def repaired(given, rows):
    return sorted((str(r[0]), *r[1:]) for r in turns.repair(given, rows).collect())


def talk_rows(n=60, seed=4, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so", "", " \n", "Why?", "Because.  ", None, "\x0bx. ", "ä.", "twice. twice"]
    roles = ["system", "user", "assistant", "tool", "", None, "ursa", "User"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c if c else None, t * rng.choice([1, 1, 1, 2]) if rng.random() > 0.05 else None, rng.choice(roles[:3] * 4 + roles), rng.choice(texts) if rng.random() < 0.5 else f"{c} {t}."))
    return rows


def test_repair_equals_brute_force(spark):
    rows = talk_rows()
    given = talk(spark, rows)
    assert repaired(given, turns.damage(given)) == brute_repair([r[0] for r in rows], damaged(rows))


def test_repair_without_damage_and_of_repeated_rows(spark):
    rows = [r for r in talk_rows(30, 9) if None not in r[2:]] * 2
    given = talk(spark, rows)
    assert repaired(given, given) == brute_repair([r[0] for r in rows], rows)


@pytest.mark.parametrize(("chunk", "fold", "rounds"), [(4, 2, 12), (7, 3, 1), (64, 64, 0)])
def test_long_conversation_in_parts(spark, chunk, fold, rounds):
    rows = talk_rows(4, 12, 150) + [(77, t, "user" if t % 2 else "assistant", f"{t % 40}.") for t in range(300)]
    rows = [r for r in rows if None not in r[2:]]
    numbered = turns.number_turns(talk(spark, rows))
    plans = turns.plan_repairs(numbered, chunk, fold, rounds)
    want = [r[:-1] for r in brute_repair([r[0] for r in rows], rows)]
    assert sorted((str(r[0]), *r[1:]) for r in plans.collect()) == want
    made = defaultdict(list)
    for r in turns.apply_repairs(numbered, plans).orderBy("place").collect():
        made[str(r.conv_id)].append(f"{r.role}:{r.text}")
    digests = {r[0]: r[-1] for r in brute_repair([r[0] for r in rows], rows)}
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in made.items()} == {c: d for c, d in digests.items() if c in made}


def test_repair_of_nothing_and_of_lost_turns(spark):
    none = talk(spark, [])
    assert turns.repair(none, turns.damage(none)).collect() == []
    given = talk(spark, [(1, 1, "user", "a."), (2, 1, "user", "a. " + "long " * 50_000)])
    rows = {r.conv_id: r for r in turns.repair(given, given.filter("conv_id = 2")).collect()}
    assert (rows[1].cost, rows[1].audit, rows[1].repaired_sha256) == (0, "", hashlib.sha256().hexdigest())
    assert (rows[2].truncated, rows[2].cost, rows[2].audit) == (1, 2, "D")


def test_ropes_compare_like_strings():
    rng = random.Random(2)

    def rope(text):
        if len(text) < 2:
            return turns.Rope(text)
        at = rng.randint(0, len(text))
        return turns.joined(rope(text[:at]), rope(text[at:])) if 0 < at < len(text) else turns.joined(rope(text[:1]), rope(text[1:]))

    for _ in range(500):
        a = "".join(rng.choice("DK") for _ in range(rng.randint(0, 12)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("DK") for _ in range(rng.randint(0, 4)))
        assert turns.rope_less(rope(a), rope(b)) == (a < b) and str(rope(a)) == a


def test_grammar_expands_to_the_sequences(spark):
    rng = random.Random(1)
    given = [bytes(rng.choice([1, 2, 2, 4, 5]) for _ in range(rng.randint(1, 60))) for _ in range(200)] + [b"\2" * 33]
    now, rules = turns.compress(spark.createDataFrame([(bytearray(g),) for g in given], "symbols binary"))

    def expand(symbol):
        return bytes([symbol]) if symbol < turns.FIRST_RULE else b"".join(map(expand, rules[symbol - turns.FIRST_RULE]))

    rows = now.collect()
    assert sorted(bytes(r.symbols) for r in rows) == sorted(set(given))
    assert all(b"".join(expand(int(s)) for s in np.frombuffer(r.now, np.uint16)) == bytes(r.symbols) for r in rows)
    assert sum(len(r.now) // 2 for r in rows) < sum(map(len, set(given))) / 2


def test_repair_of_the_table(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in QUERIES["op12_conversation_repair"](spark, SMALL).collect())
    assert got == brute_repair([r[0] for r in rows], damaged(rows))


# --- scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def base_scores(rows):
    counts = Counter(w for i, x in rows if not held(i) for w in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), held(i), len(tokens(x)), sum(counts[w] > 0 for w in tokens(x)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(x)), 6))
        for i, x in rows
    )


def scored(frame, **more):
    rows = lm.score_texts(frame, **more).collect()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


TEXTS = [(1, "The cat  saw THE cat."), (2, None), (None, "\n the \x0b dog"), (3, ""), (4, "ä Ä unseen-word"), (4, "ä Ä unseen-word"), (5, "x" * 100_000 + " " + "y " * 3000), (9, "only here held")]


@pytest.mark.parametrize("head_words", [0, 3, 1000])
def test_base_scores_wherever_the_head_ends(docs, head_words):
    frame = docs(TEXTS).selectExpr("*", "1 AS rid", "2 AS n", "'w' AS word", "3 AS c", "true AS held_out")
    assert scored(frame, head_words=head_words, rounds=1) == base_scores(TEXTS)


def test_scores_of_nothing_and_without_learnt_texts(docs):
    assert lm.score_texts(docs([])).collect() == []
    only = next(i for i in range(100) if held(i))
    assert scored(docs([(only, "a b a")])) == base_scores([(only, "a b a")])


def test_long_texts_are_split_at_spaces(monkeypatch):
    text = " ".join("ab" * (i % 9) for i in range(500)).encode()
    monkeypatch.setattr(lm, "PIECE", 64)
    assert [w for some in lm.words(text) for w in some] == text.split()


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = QUERIES["op13_lm_scoring"](spark, SMALL).collect()
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == base_scores(given)
    out = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.3


def test_unit_probabilities_add_up_to_one():
    rng = np.random.default_rng(8)
    model = lm.Model(*[rng.normal(0, 1, a.shape) for a in lm.Model.start(np.full(lm.UNITS, 1 / lm.UNITS)).arrays()])
    some = rng.integers(0, lm.UNITS**2, 50)
    scores = model.vectors(some) @ model.target.T + model.bias
    np.testing.assert_allclose(np.exp(scores - model.normalisers(some)[:, None]).sum(1), 1)


def test_shares_of_a_group_add_up_to_one(docs):
    """Words of one group after one context differ by their shares alone; an unseen word has the rest."""
    vocabulary = [f"zz{i}" for i in range(9)]
    learnt = [(i, " ".join(f"w{k}x w{k}x" for k in range(lm.UNITS)) + " " + " ".join(vocabulary[: 1 + i % 9])) for i in range(60) if not held(i)]
    counts = Counter(w for _, x in learnt for w in x.split())
    asked = [i for i in range(100, 1000) if held(i)]
    probes = dict(zip(asked, [f"w0x {w}" for w in [*vocabulary, "zznew"]], strict=False))
    rows = {r.doc_id: r for r in lm.score_texts(docs(learnt + list(probes.items())), head_words=300, rounds=1).collect()}
    group = [w for w in counts if lm.group(w.encode()) == lm.group(b"zz")]
    assert set(vocabulary) <= set(group)
    *seen, new = [rows[i].score for i in probes]
    unseen = (sum(counts[w] == 1 for w in group) + 0.5) / (sum(counts[w] for w in group) + 1)
    for w, score in zip(vocabulary, seen, strict=True):
        want = (1 - unseen) * counts[w] / sum(counts[v] for v in group) / unseen
        assert score - new == pytest.approx(math.log10(want), abs=1e-9)
