"""Operators that bring rows together: packing, mixing, sharding, repeats, exact and near copies."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adgauge.llm import exact, mixing, packing, repeats, sharding, simhash
from adgauge.llm.common import keep_rows, text_key
from adgauge.llm.queries import QUERIES
from tests.conftest import SMALL

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = prose(30_000)
    return [
        (1, None, "src0"), (2, "", "src0"), (2, "", "src0"), (3, "a b", "src0"), (None, "a b", None), (None, None, None), (4, long, "src0"),
        (5, long, "src2"), (5, long, "src2"), (6, " ", "src1"), (7, "é ☃ \u0085 x", "src1"), (8, "A B", "src3"), (9, prose(60), None),
        (9, prose(60), "src1"),
    ]


# packing


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.group, r.bin].append(r)
    for own in bins.values():
        assert len({r.source for r in own}) == len(own)
        assert len({r.cluster for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: (r.start, r.length)):
            assert r.start == at
            at += r.length
        assert at + own[0].residual == capacity and len({r.residual for r in own}) == 1 and at <= capacity


def test_packing_of_odd_rows(docs):
    rows = odd_rows()
    got = packing.pack(docs(rows), capacity=100, group_pieces=64).collect()
    check_packing(got, 100)
    whole = Counter()
    for r in got:
        whole[r.doc_id, r.source, r.cluster, r.copy] += r.length
    length = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((k[0] or 0, v) for k, v in whole.items()) == sorted((i or 0, length(t)) for i, t, _ in rows)
    assert packing.pack(docs(rows).limit(0)).count() == 0


def test_packing_is_best_fit():
    import pandas as pd

    rng = random.Random(2)
    for _ in range(20):
        n, capacity = 120, 50
        given = pd.DataFrame({
            "doc_id": range(n), "nameless": False, "source": [rng.choice(["a", "b", "c", None]) for _ in range(n)],
            "cluster": [rng.randint(0, 30) for _ in range(n)], "length": [rng.randint(0, 50) for _ in range(n)], "piece": 0, "copy": 0, "group": 0,
        })
        got = packing.pack_group(given, capacity)
        bins = []  # residual and what is in it, in order of opening
        for r in got.itertuples():
            fits = [(b["residual"], i) for i, b in enumerate(bins) if b["residual"] >= r.length and not b["in"] & {r.source, r.cluster}]
            if fits:
                assert bins[r.bin]["residual"] == min(fits)[0] and not bins[r.bin]["in"] & {r.source, r.cluster}
            else:
                assert r.bin == len(bins)
                bins.append({"residual": capacity, "in": set()})
            assert r.start == capacity - bins[r.bin]["residual"]
            bins[r.bin]["residual"] -= r.length
            bins[r.bin]["in"] |= {r.source, r.cluster}


# mixing


def test_raking_meets_the_margins():
    cells = {("a", "x"): 10.0, ("a", "y"): 30.0, ("b", "x"): 40.0, ("b", "y"): 20.0}
    targets = {"one": {"a": 0.5, "b": 0.3, "none": 0.2}, "two": {"x": 0.6, "y": 0.4}}
    w = mixing.rake(cells, targets)
    assert sum(w.values()) == pytest.approx(1)
    assert w["a", "x"] + w["a", "y"] == pytest.approx(0.625) and w["a", "x"] + w["b", "x"] == pytest.approx(0.6)
    # proportional fitting keeps the odds ratio
    assert w["a", "x"] * w["b", "y"] / (w["a", "y"] * w["b", "x"]) == pytest.approx(10 * 20 / (30 * 40))
    bound = mixing.rake(cells, targets, share=0.5)
    p = mixing.probabilities(cells, bound, 0.5)
    assert all(0 <= x <= 1 for x in p.values())
    assert sum(p[k] * cells[k] for k in cells) <= 50 + 1e-6
    assert mixing.rake({}, targets) == {}


def test_mixing(spark, docs):
    df = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    got = df.groupBy("mix_source", "mix_lang", "mix_topic").agg({"tokens": "sum", "probability": "max", "*": "count"}).collect()
    expected, sampled = Counter(), Counter()
    for r in df.filter("sampled").groupBy("mix_source", "mix_lang", "mix_topic").agg({"tokens": "sum"}).collect():
        for axis, level in enumerate(r[:3]):
            sampled[axis, level] += r[3]
    for r in got:
        for axis in range(3):
            expected[axis, r[axis]] += r["sum(tokens)"] * r["max(probability)"]
    total = sum(v for (axis, _), v in expected.items() if axis == 0)
    for axis, wanted in enumerate(mixing.TARGETS.values()):
        here = {k: v for k, v in wanted.items() if (axis, k) in expected}
        for level, share in here.items():
            assert expected[axis, level] / total == pytest.approx(share / sum(here.values()), abs=0.002)
            assert sampled[axis, level] / sum(v for (a, _), v in sampled.items() if a == axis) == pytest.approx(expected[axis, level] / total, abs=0.04)
    given = odd_rows()
    rows = mixing.mix(docs(given)).collect()
    assert len(rows) == len(given)
    for r in rows:  # the hash alone decides
        assert r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    same = defaultdict(set)
    for r in rows:
        same[r.doc_id, r.text].add(r.sampled)
    assert all(len(v) == 1 for v in same.values())
    kept = mixing.sample_mix(docs(given))
    assert kept.columns == docs(given).columns
    taken = {(x.doc_id, x.text) for x in rows if x.sampled}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs(given).collect() if (r.doc_id, r.text) in taken)
    assert mixing.mix(docs(given).limit(0)).count() == 0


def brute_mix(rows, rounds, share=0.5):
    """rows: (doc_id, text, lang, source). Cells, targets, fitting and sampling in plain numbers."""
    from xxhash import xxh64_intdigest

    def place(doc_id, text):
        h = 42
        if doc_id is not None:
            h = xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        h = xxh64_intdigest(text.encode(), h) if text is not None else h
        return xxh64_intdigest(h.to_bytes(8, "little"), 42) >> 11

    told = []
    for doc_id, text, lang, source in rows:
        whole = text or ""
        n = len(re.findall(r"[^\x20\x09-\x0D]+", whole))
        notice = any(x in whole.lower() for x in ("license", "licence", "copyright"))
        topic = "notice" if notice else "listing" if 20 * len(re.findall(r"[|#*$%&<>]", whole)) > n else "other" if n < 20 else "short prose" if n < 400 else "long prose"
        told.append((source or "other", lang if lang in mixing.TARGETS["lang"] else "other", topic, n, place(doc_id, text)))
    cells = Counter()
    for *levels, n, _ in told:
        cells[tuple(levels)] += n
    total = sum(cells.values())
    goals = []
    for axis, wanted in enumerate(mixing.TARGETS.values()):
        held = Counter()
        for levels, n in cells.items():
            held[levels[axis]] += n
        wanted = wanted or mixing.tempered(held, share)
        there = sum(v for k, v in wanted.items() if held[k] > 0)
        goals.append({k: wanted.get(k, 0.0) / there for k in held if held[k] > 0})
    w = {k: n / total for k, n in cells.items()}
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            sums = Counter()
            for k, v in w.items():
                sums[k[axis]] += v
            w = {k: v * goal.get(k[axis], 0.0) / sums[k[axis]] if sums[k[axis]] > 0 else 0.0 for k, v in w.items()}
        w = {k: min(v, cells[k] / total / share) for k, v in w.items()}
    p = {k: min(1.0, v * total * share / cells[k]) if cells[k] else 0.0 for k, v in w.items()}
    return [(i, t, *levels, n, p[tuple(levels)], at / 2**53) for (i, t, *_), (*levels, n, at) in zip(rows, told, strict=True)]


@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 0])
def test_mixing_equals_brute_force(spark, docs, driver_cells, monkeypatch):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in given] + [(None, None, None, None), (None, "", "xx", "src1"), (7, "a b c", "en", None), (7, "a b c", "en", None)]
    rounds = 1000 if driver_cells else 8
    monkeypatch.setattr(mixing.rake_table, "__defaults__", (rounds, 0.0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS probability", "'x' AS n", "2 AS w").repartition(3)
    got = mixing.mix(frame, driver_cells=driver_cells).collect()
    assert "n" in got[0] and got[0]["n"] == "x"
    key = lambda r: (repr(r[:2]), r[5])
    mine = sorted(((r.doc_id, r.text, r.mix_source, r.mix_lang, r.mix_topic, r.tokens, r.probability, r.sampled) for r in got), key=key)
    for a, b in zip(mine, sorted(brute_mix(rows, rounds), key=key), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], abs=1e-6)
        assert a[7] == (b[7] < a[6])


def test_every_source_has_a_target(spark, docs):
    assert mixing.tempered({"a": 16.0, "b": 1.0, "c": 1.0}, power=0.5) == pytest.approx({"a": 4 / 6, "b": 1 / 6, "c": 1 / 6})
    held = {"a": 98.0, "b": 1.0, "c": 1.0}
    assert mixing.tempered(held, 0.5, 0.5) == pytest.approx({"a": 0.96, "b": 0.02, "c": 0.02})  # no more than there is
    df = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    got = df.groupBy("source", "mix_source").agg({"tokens": "sum", "margin_off": "max"}).collect()
    assert len(got) == 20 and all(r.source == r.mix_source for r in got) and max(r["max(margin_off)"] for r in got) < mixing.MISS
    wanted = mixing.tempered({r.source: r["sum(tokens)"] for r in got}, mixing.SHARE)
    weights = df.selectExpr("source", "tokens * probability AS w").groupBy("source").sum("w").collect()
    total = sum(r["sum(w)"] for r in weights)
    assert {r.source: r["sum(w)"] / total for r in weights} == pytest.approx(wanted, abs=1e-6)
    # a table that cannot give its margins says so
    with pytest.warns(UserWarning, match="margins missed"):
        rows = mixing.mix(docs([(i, "a b c " * 10, "hot" if i else "rare") for i in range(20)]), {**mixing.TARGETS, "source": {"rare": 0.5, "hot": 0.5}}).collect()
    assert min(r.margin_off for r in rows) > 0.3


# sharding


def brute_places(rows, shards, vnodes, slack, cells=64):
    """Keys in ring order, each to the first shard clockwise with room."""
    from xxhash import xxh64_intdigest

    def spot(kind, *longs):
        h = xxh64_intdigest(kind, 42)
        for x, size in longs:
            if x is not None:
                h = xxh64_intdigest(int(x).to_bytes(size, "little", signed=True), h)
        return (h - (1 << 64) if h >> 63 else h) % sharding.CIRCLE

    nodes = sorted((spot("node", (s, 4), (r, 8)), s, r) for s in range(shards) for r in range(vnodes))
    keyed = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        at = spot("key", (doc_id, 8))
        arc = next((i for i, n in enumerate(nodes) if n[0] >= at), 0)
        crc = zlib.crc32(raw)
        keyed.append((arc, crc % cells, at, doc_id is not None, doc_id or 0, len(raw) + 1, crc))
    n = len(rows)
    room = [-(-n * (1 + slack) // shards) if slack else n // shards + (s < n % shards) for s in range(shards)]
    load, out = [0] * shards, []
    for arc, _, _, named, doc_id, size, crc in sorted(keyed):
        i = arc
        while load[nodes[i][1]] >= room[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        s = nodes[i][1]
        out.append((doc_id if named else None, size, crc, s, load[s]))
        load[s] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_sharding_equals_brute_force(docs, slack):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100, "same")] * 40 + [(i, prose(3)) for i in range(200, 350)]
    got = sharding.place(docs(rows), 5, vnodes=8, slack=slack).collect()
    assert sorted(map(tuple, got), key=repr) == brute_places(rows, 5, 8, slack)


def test_sharding_laws(docs, spark):
    got = QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    loads = Counter(r.shard for r in got)
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in loads.items())
    # with slack, little more than a shard's part moves when one is added
    rows = docs([(i, "x") for i in range(3000)])
    old, new = ({r.doc_id: r.shard for r in sharding.place(rows, n, vnodes=128, slack=0.3).collect()} for n in (10, 11))
    assert sum(old[i] != new[i] for i in old) < 0.25 * len(old)
    assert max(Counter(new.values()).values()) <= -(-3000 * 1.3 // 11)
    assert sharding.place(rows.limit(0), 4).count() == 0


# repeats


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(length):
    rng = random.Random(length)
    passages = [prose(length // 2, rng) for _ in range(4)]
    texts = [None, "", "x", "ab" * length, "a" * (length + 1), "a" * length, "a" * length, "é☃" * length]
    for i in range(60):
        part = rng.choice(passages)
        low = rng.randint(0, len(part) // 3)
        texts.append(prose(rng.randint(0, 60), rng) + part[low : low + length + rng.randint(-2, 30)] + prose(rng.randint(0, 60), rng))
    texts += [texts[-1], texts[-1], texts[-2][:-1], passages[0] + passages[0], passages[1] + "!" + passages[1]]
    hot = prose(length, rng)
    texts += [f"{i}-{hot}-{i}" for i in range(40)]
    edited = list(prose(3 * length, rng))
    for _ in range(20):
        edited[rng.randrange(len(edited))] = rng.choice("xyz")
        texts.append("".join(edited))
    return texts


@pytest.mark.parametrize(("length", "gram", "largest"), [(20, 4, 20_000), (20, 4, 5), (37, 8, 2), (64, 2, 20_000)])
def test_repeats_equal_brute_force(docs, monkeypatch, length, gram, largest):
    texts = repeat_texts(length)
    monkeypatch.setattr(repeats, "PIECE", 97 if largest == 5 else repeats.PIECE)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    found = repeats.remove_repeats(docs(rows), length, gram, largest).collect()
    got = sorted((r.doc_id or -1, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted(((r[0] or -1, *b) for r, b in zip(rows, brute_repeats(texts, length), strict=True)))


@pytest.mark.parametrize("order", [*itertools.permutations(range(4))])
def test_repeats_with_null_characters_in_any_order(order):
    x = "".join(random.Random(3).choices("abc", k=19)).encode()
    strings = [[x + b"\0", b"y" + x, x + b"\0a", x + b"\0\0"][i] for i in order]
    o2 = [1 if s[:1] == b"y" else 0 for s in strings]
    found = repeats.repeated_windows(np.zeros(4, np.int64), strings, np.array(o2), np.array([len(s) - 19 for s in strings]), 20)
    want = {(i, 0, 0) for i, s in enumerate(strings) if s[:20] == x + b"\0"}
    assert set(found) == want


def test_repeats_of_texts_with_null_characters(docs):
    rng = random.Random(17)
    for _ in range(3):
        parts = ["".join(rng.choices("ab\0", k=rng.randint(8, 40))) for _ in range(6)]
        texts = ["".join(rng.choices(parts, k=rng.randint(1, 4))) + "\0" * rng.randint(0, 3) for _ in range(30)]
        found = repeats.remove_repeats(docs(list(enumerate(texts))), 20, 4, 5).collect()
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found}
        assert [got[i] for i in range(30)] == brute_repeats(texts, 20)


def test_repeats_query_returns_what_is_left(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_suffix_array_dedup"](spark, SMALL).collect()}
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        r, raw = rows[doc_id], (text or "").encode()
        gone = {i for s in r.spans for i in range(s.start, s.end)}
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and len(gone) == r.n_removed
        assert r.text.replace("\ufffd", "") == kept.decode(errors="ignore").replace("\ufffd", "")


def test_repeats_of_the_tables(spark, docs):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(900, rows[5][1][50:] + "z" + rows[7][1][:700])]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(rows)).collect()}
    for (doc_id, _), want in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True):
        r = got[doc_id]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want
    assert repeats.remove_repeats(docs(rows).limit(0)).count() == 0


# exact copies


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(docs, weak):
    from pyspark.sql import functions as F

    rows = odd_rows() + [(i, f"text {i % 7}") for i in range(20, 60)] + [(77, "twice")] * 3
    digest = (lambda t: F.substring(exact.sha256(t), 1, 0 if weak == 2 else 1).substr(1, 1)) if weak else exact.sha256
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))) if weak else exact.sha256
    got = exact.find_copies(docs(rows), digest, files_per_trigger=1).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""])) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.find_copies(docs(rows).limit(0)).count() == 0


def test_exact_stage_keeps_one_row_of_each_text(docs):
    rows = odd_rows() + [(77, "twice", "src1")] * 3 + [(78, "twice", "src2")]
    kept = exact.drop_copies(docs(rows))
    assert kept.columns == docs(rows).columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})


def test_state_takes_only_new_files(spark, docs, tmp_path):
    log, state, out = (str(tmp_path / x) for x in ("log", "state", "out"))
    schema = "doc_id long, digest binary, row long, file string"
    for start, want in ((0, 5), (5, 10)):
        spark.range(start, start + 5).selectExpr("id AS doc_id", "cast('d' AS binary) AS digest", "id AS row", "'f' AS file").write.mode("append").parquet(log)
        exact.fold_stream(spark, log, schema, state, out)
        last = max(spark.read.parquet(out).collect(), key=lambda r: r.batch)
        assert (last.group_size, last.stays.doc_id) == (want, want - 1)


# near copies


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(prints))]


def near_rows():
    rows = [(i, t) for i, t, _ in odd_rows()]
    rng = random.Random(8)
    for g in range(12):
        words = prose(400, rng).split()
        for _ in range(8):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((rng.randint(100, 400), " ".join(words)))
    return rows


def test_near_copies_equal_brute_force(docs):
    rows = near_rows()
    got = simhash.find_near(docs(rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(prints, [i for i, _ in rows])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True)), key=repr)
    assert len(set(want)) < len({i for i, _ in rows}) and max(Counter(want).values()) > 3
    assert simhash.find_near(docs(rows).limit(0)).count() == 0


def test_near_stage_keeps_one_row_of_each_component(docs):
    rows = near_rows()
    kept = simhash.drop_near(docs(rows))
    assert kept.columns == docs(rows).columns
    prints = [brute_fingerprint(t) for _, t in rows]
    roots, names = brute_components(prints, [*range(len(rows))]), brute_components(prints, [i for i, _ in rows])
    want = dict(zip(roots, names, strict=True))  # components may share a name or have none
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((c or -1) for c in want.values())


def test_near_stage_counts_components_by_root(docs):
    rng = random.Random(21)
    copies = prose(400, rng)
    rows = [(None, prose(80, rng)) for _ in range(20)] + [(7, prose(80, rng)) for _ in range(3)] + [(None, copies), (None, copies), (5, copies), (6, copies)]
    rows += [(None, None), (None, ""), *near_rows()]
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints, [*range(len(rows))])  # row numbers tell components apart that share a name
    names = brute_components(prints, [i for i, _ in rows])
    kept = [(r.doc_id, r.text) for r in simhash.drop_near(docs(rows)).collect()]
    root_of, name_of = {t or "": c for (_, t), c in zip(rows, roots, strict=True)}, dict(zip(roots, names, strict=True))
    assert len(kept) == len(set(roots)) > len(set(names)) + 20
    assert sorted(root_of[t or ""] for _, t in kept) == sorted(set(roots))
    assert all(i == name_of[root_of[t or ""]] for i, t in kept) and {(i, t or "") for i, t in kept} <= {(i, t or "") for i, t in rows}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(-(1 << 63), 1 << 63, 200)
    near = [int(p) ^ (1 << int(a)) ^ (1 << int(b)) for p, (a, b) in zip(prints, rng.integers(0, 63, (200, 2)), strict=True)]
    chain = [0]
    for bit in range(0, 60, 2):
        chain.append(chain[-1] ^ (3 << bit))
    values = sorted({*map(int, prints), *near, *chain})
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    label = {v: v for v in values} | {r.node: r.label for r in found}
    masks = [v & ((1 << 64) - 1) for v in values]
    assert [label[v] for v in values] == brute_components(masks, values)


def test_golay_keys():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 23, 300)
    index = simhash.golay_index(np.arange(1 << 23))
    assert len(np.unique(index)) == 1 << 12 and set(np.bincount(index)) == {1 << 11}
    keys = simhash.golay_keys(words)
    assert max(len(set(k)) for k in keys) <= 6
    for a in range(23):
        for b in range(a, 23):
            other = simhash.golay_keys(words ^ (1 << a) ^ ((1 << b) if b > a else 0))
            assert all(set(x) & set(y) for x, y in zip(keys, other, strict=True))


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs.limit(0), SMALL).schema)
        if name != "best-fit packing":
            assert docs.columns == names
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 20
    assert sorted(r.doc_id for r in docs.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect())


def test_repeats_keep_the_same_row_and_stages_are_written(spark, docs, monkeypatch):
    import corpus_pipeline

    rows = [(1, "a b", f"src{i}") for i in range(9, 0, -1)] + [(None, None, "src2"), (None, "", "src1"), (None, None, None)]
    for n in (1, 5):
        df = docs(rows, partitions=n)
        winners = df.groupBy(F.col("doc_id").alias("win_id"), text_key(df["text"]).alias("win_key")).agg(F.count("*").alias("win_rows"))
        assert sorted((r.doc_id or 0, r.text, r.source) for r in keep_rows(df, winners).collect()) == [(0, None, None), (1, "a b", "src1")]
        tagged = df.withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
        assert {r.source for r in keep_rows(tagged, winners).collect() if r.doc_id} == {"src1"}
    given = []

    def stage(spark, df, folder):
        given.append(df.inputFiles())
        return df.filter("n_chars > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    corpus_pipeline.run(spark, SMALL)
    assert not any(set(a) & set(b) for a, b in zip(given, given[1:])) and all(given)
