"""Extra columns whose names the operators use themselves change nothing, and empty tables give no rows."""

import pytest

from adgauge.llm import exact, mixing, packing, quality, repeats, sharding, simhash

NAMES = (
    "digest row file key keep_id kept group_size spans content start n o2 core shard slot size bin piece pieces bin_id fp label node fingerprint "
    "component_id rid tokens probability margin_off sampled mix_source win_id win_key win_rows batch word id stays spot ring weight cluster residual"
).split()
ROWS = [
    (1, "Some text of a few words that is long enough to share " * 12, "src1"), (2, "Some text of a few words that is long enough to share " * 12, "src2"),
    (None, None, None), (3, "", "src1"), (3, "", "src1"), (4, "the other one, alone", "src0"), (None, "Ünïcode \0 text", "src2"),
]
OPERATORS = {
    "pack": packing.pack, "mix": mixing.mix, "sample_mix": mixing.sample_mix, "place": lambda d: sharding.place(d, 3), "remove_repeats": lambda d: repeats.remove_repeats(d, 40, 4),
    "find_copies": exact.find_copies, "drop_copies": exact.drop_copies, "find_near": simhash.find_near, "drop_near": simhash.drop_near, "drop_poor": quality.drop_poor,
}


@pytest.fixture
def frames(docs):
    plain = docs(ROWS)
    return plain, plain.selectExpr("*", *[f"'own' AS `{n}`" for n in NAMES])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(frames, name):
    plain, clashing = frames
    given = OPERATORS[name](plain)
    found = OPERATORS[name](clashing)
    shared = [c for c in given.columns if c in plain.columns or c not in NAMES or name not in ("sample_mix", "drop_copies", "drop_near", "drop_poor")]
    if name == "find_copies":
        shared.remove("key")
    want = sorted(map(repr, given.select(*shared).collect()))
    assert sorted(map(repr, found.select(*shared).collect())) == want
    kept = [c for c in NAMES if c in found.columns and c not in given.columns]
    if name.startswith(("drop", "sample")):
        assert kept == NAMES  # filters carry the columns on
        assert {r[c] for r in found.collect() for c in kept} <= {"own"}
    assert OPERATORS[name](clashing.limit(0)).count() == 0
