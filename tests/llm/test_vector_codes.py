"""Vector codes against plain distances in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from chartmeter.llm import vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 16])
def test_transform_keeps_distances(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-999, 999, (2, 50, n))
    wide = vector_codes.transform(a) - vector_codes.transform(b)
    assert ((wide**2).sum(1) == n * ((a - b) ** 2).sum(1)).all()
    changes = [(np.diff(r) != 0).sum() for r in vector_codes.transform(np.eye(n, dtype=int))[vector_codes.sequency_order(n)]]
    assert changes == list(range(n))


@pytest.mark.parametrize("width", [1, 3, 8, 12])
def test_nearest_is_that_of_all_distances(width):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-4, 4, (400, width)), rng.integers(-4, 4, (16, width))
    entries[9] = entries[3]
    found, distance = vector_codes.nearest(vector_codes.padded(parts), vector_codes.padded(entries))
    all_of_them = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (found == all_of_them.argmin(1)).all() and (distance == all_of_them.min(1)).all()
    assert 9 not in found


def expected(table, rounds=6):
    kept = [r for r in table if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    width = max(1, -(-max(map(len, ints)) // 8))
    cut = [[(v + [0] * 8 * width)[p * width : (p + 1) * width] for p in range(8)] for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:16]
    books = [[cut[i][p] for i in order] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(order)):
                members = [c[p] for c, o in zip(cut, own) if o == k]
                if members:
                    books[p][k] = [sum(m[j] for m in members) // len(members) for j in range(width)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[near(c[p], books[p]) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in c), e, sums[r[2]], digest) for r, c, e in zip(kept, coded, errors)), key=str
    )


def found(spark, table, schema=VECTORS):
    df = vector_codes.vector_codes(spark.createDataFrame(table, schema))
    df = df.withColumn("code", vector_codes.code_text(df.codes))
    return rows(df, "vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_by_brute_force(spark):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(24)] for _ in range(20)]
    table = [(900 - i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)], rng.choice((0, 1, None))) for i in range(120)]
    table += [table[0]] * 40  # a crowd of one vector
    assert found(spark, table) == expected(table)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf] * 8, 1), (4, [-inf] * 8, 1),
        (5, [0.5] * 9, None), (5, [0.5] * 9, None), (None, [-0.25] * 8, None), (6, [], 2), (7, [1.0, -1.0], 2), (5, [0.25] * 9, 1),
    ]
    assert found(spark, table) == expected(table) and len(expected(table)) == 6
    clash = [(*r, "x", 9) for r in table]
    assert found(spark, clash, VECTORS + ", code string, error int") == expected(table)
    for none in ([], [(1, None, 0)]):
        df = vector_codes.vector_codes(spark.createDataFrame(none, VECTORS))
        assert df.count() == 0 and df.columns[:2] == ["vec_id", "label"]
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(1, [1e30] * 8, 0)])
