import hashlib
import math
import random

import pytest

from sievework.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, cluster string, c0 int"


def plain(rows, k, dims, rounds):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted((digest(i), x) for i, x in kept)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def told():
        return [min((far(x, c), n) for n, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        own = told()
        for n in range(len(centres)):
            if members := [x for (_, x), (_, m) in zip(kept, own) if m == n]:
                centres[n] = [sum(col) // len(members) for col in zip(*members)]
    own = told()
    inertia = {n: sum(d for d, m in own if m == n) for _, n in own}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((-1 if i is None else i), m, d, inertia[m], sum(inertia.values()), sha[m]) for (i, _), (d, m) in zip(kept, own))


def told_by(spark, rows, **settings):
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA).repartition(3)
    found = lloyd.cluster(table, **settings).collect()
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found)


@pytest.mark.parametrize(("dims", "width", "chunk", "k"), [(6, 2, 4, 3), (5, 3, 100, 4), (4, 4, 7, 8), (3, 1, 1, 2)])
def test_equal_to_the_plain_loop_for_any_blocks(spark, dims, width, chunk, k):
    r = random.Random(dims)
    float32 = lambda x: round(x * 4096) / 4096  # noqa: E731  the same as a float and a double
    rows = [(i, [float32(r.gauss(i % 3, 0.7)) for _ in range(dims)]) for i in range(60)]
    assert told_by(spark, rows, dims=dims, width=width, chunk=chunk, k=k, rounds=4) == plain(rows, k, dims, 4)


def test_nulls_other_lengths_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 3, [0.5, -0.5]) for i in range(9)] + [(10, [0.25, 0.25]), (10, [0.25, 0.25]), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    out = [(20, None), (21, []), (22, [1.0]), (23, [1.0, None]), (24, [nan, 1.0]), (25, [inf, 1.0]), (26, [-inf, 1.0]), (27, [1.0, 2.0, 3.0])]
    assert told_by(spark, rows + out, dims=2, width=1, k=5, rounds=3) == plain(rows, 5, 2, 3)
    assert told_by(spark, out, dims=2) == [] and told_by(spark, [], dims=2) == []
    assert len(told_by(spark, rows[:1], dims=2, k=8)) == 1


def test_components_without_exact_distances_are_refused():
    import numpy as np

    assert lloyd.scaled(np.array([[-0.0001, 65536.0]]), 1024).tolist() == [[-1, 1 << 26]]
    with pytest.raises(ValueError, match="64-bit"):
        lloyd.scaled(np.array([[1e9]]), 1024)


def test_a_block_never_meets_another_one_of_its_chunk(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0]) for i in range(40)]
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)
    blocks = lloyd.column_blocks(lloyd.whole_vectors(table, 4, vec_id="vec_id", embedding="embedding"), 4, 2, 8, 1024)
    got = blocks.collect()
    assert {(len(r.m), r.n) for r in got} <= {(2 * n, n) for n in range(1, 9)} and sorted(i for r in got for i in r.ids or ()) == list(range(40))
    assert len({(r.chunk, r.block) for r in got}) == len(got)
