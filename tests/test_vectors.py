import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.engine import Engine, load
from codeloom.operators import vectorindex


@pytest.mark.parametrize("block", [7, 1000])
def test_semantic_pairs_across_labels(spark, block):
    load()
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 4) for k in range(30)]
    rows += [(100 + k, [x + rng.gauss(0, 0.2) for x in rows[k][1]], (k + 1) % 4) for k in range(6)]  # near another label's vector
    rows += [(200, [2 * x for x in rows[0][1]], 0), (201, [0.0] * 8, 1), (202, [1.0, 2.0], 1), (203, [2.0, 4.0], 2), (204, None, 0), (205, [1.0, None], 1)]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    full = [(i, v) for i, v, _ in rows if v and None not in v]
    want = {(i, j): cosine(a, b) for i, a in full for j, b in full if i < j and len(a) == len(b) and cosine(a, b) >= 0.8}
    label = {i: x for i, _, x in rows}
    assert sum(label[i] != label[j] for i, j in want) >= 6
    got = Engine(spark, vectors=spark.createDataFrame(rows, "id long, vec array<float>, label long")).run("e11_semantic_pairs", block=block).collect()
    assert len(got) == len(want) and {(r.first_id, r.second_id) for r in got} == set(want)
    assert all(abs(r.similarity - want[r.first_id, r.second_id]) < 2e-5 for r in got)


def test_k_means(spark):
    """Well separated groups come out whole, and every vector stands with the nearest of the groups' means."""
    load()
    rng = random.Random(3)
    centers = [[20.0 * (k == j) for j in range(5)] for k in range(5)]
    rows = [(100 * k + i, [x + rng.gauss(0, 0.5) for x in c], k) for k, c in enumerate(centers) for i in range(20)]
    engine = Engine(spark, vectors=spark.createDataFrame(rows, "id long, vec array<float>, label long"))
    got = {r["id"]: r["cluster"] for r in engine.run("e12_kmeans", max_clusters=5).collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    members = {}
    for i, v, _ in rows:
        members.setdefault(got[i], []).append(v)
    means = {c: [sum(x) / len(x) for x in zip(*vs, strict=True)] for c, vs in members.items()}
    for i, v, _ in rows:
        assert math.dist(v, means[got[i]]) <= min(math.dist(v, m) for m in means.values()) + 1e-3
    for k in range(5):  # no cluster holds parts of two groups
        inside = {got[i] for i, _, label in rows if label == k}
        assert not inside & {got[i] for i, _, label in rows if label != k}
    few = Engine(spark, vectors=spark.createDataFrame(rows[:2], "id long, vec array<float>, label long"))
    assert few.run("e12_kmeans").collect() == []
    sizes = {}
    for r in engine.run("e12_kmeans").collect():
        sizes[r["cluster"]] = sizes.get(r["cluster"], 0) + 1
    assert len(sizes) <= 20 and min(sizes.values()) >= 3


def plain_cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def clustered(n, dims, seed):
    """Vectors around a few directions, with copies, zero vectors and other lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(40)] + [(1000, [0.0] * dims), (1001, [0.0] * dims), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1200, None), (1201, [1.0, None]), (None, rows[1][1])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows]


def test_searches_by_the_index_equal_brute_force(spark, monkeypatch):
    """Recall is 1, with small blocks and packs, few centres and several turns."""
    for name, value in (("SAMPLE", 60), ("PACK", 3), ("LOT", 2), ("TURN", 2)):
        monkeypatch.setattr(vectorindex, name, value)
    rows = clustered(300, 6, 9)
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    index = vectorindex.VectorIndex(df, block=16)
    full = {i: v for i, v, _ in rows if i is not None and v is not None and None not in v}
    for k, threshold in ((5, None), (3, 0.9), (None, 0.95)):
        got = {}
        for r in index.search("id % 50 = 0", k=k, threshold=threshold).collect():
            got.setdefault(r.query_id, []).append((-r.s, r.id))
        for q, v in full.items():
            if q % 50 == 0:
                best = sorted((-plain_cosine(v, w), i) for i, w in full.items() if i != q and len(w) == len(v) and (threshold is None or plain_cosine(v, w) >= threshold))[:k]
                assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in best]
                assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(sorted(got.get(q, [])), best, strict=True))
    packs = index.placed.where("id % 50 = 0 AND list >= 0").groupBy("list", F.lit(0).alias("salt")).applyInArrow(index._packer(None, 5), "pack binary, size int, lists array<long>").collect()
    assert min(len(r.lists) for r in packs) < len(index.centres)  # something is left out


def test_classes_count_copies_once_and_lose_no_link(spark):
    rows = clustered(120, 6, 10)
    full = {i: v for i, v, _ in rows if i is not None and v is not None and None not in v}
    links = {i: {j for j, w in full.items() if j != i and len(w) == len(v) and plain_cosine(v, w) >= 0.97} for i, v in full.items()}
    root = {i: i for i in full}
    for _ in full:
        for i, near in links.items():
            root[i] = min([root[i], *(root[j] for j in near)])
    engine = Engine(spark, vectors=spark.createDataFrame(rows, "id long, vec array<double>, label long"))
    got = {r.id: (r.class_id, r.links) for r in engine.run("e11_semantic_classes", threshold=0.97, block=32).where("id IS NOT NULL").collect()}
    assert got == {i: (root[i], len(links[i])) for i in full}
    assert got[1000] == (1000, 0)


def test_parts_of_a_feature_vector(spark):
    """The parts of a vector of 64 elements, and of one too short for them."""
    load()
    a, b = [0.0] * 64, [0.0] * 64
    a[3], b[3], a[45], b[46], a[25], b[63], a[63] = 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0
    rows = [(100, a, 0), (1, b, 0), (200, [1.0, 0.0], 0), (2, [1.0, 1.0], 0)]
    got = {(r.query_id, r.id): (r.semantic, r.structural, r.functional) for r in Engine(spark, vectors=spark.createDataFrame(rows[:2], "id long, vec array<float>, label long")).run("e06_sliced", queries="id = 100").collect()}
    assert got == {(100, 1): (0.0, round(1 / math.sqrt(2), 5), round(1 / math.sqrt(2), 5))}
    short = Engine(spark, vectors=spark.createDataFrame(rows[2:], "id long, vec array<float>, label long")).run("e06_sliced", queries="id = 200").first()
    assert (short.semantic, short.structural, short.functional) == (0.70711,) * 3
