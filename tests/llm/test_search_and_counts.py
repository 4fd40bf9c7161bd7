"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import re
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import hard_negatives, resample, secret_scan

# --- 11: hard negatives


def brute_negatives(rows, positives=5, negatives=10, scale=256):
    """Rows (vec_id, vector, label) as the contract says, all pairs compared."""
    took = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            took.append((i, [math.floor(scale * x) for x in v], label))
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, (i, v, label) in enumerate(took):
        if i is None or i % 100:
            continue
        scored = sorted(((-dot(v, w), last(j), b) for b, (j, w, _) in enumerate(took) if b != a))
        same = [x for x in scored if took[x[2]][2] == label][:positives]
        for s, _, b in same:
            inside = [x for x in scored if took[x[2]][2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, took[b][0], k + 1, took[x[2]][0], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<double>, label int, cell string, score string"


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    return sorted((tuple(r) for r in hard_negatives.mine(df, **options).collect()), key=str)


def clusters(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(6, size=n)] + 0.4 * rng.normal(size=(n, dims))
    return [(k, [float(x) for x in row / np.linalg.norm(row)], int(rng.integers(labels))) for k, row in enumerate(v)]


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("LEAF", 8), ("PACK", 3), ("SAMPLE", 60), ("LOT", 2), ("TURN", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clusters(500, 8, 3, 1)
    rows += [(k, rows[0][1], 1) for k in range(500, 700)]  # one vector that a quarter of all rows hold
    assert found(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_of_odd_rows(spark):
    rows = clusters(220, 5, 2, 2)
    rows += [(300, None, 1), (400, [1.0, None, 0.5], 1), (500, [math.nan, 1.0], 0), (600, [math.inf, 1.0], 0), (700, [0.5, 0.5], None), (800, [], 1), (900, [0.0] * 5, 0)]
    rows += [(0, rows[0][1], rows[0][2]), (100, rows[100][1], 1 - rows[100][2]), (None, rows[3][1], 0), (None, rows[0][1], 1), (1000, [0.5, 0.5], 1), (1001, [9.0, -3.0, 0.25], 0)]
    assert found(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_of_long_vectors(spark):
    """Norms past what float32, then float64 sums hold."""
    for factor in (300.0, 200000.0):
        rows = [(k, [factor * x for x in v], label) for k, v, label in clusters(120, 4, 2, 3)]
        assert found(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_of_nothing(spark):
    assert found(spark, []) == [] == found(spark, [(0, [1.0], 1)])
    assert found(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []  # a positive of negative score has no window


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, size=(300, 6))
    norm = int((rows**2).sum(1).max())
    high = hard_negatives.augmented(rows, norm)
    tree = hard_negatives.Tree(high[:100], 4)
    leaf, away = tree.leaf_of(high)
    low, top = tree.bounds(leaf, away)
    queries = rng.integers(-50, 50, size=(40, 6))
    least, most = tree.reach(hard_negatives.augmented(queries, None), low, top)
    scores = queries @ rows.T
    d = hard_negatives.distances((queries.astype(float) ** 2).sum(1)[:, None], norm, scores)
    assert (least[:, leaf] <= d + 1e-9).all() and (most[:, leaf] >= d - 1e-9).all()


def test_windows_of_an_anchor_share_its_vector():
    """An anchor's vector is stored, and multiplied with a block, once for all of its windows."""
    vec = np.array([3, 4], "<i4").tobytes()
    rows = {"row": [7, 5, 7, 7], "tag": [1, 2, 3, 4], "label": [0] * 4, "same": [False] * 4, "low": [0, 5, 10, 15], "high": [20] * 4, "vec": [vec] * 4}
    s = hard_negatives.Searches.read(hard_negatives.Searches(pa.table(rows), 2).stored(), 2)
    assert len(s.vecs) == 2 and s.rows.tolist() == [5, 7, 7, 7] and s.who.tolist() == [0, 1, 1, 1] and sorted(s.low[1:]) == [0, 10, 15]


# --- 12: importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, k1 string, bucket int, score string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[k : k + size]) for k in range(len(w)) for size in range(1, n + 1) if k + size <= len(w)]


def brute_draw(rows, target, n=1, buckets=10000, least=20, percent=10):
    code = lambda f: crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text, n):
                counts[code(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        f = features(text, n)
        weight = sum(gain[code(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def documents(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "été", "東京", "Straße", "ſ", "K"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(n)]
    return rows + [(None, rows[7][1] + " a b c"), (900, None), (901, ""), (902, " \n.,;"), (903, "Wort-für-Wort\tA1\x00b2 \x7fx" * 5), (904, "lang " * 200_000)] + [(905, "same " * 30)] * 150


TARGET = ["w1 w2 w3 w1", "W1 été", None, "", "same same"]


@pytest.mark.parametrize(("n", "buckets", "percent", "range_rows"), [(1, 10000, 10, 2000), (3, 97, 60, 7), (2, 10000, 100, 5)])
def test_resampling(spark, monkeypatch, n, buckets, percent, range_rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    rows = documents()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = resample.ranked(docs, target, n=n, buckets=buckets, percent=percent).collect()
    want = brute_draw(rows, TARGET, n, buckets, 20, percent)
    assert sorted((tuple(r) for r in got), key=str) == want
    drawn = resample.resample(docs, target, n=n, buckets=buckets, percent=percent)
    assert drawn.columns == docs.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r[0]) for r in want if r[4])


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.ranked(docs, target).collect() == [] == resample.resample(docs, target).collect()
    some = spark.createDataFrame([(1, "a b", "", 0, "")], DOCS)
    assert [r["rank"] for r in resample.ranked(some, target.where("false")).collect()] == [None]


def test_ring_of_states():
    text = " ".join(f"w{k % 7}" for k in range(50)).encode()
    w = text.split()
    for n in (1, 2, 4, 9):
        want = sorted(crc32(b" ".join(w[k : k + size])) for k in range(len(w)) for size in range(1, n + 1) if k + size <= len(w))
        assert sorted(resample.run_codes(w, n)) == want


# --- 13: secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
PIECES = ["password", "PassWd", "token", "secret", "api_key", "ApiKey", "apikey", " ", "  ", "=", ":", "'", '"', "abc", "deadbeef" * 4, "a0" * 15, "AKIA", "AKIAABCDEFGHIJKL", "Ä", "ſecret", "K", "€", "\n", "==", "x.y-z", "12345678", "0123456789abcdef" * 2, "://u:p@", "Zz9" * 9, "_", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----MIIabc"]


def base_of(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def own_of(text):
    out = [(m.start(), 3, m.end(), m[1]) for m in re.finditer(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\r\n]*([A-Za-z0-9+/=]*)", text)]
    out += [(m.start() + 3, 4, m.end() - 1, m[1]) for m in re.finditer(r"://[^\x00-\x20/:@]+:([^\x00-\x20/:@]+)@", text)]
    out += [(m.start(), 5, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 24 and all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]"))]
    return sorted(x for x in out if not any(a < x[2] and b > x[0] for a, _, b in base_of(text)))


def brute_secrets(rows, max_owners=2, max_repos=10):
    held = {}
    values = []
    for i, text, owner in rows:
        t = text or ""
        mine = [(a, k, b, (ASSIGN.match(t, a)[2] if k == 0 else t[a:b])) for a, k, b in base_of(t)] + own_of(t)
        values.append(sorted(mine))
        for x in mine:
            held.setdefault(x[3], set()).add((owner, i))
    live = {v for v, o in held.items() if len({w for w, _ in o}) <= max_owners and len(o) <= max_repos}
    kinds = ("assign", "access", "hex", "key", "url", "mixed")
    spell = lambda xs: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in xs)
    out = []
    for (i, _, _), xs in zip(rows, values, strict=True):
        told = [x for x in xs if x[1] < 3 or x[3] in live]
        known = [x for x in told if x[3] in live]
        out.append((i, *(sum(x[1] == k for x in xs) for k in range(3)), hashlib.sha256(spell([x for x in xs if x[1] < 3]).encode()).hexdigest(), spell(told), len(known), spell(known)))
    return sorted(out, key=str)


def secret_rows():
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(20))), f"o{rng.randrange(4)}") for k in range(500)]
    shown = "see https://user:hunter2@example.org and token = ABCDabcd0123EFGHefgh4567xyz"
    rows += [(600 + k, shown, f"o{k}") for k in range(6)] + [(700 + k, "one owner's Ab1" + "x" * 30, "o9") for k in range(11)] + [(800, "mine: Ab2" + "y" * 30, "o1")] * 20
    return rows + [(None, "password: abcdefgh9", None), (900, None, "o1"), (901, "", None), (902, "secret=" + "k" * 300_000 + " ö " + "0f" * 200_000, "o2"), (903, "password = short", "o1")]


def test_secrets(spark):
    rows = secret_rows()
    df = spark.createDataFrame([(i, t, o, "clash", "clash") for i, t, o in rows], "doc_id long, text string, source string, value string, spans string")
    for limit in (1 << 20, 0):
        got = secret_scan.digest(df, max_broadcast=limit).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_secrets(rows)


def test_secrets_sql(spark):
    rows = secret_rows()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    assert sorted((tuple(r) for r in con.execute(secret_scan.oracle()).fetchall()), key=str) == brute_secrets(rows)


def test_secrets_of_nothing(spark):
    assert secret_scan.digest(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_secrets_by_bytes():
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        _, _, rows = secret_scan.found_in(text.encode())
        assert [(r["start"], r["kind"], r["end"]) for r in rows] == sorted(base_of(text) + [x[:3] for x in own_of(text)])
