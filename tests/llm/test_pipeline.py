"""The pipeline against brute force: each stage by row, on rows that repeat ids, are repeated, or have none."""

import random
import re

import pytest

from codeloom.llm import piece_codec, quality_knn
from codeloom.llm.queries import PIECES
from test_pair_operators import WORDS, brute_lines, edit_distance  # noqa: F401

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, lines long, k1 long"


def write(spark, folder, docs, labels, items):
    rows = [(i, t, "en", "s", -1 if t is None else len(t), "clash", 7, 8) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def corpus():
    rng = random.Random(8)
    passage = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, passage(15)) for k in range(3)] + [(9, None), (None, passage(9))]
    docs = [(k, "\n".join(passage(20) for _ in range(4))) for k in range(20)]
    a, b = docs[0][1], docs[1][1]
    docs += [(20, a), (21, " ".join(b.replace("\n", " ").split()[:-1] + ["changed"]))]  # all lines copied; a near copy in one line
    docs += [(22, passage(10) + "\n" + items[0][1] + " " + passage(10)), (5, passage(12) + " " + items[1][1])]  # leaks, one under an id that repeats
    docs += [(7, passage(40)), (7, passage(40)), (None, passage(40)), (None, passage(8) + " " + items[2][1]), (None, None), (23, ""), (24, passage(9000))]
    docs += [(25, passage(30)), (25, docs[-1][1][:100])]
    docs += [(26, x := passage(25)), (26, x)]  # the same row twice
    line = passage(9)
    docs += [(40, line + "\n" + passage(30)), (3, passage(30) + "\n" + line[:-1] + "z"), (40, passage(30) + "\n" + line)]
    return docs, [(30 + k, f"###!! $$%d {k} " * 30) for k in range(10)], items


def shingles(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, percent=80):
    """One row of each group: the one of the smallest id, null last; of equal rows one."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x, r in enumerate(rows):
        groups.setdefault(find(x), []).append(r)
    return groups.values()


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, bad, items = corpus()
    labels = [(i, 1, 0) for i, _ in docs if i is not None] + [(i, 0, 0) for i, _ in bad]
    folder = write(spark, tmp_path, docs + bad, labels, items)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    # quality: the rows that the classifier accepts, one by one
    space = quality_knn.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in docs + bad if float(quality_knn._scores(space, [r[1]], 2048, 15, 4.0)[0]) >= 0.5]
    first = pipeline.quality_stage(spark, frame, folder)
    assert first.columns == frame.columns and plain(first) == sorted(good, key=str)
    assert not {i for i, _ in good} & {i for i, _ in bad} and (None, None) not in good

    # lines
    keys = {r: k for k, r in enumerate(sorted(set(good), key=lambda r: (r[0] is None, r[0] or 0)))}
    ranked = [(keys[r], r[1]) for r in good]
    kept = brute_lines(list(dict.fromkeys(ranked)))
    lines = []
    for r in good:
        rest = [x for k, x in enumerate(r[1].split("\n")) if kept.get((keys[r], k), ((keys[r], k), 0))[0] == (keys[r], k)]
        if len(rest) == len(r[1].split("\n")) or "".join(rest).strip():
            lines.append((r[0], "\n".join(rest)))
    second = pipeline.line_stage(spark, first, folder)
    assert second.columns == frame.columns and plain(second) == sorted(lines, key=str)
    assert all(r.n_chars == len(r.text) for r in second.collect())

    # near duplicates
    third = pipeline.near_dedup_stage(spark, second, folder)
    got = plain(third)
    groups = brute_near(lines)
    assert len(got) == len(groups)
    for g in groups:
        stay = [r for r in got if r in g]
        assert len(stay) == 1 and stay[0][0] == min((i for i, _ in g), key=lambda i: (i is None, i or 0))

    # benchmark
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 8]) for i, t in items if i is not None for w in [words(t)] if w for k in range(max(len(w) - 7, 1))}
    holds = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    fourth = pipeline.decontamination_stage(spark, third, folder)
    left = sorted((r for r in got if not holds(r[1])), key=str)
    assert fourth.columns == frame.columns and plain(fourth) == left

    # pieces, and the whole
    c = piece_codec.codec(piece_codec.read_model(PIECES))
    whole = sorted((str(r.doc_id), list(r.ids)) for r in pipeline.run(spark, folder).collect())
    assert whole == sorted((str(i), c.encode(t)) for i, t in left)


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, folder).collect() == []
