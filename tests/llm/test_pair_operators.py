"""Operators 4, 5, 6 and 7 and the pipeline against brute force."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import decontaminate, license_scan, line_dedup, near_dedup

WORDS = [f"w{k}" for k in range(400)]
SCHEMA = "doc_id long, text string, lang string, key string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in rows], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    rows, rep = [], [rng.choice(WORDS) for _ in range(120)]
    for k in range(40):  # one group of near copies, some of them near the threshold
        w = list(rep)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((k, " ".join(w)))
    rows += [(50 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))) for k in range(30)]
    rows += [(90, "only three words"), (91, "Only Three\twords"), (92, ""), (93, None), (94, " \n "), (95, rows[0][1].upper()), (96, " ".join(WORDS) * 30), (90, "only three words"), (None, "only three words")]
    return rows


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 70])
def test_near_duplicates(spark, percent):
    rows = corpus()
    options = {} if percent == 85 else {"bands": 60, "rows": 4}
    got = near_dedup.near_duplicates(frame(spark, rows), percent=percent, **options).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []
    assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [1, 2]


def test_dedup_keeps_one_row_of_each_group(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, a), (None, "a text of its own"), (8, ""), (8, ""), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, True) for i, t in rows], "doc_id long, text string, k1 int, s1 int, stays boolean")
    for limit in (1 << 20, 0):
        out = near_dedup.dedup(df, max_broadcast=limit)
        assert out.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for i, t in [rows[0], rows[2], *rows[6:]])
    assert near_dedup.dedup(df.where("false")).collect() == []


def test_large_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 2)
    rows = corpus(9)
    want = brute_components(rows, 70)
    for r in near_dedup.near_duplicates(frame(spark, rows), percent=70, bands=60, rows=4).collect():
        assert r.doc_id is None or (r.n_shingles, r.component_id) == want[r.doc_id]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize(("percent", "rows", "bands"), [(80, 7, 59), (85, 7, 36), (80, 5, 35), (85, 5, 24)])
def test_bands_meet_the_bound(percent, rows, bands):
    share = (percent / 100) ** rows
    assert near_dedup.bands_for(percent, rows) == bands
    assert (1 - share) ** bands < 1e-6 <= (1 - share) ** (bands - 1)


def test_pipeline_stage_links_from_80_percent(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"u{k}" for k in range(100)]
    other = [w + "x" if k in (30, 60) else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"v{k}" for k in range(100)))]
    one, two = ({tuple(w[k : k + 5]) for k in range(96)} for w in (words, other))
    assert 0.80 <= len(one & two) / len(one | two) < 0.85
    assert {r.doc_id for r in pipeline.near_dedup_stage(spark, frame(spark, rows), "").collect()} == {1, 3}
    assert all(r.kept for r in near_dedup.near_duplicates(frame(spark, rows), percent=85).collect())


def test_edit_filters_lose_nothing():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(15)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            k, at = rng.randrange(3), rng.randrange(len(b) + 1)
            if k == 0:
                b.insert(at, rng.choice("abc"))
            elif at < len(b):
                b[at : at + 1] = [] if k == 1 else [rng.choice("abc")]
        b = "".join(b)
        d = edit_distance(a, b)
        for e in (1, 2, 3):
            assert line_dedup.within(a, b, e) == (d <= e)
            short, long = sorted((a, b), key=len)
            if d <= e < len(short):
                assert set(line_dedup.index_keys(short, e)) & set(line_dedup.probe_keys(long, e))
                assert sum(abs(x - y) for x, y in zip(line_dedup.histogram(a), line_dedup.histogram(b), strict=True)) <= 2 * e


def line_corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 12))) for _ in range(8)]
    rows = []
    for k in range(30):
        lines = []
        for _ in range(4):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                s[rng.randrange(len(s))] = rng.choice("wxyz0123 ")
            lines.append("".join(s))
        rows.append((k, "\n".join([*lines, "short line", ""])))
    return [*rows, (40, None), (41, ""), (42, rows[0][1]), (43, "é " * 3000), (None, rows[0][1])]


def brute_lines(rows, edits=2):
    lines = [(i, k, s) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len((s := x.strip(" \t\n\x0b\x0c\r")).split()) >= 5]
    texts = sorted({s for *_, s in lines})
    link = {s: {u for u in texts if u != s and abs(len(u) - len(s)) <= edits and edit_distance(s, u) <= edits} for s in texts}
    out = {}
    for i, k, s in lines:
        todo, group = [s], {s}
        while todo:
            for u in link[todo.pop()] - group:
                group.add(u)
                todo.append(u)
        out[i, k] = (min(((a, b) for a, b, u in lines if u in group), key=lambda x: (x[0] is None, x[0] or 0, x[1])), len(link[s]))
    return out


def test_line_classes(spark):
    rows = line_corpus()
    got = {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.n_links) for r in line_dedup.line_classes(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_dedup_lines_decides_by_row(spark):
    """Ids repeat, and columns have names that the operator might want for its own."""
    lines = [f"line {k} has these five words or more" * (k + 1) for k in range(4)]
    rows = [(5, lines[0]), (3, lines[0]), (5, f"{lines[1]}\n{lines[2]}"), (5, f"{lines[1]}\n{lines[2]}"), (None, f"{lines[3]}\n{lines[1]}"), (None, "a null id and words of its own")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, k1 int, lines int, _dup_doc int, _cut int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(i), t) for i, t in [(3, rows[1][1]), rows[2], rows[3], (None, lines[3]), rows[5]])
    assert sorted(map(str, line_dedup.dedup_lines(df, max_broadcast=0).collect())) == sorted(map(str, out.collect()))


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rows = [(k, f"the same words again and again {a}{b} in the very same place") for k, (a, b) in enumerate((a, b) for a in "0123456" for b in "abcdef")]
    got = {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.n_links) for r in line_dedup.line_classes(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_dedup_lines(spark):
    rows = line_corpus()
    want = brute_lines(rows)
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = {r.doc_id: r.text for r in out.collect()}
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if want.get((i, k), ((i, k), 0))[0] == (i, k)]
        if len(kept) < len(t.split("\n")) and not "".join(kept).strip():
            assert i not in got
        else:
            assert got[i] == "\n".join(kept)
    assert line_dedup.line_classes(frame(spark, [])).collect() == []


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        con.register(name, pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema))
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted(str(sorted(zip(names, r, strict=True))) for r in result.fetchall())


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def test_decontamination(spark):
    rng = random.Random(2)
    passage = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, passage(20)) for k in range(6)] + [(6, "Two words"), (7, "one"), (8, None), (9, " .,; "), (0, "the the the the the the the the the the"), (None, passage(12))]
    docs = [(k, f"{passage(10)}. {' '.join(rng.choice(items)[1].split()[k % 5 :][:12]) if k % 2 and k < 20 and False else passage(5)}") for k in range(5)]
    docs += [(10 + k, f"{passage(8)} {items[k][1].upper()} {passage(3)}, {items[(k + 1) % 6][1][: 40 + 9 * k]}") for k in range(6)]
    docs += [(20, "the " * 30), (21, "two words ONE"), (22, None), (23, ""), (24, items[0][1]), (24, items[0][1]), (None, items[1][1]), (25, items[-1][1]), (26, passage(9000) + " " + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    got = decontaminate.find(df, bench)
    assert sorted(str(sorted(r.asDict().items())) for r in got.collect()) == oracle(decontaminate.oracle(), documents=(docs, DOCS), benchmark=(items, ITEMS))
    by = {r.doc_id: r for r in got.collect()}
    assert by[22].n_hit == 0 and by[22].items_sha256 == sha256(b"").hexdigest() and by[24].n_hit == 20
    shuffled = decontaminate.find(df, bench, max_broadcast=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))
    none = decontaminate.find(df, bench.where("false")).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    assert decontaminate.find(df.where("false"), bench).collect() == []


def test_license_scan(spark):
    notice = license_scan.TEMPLATES[0][1]
    docs = [
        (1, "Released under the MIT License."), (2, "mit license mit license; MIT-LICENSE apache\nlicense"), (3, "GNU General Public License"), (4, "general public licenses"), (5, None), (6, ""),
        (7, "word " * 50 + notice + " word" * 20), (8, notice.replace("copy", "print")), (9, " ".join(notice.split()[:20])), (10, "x " * 30_000 + "Apache License"), (10, "again"), (None, "MIT License"), (11, "é mité license"),
    ]
    got = license_scan.scan(frame(spark, docs)).collect()
    assert sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in got) == [re.sub(r"0\.\d{10,}", lambda m: str(round(float(m[0]), 9)), x) for x in oracle(license_scan.oracle(), documents=(docs, DOCS))]
    by = {r.doc_id: r for r in got if r.doc_id}
    assert (by[2].n_base, by[2].first_word, by[2].last_word, by[2].base_labels) == (4, 0, 6, "apache,mit")
    assert by[7].labels == "mit" and by[7].score == 1.0 and by[8].labels == "mit" and by[9].labels == "" and by[1].first_word == 3
    assert license_scan.scan(frame(spark, [])).collect() == []
    greek = [("greek", "Άδεια χρήσης αυτού του λογισμικού"), ("mit", "plain words of a template")]
    assert [r.labels for r in license_scan.scan(frame(spark, [(1, greek[0][1]), (2, greek[1][1]), (3, "Άδεια")]), templates=greek).orderBy("doc_id").collect()] == ["greek", "mit", ""]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_license_scan_with_any_number_of_words(spark, monkeypatch, limit):
    """Templates of 5,000 different words together, as a table of places, broadcast or shuffled."""
    monkeypatch.setattr(license_scan, "MAX_BROADCAST", limit)
    rng = random.Random(14)
    vocabulary = [f"t{k}" for k in range(4900)] + ["license", "the", "software", *(f"é{k}" for k in range(100))]
    templates = [(f"l{k}", " ".join(vocabulary[49 * k : 49 * k + rng.randrange(30, 49)] + rng.sample(vocabulary[-103:], 3))) for k in range(100)] + [("none", " .,; ")]
    assert len({w for _, t in templates for w in license_scan.template_words(t)}) > license_scan.INLINE
    docs = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(90))) + " " + " ".join(w for w in templates[rng.randrange(100)][1].split() if rng.random() < 0.9) + " mit license") for k in range(60)]
    docs += [(100, None), (101, ""), (102, " ".join(t for _, t in templates)), (102, "again"), (None, templates[5][1].upper())]
    got = license_scan.scan(frame(spark, docs), templates=templates).collect()
    plain = [t for t in templates if license_scan.template_words(t[1])]
    tidy = lambda x: re.sub(r"0\.\d{10,}", lambda m: str(round(float(m[0]), 9)), x)
    assert sorted(tidy(str(sorted(r.asDict().items()))) for r in got) == sorted(map(tidy, oracle(license_scan.oracle(templates=plain), documents=(docs, DOCS))))
    assert sum(r.labels not in ("", "mit") for r in got) > 30


def test_giant_texts_share_no_band():
    """Unrelated sets, larger than the circle's table, are no candidates of one another; near ones are."""
    rng = np.random.default_rng(15)
    sets = [np.unique(rng.integers(0, 1 << 63, size=3_000_000, dtype=np.uint64)) for _ in range(2)]
    near = np.unique(np.concatenate([sets[0][:2_850_000], sets[1][:150_000]]))
    keys = [near_dedup.band_keys(near_dedup.signature(s, 120, 1), 24, 5) for s in (*sets, near)]
    assert not set(keys[0]) & set(keys[1]) and set(keys[0]) & set(keys[2])


def test_signatures_are_those_of_a_plain_permutation():
    """Each coordinate is the first of the set in the order of the shifted second permutation."""
    rng = np.random.default_rng(16)
    table = near_dedup.circulant(12, 1)[0][:, 0]
    for size in (1, 5, 700):
        shingles = np.unique(rng.integers(0, 1 << 63, size=size, dtype=np.uint64))
        places = [int(x) * 0xBF58476D1CE4E5B9 % (1 << 64) for x in shingles]
        order = lambda y, k: (table[((y >> 44) + k) % (1 << 20)], y % (1 << 44))
        assert near_dedup.signature(shingles, 12, 1).tolist() == [min(places, key=lambda y: order(y, k)) for k in range(12)]


@pytest.mark.parametrize(("percent", "common", "size"), [(85, 185, 200), (80, 179, 200)])
def test_bands_find_pairs_at_the_threshold(percent, common, size):
    """Pairs of similarity 0.86 and 0.81: none of 3,000 is missed."""
    rng = np.random.default_rng(17)
    bands = near_dedup.bands_for(percent, 5)
    keys = lambda s: near_dedup.band_keys(near_dedup.signature(np.unique(s), 5 * bands, 1), bands, 5)
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, size=2 * size - common, dtype=np.uint64)
        assert set(keys(x[:size])) & set(keys(np.concatenate([x[:common], x[size:]])))


def test_pipeline_stages_chain(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    passage = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, passage(15)) for k in range(3)]
    texts = {k: "\n".join(passage(20) for _ in range(4)) for k in range(20)}
    texts[20] = texts[0]  # an exact copy: all its lines are duplicates
    texts[21] = " ".join(texts[1].replace("\n", " ").split()[:-1] + ["changed"])  # a near copy in one line
    texts[22] = passage(10) + "\n" + items[0][1] + " " + passage(10)  # a leak
    bad = {30 + k: "###!! $$%d " % k * 30 for k in range(10)}
    rows = [(i, t, "en", "s", len(t)) for i, t in {**texts, **bad}.items()]
    spark.createDataFrame([*rows, (50, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 30), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert not got & set(bad) and not got & {20, 21, 22}
    assert got >= set(range(20))
