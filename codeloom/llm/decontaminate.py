"""Operator 7: benchmark decontamination by a prefix-filtered set join. Built-in functions only.

A benchmark window is ``window`` consecutive words of an item (an item of fewer
words is one window). Each window is the set of its placed shingles (``shingle``
consecutive words, or the whole window where that is shorter). A window occurs
exactly where all its shingles stand at their places, so any one of them is a
necessary prefix, and the rarest makes the fewest candidates:

1. the benchmark's words are counted over all documents (partial sums); a shingle is
   at most as frequent as its rarest word, and that count orders the shingles;
2. each window's prefix is its first shingle in that order; a window with a word that
   no document holds cannot occur and goes;
3. the join is on prefix shingles alone; the place in the document gives the only
   window start that can match (positional filter), which must leave room for the
   whole window (length filter);
4. candidates are verified exactly: the document's words at the candidate's place
   must equal a window's.

Shingles are joined as 64-bit hashes, but words decide. Nothing is collected but the
few shingle sizes; each table of the benchmark is broadcast only up to
``max_broadcast`` bytes of its own rows, else joined by a shuffle.

Defined cases: null and empty texts have no words and no hit; null or empty items
have no window; a window of an item without id still hits but counts for no item;
repeated items count once; rows, not ids, are what is searched: an id may stand at
several texts or be null, and repeated rows get one equal row each; very long texts
are searched as wholes; empty tables give no rows or no hits; columns besides ids and
texts are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, dropped, near, picked, row_key, written
from .native_text import number_of_words, spaced, words_of


def _shingles(words: Column, size: int) -> Column:
    """Place and hash of each run of size consecutive words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), *[F.element_at(words, i + (k + 1)) for k in range(size)]).alias("h")))


def with_words(df: DataFrame) -> DataFrame:
    """df with the array of words of its column text in place of that, made once (the generator keeps the optimizer from repeating it for every element)."""
    keep = [c for c in df.columns if c != "text"]
    return df.select(*keep, F.inline(F.array(F.struct(spaced(F.col("text")).alias("padded"))))).select(*keep, F.inline(F.array(F.struct(words_of(F.col("padded")).alias("words")))))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, run (the window's words, joined by blanks), w (the words) and n (how many)."""
    items = with_words(benchmark).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w"))
    return wins.select("item_id", F.array_join("w", " ").alias("run"), "w", F.size("w").alias("n")).distinct()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = picked(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def occurrences(docs: DataFrame, windows: DataFrame, *, shingle: int, max_broadcast: int) -> DataFrame:
    """k1, k2, start, n and run of each window (of benchmark_windows()) that stands in a row of docs (k1, k2, text)."""
    runs = windows.select("run", "w", "n").dropDuplicates(["run"])

    # 1: how often the documents hold the benchmark's words
    vocabulary = written(runs.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    known = near(vocabulary, F.octet_length("word") + 16, max_broadcast)
    held = with_words(docs.select("text")).select(F.explode("words").alias("word"))
    if known is vocabulary:  # too large to broadcast: count before the shuffle
        held = held.groupBy("word").agg(F.count("*").alias("held")).join(vocabulary, "word")
    else:
        held = held.join(known, "word").groupBy("word").agg(F.count("*").alias("held"))
    held = written(held.select("word", "held"), "held")

    # 2: the rarest shingle of each window
    counts = runs.select("run", "w", "n", F.posexplode("w").alias("at", "word")).join(held, "word")
    counts = counts.groupBy("run", "w", "n").agg(F.array_sort(F.collect_list(F.struct("at", "held"))).alias("c")).where("size(c) = n")
    size = F.least("n", F.lit(shingle))
    rarity = F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: F.struct(F.array_min(F.transform(F.slice("c", i + 1, size), lambda x: x["held"])).alias("held"), i.alias("at")))
    chosen = counts.select("run", "w", "n", size.alias("size"), F.array_min(rarity)["at"].alias("off"))
    hashes = F.lit(None).cast("bigint")
    for s in range(1, shingle + 1):
        hashes = F.when(F.col("size") == s, F.xxhash64(F.lit(s), *[F.element_at("w", F.col("off") + (k + 1)) for k in range(s)])).otherwise(hashes)
    prefix = written(chosen.select(hashes.alias("h"), "size", "off", "n").distinct(), "prefix")
    sizes = [r["size"] for r in prefix.select("size").distinct().orderBy("size").collect()]  # at most `shingle` numbers

    # 3: candidates
    worded = with_words(docs.select("k1", "k2", "text"))
    stands = F.concat(*[_shingles(F.col("words"), s) for s in sizes]) if sizes else F.array().cast("array<struct<pos:int,h:bigint>>")
    start = F.col("pos") - F.col("off")
    cand = worded.select("k1", "k2", F.size("words").alias("n_words"), F.inline(stands)).join(near(prefix, 20, max_broadcast), "h")
    cand = written(cand.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("k1", "k2", start.alias("start"), "n").distinct(), "candidates")

    # 4: the words at the candidates' places
    asked = written(cand.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("places")), "places")
    found = docs.join(near(asked, F.size("places") * 8 + 24, max_broadcast), ["k1", "k2"])
    found = with_words(found.select("k1", "k2", "places", "text"))
    run = lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.array_join(F.slice(F.col("words"), x["start"] + 1, x["n"]), " ").alias("run"))
    found = found.select("k1", "k2", F.inline(F.transform("places", run)))
    names = written(runs.select("run"), "runs")
    sure = written(found.join(near(names, F.octet_length("run") + 16, max_broadcast), "run").select("k1", "k2", "start", "n", "run").distinct(), "occurrences")
    dropped(vocabulary, held, prefix, cand, asked, names)
    return sure


def _by_row(sure: DataFrame, windows: DataFrame) -> DataFrame:
    """k1, k2 and items (sorted ids, as strings) of each row with a window of an item with an id."""
    owners = windows.where("item_id IS NOT NULL").select("run", F.col("item_id").cast("string").alias("item")).distinct()
    return sure.select("k1", "k2", "run").distinct().join(owners, "run").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=8, shingle=3, min_items=2, max_broadcast=MAX_BROADCAST) -> DataFrame:
    """One row for each row of documents: words, words hit, items, digest of the items, contaminated."""
    docs = _keyed(documents, id_col, text_col)
    windows = written(benchmark_windows(picked(benchmark, item_id=item_col, text=item_text_col), window), "windows")
    sure = occurrences(docs, windows, shingle=shingle, max_broadcast=max_broadcast)
    spans = sure.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    hits = spans.select("k1", "k2", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))).cast("long").alias("n_hit"))
    found = hits.join(_by_row(sure, windows), ["k1", "k2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    found = written(found.select("k1", "k2", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "found")
    dropped(windows, sure)
    counted = docs.select("doc_id", "k1", "k2", number_of_words(F.col("text")).alias("n_words"))
    zero, n = F.lit(0).cast("long"), F.coalesce("n_items", F.lit(0).cast("long"))
    return counted.join(near(found, 120, max_broadcast), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), n.alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n >= min_items).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=8, shingle=3, min_items=2, max_broadcast=MAX_BROADCAST) -> DataFrame:
    """documents without the rows that find() calls contaminated, all columns kept."""
    windows = written(benchmark_windows(picked(benchmark, item_id=item_col, text=item_text_col), window), "windows")
    sure = occurrences(_keyed(documents, id_col, text_col), windows, shingle=shingle, max_broadcast=max_broadcast)
    gone = written(_by_row(sure, windows).where(F.size("items") >= min_items).select("k1", "k2"), "leaks")
    dropped(windows, sure)
    k1, k2 = row_key(documents[f"`{id_col}`"], documents[f"`{text_col}`"])
    few = near(gone, 16, max_broadcast)
    return documents.join(few, (k1 == few["k1"]) & (k2 == few["k2"]), "left_anti")


def oracle(window=8, min_items=2) -> str:
    """The same rows by joining every run of words with every window."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {window - 1}, 1) + 1), lambda i: list_slice(w, i, i + {window - 1}))) AS x FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    runs AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    occ AS (SELECT r, i, n, item_id FROM runs JOIN win USING (n, x)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
    it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {min_items} AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""
