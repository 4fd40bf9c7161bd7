"""Vectors, clusters and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans import rules
from ..plans.dialect import SPARK, Dialect
from ..plans.rules import like_any
from ..storage import dropped, written
from .components import connected_components
from .patterns import naming_style
from .vectorindex import BLOCK, VectorIndex, representatives, similar_pairs

DIMENSIONS = 256


def _norm(d: Dialect, v: str) -> str:
    return f"sqrt({d.dot(v, v)})"


def _cosine(d: Dialect, a: str, b: str) -> str:
    return f"CASE WHEN {_norm(d, a)} * {_norm(d, b)} = 0e0 THEN 0e0 ELSE {d.dot(a, b)} / ({_norm(d, a)} * {_norm(d, b)}) END"


QUERIES = "id % 100 = 0"  # of the driver's searches: the vectors whose ids are divisible by 100


def _pairs_sql(d: Dialect, columns: str) -> str:
    return f"SELECT q.id AS query_id, v.id, {columns} FROM vectors v JOIN vectors q ON q.{QUERIES} AND q.id <> v.id"


@frame_operator("vectors", lambda d: _pairs_sql(d, f"round(greatest(0e0, least(1e0, {_cosine(d, 'v.vec', 'q.vec')})), 5) AS similarity"), queries=QUERIES)
def e04_cosine_clamped(t: dict[str, DataFrame], queries: str) -> DataFrame:
    """Cosine of each query (vectors of a condition) with each other vector, held to 0..1."""
    return VectorIndex(t["vectors"]).search(queries).select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s")), 5).alias("similarity"))


@frame_operator("vectors", lambda d: _pairs_sql(d, f"round({_cosine(d, 'v.vec', 'q.vec')}, 5) AS similarity"), queries=QUERIES)
def e05_cosine(t: dict[str, DataFrame], queries: str) -> DataFrame:
    return VectorIndex(t["vectors"]).search(queries).select("query_id", "id", F.round("s", 5).alias("similarity"))


#: Which elements of a feature vector (from 0) tell of meaning, structure and function; the last five are those of quality. A vector too short for a part is compared whole.
SEMANTIC, STRUCTURAL, COMPLEXITY, QUALITY = (40, 59), (0, 29), (22, 29), 5


def segments(n: int) -> dict[str, list[int] | None]:
    """The elements compared for each part in vectors of that length; None: all."""
    return {
        "semantic": list(range(*SEMANTIC)) if n > SEMANTIC[1] else None, "structural": list(range(*STRUCTURAL)) if n > STRUCTURAL[1] else None,
        "functional": [*range(*COMPLEXITY), *range(n - QUALITY, n)] if n > COMPLEXITY[1] else None,
    }


def _sliced_sql(d: Dialect, n: int = 64) -> str:
    take = lambda v, part: v if part is None else f"[{', '.join(f'{v}[{k + 1}]' for k in part)}]"
    held = lambda part: f"round(greatest(0e0, least(1e0, {_cosine(d, take('v.vec', part), take('q.vec', part))})), 5)"
    return _pairs_sql(d, ", ".join(f"{held(part)} AS {name}" for name, part in segments(n).items()))


@frame_operator("vectors", lambda d: _sliced_sql(d), queries=QUERIES)
def e06_sliced(t: dict[str, DataFrame], queries: str) -> DataFrame:
    """Of each query with each other vector: the similarity of the parts that tell of meaning, structure and function, held to 0..1."""
    index = VectorIndex(t["vectors"])
    held = [F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 5).alias(c) for c in segments(0)]
    return index.search(queries, segments=segments(index.dims)).select("query_id", "id", *held)


def _top_sql(d: Dialect, k: int, threshold: float = -2.0) -> str:
    return f"SELECT query_id, id, round(s, 5) AS similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM ({_pairs_sql(d, _cosine(d, 'v.vec', 'q.vec') + ' AS s')}) p WHERE s >= {threshold}e0) x WHERE k <= {k}"


@frame_operator("vectors", lambda d: _top_sql(d, 10), queries=QUERIES)
def e07_top_similar(t: dict[str, DataFrame], queries: str, k: int = 10) -> DataFrame:
    """The k most similar vectors of each query, by the index; ties: smaller ids."""
    return VectorIndex(t["vectors"]).search(queries, k=k).select("query_id", "id", F.round("s", 5).alias("similarity"), "rank")


@frame_operator("vectors", lambda d: _top_sql(d, 20, 0.1), queries=QUERIES)
def e08_semantic_search(t: dict[str, DataFrame], queries: str, threshold: float = 0.1, k: int = 20) -> DataFrame:
    """The same from a threshold up."""
    return VectorIndex(t["vectors"]).search(queries, threshold=threshold, k=k).select("query_id", "id", F.round("s", 5).alias("similarity"), "rank")


@sql_operator
def e09_similar_code(d: Dialect, words: str = "red widget") -> str:
    """Without vectors: by the words of a name (any number), ranked by where they match: all joined at its beginning, all anywhere, the first, another."""
    each = [w.replace("'", "''") for w in words.split()]
    if not each:
        raise ValueError("no words are given")
    every = " AND ".join(f"name ILIKE '%{w}%'" for w in each)
    return f"SELECT id, name, CASE WHEN name ILIKE '{'_'.join(each)}%' THEN 1 WHEN {every} THEN 2 WHEN name ILIKE '%{each[0]}%' THEN 3 ELSE 4 END AS relevance FROM symbols WHERE {every.replace(' AND ', ' OR ')}"


@sql_operator
def e10_find_implementations(d: Dialect, word: str = "bolt", exact: int = 5, similar: int = 10) -> str:
    """Exact (by name) and similar (by signature, namespace or file) matches, scored 0.5 / 0.3 / 0.2."""
    score = f"(CASE WHEN name ILIKE '%{word}%' THEN 0.5e0 ELSE 0e0 END + CASE WHEN signature ILIKE '%{word}%' THEN 0.3e0 ELSE 0e0 END + CASE WHEN qualified_name ILIKE '%{word}%' THEN 0.2e0 ELSE 0e0 END)"
    return f"SELECT id, grade, score FROM (SELECT id, grade, score, row_number() OVER (PARTITION BY grade ORDER BY score DESC, id) AS k FROM (SELECT id, CASE WHEN name ILIKE '{word}%' THEN 'exact' ELSE 'similar' END AS grade, round({score}, 6) AS score FROM symbols WHERE {score} > 0e0) s) x WHERE grade = 'exact' AND k <= {exact} OR grade = 'similar' AND k <= {similar}"


def _label_pairs(d: Dialect, threshold: float = 0.8) -> str:
    different = "(SELECT min(id) AS id, vec FROM vectors_near GROUP BY vec)"
    return f"SELECT first_id, second_id, round(s, 5) AS similarity, round(least(0.9e0, 1.1e0 * s), 5) AS confidence FROM (SELECT a.id AS first_id, b.id AS second_id, {_cosine(d, 'a.vec', 'b.vec')} AS s FROM {different} a JOIN {different} b ON a.id < b.id) x WHERE s >= {threshold}e0"


def _pairs(t: dict[str, DataFrame], vectors: str, threshold: float, block: int) -> DataFrame:
    pairs = similar_pairs(t[vectors], threshold, block)
    return pairs.select("first_id", "second_id", F.round("s", 5).alias("similarity"), F.round(F.least(F.lit(0.9), 1.1 * F.col("s")), 5).alias("confidence"))


def _whole_pairs_sql(d: Dialect, threshold: float = 0.8) -> str:
    own = _cosine(d, "v.vec", "v.vec")
    copies = f"SELECT m.id AS first_id, v.id AS second_id, round({own}, 5) AS similarity, round(least(0.9e0, 1.1e0 * {own}), 5) AS confidence FROM vectors_near v JOIN (SELECT min(id) AS id, vec FROM vectors_near GROUP BY vec) m ON m.vec = v.vec AND m.id <> v.id WHERE {own} >= {threshold}e0"
    return f"{_label_pairs(d, threshold)} UNION ALL {copies}"


@frame_operator("vectors_near", _whole_pairs_sql, vectors="vectors_near")
def e11_semantic_pairs(t: dict[str, DataFrame], threshold: float = 0.8, block: int = BLOCK, vectors: str = "vectors") -> DataFrame:
    """Pairs of different vectors of any labels with cosine from the threshold up, under the smallest ids that have them, and of each of those ids with its copies; confidence min(0.9, 1.1 s)."""
    rows = t[vectors].where("id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    first = representatives(rows).where("copies > 1").select(F.col("id").alias("first_id"), "vec")
    copies = rows.join(first, "vec").where("first_id <> id").select("first_id", F.col("id").alias("second_id"), F.expr(_cosine(SPARK, "vec", "vec")).alias("s")).where(F.col("s") >= threshold)
    return _pairs(t, vectors, threshold, block).unionByName(copies.select("first_id", "second_id", F.round("s", 5).alias("similarity"), F.round(F.least(F.lit(0.9), 1.1 * F.col("s")), 5).alias("confidence")))


def _class_sql(d: Dialect, threshold: float = 0.8) -> str:
    return f"""WITH RECURSIVE l AS (SELECT a.id AS a, b.id AS b FROM vectors_near a JOIN vectors_near b ON a.id <> b.id AND {_cosine(d, 'a.vec', 'b.vec')} >= {threshold}e0),
        c(id, class_id) USING KEY (id) AS (SELECT id, id FROM vectors_near UNION SELECT l.b, min(c.class_id) FROM c JOIN l ON l.a = c.id JOIN recurring.c o ON o.id = l.b WHERE c.class_id < o.class_id GROUP BY l.b)
        SELECT c.id, c.class_id, coalesce(n.links, 0) AS links FROM c LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) n ON n.a = c.id"""


@frame_operator("vectors_near", _class_sql, vectors="vectors_near")
def e11_semantic_classes(t: dict[str, DataFrame], threshold: float = 0.8, block: int = BLOCK, vectors: str = "vectors") -> DataFrame:
    """Of each vector: how many others have a cosine from the threshold up with it (copies counted), and the smallest id that such links lead to."""
    rows = t[vectors].where("id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    kinds = written(representatives(rows).select(F.col("id").alias("kind"), "vec", "copies"), "kinds")
    pairs = similar_pairs(rows, threshold, block)
    both = pairs.select(F.col("first_id").alias("kind"), F.col("second_id").alias("other")).unionAll(pairs.select("second_id", "first_id"))
    links = both.join(kinds.select(F.col("kind").alias("other"), F.col("copies").alias("more")), "other").groupBy("kind").agg(F.sum("more").alias("links"))
    classes = connected_components(pairs, "first_id", "second_id").withColumnRenamed("id", "kind")
    each = kinds.join(links, "kind", "left").join(classes, "kind", "left")
    alike = F.exists("vec", lambda x: x != 0).cast("long")  # copies of a zero vector have cosine 0
    own = F.when(alike == 1, F.col("copies") - 1).otherwise(0)
    each = each.select("vec", (F.coalesce("links", F.lit(0)) + own).alias("links"), F.coalesce("component", F.when(alike == 1, F.col("kind"))).alias("class_id"))
    return rows.select("id", "vec").join(each, "vec").select("id", F.coalesce("class_id", "id").alias("class_id"), "links")


@frame_operator("vectors")
def e12_kmeans(t: dict[str, DataFrame], max_clusters: int = 20, min_size: int = 3, seed: int = 42, rounds: int = 20) -> DataFrame:
    """id and cluster by k-means with parallel seeding, one cluster for each min_size vectors within 2 and max_clusters. Fewer vectors than min_size have none, and smaller clusters are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = t["vectors"].where("id IS NOT NULL AND vec IS NOT NULL").select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    n = rows.count()
    if n < min_size:
        return t["vectors"].select("id", F.lit(0).cast("long").alias("cluster")).limit(0)
    k = min(max_clusters, max(2, n // min_size))
    placed = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"))
    large = placed.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") >= min_size)
    return placed.join(large.select("cluster"), "cluster", "left_semi").select("id", "cluster")


def _centroids(d: Dialect) -> str:
    at = "posexplode(vec) AS (pos, x)" if d.spark else "generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x"
    return f"SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, {at} FROM vectors) c GROUP BY label, pos"


@sql_operator
def e13_group_centroids(d: Dialect) -> str:
    return f"SELECT label, CAST(pos AS BIGINT) AS pos, round(x, 5) AS x FROM ({_centroids(d)}) c"


def _member_similarity(d: Dialect) -> str:
    at = "posexplode(vec) AS (pos, x)" if d.spark else "generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x"
    return f"SELECT v.id, v.label, sum(CAST(v.x AS DOUBLE) * c.x) / sqrt(sum(CAST(v.x AS DOUBLE) * CAST(v.x AS DOUBLE)) * sum(c.x * c.x)) AS s FROM (SELECT id, label, {at} FROM vectors) v JOIN ({_centroids(d)}) c ON c.label = v.label AND c.pos = v.pos GROUP BY v.id, v.label"


@sql_operator
def e14_cluster_quality(d: Dialect) -> str:
    """(mean + 1 - deviation) / 2 of the members' similarity to the centroid, held to 0..1."""
    return f"SELECT label, count(*) AS members, round(greatest(0e0, least(1e0, (avg(s) + 1e0 - stddev_pop(s)) / 2e0)), 5) AS quality FROM ({_member_similarity(d)}) m GROUP BY label"


@sql_operator
def e15_member_roles(d: Dialect) -> str:
    return f"SELECT id, label, CASE WHEN s >= 0.85e0 THEN 'core' WHEN s >= 0.7e0 THEN 'member' WHEN s >= 0.5e0 THEN 'peripheral' ELSE 'outlier' END AS role FROM ({_member_similarity(d)}) m"


def greedy_merge(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and merged_into, as a walk over ids in their order would merge: an id that no earlier one has taken takes all later ones it is paired with (a < b) that none has taken. Rounds settle whatever all earlier partners of are settled."""
    state = written(ids.select("id", F.lit(None).cast("long").alias("merged_into")), "merge")
    pairs = written(pairs.select("a", "b"), "merge-pairs")
    while not state.where("merged_into IS NULL").isEmpty():
        head = state.select(F.col("id").alias("a"), F.col("merged_into").alias("of"))
        before = pairs.join(head, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.when(F.col("of") == F.col("a"), F.col("a"))).alias("taker"), F.min(F.when(F.col("of").isNull(), F.col("a"))).alias("open"))
        settled = F.when(F.col("taker").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("taker"))), F.col("taker")).when(F.col("taker").isNull() & F.col("open").isNull(), F.col("id"))
        new = written(state.join(before, "id", "left").select("id", F.coalesce("merged_into", settled).alias("merged_into")), "merge")
        dropped(state)
        state = new
    return state


def _merge_sql(d: Dialect, threshold: float) -> str:
    return f"""WITH RECURSIVE c AS (SELECT label, list(x ORDER BY pos) AS vec FROM ({_centroids(d)}) x GROUP BY label), o AS (SELECT label, vec, row_number() OVER (ORDER BY label) AS k FROM c),
        pairs AS (SELECT a.label AS a, b.label AS b FROM c a JOIN c b ON a.label < b.label AND {_cosine(d, 'a.vec', 'b.vec')} > {threshold}e0),
        walk(k, heads, label, merged_into) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
          UNION ALL SELECT o.k, CASE WHEN t IS NULL THEN list_append(heads, o.label) ELSE heads END, o.label, coalesce(t, o.label) FROM (SELECT w.k, w.heads, o.label AS ol, (SELECT min(p.a) FROM pairs p WHERE p.b = o.label AND list_contains(w.heads, p.a)) AS t FROM walk w JOIN o ON o.k = w.k + 1) s JOIN o ON o.label = s.ol)
        SELECT label, merged_into FROM walk WHERE label IS NOT NULL"""


@frame_operator("vectors", lambda d: _merge_sql(d, 0.05), threshold=0.05)
def e16_cluster_merge(t: dict[str, DataFrame], threshold: float = 0.8) -> DataFrame:
    """Clusters in the order of their labels: one that none has taken takes all later ones, not yet taken, whose centroid has a cosine over the threshold with its own."""
    centres = t["vectors"].where("vec IS NOT NULL").select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    centres = written(centres.select(F.col("label").cast("long").alias("id"), "vec"), "centres")
    pairs = VectorIndex(centres).search(threshold=threshold).where(F.col("s") > threshold).where("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return greedy_merge(centres, pairs).select(F.col("id").alias("label"), "merged_into")


@frame_operator("vectors_near", lambda d: _label_pairs(d, 0.9), vectors="vectors_near")
def e17_high_pairs(t: dict[str, DataFrame], vectors: str = "vectors") -> DataFrame:
    return _pairs(t, vectors, 0.9, BLOCK)


@frame_operator("vectors_near", lambda d: _class_sql(d, 0.9), vectors="vectors_near")
def e17_high_classes(t: dict[str, DataFrame], vectors: str = "vectors") -> DataFrame:
    return e11_semantic_classes(t, 0.9, vectors=vectors)


PASCAL_IF_EXPORTED = "CASE WHEN is_exported THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE name END"  # the names of the test tables' symbols, exported ones with a capital


@sql_operator(name=PASCAL_IF_EXPORTED)
def e18_naming_inconsistency(d: Dialect, name: str = "name") -> str:
    """Namespaces in which the most frequent way of naming (snake, camel, pascal or other) has under 70 % of the symbols."""
    return f"SELECT namespace, max(n) AS dominant, CAST(sum(n) AS BIGINT) AS symbols FROM (SELECT namespace, {naming_style(d, 'name')} AS style, count(*) AS n FROM (SELECT namespace, {name} AS name FROM symbols) s GROUP BY 1, 2) x GROUP BY namespace HAVING CAST(max(n) AS DOUBLE) / sum(n) < 0.7e0"


@sql_operator
def e19_cluster_insights(d: Dialect) -> str:
    return f"SELECT label, CASE WHEN members > 50 THEN 'split' WHEN spread < 0.3e0 THEN 'loose' ELSE 'sound' END AS insight FROM (SELECT label, count(*) AS members, avg(s) AS spread FROM ({_member_similarity(d)}) m GROUP BY label) x"


@sql_operator(hotspots=["gear", "bolt"], lower=["ring"], upper=["widget"], name=PASCAL_IF_EXPORTED)
def e20_generate_insights(d: Dialect, hotspots: list[str] = rules.HOTSPOT_NAMES, lower: list[str] = ("repository", "dao", "database"), upper: list[str] = ("gui", "view", "controller"), name: str = "name") -> str:
    """Six rules: a lower layer that refers to an upper one, clusters (labels) of over 20 vectors, complexity over 15, complexity over 10 of functions named for computing, clusters of quality over 0.9 with 3 members or more, namespaces without one way of naming. subject is the symbol's, label's or namespace's name or number."""
    text = "CAST({} AS STRING)" if d.spark else "CAST({} AS VARCHAR)"
    parts = [
        f"SELECT {text.format('r.from_id')} AS subject, 'layer violation' AS insight FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE {like_any('f.name', list(lower))} AND {like_any('t.name', list(upper))} GROUP BY r.from_id",
        f"SELECT {text.format('label')} AS subject, 'large cluster' AS insight FROM vectors GROUP BY label HAVING count(*) > 20",
        f"SELECT {text.format('id')} AS subject, 'god object' AS insight FROM symbols WHERE complexity > 15",
        f"SELECT {text.format('id')} AS subject, 'hotspot' AS insight FROM symbols WHERE complexity > 10 AND kind IN ('function', 'method') AND {like_any('name', hotspots)}",
        f"SELECT {text.format('label')} AS subject, 'duplication' AS insight FROM ({e14_cluster_quality(d)}) q WHERE quality > 0.9e0 AND members >= 3",
        f"SELECT namespace AS subject, 'naming' AS insight FROM ({e18_naming_inconsistency(d, name)}) n",
    ]
    return " UNION ALL ".join(parts)


_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"


@sql_operator
def e21_top_insights(d: Dialect, top: int = 5) -> str:
    return f"SELECT id, category, severity, confidence FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_RANK}, confidence DESC, id) AS k FROM insights WHERE confidence >= 0.6e0) x WHERE k <= {top}"


@sql_operator
def e22_insight_listing(d: Dialect, limit: int = 100) -> str:
    return f"SELECT id, category, severity, status FROM insights WHERE status = 'active' ORDER BY {_RANK}, confidence DESC, id LIMIT {limit}"


@sql_operator
def e23_cluster_details(d: Dialect) -> str:
    return f"SELECT label, count(*) AS members, {d.joined_list('CAST(id AS ' + ('STRING' if d.spark else 'VARCHAR') + ')', 'id')} AS ids FROM vectors GROUP BY label"


@sql_operator
def e24_quality_rollup(d: Dialect) -> str:
    return "SELECT category, severity, count(*) AS n, round(avg(confidence), 9) AS confidence, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM insights GROUP BY category, severity"


@sql_operator
def e25_feedback(d: Dialect) -> str:
    """The table after feedback: confident dismissals stay, unsure active ones are dismissed."""
    return "SELECT id, CASE WHEN status = 'active' AND confidence < 0.5e0 THEN 'dismissed' ELSE status END AS status FROM insights"


@sql_operator
def e26_semantic_stats(d: Dialect) -> str:
    return "SELECT (SELECT count(*) FROM vectors) AS vectors, (SELECT count(DISTINCT label) FROM vectors) AS clusters, (SELECT count(*) FROM insights) AS insights, (SELECT count(*) FROM insights WHERE status = 'active') AS active, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(*) FROM symbols) AS symbols"
