"""Clusters, their names, terms, noise and stability; topics, classes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators import clusters, components, evaluate, graph, hierarchy, spanning, vectors
from caselens.plans.registry import SQL, query, table
from caselens.runtime import new_path, spread

CELL, DIMS, MIN_PTS, MIN_SIZE = 0.1, 3, 5, 30

_CUBES = ", ".join(f"CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE) / {CELL}) AS BIGINT) AS c{i}" for i in range(DIMS))
_KEYS = ", ".join(f"c{i}" for i in range(DIMS))


@query("density_clusters", f"""
WITH RECURSIVE points AS (SELECT vec_id, {_CUBES} FROM embeddings),
dense AS (SELECT {_KEYS}, count(*) AS n, min(vec_id) AS id FROM points GROUP BY {_KEYS} HAVING count(*) >= {MIN_PTS}),
links AS (SELECT a.id AS src, b.id AS dst FROM dense a JOIN dense b
  ON {' AND '.join(f'abs(a.c{i} - b.c{i}) <= 1' for i in range(DIMS))}),
reach(id, root) AS (SELECT id, id FROM dense UNION SELECT links.dst, reach.root FROM reach JOIN links ON links.src = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
sizes AS (SELECT root, sum(n) AS size FROM roots JOIN dense USING (id) GROUP BY root HAVING sum(n) >= {MIN_SIZE}),
numbers AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster FROM sizes)
SELECT vec_id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster
FROM points LEFT JOIN dense USING ({_KEYS}) LEFT JOIN roots USING (id) LEFT JOIN numbers USING (root)""")
def density_clusters(spark, sf_dir):
    return clusters.density_clusters(
        table(spark, sf_dir, "embeddings"), case_id="vec_id", vector="embedding",
        cell=CELL, dims=DIMS, min_pts=MIN_PTS, min_size=MIN_SIZE)


@query("reduced_density_clusters")
def reduced_density_clusters(spark, sf_dir):
    reduced = vectors.reduce_dims(table(spark, sf_dir, "embeddings"), vector="embedding", k=5)
    return clusters.density_clusters(
        reduced, case_id="vec_id", vector="reduced", cell=0.2, dims=5, min_pts=3, min_size=10)


@query("hierarchy_clusters")
def hierarchy_clusters(spark, sf_dir):
    """Density found per cluster, on the reduced vectors."""
    reduced = vectors.reduce_dims(table(spark, sf_dir, "embeddings"), vector="embedding", k=3)
    return hierarchy.density_hierarchy(reduced, case_id="vec_id", vector="reduced", dims=3, min_size=20)


_PLANTED = """
WITH p AS (SELECT CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN -1
  WHEN p_partkey % 10 < 5 THEN 0 WHEN p_partkey % 10 < 8 THEN 1 ELSE 2 END AS place FROM part)
SELECT CAST(place AS INTEGER) AS place, count(*) AS n, true AS found FROM p GROUP BY 1"""


def _planted(spark, sf_dir, cluster) -> DataFrame:
    """Three places of different sizes and densities, with one part far away from all, and what ``cluster`` makes of them."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    key, last = F.col("p_partkey"), parts.agg(F.max("p_partkey")).first()[0]
    rest = key % 10
    place = F.when(rest < 5, 0.0).when(rest < 8, 60.0).otherwise(130.0)
    width = F.when(rest < 5, 1.0).when(rest < 8, 2.0).otherwise(0.5)

    def around(salt: int):
        # The sum of three even draws, from a hash of the key.
        draw = sum(F.pmod(F.xxhash64("p_partkey", F.lit(salt + i)), F.lit(1000)) / 1000 for i in range(3))
        return place + width * (draw - 1.5)

    far = key == last
    spots = parts.select("p_partkey", F.array(F.when(far, 1e6).otherwise(around(1)), F.when(far, 1e6).otherwise(around(11))).alias("v"))
    found = cluster(spots)
    where = F.when(far, -1).when(rest < 5, 0).when(rest < 8, 1).otherwise(2).cast("int")
    cells = found.select("p_partkey", "cluster").withColumn("place", where).groupBy("place", "cluster").agg(F.count("*").alias("c"))
    tops = cells.groupBy("place").agg(
        F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("cluster", "c").alias("cluster"))
    # Every place has a cluster of its own that holds most of it; the far part is noise.
    own = F.count("*").over(Window.partitionBy("cluster")) == 1
    right = F.when(F.col("place") == -1, F.col("cluster") == -1).otherwise((F.col("cluster") >= 0) & (F.col("top") >= 0.7 * F.col("n")))
    return tops.select("place", "n", (own & right).alias("found"))


@query("hierarchy_planted", _PLANTED)
def hierarchy_planted(spark, sf_dir):
    return _planted(spark, sf_dir, lambda spots: hierarchy.density_hierarchy(
        spots, case_id="p_partkey", vector="v", dims=2, min_size=25, min_pts=3))


@query("density_tree_planted", _PLANTED)
def density_tree_planted(spark, sf_dir):
    """The same places by a spanning tree of mutual reachability distances."""
    return _planted(spark, sf_dir, lambda spots: spanning.density_tree(spots, case_id="p_partkey", vector="v", min_size=25, min_pts=5))


@query("connected_parts", """
SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand) AS component FROM part""")
def connected_parts(spark, sf_dir):
    """Each part is linked to the next one of its brand: one long chain per brand."""
    following = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), following.alias("dst"))
    return graph.components(links.where("dst IS NOT NULL"))


@query("components_appended", SQL["connected_parts"])
def components_appended(spark, sf_dir):
    """The same links in three loads, each joined to what was stored before."""
    following = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), following.alias("dst"))
    store = components.ComponentStore(spark, new_path(spark, "components"))
    for load in range(3):
        store.append(links.where(F.pmod(F.xxhash64("src"), F.lit(3)) == load), load=load)
    return store.read()


_LABELLED = """
c AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings)"""


def labelled(spark, sf_dir) -> DataFrame:
    cluster = F.when(F.col("label") == 0, -1).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", cluster.alias("cluster"))


@query("cluster_labels", f"""
WITH {_LABELLED} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster,
  CASE WHEN cluster BETWEEN 1 AND 7 THEN 'theme ' || cluster ELSE 'Noise/Outlier' END AS label FROM c""")
def cluster_labels(spark, sf_dir):
    cases = labelled(spark, sf_dir)
    names = cases.where("cluster BETWEEN 1 AND 7").select("cluster").distinct().withColumn(
        "label", F.concat(F.lit("theme "), F.col("cluster").cast("string")))
    return clusters.label_clusters(cases, names).select("vec_id", "cluster", "label")


@query("cluster_count", f"""
WITH {_LABELLED} SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
  count(DISTINCT cluster) AS n_values FROM c""")
def cluster_count(spark, sf_dir):
    return clusters.cluster_count(labelled(spark, sf_dir))


@query("label_list", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def label_list(spark, sf_dir):
    return clusters.label_list(table(spark, sf_dir, "documents").select(F.col("lang").alias("label")), label="label")


@query("noise_report", f"""
WITH {_LABELLED}, least AS (SELECT vec_id FROM c WHERE cluster = -1 ORDER BY vec_id LIMIT 5)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE cluster = -1) AS n_noise,
  round(count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS noise_share,
  (SELECT string_agg(vec_id, ',' ORDER BY vec_id) FROM least) AS examples FROM c""")
def noise_report(spark, sf_dir):
    return (clusters.noise_report(labelled(spark, sf_dir), case_id="vec_id")
            .withColumn("noise_share", F.round("noise_share", 6))
            .withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ",")))


@query("class_terms", """
WITH t AS (
  SELECT source, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
c AS (SELECT source, term, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2),
k AS (SELECT source, sum(n) AS class_n FROM c GROUP BY 1),
f AS (SELECT term, sum(n) AS term_n FROM c GROUP BY 1),
s AS (
  SELECT c.source, c.term, n, n / class_n * ln(1 + (SELECT avg(class_n) FROM k) / term_n) AS score
  FROM c JOIN k USING (source) JOIN f USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT source, CAST(rank AS INTEGER) AS rank, term, n, round(score, 6) AS score FROM r WHERE rank <= 10""")
def class_terms(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return clusters.class_terms(docs, by="source", text="text").withColumn("score", F.round("score", 6))


def first_sample_model():
    """A stand-in model: repeats the opening of the first sample behind the cue."""
    def reply(prompt: str) -> str:
        first = prompt.split("\n\n", 1)[1]
        found = first.split()[1:4]
        return f"{prompt[:20]} Theme: {' '.join(found)} "
    return lambda prompts: [reply(p) for p in prompts]


@query("name_clusters", """
WITH c AS (
  SELECT doc_id, text, CASE WHEN source = 'src0' THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END AS cluster
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('0' || CAST(doc_id AS VARCHAR)), doc_id) AS r
  FROM c WHERE cluster <> -1 AND cluster <> 3)
SELECT cluster, array_to_string((list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))[1:3], ' ') AS label
FROM r WHERE r = 1
UNION ALL SELECT 3, 'Unknown'""")
def name_clusters(spark, sf_dir):
    """One cluster is noise, one has no text."""
    number = F.substring("source", 4, 10).cast("int")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(number == 0, -1).otherwise(number).alias("cluster"),
        F.when(number != 3, F.col("text")).alias("text"))
    return clusters.name_clusters(
        docs, case_id="doc_id", cluster="cluster", text="text", factory=lambda: first_sample_model())


@query("reduced_vectors")
def reduced_vectors(spark, sf_dir):
    reduced = vectors.reduce_dims(table(spark, sf_dir, "embeddings"), vector="embedding", k=5)
    return reduced.select("vec_id", "reduced")


@query("reduced_norms", "SELECT vec_id, true AS kept FROM embeddings")
def reduced_norms(spark, sf_dir):
    """With as many components as a vector has entries, the reduction only turns it: its length stays."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = len(v.first()["embedding"])

    def length(c: str):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))

    turned = vectors.reduce_dims(v, vector="embedding", k=width)
    return turned.select("vec_id", (F.abs(length("reduced") - length("embedding")) <= 1e-4 * length("embedding")).alias("kept"))


@query("kmeans_settled", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS astray FROM embeddings")
def kmeans_settled(spark, sf_dir):
    """No vector is nearer to another centre than to its own."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    placed, centres = vectors.coarse_cells(v, vector="embedding", cells=8)
    again = vectors.assign_cells(placed.withColumnRenamed("cell", "own"), centres, vector="embedding")
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("own") != F.col("cell")).alias("astray"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return vectors.kmeans(table(spark, sf_dir, "embeddings"), vector="embedding", k=8).select("vec_id", "cluster")


@query("kmeans_stability")
def kmeans_stability(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    twice = vectors.kmeans(v, vector="embedding", k=8, seed=1, output="a").join(
        vectors.kmeans(v, vector="embedding", k=8, seed=2, output="b").select("vec_id", "b"), "vec_id")
    return clusters.stability(twice, first="a", second="b")


@query("label_stability", """
WITH cells AS (
  SELECT quality, toxic, CAST(count(*) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS same_pairs FROM cells),
a AS (SELECT sum(m * (m - 1) / 2) AS first_pairs FROM (SELECT sum(n) AS m FROM cells GROUP BY quality)),
b AS (SELECT sum(m * (m - 1) / 2) AS second_pairs FROM (SELECT sum(n) AS m FROM cells GROUP BY toxic)),
e AS (SELECT *, first_pairs * second_pairs / (n * (n - 1) / 2) AS expected FROM t, a, b)
SELECT CAST(n AS BIGINT) AS n_rows, same_pairs, first_pairs, second_pairs,
  round((same_pairs - expected) / ((first_pairs + second_pairs) / 2 - expected), 9) AS adjusted_rand FROM e""")
def label_stability(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return clusters.stability(both, first="quality", second="toxic").withColumn(
        "adjusted_rand", F.round("adjusted_rand", 9))


_PREDICTED = """
p AS (
  SELECT CAST(quality AS VARCHAR) AS actual, CASE WHEN n_chars > 6000 THEN '2' WHEN n_chars > 500 THEN '1' ELSE '0' END AS predicted
  FROM documents JOIN labels USING (doc_id)),
m AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY 1, 2)"""


def predicted(spark, sf_dir) -> DataFrame:
    """A rule on the length as the prediction; one predicted class has no actual rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rule = F.when(F.col("n_chars") > 6000, "2").when(F.col("n_chars") > 500, "1").otherwise("0")
    return docs.select("doc_id", F.col("quality").cast("string").alias("actual"), rule.alias("predicted"))


@query("confusion", f"WITH {_PREDICTED} SELECT * FROM m")
def confusion(spark, sf_dir):
    return evaluate.confusion(predicted(spark, sf_dir), actual="actual", predicted="predicted")


@query("class_report", f"""
WITH {_PREDICTED}, l AS (SELECT DISTINCT actual AS label FROM m UNION SELECT DISTINCT predicted FROM m),
c AS (
  SELECT label, CAST(coalesce(sum(n) FILTER (WHERE actual = label), 0) AS BIGINT) AS support,
    CAST(coalesce(sum(n) FILTER (WHERE predicted = label), 0) AS BIGINT) AS n_predicted,
    CAST(coalesce(sum(n) FILTER (WHERE actual = label AND predicted = label), 0) AS BIGINT) AS n_hit
  FROM l, m GROUP BY label)
SELECT *, round(CASE WHEN n_predicted > 0 THEN n_hit / n_predicted END, 6) AS precision,
  round(CASE WHEN support > 0 THEN n_hit / support END, 6) AS recall,
  round(2 * n_hit / (support + n_predicted), 6) AS f1 FROM c""")
def class_report(spark, sf_dir):
    matrix = evaluate.confusion(predicted(spark, sf_dir), actual="actual", predicted="predicted")
    return evaluate.class_report(matrix).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("prediction_errors", f"""
SELECT doc_id, CAST(quality AS VARCHAR) AS actual,
  CASE WHEN n_chars > 6000 THEN '2' WHEN n_chars > 500 THEN '1' ELSE '0' END AS predicted
FROM documents JOIN labels USING (doc_id)
WHERE CAST(quality AS VARCHAR) <> CASE WHEN n_chars > 6000 THEN '2' WHEN n_chars > 500 THEN '1' ELSE '0' END""")
def prediction_errors(spark, sf_dir):
    return evaluate.errors(predicted(spark, sf_dir), actual="actual", predicted="predicted")


@query("classify_cases")
def classify_cases(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cases = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    train, test = evaluate.hash_split(cases, case_id="doc_id")
    model = evaluate.fit_classifier(train, text="text", label="quality")
    return evaluate.classify(model, test, text="text").select("doc_id", "quality", "predicted")


@query("classify_coverage", """
SELECT count(*) AS n_cases, true AS all_split, CAST(0 AS BIGINT) AS n_strange FROM documents JOIN labels USING (doc_id)""")
def classify_coverage(spark, sf_dir):
    """Every labelled case is either learnt from or predicted, and only known labels are predicted."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cases = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    train, test = evaluate.hash_split(cases, case_id="doc_id")
    model = evaluate.fit_classifier(train, text="text", label="quality")
    rows = evaluate.classify(model, test, text="text").select("doc_id", F.col("predicted").cast("string").alias("p"))
    known = train.select("doc_id", F.lit(None).cast("string").alias("p"))
    both = rows.unionByName(known)
    strange = F.col("p").isNotNull() & ~F.col("p").cast("double").isin(0.0, 1.0)
    return both.agg(F.count("*").alias("n_cases"), (F.count_distinct("doc_id") == F.count("*")).alias("all_split"),
                    F.count_if(strange).alias("n_strange"))


def _drawn(stem, words: int, n: int) -> list:
    """``n`` draws from the words of a stem, by a hash of the document's id."""
    stem = F.lit(stem) if isinstance(stem, str) else stem
    return [F.concat(stem, F.lit("word"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(words)).cast("string")) for i in range(n)]


@query("classify_planted", "SELECT count(*) AS n_cases, true AS right FROM documents")
def classify_planted(spark, sf_dir):
    """One word among all others tells the class: held-out cases must get theirs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id"))
    kind = F.concat(F.lit("kind"), (F.col("doc_id") % 3).cast("string"))
    cases = docs.select("doc_id", kind.alias("kind"), F.concat_ws(" ", F.concat(F.lit("mark"), kind), *_drawn("any", 40, 10)).alias("text"))
    train, test = evaluate.hash_split(cases, case_id="doc_id")
    model = evaluate.fit_classifier(train, text="text", label="kind")
    told = evaluate.classify(model, test, text="text").select((F.col("predicted") == F.col("kind")).alias("hit"))
    both = told.unionByName(train.select(F.lit(None).cast("boolean").alias("hit")))
    return both.agg(F.count("*").alias("n_cases"), (F.count_if("hit") >= 0.95 * F.count("hit")).alias("right"))


@query("topics_planted", """
SELECT doc_id % 4 AS planted, count(*) AS n, true AS found FROM documents GROUP BY 1""")
def topics_planted(spark, sf_dir):
    """Texts of four sets of words, eight topics: each set has a topic of its own, which nearly all its texts get."""
    place = F.concat(F.lit("set"), (F.col("doc_id") % 4).cast("string"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", F.concat_ws(" ", *_drawn(place, 12, 30)).alias("text"))
    model = evaluate.fit_topics(docs, text="text", k=8, max_iter=20)
    cells = evaluate.topic_of(model, docs, text="text").groupBy((F.col("doc_id") % 4).alias("planted"), "topic").agg(F.count("*").alias("c"))
    tops = cells.groupBy("planted").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("topic", "c").alias("topic"))
    own = F.count("*").over(Window.partitionBy("topic")) == 1
    return tops.select("planted", "n", (own & (F.col("top") >= 0.9 * F.col("n"))).alias("found"))


@query("topic_model")
def topic_model(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return evaluate.topic_terms(evaluate.fit_topics(docs, text="text", k=5, max_iter=5))


@query("topic_coverage", "SELECT count(*) AS n_documents FROM documents")
def topic_coverage(spark, sf_dir):
    """Every document has one topic."""
    return topic_assignments(spark, sf_dir).agg(F.sum("n").alias("n_documents"))


@query("topic_assignments")
def topic_assignments(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = evaluate.fit_topics(docs, text="text", k=5, max_iter=5)
    return evaluate.topic_of(model, docs, text="text").groupBy("topic").agg(F.count("*").alias("n"))
