"""Queries over images, documents, stored vectors and neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import dot, norm
from ..io import latest_rows, table
from ..operators import filters as FI
from ..operators import ranking as R
from ..operators import similarity as SI
from ..operators.skyline import pareto_front

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "images")


WORDS = "list_filter(regexp_split_to_array(coalesce(caption, ''), '\\s+'), lambda w: w <> '')"
VALID = f"""(len({WORDS}) >= 5 AND NOT starts_with(lower(trim(coalesce(caption, ''), ' ')), 'http') AND NOT starts_with(lower(trim(coalesce(caption, ''), ' ')), 'www')
  AND NOT regexp_matches(coalesce(caption, ''), '(\\.jpg|\\.png|\\.jpeg|\\.gif|\\.webp)\\s*$'))"""


@query(f"SELECT id, {VALID} AS valid FROM (SELECT DISTINCT id, caption FROM images)")
def caption_valid(spark, folder):
    return _images(spark, folder).select("id", "caption").distinct().select("id", T.caption_valid(F.col("caption")).alias("valid"))


@query(f"""SELECT CASE WHEN NOT {VALID} THEN 'caption' WHEN coalesce(width, 0) < 256 OR coalesce(height, 0) < 256 THEN 'size' ELSE 'kept' END AS reason, count(*) AS n FROM images GROUP BY 1""")
def caption_drop_reasons(spark, folder):
    reason = FI.drop_reason(F.col("caption"), F.col("width"), F.col("height"))
    return _images(spark, folder).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS (SELECT * FROM images WHERE trim(coalesce(url, ''), ' ') <> '' AND len({WORDS}) >= 5 AND coalesce(width, 0) >= 256 AND coalesce(height, 0) >= 256 AND batch > 0)
SELECT DISTINCT id, batch FROM f WHERE id NOT IN (SELECT id FROM images WHERE batch = 0)""")
def ingest_filter_dedup(spark, folder):
    i = _images(spark, folder)
    new = FI.ingest_filter(i.where("batch > 0")).select("id", "batch", "url")
    return FI.insert_or_ignore(new, "id", "batch", i.where("batch = 0")).select("id", "batch")


@query("""WITH d AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(trim(coalesce(text, ''), ' '), '\\s+'), lambda w: w <> ''), lambda w: lower(w)) AS w, lower(coalesce(text, '')) AS low FROM documents),
p AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 3 THEN [list_aggregate(w[i:i+2], 'string_agg', ' ') FOR i IN range(1, len(w) - 1)] END AS t,
  CASE WHEN starts_with(low, 'http') OR contains(low, 'www.') THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(low, '\\.(jpg|jpeg|png|gif|webp|bmp|tiff?)(\\s|$)') THEN 0.3 ELSE 0 END + CASE WHEN len(low) - len(replace(low, '|', '')) > 3 OR len(low) - len(replace(low, '_', '')) > 5 THEN 0.2 ELSE 0 END AS art FROM d)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 0.1 ELSE greatest(0, least(1, 0.4 * CASE WHEN n < 20 THEN n / 20.0::DOUBLE WHEN n <= 80 THEN 1.0 ELSE greatest(0.3, 1 - (n - 80) / 200.0::DOUBLE) END + 0.4 * len(list_distinct(w)) / n - (1 - len(list_distinct(t)) / len(t)) / 2 - art::DOUBLE)) END, 4) AS quality FROM p""")
def caption_quality(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(T.caption_quality(F.col("text")), 4).alias("quality"))


@query("""SELECT shard_id, CASE WHEN contains(lower(path), 'openalt') THEN 'alt' WHEN contains(lower(path), 'art') THEN 'art' WHEN contains(lower(path), 'map') THEN 'map' ELSE 'unknown' END AS label FROM (SELECT DISTINCT shard_id, path FROM shards WHERE shard_id IS NOT NULL)""")
def source_from_path(spark, folder):
    s = table(spark, folder, "shards").where("shard_id IS NOT NULL").select("shard_id", "path").distinct()
    return s.select("shard_id", F.when(F.col("path").isNull(), "unknown").otherwise(T.label_from_path(F.col("path"), [("openalt", "alt"), ("art", "art"), ("map", "map")])).alias("label"))


@query("SELECT status, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS with_error, count(DISTINCT id) AS records FROM images GROUP BY status")
def status_rollup(spark, folder):
    return _images(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("with_error"), F.countDistinct("id").alias("records"))


@query("SELECT id, min(least(coalesce(width, 0), coalesce(height, 0))) AS side FROM images GROUP BY id HAVING min(least(coalesce(width, 0), coalesce(height, 0))) < 256")
def small_images(spark, folder):
    return _images(spark, folder).groupBy("id").agg(F.min(F.least(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))).alias("side")).where("side < 256")


@query("""WITH b AS (SELECT * FROM (VALUES (0, 1.0), (1, 1.5), (2, 0.66), (3, 2.0), (4, 0.5)) t(bucket, ratio)), i AS (SELECT DISTINCT id, width, height FROM images),
r AS (SELECT id, bucket, row_number() OVER (PARTITION BY id ORDER BY abs(width / height::DOUBLE - ratio), bucket) AS k FROM i, b WHERE width > 0 AND height > 0)
SELECT bucket, count(*) AS n FROM (SELECT bucket FROM r WHERE k = 1 UNION ALL SELECT 0 FROM i WHERE coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0) GROUP BY bucket""")
def aspect_buckets(spark, folder):
    """Records by the nearest of five aspect ratios, the first on ties; a record without a size goes to the first."""
    ratios = [1.0, 1.5, 0.66, 2.0, 0.5]
    known = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    apart = F.array(*[F.struct(F.abs(F.try_divide(F.col("width"), F.col("height")) - r).alias("d"), F.lit(i).alias("b")) for i, r in enumerate(ratios)])
    one = _images(spark, folder).select("id", "width", "height").distinct()
    return one.groupBy(F.when(known, F.array_min(apart)["b"]).otherwise(0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text IS NOT NULL AND trim(text, ' ') <> '' AS has_text, coalesce(n_chars, -1) = coalesce(len(text), 0) AS chars_right FROM documents")
def document_checks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", (F.col("text").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("has_text"), (F.coalesce("n_chars", F.lit(-1)) == F.coalesce(F.length("text"), F.lit(0))).alias("chars_right"))


@query("""WITH d AS (SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT first_id, copies FROM d WHERE copies > 1""")
def exact_duplicates(spark, folder):
    """Groups of equal texts with their smallest id."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1").select("first_id", "copies")


@query("""WITH f AS (SELECT source, campaign, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT lang AS source, campaign, count(*) AS m FROM documents GROUP BY ALL)
SELECT coalesce(f.source, g.source) AS name, coalesce(f.campaign, g.campaign) AS campaign, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM f FULL JOIN g ON f.source IS NOT DISTINCT FROM g.source AND f.campaign IS NOT DISTINCT FROM g.campaign""")
def full_outer_coverage(spark, folder):
    """Two histograms side by side, zeros where one has none."""
    d = table(spark, folder, "documents")
    f = d.groupBy("source", "campaign").agg(F.count(F.lit(1)).alias("n"))
    g = d.groupBy(F.col("lang").alias("s2"), F.col("campaign").alias("c2")).agg(F.count(F.lit(1)).alias("m"))
    both = f.join(g, F.col("source").eqNullSafe(F.col("s2")) & F.col("campaign").eqNullSafe(F.col("c2")), "full_outer")
    return both.select(F.coalesce("source", "s2").alias("name"), F.coalesce("campaign", "c2").alias("campaign"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM shards WHERE shard_id IS NOT NULL) WHERE rn = 1)"


@query(f"""WITH {CURRENT}, h AS (SELECT shard_id, coalesce(source, '') AS source, ('0x' || substr(md5(shard_id || ':42'), 1, 15))::BIGINT AS h FROM cur),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, shard_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS t FROM h) SELECT shard_id, source FROM r WHERE p >= t // 5 AND p < 2 * t // 5""")
def seeded_slice(spark, folder):
    """The second of five slices of every source's shards."""
    s = latest_rows(table(spark, folder, "shards"), "shard_id", "indexed_at").select("shard_id", F.coalesce("source", F.lit("")).alias("source"))
    return R.seeded_slice(s, "source", "shard_id", 2, 5)


@query(f"""WITH {CURRENT}, h AS (SELECT shard_id, CASE WHEN isnan(final_value_score) THEN 0 ELSE final_value_score END AS w, (('0x' || substr(md5(shard_id || ':42'), 1, 15))::BIGINT + 1) / 1152921504606846976.0::DOUBLE AS u FROM cur)
SELECT shard_id, w FROM h WHERE w > 0 ORDER BY ln(u) / w DESC, shard_id LIMIT 100""")
def weighted_sample(spark, folder):
    """A hundred shards drawn without replacement by their value."""
    s = latest_rows(table(spark, folder, "shards"), "shard_id", "indexed_at").select("shard_id", F.nanvl("final_value_score", F.lit(0.0)).alias("w"))
    return R.weighted_sample(s, "shard_id", F.col("w"), 100)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(id || ':0'), 1, 15))::BIGINT % 512, ('0x' || substr(md5(id || ':0'), 1, 15))::BIGINT, id) - 1 AS p FROM (SELECT DISTINCT id FROM images WHERE id IS NOT NULL))
SELECT p // 500 AS bin, count(*) AS n, max(p % 500) AS last_slot FROM p GROUP BY 1""")
def shard_packing(spark, folder):
    """Records packed into bins of 500, with the bins' sizes and ends."""
    one = _images(spark, folder).where("id IS NOT NULL").select("id").distinct()
    return FI.pack(one, "id", 500).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last_slot"))


@query("""WITH r AS (SELECT shard_id, rec_id, row_number() OVER (PARTITION BY shard_id ORDER BY rec_id) AS k FROM (SELECT DISTINCT shard_id, rec_id FROM style_vectors WHERE rec_id IN (SELECT rec_id FROM assignments))) SELECT shard_id, rec_id FROM r WHERE k <= 2""")
def allowed_then_capped(spark, folder):
    """At most two records per shard, of those on an allow-list."""
    v = table(spark, folder, "style_vectors").select("shard_id", "rec_id").distinct()
    return FI.capped(v, "shard_id", [F.asc("rec_id")], 2, table(spark, folder, "assignments"), "rec_id")


@query("""WITH v AS (SELECT DISTINCT rec_id, regexp_extract(rec_id, '^(.*)_[^_]*$', 1) AS shard FROM style_vectors) SELECT shard, count(*) AS records FROM v GROUP BY 1""")
def record_shards(spark, folder):
    v = table(spark, folder, "style_vectors").select("rec_id").distinct()
    return v.groupBy(T.record_shard(F.col("rec_id")).alias("shard")).agg(F.count(F.lit(1)).alias("records"))


@query("""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY neighbor_ids, neighbor_cos) AS k FROM neighbors WHERE rec_id IS NOT NULL) WHERE k = 1),
j AS (SELECT rec_id, try_cast(CASE WHEN json_valid(neighbor_cos) THEN neighbor_cos END AS DOUBLE[]) AS c FROM n)
SELECT rec_id, coalesce(len(list_filter(c, lambda x: x >= 0.85)), 0) AS strong, coalesce(len(c), 0) AS listed FROM j""")
def neighbour_list_quality(spark, folder):
    """Stored neighbour lists: how many neighbours they have and how many near ones; broken JSON counts as none."""
    n = table(spark, folder, "neighbors").where("rec_id IS NOT NULL").groupBy("rec_id").agg(F.min(F.struct("neighbor_ids", "neighbor_cos")).alias("r"))
    c = F.from_json("r.neighbor_cos", "array<double>", {"mode": "PERMISSIVE"})
    return n.select("rec_id", F.coalesce(F.size(F.filter(c, lambda x: x >= 0.85)), F.lit(0)).alias("strong"), F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).alias("listed"))


@query("""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY neighbor_ids, neighbor_cos) AS k FROM neighbors WHERE rec_id IS NOT NULL) WHERE k = 1),
j AS (SELECT rec_id, try_cast(CASE WHEN json_valid(neighbor_cos) THEN neighbor_cos END AS DOUBLE[]) AS c FROM n), s AS (SELECT rec_id, list_avg(list_reverse_sort(c)[1:5]) AS m FROM j WHERE len(c) >= 3),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC, rec_id) AS p, count(*) OVER () AS t FROM s) SELECT rec_id, round(m, 4) AS strength FROM r WHERE p <= greatest(1, floor(t * 0.25))""")
def style_strength(spark, folder):
    """The quarter of the records whose five best stored cosines are highest on average."""
    n = table(spark, folder, "neighbors").where("rec_id IS NOT NULL").groupBy("rec_id").agg(F.min(F.struct("neighbor_ids", "neighbor_cos")).alias("r"))
    c = n.select("rec_id", F.from_json("r.neighbor_cos", "array<double>").alias("c")).where(F.size("c") >= 3)
    best = F.slice(F.sort_array("c", asc=False), 1, 5)
    m = c.select("rec_id", (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)).alias("m"))
    ranked = R.global_rank(m, F.col("m"), "rec_id")
    return ranked.where(R.top_share(F.col("rank"), F.col("total"), 25)).select("rec_id", F.round("m", 4).alias("strength"))


# embeddings

EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(f"WITH {EMB}, p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, count(*) AS pairs, round(1 - avg(c), 4) AS diversity FROM p GROUP BY 1")
def label_diversity(spark, folder):
    """One minus the mean cosine of a label's pairs, from vector sums."""
    g = SI.group_spread(table(spark, folder, "embeddings"), "label", "embedding")
    return g.where("n > 1").select("label", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), F.round(1 - F.col("mean_cosine"), 4).alias("diversity"))


@query(f"""WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND list_cosine_similarity(a.v, b.v) <= 0.95),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, other) AS place FROM p) SELECT vec_id, other, cos, place FROM r WHERE place <= 5""")
def topk_neighbours(spark, folder):
    """The five nearest of all vectors for every vector whose id is divisible by 50, copies left out."""
    e = table(spark, folder, "embeddings")
    return SI.search(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5, 0.95).select("vec_id", "other", F.round("cos", 6).alias("cos"), "place")


@query(f"""WITH RECURSIVE {EMB}, l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.42),
reach AS (SELECT DISTINCT u AS root, u AS node FROM l UNION SELECT r.root, l.w FROM reach r JOIN l ON l.u = r.node), c AS (SELECT node, min(root::VARCHAR) AS class FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS links FROM l GROUP BY 1)
SELECT e.vec_id::VARCHAR AS vec_id, coalesce(c.class, e.vec_id::VARCHAR) AS class, coalesce(n.links, 0) AS links FROM e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id""")
def threshold_classes(spark, folder):
    """Vectors linked by a cosine of 0.42 or more: class and number of links of each."""
    return SI.threshold_classes(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.42)


@query(f"""WITH {EMB}, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS y FROM e), s AS (SELECT label, i, sum(y) AS s FROM x GROUP BY 1, 2), c AS (SELECT label, list(s ORDER BY i) AS c FROM s GROUP BY 1),
p AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.v, c.c) AS cos FROM e, c WHERE vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS place FROM p),
w AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY vec_id)) / 0.1) AS u FROM r WHERE place <= 3) SELECT vec_id, label, round(u / sum(u) OVER (PARTITION BY vec_id), 4) AS weight FROM w""")
def retrieval_softmax(spark, folder):
    """The three nearest label centres of each asked vector, with softmax weights at temperature 0.1."""
    e = table(spark, folder, "embeddings")
    c = SI.centroids(e, "label", "embedding").select(F.concat(F.lit("c"), "label").alias("vec_id"), F.col("centroid").alias("embedding"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("vec_id"), "embedding")
    best = SI.search(q, c, "vec_id", "embedding", 3).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.substring("other", 2, 20).cast("int").alias("label"), "cos")
    by = Window.partitionBy("vec_id")
    u = F.exp((F.col("cos") - F.max("cos").over(by)) / 0.1)
    return best.withColumn("u", u).select("vec_id", "label", F.round(F.col("u") / F.sum("u").over(by), 4).alias("weight"))


@query(f"WITH {EMB} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS length, round(list_dot_product(v, v), 5) AS square FROM e")
def vector_lengths(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"), F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("square"))


@query()
def farthest_points(spark, folder):
    """Twelve vectors, each the least similar to those before it."""
    return SI.farthest_points(table(spark, folder, "embeddings"), "vec_id", "embedding", 12)


@query()
def kmeans_clusters(spark, folder):
    """Cluster sizes of k-means on unit vectors (labels depend on the seed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vector import unit

    e = SI.usable(table(spark, folder, "embeddings"), "embedding").select("vec_id", array_to_vector(unit(F.col("embedding"))).alias("features"))
    model = KMeans(k=10, seed=7, maxIter=20).fit(e)
    return model.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND length(b.p_name) >= length(a.p_name) AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size OR length(b.p_name) > length(a.p_name)))""")
def pareto3(spark, folder):
    return pareto_front(table(spark, folder, "part").withColumn("l", F.length("p_name")), "p_partkey", ["p_retailprice", "l"], ["p_size"])


@query("""WITH s AS (SELECT shard_id, CASE WHEN NOT isnan(light_score) THEN light_score ELSE 0 END AS a, CASE WHEN NOT isnan(diversity_score) THEN diversity_score ELSE 0 END AS b FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM shards WHERE shard_id IS NOT NULL) WHERE rn = 1),
z AS (SELECT shard_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM s) SELECT shard_id FROM z x WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def pareto2_null_zero(spark, folder):
    return pareto_front(latest_rows(table(spark, folder, "shards"), "shard_id", "indexed_at"), "shard_id", ["light_score", "diversity_score"], nulls_as_zero=True)
