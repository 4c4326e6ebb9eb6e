"""Queries on groups, graphs, distances, clusterings and labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators import clustering as K
from cohortal.operators import comparison as C
from cohortal.operators import encoding as E
from cohortal.operators import enrichment as R
from cohortal.operators import graph as A
from cohortal.operators import pairs as P
from cohortal.operators import quality as Q
from cohortal.operators import tiles as T
from cohortal.plans.oracle import BOTH, CLOSURE, EDGES, MARKED, MEMBERS, PAIRS, average_rank, fisher, hypergeometric
from cohortal.plans.statistics import rounded
from cohortal.sources import files
from cohortal.sources import tables as D

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUTOFF = 1.1


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_FLAT = f"""{MEMBERS}, {MARKED}, g AS (SELECT gid, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits FROM membership JOIN marked USING (member) GROUP BY 1),
 w AS (SELECT gid, n, hits, (SELECT count(*) FROM marked) AS total, (SELECT count(*) FROM marked WHERE hit) AS th FROM g), x AS (SELECT gid, n, hits, hits AS a, n - hits AS b, th - hits AS c, total - th - (n - hits) AS d FROM w)"""


def _tested(p: str) -> str:
    return f"WITH {_FLAT}, t AS (SELECT *, {p} AS p FROM x) SELECT gid, n, hits, round(hits / n, 6) AS fraction, round(p, 6) AS p FROM t"


@query(_tested(fisher("a", "b", "c", "d")))
def fisher_flat(spark: SparkSession, d: str) -> DataFrame:
    """Fisher's test of every part group for often returned parts."""
    return rounded(R.enrichment(D.membership(spark, d), D.marked_parts(spark, d)).select("gid", "n", "hits", "fraction", "p"), "fraction", "p")


@query(_tested(hypergeometric("a", "b", "c", "d")))
def hypergeom_flat(spark: SparkSession, d: str) -> DataFrame:
    """The hypergeometric tail of the same groups."""
    return rounded(R.enrichment(D.membership(spark, d), D.marked_parts(spark, d), "hypergeometric").select("gid", "n", "hits", "fraction", "p"), "fraction", "p")


@query(f"WITH {MEMBERS}, {MARKED} SELECT gid, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits, round(count(CASE WHEN hit THEN 1 END) / count(*), 6) AS fraction FROM membership JOIN marked USING (member) GROUP BY 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """Marked members of groups."""
    return rounded(R.group_counts(D.membership(spark, d), D.marked_parts(spark, d)), "fraction")


def _some(spark: SparkSession, d: str) -> DataFrame:
    """Membership in which brands with an odd last digit have no group of their own, so that masking leaves their parts with the types above."""
    return D.membership(spark, d).where(~F.col("gid").rlike(r"\|.*[13579]$"))


@query(f"""WITH {CLOSURE}, {MEMBERS.replace('membership AS', 'every AS')}, membership AS (SELECT * FROM every WHERE NOT regexp_matches(gid, '\\|.*[13579]$')), {MARKED},
 used AS (SELECT DISTINCT c.ancestor AS gid, m.member FROM closure c JOIN membership m ON c.descendant = m.gid), k AS (SELECT * FROM membership ANTI JOIN used USING (gid, member)),
 g AS (SELECT gid, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits FROM k JOIN marked USING (member) GROUP BY 1),
 w AS (SELECT gid, n, hits, (SELECT count(*) FROM marked) AS total, (SELECT count(*) FROM marked WHERE hit) AS th FROM g), x AS (SELECT gid, n, hits, hits AS a, n - hits AS b, th - hits AS c, total - th - (n - hits) AS d FROM w),
 t AS (SELECT gid, n, hits, {fisher('a', 'b', 'c', 'd')} AS p FROM x) SELECT m.gid, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, round(coalesce(p, 1.0), 6) AS p FROM (SELECT DISTINCT gid FROM membership) m LEFT JOIN t USING (gid)""")
def hier_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment along the hierarchy, descendants masking their members."""
    x = R.hierarchical_enrichment(_some(spark, d), D.group_edges(spark, d), D.marked_parts(spark, d))
    return rounded(x.select("gid", "n", "hits", "p"), "p")


@query(f"WITH {CLOSURE} SELECT ancestor, descendant, CAST(depth AS BIGINT) AS depth FROM closure")
def dag_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of part groups."""
    return rounded(A.closure(D.group_edges(spark, d)))


@query(f"WITH {CLOSURE} SELECT id, count(c.ancestor) AS level FROM (SELECT parent AS id FROM edges UNION SELECT child FROM edges) LEFT JOIN closure c ON c.descendant = id GROUP BY 1")
def dag_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of part groups."""
    return A.levels(D.group_edges(spark, d))


@query(f"WITH {EDGES}, b AS (SELECT parent AS id, 0 AS u, 1 AS d FROM edges UNION ALL SELECT child, 1, 0 FROM edges) SELECT id, CAST(sum(u) AS BIGINT) AS ascendants, CAST(sum(d) AS BIGINT) AS descendants, count(*) AS links FROM b GROUP BY 1")
def dag_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of part groups."""
    return A.degrees(D.group_edges(spark, d))


@query(f"WITH {EDGES} SELECT DISTINCT parent AS id, 'root' AS kind FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT DISTINCT child, 'leaf' FROM edges WHERE child NOT IN (SELECT parent FROM edges)")
def dag_ends(spark: SparkSession, d: str) -> DataFrame:
    """Roots and leaves."""
    e = D.group_edges(spark, d)
    return A.roots(e).withColumn("kind", F.lit("root")).unionByName(A.leaves(e).withColumn("kind", F.lit("leaf")))


_NATION_GROUPS = """groups AS (SELECT 'R:' || r_name AS gid, n_nationkey AS member FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'A:' || n_name, n_nationkey FROM nation UNION SELECT 'W:' || (n_nationkey // 13), n_nationkey FROM nation)"""


@query(f"""WITH {_NATION_GROUPS}, s AS (SELECT gid, count(*) AS n FROM groups GROUP BY 1), h AS (SELECT b.gid AS parent, a.gid AS child FROM groups a JOIN groups b ON a.member = b.member AND a.gid <> b.gid JOIN s sa ON sa.gid = a.gid JOIN s sb ON sb.gid = b.gid GROUP BY 1, 2, sa.n, sb.n
 HAVING count(*) = sa.n AND (sb.n > sa.n OR (sb.n = sa.n AND b.gid < a.gid))) SELECT parent, child FROM h ANTI JOIN (SELECT x.parent, y.child FROM h x JOIN h y ON x.child = y.parent) USING (parent, child)""")
def pclist_containment(spark: SparkSession, d: str) -> DataFrame:
    """Parents of groups by containment of members."""
    n = D.read(spark, d, "nation").join(D.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda g: n.select(g.alias("gid"), F.col("n_nationkey").alias("member"))
    return A.containment_edges(one(F.concat(F.lit("R:"), "r_name")).unionByName(one(F.concat(F.lit("A:"), "n_name"))).unionByName(one(F.concat(F.lit("W:"), F.floor(F.col("n_nationkey") / 13).cast("string")))))


@query(f"""WITH {MEMBERS} SELECT gid || chr(9) || '' || chr(9) || string_agg(member::VARCHAR, chr(9) ORDER BY member) AS value FROM membership WHERE gid LIKE '%|%' GROUP BY gid""")
def gmt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Group file lines."""
    g = D.membership(spark, d).where(F.contains("gid", F.lit("|"))).groupBy("gid").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return files.gmt_lines(g.withColumn("description", F.lit("")))


@query("""WITH m AS (SELECT c_mktsegment AS gid, 'n' || c_nationkey AS member FROM customer), y AS (SELECT 'n' || n_nationkey AS member, n_name AS synonym FROM nation) SELECT gid, member FROM m UNION SELECT gid, synonym FROM m JOIN y USING (member)""")
def synonym_groups(spark: SparkSession, d: str) -> DataFrame:
    """Segments of nations with names beside keys."""
    key = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    m = D.read(spark, d, "customer").select(F.col("c_mktsegment").alias("gid"), key("c_nationkey").alias("member"))
    return R.with_synonyms(m, D.read(spark, d, "nation").select(key("n_nationkey").alias("member"), F.col("n_name").alias("synonym")))


@query(f"WITH {PAIRS} SELECT i, j, round(d, 6) AS d FROM pairs")
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all embeddings."""
    return T.rounded_pairs(D.points(spark, d))


@query(f"WITH {PAIRS}, r AS (SELECT i, j, round(d, 6) AS d FROM pairs) SELECT i, j, round({average_rank('d')} / count(*) OVER (), 6) AS equalised FROM r")
def uncursed(spark: SparkSession, d: str) -> DataFrame:
    """Distances equalised by rank."""
    return rounded(P.equalised_pairs(D.points(spark, d)), "equalised")


@query(f"WITH {PAIRS}, {BOTH} SELECT round(min(d), 6) AS nearest, round((SELECT min(m) FROM (SELECT max(d) AS m FROM both_ways GROUP BY i)), 6) AS \"full\" FROM pairs")
def clustering_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Where anything, and where everything is connected."""
    return rounded(K.clustering_bounds_of_points(D.points(spark, d)), "nearest", "full")


_COMPONENTS = f"""WITH RECURSIVE {PAIRS}, e AS (SELECT i, j FROM pairs WHERE d <= {CUTOFF} UNION SELECT j, i FROM pairs WHERE d <= {CUTOFF}),
 reach(a, b) AS (SELECT item, item FROM points UNION SELECT r.a, e.j FROM reach r JOIN e ON r.b = e.i), top AS (SELECT a AS item, max(b) AS top FROM reach GROUP BY 1)
SELECT item, dense_rank() OVER (ORDER BY top) - 1 AS cluster FROM top"""


@query(_COMPONENTS)
def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of embeddings at a cutoff."""
    return rounded(K.near_components(D.points(spark, d), CUTOFF))


@query(f"""WITH RECURSIVE {PAIRS}, {BOTH}, core AS (SELECT i AS item FROM both_ways WHERE d < {CUTOFF} GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT i, j FROM both_ways WHERE d <= {CUTOFF} AND i IN (SELECT item FROM core) AND j IN (SELECT item FROM core)),
 reach(a, b) AS (SELECT item, item FROM core UNION SELECT r.a, e.j FROM reach r JOIN e ON r.b = e.i), top AS (SELECT a AS item, max(b) AS top FROM reach GROUP BY 1), n AS (SELECT item, dense_rank() OVER (ORDER BY top) - 1 AS cluster FROM top)
SELECT item, coalesce(cluster, -1) AS cluster FROM points LEFT JOIN n USING (item)""")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of embeddings."""
    return rounded(K.dbscan_of_points(D.points(spark, d), CUTOFF, 2))


@query()
def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Merge heights of single linkage."""
    return K.single_linkage_heights(K.spanning_tree_of_points(D.points(spark, d)))


@query()
def hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the single-linkage hierarchy and their score."""
    points = D.points(spark, d)
    return K.level_score(K.hierarchy_levels(K.spanning_tree_of_points(points), points.count()))


@query(f"WITH {PAIRS}, {BOTH}, r AS (SELECT i, j, d, rank() OVER (PARTITION BY i ORDER BY d) AS r FROM both_ways) SELECT i, j, round(d, 6) AS d FROM r WHERE r <= 5")
def nn_graph(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest neighbours."""
    return rounded(K.nearest_of_points(D.points(spark, d), 5), "d")


@query(f"WITH {PAIRS}, {BOTH}, r AS (SELECT i, lb, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM both_ways) SELECT i AS item, CAST(lb AS BIGINT) AS label, round(count(*) / 8, 6) AS share FROM r WHERE r <= 8 GROUP BY 1, 2")
def knn_probability(spark: SparkSession, d: str) -> DataFrame:
    """Labels among the eight nearest."""
    return rounded(K.label_shares_of_points(D.points(spark, d), 8), "share")


@query(f"WITH {PAIRS} SELECT CAST(least(la, lb) AS BIGINT) AS c1, CAST(greatest(la, lb) AS BIGINT) AS c2, round(avg(d), 6) AS mean, count(*) AS pairs FROM pairs GROUP BY 1, 2")
def compactness(spark: SparkSession, d: str) -> DataFrame:
    """Mean distances within and between labels."""
    return rounded(Q.compactness_of_points(D.points(spark, d)), "mean")


@query(f"WITH {PAIRS} SELECT round(min(CASE WHEN la <> lb THEN d END) / max(CASE WHEN la = lb THEN d END), 6) AS dunn FROM pairs")
def dunn(spark: SparkSession, d: str) -> DataFrame:
    """Dunn's index of labels."""
    return rounded(Q.dunn_index_of_points(D.points(spark, d)), "dunn")


_CELLS = "c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * n) AS ss FROM c), a AS (SELECT sum(n * n) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * n) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY source))"


@query(f"WITH {_CELLS} SELECT CAST(ss - t AS BIGINT) AS tp, CAST(sa - ss AS BIGINT) AS fp, CAST(sb - ss AS BIGINT) AS fn, CAST(t * t - (ss - t) - (sa - ss) - (sb - ss) AS BIGINT) AS tn FROM t, a, b")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pair agreement of languages and sources."""
    return Q.pair_counts(D.read(spark, d, "documents"), "lang", "source")


@query(f"""WITH {_CELLS}, m AS (SELECT sum(n / (SELECT t FROM t) * ln(n * (SELECT t FROM t) / (ra * rb))) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY lang) AS ra, sum(n) OVER (PARTITION BY source) AS rb FROM c)),
 p AS (SELECT mi, (ss - t) / 2.0 AS s, (sa - t) / 2.0 AS sa, (sb - t) / 2.0 AS sb, t * (t - 1) / 2.0 AS al FROM t, a, b, m)
SELECT round(mi, 6) AS mutual_information, round((al + 2 * s - sa - sb) / al, 6) AS rand, round((s - sa * sb / al) / ((sa + sb) / 2 - sa * sb / al), 6) AS adjusted_rand FROM p""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Information, Rand and adjusted Rand of languages and sources."""
    return rounded(Q.agreement(D.read(spark, d, "documents"), "lang", "source"), "mutual_information", "rand", "adjusted_rand")


@query("""WITH t AS (SELECT count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END)::DOUBLE AS fn, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END)::DOUBLE AS tn FROM labels)
SELECT round(tp / (tp + fn), 6) AS tpr, round(tn / (tn + fp), 6) AS tnr, round(tp / (tp + fp), 6) AS ppv, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(tp * tn / (fp * fn), 6) AS odds_ratio FROM t""")
def quality_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of cleanness as a guess at quality."""
    n = lambda q, t: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1)).cast("double")
    t = D.read(spark, d, "labels").agg(n(1, 0).alias("tp"), n(0, 0).alias("fp"), n(1, 1).alias("fn"), n(0, 1).alias("tn"))
    names = ["tpr", "tnr", "ppv", "accuracy", "f1", "mcc", "odds_ratio"]
    found = C.rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return t.select([F.round(found[c], 6).alias(c) for c in names])


_HISTOGRAM = f"{PAIRS}, o AS (SELECT la = lb AS same, CAST(floor((row_number() OVER (ORDER BY d, i, j) - 1) * 20 / count(*) OVER ()) AS INTEGER) AS bin FROM pairs), h AS (SELECT bin, count(CASE WHEN same THEN 1 END) AS n_in, count(CASE WHEN NOT same THEN 1 END) AS n_out FROM o GROUP BY 1)"


@query(f"""WITH {_HISTOGRAM}, x AS (SELECT n_in, n_out, coalesce(sum(n_out) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS a, coalesce(sum(n_in) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b FROM h),
 g AS (SELECT sum(n_in * a + 0.5 * n_in * n_out) AS w, sum(n_in)::DOUBLE AS ni, sum(n_out)::DOUBLE AS no, sum(n_in * (a * a + a * n_out + n_out * n_out / 3.0)) AS q2, sum(n_out * (b * b + b * n_in + n_in * n_in / 3.0)) AS q1 FROM x),
 u AS (SELECT ni, no, w / (ni * no) AS auc, q1 / (no * ni * ni) AS q1, q2 / (ni * no * no) AS q2 FROM g) SELECT round(auc, 6) AS auc, round(sqrt((auc * (1 - auc) + (ni - 1) * (q1 - auc * auc) + (no - 1) * (q2 - auc * auc)) / (ni * no)), 6) AS se FROM u""")
def auc_distances(spark: SparkSession, d: str) -> DataFrame:
    """How well small distance tells equal labels, from a rank histogram."""
    return rounded(Q.histogram_auc(Q.filled_histogram(D.points(spark, d), 20)), "auc", "se")


@query(f"WITH {PAIRS}, {BOTH}, r AS (SELECT i, la, lb, rank() OVER (PARTITION BY i ORDER BY d) AS r FROM both_ways) SELECT i AS item, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS happiness FROM r WHERE r <= 5 GROUP BY 1")
def happiness(spark: SparkSession, d: str) -> DataFrame:
    """Share of near neighbours with the own label."""
    return rounded(Q.happiness(K.nearest_of_points(D.points(spark, d), 5), D.points(spark, d).select("item", "label")), "happiness")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of languages and sources."""
    return Q.confusion(D.read(spark, d, "documents"), "lang", "source")


@query("""WITH m AS (SELECT DISTINCT c_mktsegment AS g, c_nationkey % 9 * 25 + c_custkey % 11 AS m FROM customer), s AS (SELECT g, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.g AS i, b.g AS j, count(*) AS shared FROM m a JOIN m b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2)
SELECT i, j, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.g = i JOIN s y ON y.g = j""")
def jaccard_groups(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of segments' members."""
    m = D.read(spark, d, "customer").select("c_mktsegment", (F.col("c_nationkey") % 9 * 25 + F.col("c_custkey") % 11).alias("m"))
    return rounded(P.jaccard(m, "c_mktsegment", "m"), "jaccard")


@query(f"WITH {PAIRS}, b AS (SELECT CAST(floor(d / 0.05) AS BIGINT) AS bin, count(*) AS pairs FROM pairs WHERE d < 2.0 GROUP BY 1) SELECT bin, pairs, round(pairs / (4.0 / 3 * pi() * (pow((bin + 1) * 0.05, 3) - pow(bin * 0.05, 3))), 4) AS density FROM b")
def rdf_hist(spark: SparkSession, d: str) -> DataFrame:
    """Radial histogram of distances."""
    return rounded(P.radial_histogram_of_points(D.points(spark, d), 40, 2.0), "density", places=4)


@query("SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS keys FROM nation GROUP BY 1")
def inverted_lists(spark: SparkSession, d: str) -> DataFrame:
    """Nations of each region as a list."""
    return E.inverted(D.read(spark, d, "nation"), "n_name", "n_regionkey")


@query()
def complete_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Complete linkage of all embeddings."""
    return K.linkage_of_points(D.points(spark, d), "max")


@query()
def linkage_levels(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of single linkage at one height inside those at a greater one."""
    items = D.points(spark, d).select("item")
    tree = K.spanning_tree_of_points(D.points(spark, d))
    return K.level_edges(K.cut(tree, items, 1.0), K.cut(tree, items, CUTOFF))


@query(f"""WITH {PAIRS.split(', pairs AS')[0]},
 m AS (SELECT label, k, avg(vec[k]::DOUBLE) AS v FROM points, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2), d AS (SELECT p.item, m.label, sum((p.vec[m.k]::DOUBLE - m.v) * (p.vec[m.k]::DOUBLE - m.v)) AS d FROM points p, m GROUP BY 1, 2)
SELECT item, CAST(arg_min(label, d) AS BIGINT) AS owner FROM d GROUP BY 1""")
def centroid_owner(spark: SparkSession, d: str) -> DataFrame:
    """The label whose centroid is nearest to each embedding."""
    x = D.points(spark, d)
    centre = x.groupBy("label").agg(F.array(*[F.avg(F.col("vec")[k]) for k in range(64)]).alias("centre"))
    return K.nearest_centroid(x.select("item", "vec"), centre)
