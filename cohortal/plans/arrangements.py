"""Queries on images, curves, lists, walks, factors and histograms of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions import numeric as N
from cohortal.operators import clustering as K
from cohortal.operators import factors as X
from cohortal.operators import fields as I
from cohortal.operators import graph as A
from cohortal.operators import pairs as P
from cohortal.operators import quality as Q
from cohortal.operators import sequences as L
from cohortal.operators import series as S
from cohortal.operators import significance as G
from cohortal.operators import tiles as T
from cohortal.plans.oracle import ANALYTE, BOTH, CLOSURE, DAILY, EDGES, PAIRS, average_rank
from cohortal.plans.statistics import _P, part_p, rounded
from cohortal.sources import files
from cohortal.sources import tables as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""{_P}, r AS (SELECT pos, p, row_number() OVER (ORDER BY p, pos) AS r, count(*) OVER () AS n FROM part_p),
 q AS (SELECT a.r AS m, a.r * min(b.p / (b.r - (a.n - a.r))) AS q FROM r a JOIN r b ON b.r > a.n - a.r GROUP BY 1)
SELECT pos, round(max(least(m * p, q)), 6) AS adjusted FROM r, q GROUP BY 1""")
def adjust_hommel(spark: SparkSession, d: str) -> DataFrame:
    """Parts' p-values adjusted by Hommel's method."""
    return rounded(G.adjusted(part_p(spark, d), "hommel").drop("p"), "adjusted")


IMAGE = """image AS (SELECT f.l_returnflag AS image, a.i, b.j, coalesce(n, 0)::DOUBLE AS value FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT unnest(range(31)) AS i) a, (SELECT unnest(range(50)) AS j) b
  LEFT JOIN (SELECT l_returnflag AS image, day(l_shipdate) - 1 AS i, l_quantity::BIGINT - 1 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) c ON c.image = f.l_returnflag AND c.i = a.i AND c.j = b.j)"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """image (return flag), i (day of the month), j (quantity), value (number of lines)."""
    line = D.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("image"), (F.dayofmonth("l_shipdate") - 1).cast("long").alias("i"), (F.col("l_quantity").cast("long") - 1).alias("j"))
    counted = line.groupBy("image", "i", "j").agg(F.count("*").alias("n"))
    place = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    every = line.select("image").distinct().withColumn("i", place(31)).withColumn("j", place(50))
    return every.join(counted, ["image", "i", "j"], "left").select("image", "i", "j", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


_ACCENT = f"{IMAGE}, ranked AS (SELECT *, {average_rank('value', 'image')} AS r FROM image), accent AS (SELECT *, 2 * (exp(r / (max(r) OVER (PARTITION BY image) + 0.5)) - 1) AS a FROM ranked)"


@query(f"WITH {_ACCENT} SELECT image, i, j, round(a, 6) AS accent, round((i - 15) / 31.0, 6) AS y, round((j - 25) / 50.0, 6) AS x FROM accent")
def field_accent(spark: SparkSession, d: str) -> DataFrame:
    """Images of lines by day and quantity, equalised and spread, on centred grids."""
    return rounded(I.centred_grid(I.accentuated(images(spark, d))).drop("value"), "accent", "y", "x")


@query(f"""WITH {IMAGE}, met AS (SELECT c.image, c.i AS ci, c.j AS cj, c.value AS c, n.i, n.j, n.value AS v FROM image c JOIN image n ON c.image = n.image AND n.i BETWEEN c.i - 1 AND c.i + 1 AND n.j BETWEEN c.j - 1 AND c.j + 1 AND (n.i <> c.i OR n.j <> c.j)),
 o AS (SELECT *, row_number() OVER (PARTITION BY image, ci, cj ORDER BY abs(v - c), i, j) AS k, count(*) OVER (PARTITION BY image, ci, cj) AS n FROM met),
 g AS (SELECT image, ci, cj, 0.5 * (v + c) / n AS share FROM o WHERE k = 1), s AS (SELECT image, i, j, sum(share) AS s FROM met JOIN g USING (image, ci, cj) GROUP BY 1, 2, 3)
SELECT image, i, j, round(value + s, 6) AS blurred FROM image JOIN s USING (image, i, j)""")
def field_blur(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the images blurred along its nearest-valued neighbour."""
    return rounded(I.neighbour_blurred(images(spark, d)).drop("value"), "blurred")


@query(f"""WITH {_ACCENT}, w AS (SELECT image, i, j, a, var_pop(a) OVER (PARTITION BY image) AS w FROM accent), o AS (SELECT x.d AS di, y.d AS dj FROM (SELECT unnest(range(-3, 3)) AS d) x, (SELECT unnest(range(-3, 3)) AS d) y WHERE x.d <> 0 OR y.d <> 0),
 t AS (SELECT w.image, w.i + di AS i, w.j + dj AS j, (s.a - w.a) * (s.a - w.a) / w.w AS a, (di * di + dj * dj) / 9.0 AS b FROM w, o JOIN w s ON s.image = w.image AND s.i = (w.i - di + 31) % 31 AND s.j = (w.j - dj + 50) % 50)
SELECT image, i, j, round(sum(2 * sqrt(a * b) / (a + b)), 6) AS texture FROM t WHERE i BETWEEN 0 AND 30 AND j BETWEEN 0 AND 49 GROUP BY 1, 2, 3""")
def field_texture(spark: SparkSession, d: str) -> DataFrame:
    """Texture of the images over shifts of up to three cells."""
    return rounded(I.texture(images(spark, d)), "texture")


_CURVE = """RECURSIVE curve(side, d, x, y) AS (SELECT 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT 2 * side, q * side * side + d, CASE q WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN x + side ELSE 2 * side - 1 - y END, CASE q WHEN 0 THEN x WHEN 1 THEN y + side WHEN 2 THEN y + side ELSE side - 1 - x END FROM curve, (SELECT unnest([0, 1, 2, 3])::BIGINT AS q) WHERE side < 64),
 cells AS (SELECT d, x, y FROM curve WHERE side = 64)"""


@query(f"""WITH {_CURVE}, p AS (SELECT p_partkey, p_size::BIGINT AS x, CAST(substr(p_brand, 7) AS BIGINT) AS y FROM part), l AS (SELECT list(d ORDER BY x, y) AS l FROM cells)
SELECT p_partkey, l[64 * x + y + 1] AS place, x, y, list_transform([[0, 0], [0, 1], [1, 1], [1, 0], [1, -1], [0, -1], [-1, -1], [-1, 0], [-1, 1]], lambda s: l[64 * ((x + s[1] + 64) % 64) + (y + s[2] + 64) % 64 + 1]) AS around,
 list_transform([[0, 0], [-1, 0], [1, 0], [0, -1], [0, 1]], lambda s: l[64 * least(63, greatest(0, x + s[1])) + least(63, greatest(0, y + s[2])) + 1]) AS beside FROM p, l""")
def hilbert_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts' places along Hilbert's curve by size and brand, the way back, and the places around and beside them."""
    parts = D.read(spark, d, "part").select("p_partkey", "p_size", F.substring("p_brand", 7, 10).cast("long").alias("brand"))
    # The curve is followed once for each size and brand, not for each part.
    x = parts.select(F.col("p_size").alias("_size"), F.col("brand").alias("_brand")).distinct().withColumn("place", N.hilbert_place(64, F.col("_size"), F.col("_brand")))
    at = N.hilbert_point(64, F.col("place"))
    cells = x.select("_size", "_brand", "place", at["x"].alias("x"), at["y"].alias("y"), N.hilbert_neighbours(64, F.col("place")).alias("around"), N.hilbert_neighbours(64, F.col("place"), N.BESIDE, False).alias("beside"))
    found = parts.join(cells, F.col("p_size").eqNullSafe(F.col("_size")) & F.col("brand").eqNullSafe(F.col("_brand")))
    return found.select("p_partkey", "place", "x", "y", "around", "beside")


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, p, unnest(range(1, len(p) + 1)) AS a FROM a), t AS (SELECT l_orderkey, p, a, unnest(range(a, len(p) + 1)) AS b FROM s)
SELECT l_orderkey, array_to_string(p[a:b], ' ') AS parts FROM t""")
def order_sub_arrays(spark: SparkSession, d: str) -> DataFrame:
    """All runs of parts in every order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    x = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("p"))
    return x.select("l_orderkey", F.explode(L.sub_arrays(F.col("p"))).alias("a")).select("l_orderkey", F.array_join("a", " ").alias("parts"))


@query("""WITH a AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS p FROM nation GROUP BY 1), k AS (SELECT n_regionkey, p, unnest(range(0, len(p) // 2)) AS k FROM a),
 o AS (SELECT x.n_regionkey, x.n_name || ' ' || y.n_name || ' ' || z.n_name AS names FROM nation x JOIN nation y USING (n_regionkey) JOIN nation z USING (n_regionkey) WHERE x.n_name <> y.n_name AND x.n_name <> z.n_name AND y.n_name <> z.n_name)
SELECT n_regionkey::BIGINT AS n_regionkey, 'order' AS kind, names FROM o UNION ALL SELECT n_regionkey, 'chunk', p[2 * k + 1] || ' ' || p[2 * k + 2] FROM k
 UNION ALL SELECT n_regionkey, 'without', array_to_string(p[2:2] || p[4:], ' ') FROM a""")
def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    """Regions' nations in all orders of three, in pairs, and without the first and third."""
    x = D.read(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("p"))
    names = lambda kind, lists: x.select("n_regionkey", F.lit(kind).alias("kind"), F.explode(lists).alias("a")).select("n_regionkey", "kind", F.array_join("a", " ").alias("names"))
    return names("order", L.permutations(F.col("p"), 3)).unionByName(names("chunk", L.chunks(F.col("p"), 2))).unionByName(names("without", F.array(L.without_places(F.col("p"), [0, 2]))))


@query("WITH f AS (SELECT o_orderpriority AS label, min(o_orderkey) AS f FROM orders GROUP BY 1), n AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS number FROM f) SELECT o_orderkey, number FROM orders JOIN n ON label = o_orderpriority")
def labels_by_first(spark: SparkSession, d: str) -> DataFrame:
    """Orders' priorities numbered as they first appear."""
    return L.renamed_by_first(D.read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").drop("o_orderpriority")


@query("""WITH s AS (SELECT p_partkey, p_name, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring'])) AS s FROM part)
SELECT 'words' AS by, (SELECT p_partkey FROM s ORDER BY s DESC, p_partkey DESC LIMIT 1) AS position UNION ALL SELECT 'text', (SELECT min(p_partkey) FROM part WHERE contains(p_name, 'widget'))""")
def located_part(spark: SparkSession, d: str) -> DataFrame:
    """The part that shares most words with a text, and the first that holds one."""
    p = D.read(spark, d, "part")
    one = lambda by, exact: L.located(p, "p_partkey", "p_name", "red ring", exact).select(F.lit(by).alias("by"), "position")
    return one("words", "no such part").unionByName(one("text", "widget"))


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def long_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts' numbers in long form."""
    return L.long_form(D.read(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT p_brand, " + ", ".join(f"count(CASE WHEN p_size % 3 = {k} THEN 1 END) AS \"{k}\"" for k in range(3)) + " FROM part GROUP BY 1")
def brand_cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Brands against sizes modulo three."""
    return L.cross_table(D.read(spark, d, "part").select("p_brand", (F.col("p_size") % 3).alias("k")), "p_brand", "k", [0, 1, 2])


@query("""SELECT 'both' AS kind, p_size::BIGINT AS p_size, p_brand FROM (SELECT p_size, p_brand FROM part WHERE p_type = 'ECONOMY' INTERSECT SELECT p_size, p_brand FROM part WHERE p_type = 'STANDARD')
 UNION ALL SELECT 'one', p_size, p_brand FROM (SELECT p_size, p_brand FROM part WHERE p_type = 'ECONOMY' EXCEPT SELECT p_size, p_brand FROM part WHERE p_type = 'STANDARD')""")
def shared_and_own(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and brands that two types share, and those of one alone."""
    of = lambda t: D.read(spark, d, "part").where(F.col("p_type") == t).select(F.col("p_size").cast("long").alias("p_size"), "p_brand")
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "p_size", "p_brand")
    return named("both", of("ECONOMY").intersect(of("STANDARD"))).unionByName(named("one", of("ECONOMY").subtract(of("STANDARD"))))


@query(f"""WITH {DAILY}, n AS (SELECT series_id, count(*) AS n FROM daily GROUP BY 1)
SELECT a.series_id, a.pos, round(coalesce(sum((b.value - a.value) / nullif(b.value + a.value, 0)), 0) / min(n), 6) AS contrast FROM daily a JOIN n USING (series_id) LEFT JOIN daily b ON a.series_id = b.series_id AND b.pos > a.pos GROUP BY 1, 2""")
def lag_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Daily means against all later ones."""
    return rounded(S.lag_contrasts(D.daily(spark, d)), "contrast")


@query(f"WITH {ANALYTE} SELECT feature, round(exp(avg(ln(value))) / avg(value), 6) AS flatness, round(1 - exp(avg(ln(value))) / avg(value), 6) AS contrast FROM analyte GROUP BY 1")
def revenue_flatness(spark: SparkSession, d: str) -> DataFrame:
    """How evenly brands' revenue lies over nations."""
    x = D.analytes(spark, d).groupBy("feature").agg(N.flatness(F.col("value")).alias("flatness"))
    return rounded(x.withColumn("contrast", 1 - F.col("flatness")), "flatness", "contrast")


@query("""WITH r AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS r FROM part) SELECT p_partkey, round(r * r * r * r * 4 - 3 * r * r, 6) AS whole, round(4 * r * r * r * r, 6) AS part, round(1 - 6 * r * r + 6 * r * r * r * r, 6) AS round FROM r""")
def radial_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Radial polynomials of parts' sizes."""
    r = F.col("p_size") / 50.0
    x = D.read(spark, d, "part").select("p_partkey", N.radial_polynomial(r, 4, 2).alias("whole"), N.radial_polynomial(r, 4, 2, False).alias("part"), N.radial_polynomial(r, 4, 0).alias("round"))
    return rounded(x, "whole", "part", "round")


@query(f"WITH {ANALYTE}, b AS (SELECT feature, sample, ({average_rank('value', 'sample')} - 0.5) / count(*) OVER (PARTITION BY sample) AS b FROM analyte) SELECT feature, sample::BIGINT AS sample, round(log2(b / (1 - b)), 6) AS m FROM b")
def spectral_order(spark: SparkSession, d: str) -> DataFrame:
    """Brands' fractional ranks in every nation, on the scale of log odds."""
    x = D.analytes(spark, d)
    n = F.count("*").over(N.over_all("sample"))
    return rounded(x.select("feature", "sample", N.beta_to_m((N.average_rank("value", "sample") - 0.5) / n).alias("m")), "m")


_POWER = f"{DAILY}, power AS (SELECT a.series_id AS i, b.series_id AS j, sum(a.value * b.value) * (SELECT count(DISTINCT pos) FROM daily) AS power FROM daily a JOIN daily b USING (pos) GROUP BY 1, 2)"


@query(f"""WITH {_POWER}, f AS (SELECT (abs(quantile_cont(power, 0.01)) + abs(quantile_cont(power, 0.99))) / 2 AS f FROM power WHERE i = (SELECT min(i) FROM power)), b AS (SELECT i, j, power, pow(2, power / f) AS b FROM power, f)
SELECT i, j, round(power, 4) AS power, round(2 * b / (b + 1) - 1, 6) AS resonance FROM b""")
def event_resonances(spark: SparkSession, d: str) -> DataFrame:
    """Cross power of daily series of event types, and their resonances."""
    return rounded(rounded(P.resonances(P.cross_power(D.daily(spark, d), "series_id", "pos", "value")), "resonance"), "power", places=4)


@query(f"""WITH {PAIRS}, n AS (SELECT round_even(count(*) * 0.1, 0) + 1 AS l FROM points), c AS (SELECT round(d, 6) AS d, la = lb AS same FROM pairs), b AS (SELECT floor({average_rank('d')} / l)::BIGINT AS bin, same FROM c, n)
SELECT bin, count(CASE WHEN same THEN 1 END) AS n_in, count(CASE WHEN NOT same THEN 1 END) AS n_out FROM b GROUP BY 1 UNION ALL SELECT 0, 0, 0 WHERE NOT EXISTS (SELECT 1 FROM b WHERE bin = 0)""")
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of embeddings within and between labels by rank of their distance."""
    points = D.points(spark, d)
    return Q.ranked_counts(T.rounded_counts(points, "label"), points.select("item", "label"))


@query(f"""WITH {PAIRS}, {BOTH}, n AS (SELECT round_even(count(*) * 0.1, 0) + 1 AS l FROM points), a AS (SELECT i, round(d, 6) AS d, la = lb AS same FROM both_ways UNION ALL SELECT item, 0, TRUE FROM points),
 b AS (SELECT i AS item, floor({average_rank('d', 'i')} / l) AS bin, same FROM a, n), h AS (SELECT item, bin, count(CASE WHEN same THEN 1 END)::DOUBLE AS n_in, count(CASE WHEN NOT same THEN 1 END)::DOUBLE AS n_out FROM b GROUP BY 1, 2),
 u AS (SELECT *, sum(n_out) OVER (PARTITION BY item ORDER BY bin DESC) - n_out AS above FROM h)
SELECT item, round(sum(n_in * above + 0.5 * n_in * n_out) / (sum(n_in) * sum(n_out)), 6) AS auc FROM u GROUP BY 1""")
def immersiveness(spark: SparkSession, d: str) -> DataFrame:
    """How well distance from each embedding tells its label."""
    x = Q.immersiveness_of_points(D.points(spark, d))
    return rounded(x.select("item", "auc"), "auc")


def plane(spark: SparkSession, d: str) -> DataFrame:
    """item, x, y: the first two places of embeddings."""
    return D.points(spark, d).select("item", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("""WITH p AS (SELECT vec_id AS item, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), t AS (SELECT item, x, y, x * cos(0.3) - y * sin(0.3) AS u, x * sin(0.3) + y * cos(0.3) AS v FROM p),
 f AS (SELECT *, round(atan2(u, v) / pi() / 2 * 6) AS f FROM t), l AS (SELECT item, x, y, CASE WHEN abs(f) < sqrt(6) THEN f ELSE abs(f) END AS l, sqrt(x * x + y * y) > 0.1 AS o FROM f),
 s AS (SELECT item, x, y, (l - min(l) OVER () + CASE WHEN o THEN (SELECT count(DISTINCT l) FROM l) ELSE 0 END)::BIGINT AS label FROM l),
 c AS (SELECT round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d, a.label = b.label AS same FROM s a JOIN s b ON a.item < b.item), n AS (SELECT round_even(count(*) * 0.9, 0) + 1 AS l FROM p),
 r AS (SELECT floor((rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0) / l) AS bin, same FROM c, n), h AS (SELECT bin, count(CASE WHEN same THEN 1 END) AS n_in, count(CASE WHEN NOT same THEN 1 END) AS n_out FROM r GROUP BY 1),
 g AS (SELECT bin, sum(n_in) OVER (ORDER BY bin) / sum(n_in) OVER () AS t, sum(n_out) OVER (ORDER BY bin) / sum(n_out) OVER () AS f FROM h), k AS (SELECT (f - lag(f) OVER (ORDER BY bin)) * (t + lag(t) OVER (ORDER BY bin)) / 2 AS area FROM g)
SELECT label, count(*) AS n, (SELECT round(sum(area), 6) FROM k) AS auc FROM s GROUP BY 1""")
def segment_auc(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings in the plane by angle and radius, and how well distance tells the segments."""
    p = plane(spark, d)
    labels = A.settled(Q.segments(p, 0.1, 0.3, 6))
    points = p.select("item", F.array("x", "y").alias("vec")).join(labels, "item")
    auc = rounded(Q.curve_auc(Q.ranked_counts(T.rounded_counts(points, "label"), labels, 0.9)), "auc")
    return labels.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(auc))  # one row


@query(f"""WITH {ANALYTE}, t AS (SELECT feature, sample, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, sample DESC) AS k FROM analyte)
SELECT feature, round(sum(value * (sample % 5)) / sum(value), 6) AS x, round(sum(value * (sample // 5)) / sum(value), 6) AS y FROM t WHERE k <= 4 GROUP BY 1""")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Where brands lie among their four strongest nations, nations being laid out in rows of five."""
    at = D.journal(spark, d).select(F.col("sample").alias("item"), F.array((F.col("sample") % 5).cast("double"), F.floor(F.col("sample") / 5).cast("double")).alias("vec"))
    x = K.weighted_centroids(D.analytes(spark, d).select(F.col("feature").alias("row"), F.col("sample").alias("item"), "value"), at, 4)
    return rounded(x.select(F.col("row").alias("feature"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "x", "y")


@query(f"""WITH RECURSIVE {EDGES}, w(id, path) AS (SELECT 'ALL', ['ALL'] UNION ALL SELECT child, list_append(path, child) FROM w JOIN edges ON parent = id), n AS (SELECT p_type || '|' || p_brand AS id FROM part GROUP BY 1 HAVING avg(p_size) > 26 UNION ALL SELECT p_type FROM part GROUP BY 1 HAVING avg(p_size) > 25)
SELECT id, row_number() OVER (ORDER BY path) AS place FROM w JOIN n USING (id)""")
def located_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of large parts, as a walk down the hierarchy meets them."""
    p = D.read(spark, d, "part")
    large = lambda g, least: p.groupBy(g.alias("id")).agg(F.avg("p_size").alias("s")).where(F.col("s") > least).select("id")
    return A.located(D.group_edges(spark, d), large(F.concat_ws("|", "p_type", "p_brand"), 26).unionByName(large(F.col("p_type"), 25)))


@query("""WITH m AS (SELECT DISTINCT p_size::VARCHAR AS gid, p_brand AS member FROM part UNION SELECT DISTINCT 'ALL', p_brand FROM part), n AS (SELECT count(DISTINCT member) AS n FROM m), z AS (SELECT gid, count(*) AS z FROM m GROUP BY 1),
 o AS (SELECT avg(c) AS o FROM (SELECT member, 1 / (1.0 + count(*)) AS c FROM m GROUP BY 1)), w AS (SELECT count(*) AS w FROM z, n WHERE z = n),
 s AS (SELECT a.member AS i, b.member AS j, count(*) AS s FROM m a JOIN m b ON a.gid = b.gid AND a.member < b.member JOIN z ON z.gid = a.gid, n WHERE z < n GROUP BY 1, 2)
SELECT i, j, round(abs(1 / (1.0 + w + s) - o), 6) AS d FROM s, w, o UNION ALL SELECT NULL, NULL, round(abs(1 / (1.0 + w) - o), 6) FROM w, o""")
def comembership(spark: SparkSession, d: str) -> DataFrame:
    """Distances of brands by the sizes they come in; the row without names is that of brands that share none."""
    p = D.read(spark, d, "part")
    m = p.select(F.col("p_size").cast("string").alias("gid"), F.col("p_brand").alias("member")).unionByName(p.select(F.lit("ALL").alias("gid"), F.col("p_brand").alias("member")))
    near, rest = A.comembership_distance(m)
    return rounded(near.unionByName(rest, allowMissingColumns=True), "d")


@query(f"WITH {EDGES} SELECT parent, child FROM edges")
def edges_back(spark: SparkSession, d: str) -> DataFrame:
    """The edges of part groups, from their adjacency matrix."""
    return A.edges_of(A.adjacency(D.group_edges(spark, d), ("descendants",)))


_LEVELS = f"{CLOSURE}, ids AS (SELECT parent AS id FROM edges UNION SELECT child FROM edges), level AS (SELECT id, count(ancestor) AS level FROM ids LEFT JOIN closure ON descendant = id GROUP BY 1)"


@query(f"""WITH {_LEVELS}, g AS (SELECT p_type || '|' || p_brand AS id, p_type AS description, max(p_size) AS metric, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY 1, 2), up AS (SELECT child AS id, string_agg(parent, ':' ORDER BY parent) AS up FROM edges GROUP BY 1)
SELECT id || chr(9) || coalesce(up, '') || ':' || coalesce(description, '') || ':' || level || ':' || coalesce(metric::VARCHAR, '') || coalesce(chr(9) || array_to_string(members, chr(9)), '') AS line FROM level LEFT JOIN g USING (id) LEFT JOIN up USING (id)""")
def node_gmt(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the part hierarchy as lines of a group file."""
    p = D.read(spark, d, "part")
    groups = p.groupBy(F.concat_ws("|", "p_type", "p_brand").alias("id"), F.col("p_type").alias("description")).agg(F.max("p_size").alias("metric"), F.sort_array(F.collect_list("p_partkey")).cast("array<string>").alias("members"))
    edges = D.group_edges(spark, d)
    return files.node_gmt_lines(edges, groups, A.levels(edges))


@query(f"""WITH {_LEVELS}, m AS (SELECT p_type AS id, max(p_size) AS metric FROM part GROUP BY 1) SELECT format('["cluster":{{}}, "metric":{{:.6f}}]', id, coalesce(metric, level)::DOUBLE) AS line FROM level LEFT JOIN m USING (id)""")
def linkage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the part hierarchy with their metric or level."""
    metrics = D.read(spark, d, "part").groupBy(F.col("p_type").alias("id")).agg(F.max("p_size").alias("metric"))
    return files.linkage_lines(A.levels(D.group_edges(spark, d)), metrics)


def regression(spark: SparkSession, d: str):
    """Partial least squares of brands' revenue on regions, and how brands and nations lie to regions."""
    design = D.journal(spark, d).select("sample", F.col("region").alias("term"), F.lit(1.0).alias("x"))
    return X.alignment(*X.partial_least_squares(D.analytes(spark, d), design), axes=[("ASIA", "EUROPE")])


@query()
def pls_features(spark: SparkSession, d: str) -> DataFrame:
    """Brands in the plane of two components."""
    x = regression(spark, d)[0]
    return rounded(x, *[c for c in x.columns if c not in ("feature", "owner")])


@query()
def pls_projections(spark: SparkSession, d: str) -> DataFrame:
    """Brands along the directions of regions."""
    return rounded(regression(spark, d)[1].select("feature", "term", "r", "p", "rho"), "r", "p", "rho")


@query()
def pls_samples(spark: SparkSession, d: str) -> DataFrame:
    """Nations in the plane of two components."""
    return rounded(regression(spark, d)[2], "c0", "c1")
