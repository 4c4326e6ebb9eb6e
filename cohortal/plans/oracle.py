"""Pieces of DuckDB SQL that several queries share."""

ANALYTE = """analyte AS (SELECT p_brand AS feature, c_nationkey AS sample, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
JOURNAL = "journal AS (SELECT n_nationkey AS sample, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
LABELLED = f"{ANALYTE}, {JOURNAL}, labelled AS (SELECT feature, sample, value, region FROM analyte JOIN journal USING (sample))"
EDGES = """edges AS (SELECT DISTINCT 'ALL' AS parent, p_type AS child FROM part UNION SELECT DISTINCT p_type, p_type || '|' || p_brand FROM part)"""
CLOSURE = f"""RECURSIVE {EDGES}, walk(ancestor, descendant, depth) AS (SELECT parent, child, 1 FROM edges
  UNION ALL SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edges e ON w.descendant = e.parent),
 closure AS (SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY 1, 2)"""
MEMBERS = """membership AS (SELECT 'ALL' AS gid, p_partkey AS member FROM part UNION SELECT p_type, p_partkey FROM part UNION SELECT p_type || '|' || p_brand, p_partkey FROM part)"""
MARKED = "marked AS (SELECT l_partkey AS member, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > 0.4 AS hit FROM lineitem GROUP BY 1)"
POINTS = "points AS (SELECT vec_id AS item, embedding AS vec, label FROM embeddings)"
PAIRS = f"""{POINTS}, pairs AS (SELECT a.item AS i, b.item AS j, a.label AS la, b.label AS lb,
  sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM points a JOIN points b ON a.item < b.item)"""
BOTH = "both_ways AS (SELECT i, j, la, lb, d FROM pairs UNION ALL SELECT j, i, lb, la, d FROM pairs)"
DAILY = """daily AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos, round(value, 9) AS value
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2))"""


def upper_tail(z: str) -> str:
    """The upper normal tail, as an integral of the density by Simpson's rule over ten units beyond |z|."""
    at = f"(abs({z}) + k * 0.005)"
    weight = "(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    beyond = f"(0.005 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda k: {weight} * exp(-0.5 * {at} * {at}))))"
    return f"(CASE WHEN {z} >= 0 THEN {beyond} ELSE 1 - {beyond} END)"


def beta(x: str, a: str, b: str) -> str:
    """The regularized incomplete beta function, as an integral over the log odds by Simpson's rule on the side of its mean where x lies."""

    def side(x: str, a: str, b: str) -> str:
        far = f"(10 * sqrt(1.0 / ({a}) + 1.0 / ({b})) + 40.0 / ({a}))"
        y = f"(ln(({x}) / (1 - ({x}))) - {far} * (1 - k / 4000.0))"
        log = f"(-({a}) * ln(1 + exp(-{y})) - ({b}) * ({y} + ln(1 + exp(-{y}))))"
        weight = "(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
        term = f"{weight} * exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}) + {log})"
        return f"(CASE WHEN {x} <= 0 THEN 0 ELSE {far} / 12000 * list_sum(list_transform(range(0, 4001), lambda k: {term})) END)"

    return f"(CASE WHEN {x} > ({a}) / (({a}) + ({b})) THEN 1 - {side(f'(1 - {x})', b, a)} ELSE {side(x, a, b)} END)"


def log_choose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


def fisher(a: str, b: str, c: str, d: str) -> str:
    n, row, col = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({a} + {c})"
    lp = lambda k: f"({log_choose(col, k)} + {log_choose(f'{n} - {col}', f'{row} - {k}')} - {log_choose(n, row)})"
    return f"least(1.0, list_sum(list_transform(range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1), lambda k: CASE WHEN {lp('k')} <= {lp(a)} + ln(1 + 1e-7) THEN exp({lp('k')}) ELSE 0 END)))"


def hypergeometric(a: str, b: str, c: str, d: str) -> str:
    n, row, col = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({a} + {c})"
    lp = lambda k: f"({log_choose(col, k)} + {log_choose(f'{n} - {col}', f'{row} - {k}')} - {log_choose(n, row)})"
    return f"least(1.0, list_sum(list_transform(range({a}, least({row}, {col}) + 1), lambda k: exp({lp('k')}))))"



def average_rank(v: str, by: str = "") -> str:
    head, part = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"(rank() OVER ({head}ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}{v}) - 1) / 2.0)"
