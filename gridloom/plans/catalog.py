"""Every operator as a query over the driver's tables, with its DuckDB equivalent where SQL has one.

Vectors come from ``embeddings``: unit vectors in 64 dimensions, of which queries take the first 24
times 8, or the first 8 times 4, so that they lie between lattice points. Results are long and rounded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions import bits, golden, hyperbolic as hyp, vec
from gridloom.operators import bytestats, codec, consolidate, e8, entropy, golay, hadamard, horizon, leech, recall, sniff, trajectory
from gridloom.session import Scratch, shuffle_width
from gridloom.streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str, n: int = 24, scale: float = 8.0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.vector("embedding", n, scale).alias("v"), "label")


def neighbours(spark: SparkSession, sf_dir: str, n: int, scale: float) -> DataFrame:
    """Each vector with that of the next id: id, a, b."""
    left = vectors(spark, sf_dir, n, scale).select("id", F.col("v").alias("a"))
    right = vectors(spark, sf_dir, n, scale).select((F.col("id") - 1).alias("id"), F.col("v").alias("b"))
    return left.join(right, "id")


def long(df: DataFrame, *keys: str, column: str = "v", digits: int = 6) -> DataFrame:
    """keys, pos, value."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).select(*keys, F.col("pos").cast("long").alias("pos"), r6(F.col("value"), digits).alias("value"))


def sql_vectors(n: int = 24, scale: float = 8.0, name: str = "v") -> str:
    return f"SELECT vec_id AS id, list_transform(embedding[1:{n}], lambda x: x::DOUBLE * {scale!r}::DOUBLE) AS {name}, label FROM embeddings"


def sql_pairs(n: int, scale: float) -> str:
    v = sql_vectors(n, scale)
    return f"WITH v AS ({v}), p AS (SELECT a.id, a.v AS a, b.v AS b FROM v a JOIN v b ON b.id = a.id + 1)"


R6 = "round({}, 6) + 0.0"
DOT = "list_inner_product({}, {})"
D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def lit(xs: list[float]) -> str:
    return "[" + ", ".join(f"{x:.17e}" for x in xs) + "]::DOUBLE[]"


# --- recall ---------------------------------------------------------------------------------------

ASKED = "id % 100 = 0"  # the queries: every hundredth row, against all rows


@query(f"""WITH v AS ({sql_vectors()}), q AS (SELECT id AS qid, v AS q FROM v WHERE id % 100 = 0),
d AS (SELECT qid, id AS rid, {D2.format('q', 'v')} AS d2 FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rank FROM d)
SELECT qid, rank, rid, {R6.format('d2')} AS d2 FROM r WHERE rank <= 10""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return recall.exact(rows, rows.where(ASKED), 10).withColumn("d2", r6(F.col("d2")))


@query(f"""WITH v AS ({sql_vectors(64, 1.0)}), q AS (SELECT id AS qid, v AS q FROM v WHERE id % 100 = 0),
d AS (SELECT qid, id AS rid, 1 - {DOT.format('q', 'v')} / (sqrt({DOT.format('q', 'q')}) * sqrt({DOT.format('v', 'v')})) AS d2 FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 12), rid) AS rank FROM d)
SELECT qid, rank, rid, {R6.format('d2')} AS distance FROM r WHERE rank <= 10""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir, 64, 1.0)
    return recall.exact(rows, rows.where(ASKED), 10, "cosine").select("qid", "rank", "rid", r6(F.col("d2")).alias("distance"))


RADIUS = 6.0  # just over the mean distance of these rows' tenth neighbour, 4.7 to 5.3


def _projection_sql(radius: float = RADIUS, votes: int = 2) -> str:
    low = ", ".join(f"({p}, {', '.join(DOT.format('v', lit(m[:, j].tolist())) for j in range(3))})" for p, m in enumerate(recall.projections()))
    return f"""WITH v AS ({sql_vectors()}),
low AS (SELECT id, u[1] AS p, u[2] AS x, u[3] AS y, u[4] AS z FROM (SELECT id, unnest([{", ".join("[" + s[1:-1] + "]" for s in low.replace("), (", ")|(").split("|"))}]) AS u FROM v)),
c AS (SELECT a.id AS qid, b.id AS rid FROM low a JOIN low b ON a.p = b.p
  WHERE a.id % 100 = 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {radius * radius!r}
  GROUP BY 1, 2 HAVING count(*) >= {votes}),
d AS (SELECT qid, rid, {D2.format('q.v', 'r.v')} AS d2 FROM c JOIN v q ON q.id = qid JOIN v r ON r.id = rid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rank FROM d)
"""


@query(_projection_sql() + f"SELECT qid, rank, rid, {R6.format('d2')} AS d2 FROM r WHERE rank <= 10")
def recall_projection_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return recall.by_projection(rows, rows.where(ASKED), 10, radius=RADIUS).withColumn("d2", r6(F.col("d2")))


@query(_projection_sql() + f""", got AS (SELECT qid, rid FROM r WHERE rank <= 10),
e AS (SELECT q.id AS qid, v.id AS rid, row_number() OVER (PARTITION BY q.id ORDER BY {D2.format('q.v', 'v.v')}, v.id) AS rank FROM v q, v WHERE q.id % 100 = 0),
t AS (SELECT qid, rid FROM e WHERE rank <= 10)
SELECT count(got.rid) AS hits, count(*) AS truth, round(count(got.rid)::DOUBLE / count(*), 6) AS recall FROM t LEFT JOIN got USING (qid, rid)""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.where(ASKED)
    return recall.recall_at(recall.by_projection(rows, asked, 10, radius=RADIUS), recall.exact(rows, asked, 10)).withColumn("recall", r6(F.col("recall")))


@query(_projection_sql(0.5, 4) + f""", w AS (SELECT id AS qid, unnest(range(1, 11)) AS rank FROM v WHERE id % 100 = 0)
SELECT w.qid, w.rank, coalesce(r.rid, -1)::BIGINT AS rid, coalesce({R6.format('r.d2')}, 'infinity'::DOUBLE) AS d2 FROM w LEFT JOIN r ON r.qid = w.qid AND r.rank = w.rank""")
def recall_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.where(ASKED)
    return recall.padded(recall.by_projection(rows, asked, 10, votes=4, radius=0.5), asked, 10).withColumn("d2", r6(F.col("d2")))


# --- vector functions -----------------------------------------------------------------------------

@query(f"""WITH v AS ({sql_vectors()}), n AS (SELECT *, sqrt({DOT.format('v', 'v')}) AS n FROM v)
SELECT id, {R6.format('n')} AS norm, {R6.format('list_sum(v)')} AS total, {R6.format("v[1] / n")} AS unit_first, {R6.format("v[1] / n * 2")} AS sphere_first,
{R6.format("CASE WHEN n > 3 THEN v[1] / n * 3 ELSE v[1] END")} AS ball_first, {R6.format("list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / 24")} AS variance FROM n""")
def vec_norms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return vectors(spark, sf_dir).select(
        "id", r6(vec.norm(v)).alias("norm"), r6(vec.total(v)).alias("total"), r6(vec.normalize(v)[0]).alias("unit_first"), r6(vec.project_to_sphere(v, 2.0)[0]).alias("sphere_first"),
        r6(vec.project_to_ball(v, 3.0)[0]).alias("ball_first"), r6(vec.variance(v)).alias("variance"),
    )


@query(sql_pairs(24, 8.0) + f""", c AS (SELECT *, {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')})) AS c FROM p)
SELECT id, {R6.format('c')} AS cosine, {R6.format('acos(greatest(-1, least(1, c)))')} AS angle, {R6.format('sqrt(' + D2.format('a', 'b') + ')')} AS distance FROM c""")
def angular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf_dir, 24, 8.0).select("id", r6(vec.cosine(a, b)).alias("cosine"), r6(vec.angle(a, b)).alias("angle"), r6(F.sqrt(vec.distance2(a, b))).alias("distance"))


@query(sql_pairs(8, 4.0) + f""", u AS (SELECT *, sqrt({DOT.format('a', 'a')}) AS na, sqrt({DOT.format('b', 'b')}) AS nb FROM p),
w AS (SELECT *, acos({DOT.format('a', 'b')} / (na * nb)) AS w FROM u)
SELECT id, (k - 1)::BIGINT AS pos, {R6.format('0.75 * a[k] + 0.25 * b[k]')} AS lerp, {R6.format('(sin(0.75 * w) * a[k] / na + sin(0.25 * w) * b[k] / nb) / sin(w)')} AS slerp
FROM w, range(1, 9) t(k)""")
def lerp_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    both = neighbours(spark, sf_dir, 8, 4.0).select("id", F.arrays_zip(vec.lerp(a, b, 0.25).alias("l"), vec.slerp(a, b, 0.25).alias("s")).alias("z"))
    return both.select("id", F.posexplode("z").alias("pos", "e")).select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("e.l")).alias("lerp"), r6(F.col("e.s")).alias("slerp"))


@query(f"""WITH v AS ({sql_vectors()}), s AS (SELECT id, v, list_sum(list_transform(v, lambda x: abs(x))) AS s FROM v)
SELECT id, {R6.format("list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / s) * log2(abs(x) / s) END))")} AS entropy FROM s""")
def vec_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", r6(vec.entropy_bits(F.col("v"))).alias("entropy"))


@query(f"""WITH v AS ({sql_vectors()})
SELECT id, {R6.format(f"sqrt({DOT.format('v', 'v')}) / (list_max(list_transform(v, lambda x: abs(x))) + 1e-10) / sqrt(24.0::DOUBLE)")} AS incoherence FROM v""")
def incoherence_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", r6(vec.incoherence(F.col("v"))).alias("incoherence"))


@query(f"""WITH v AS ({sql_vectors(8, 4.0)})
SELECT id, i AS pos, {R6.format("list_sum(list_transform(v, lambda x, j: CASE WHEN bit_count((i & (j - 1))::BIGINT) % 2 = 0 THEN x ELSE -x END)) / sqrt(8.0::DOUBLE)")} AS value FROM v, range(0, 8) t(i)""")
def hadamard8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir, 8, 4.0).select("id", vec.hadamard(F.col("v"), 8).alias("v")), "id")


@query(f"""WITH v AS ({sql_vectors(16, 4.0)}) SELECT id, (k - 1)::BIGINT AS pos, {R6.format('v[k]')} AS value FROM v, range(1, 17) t(k)""")
def hadamard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = hadamard.transform(vectors(spark, sf_dir, 16, 4.0).select("id", "v"))
    return long(hadamard.transform(turned, inverse=True), "id")


# --- golden ratio -----------------------------------------------------------------------------------

@query(sql_pairs(8, 4.0) + f""", d AS (SELECT id, sqrt({D2.format('a', 'b')}) AS d, sqrt(list_sum(list_transform(list_zip(a, b, {lit(golden.fibonacci(8))}), lambda z: (z[1] - z[2]) * (z[1] - z[2]) * z[3] / 54))) AS w FROM p)
SELECT id, {R6.format('w')} AS weighted, {R6.format(f'pow({golden.PHI!r}::DOUBLE, -d)')} AS phi_weight, {R6.format(f'1 - pow({golden.PHI!r}::DOUBLE, -d)')} AS inverse_weight FROM d""")
def phi_weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt(vec.distance2(F.col("a"), F.col("b")))
    return neighbours(spark, sf_dir, 8, 4.0).select(
        "id", r6(golden.weighted_distance(F.col("a"), F.col("b"), 8)).alias("weighted"), r6(golden.phi_weight(d)).alias("phi_weight"), r6(golden.inverse_phi_weight(d)).alias("inverse_weight")
    )


@query(f"""WITH e AS (SELECT event_id, value, list_transform({lit(golden.fibonacci(15))}, lambda f: abs(abs(value) - f)) AS off FROM events)
SELECT event_id, list_position(off, list_min(off)) - 1 AS level, {R6.format(f"value - CASE WHEN value < 0 THEN -1 ELSE 1 END * list_extract({lit(golden.fibonacci(15))}, list_position(off, list_min(off)))")} AS residual FROM e""")
def fibonacci_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", golden.fibonacci_level(x).alias("level"), r6(golden.fibonacci_residual(x)).alias("residual"))


@query(f"""SELECT event_id, {R6.format(f"1 + 0.02::DOUBLE * cos({2 * 3.141592653589793 / 0.48121182505960347!r}::DOUBLE * ln(greatest(abs(value), 1e-12::DOUBLE) / 0.05::DOUBLE))", )} AS weight,
floor((abs(value) / (1 + abs(value))) * {golden.PHI!r}::DOUBLE)::INTEGER % 256 AS sector FROM events""")
def golden_log_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.abs(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", r6(golden.log_periodic(x)).alias("weight"), golden.golden_angle_sector(x / (1 + x)).alias("sector"))


@query(f"""SELECT event_id, {R6.format('value')} AS value FROM events""")
def fibonacci_greedy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), golden.greedy_fibonacci(F.col("value"), 19).alias("g"))
    back = golden.greedy_value(F.col("g.indices"), F.abs(F.col("g.residual"))) * F.when(F.col("x") < 0, -1.0).otherwise(1.0)
    return coded.select("event_id", r6(back).alias("value"))


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), d AS (SELECT sqrt({D2.format('a.v', 'b.v')}) AS d FROM v a JOIN v b ON a.id < b.id)
SELECT {R6.format(f'sum(CASE WHEN d >= 1e-10 THEN pow({golden.PHI!r}::DOUBLE, -d) / (d * d) END)').replace('6)', '4)')} AS total_energy, count(*) AS pairs, {R6.format('min(d) FILTER (d >= 1e-10)')} AS min_distance, {R6.format('max(d)')} AS max_distance FROM d""")
def packing_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horizon.packing_energy(vectors(spark, sf_dir, 8, 4.0))
    return out.select(r6(F.col("total_energy"), 4).alias("total_energy"), "pairs", r6(F.col("min_distance")).alias("min_distance"), r6(F.col("max_distance")).alias("max_distance"))


_FORCE = f"pow({golden.PHI!r}::DOUBLE, -d) / (d * d) * (ln({golden.PHI!r}::DOUBLE) + 2 / d) / d"


@query(f"""WITH RECURSIVE v AS ({sql_vectors(8, 4.0)}), s AS (SELECT label, 0 AS n, list(id ORDER BY id) AS ids, list(v ORDER BY id) AS x FROM v GROUP BY label
UNION ALL SELECT label, n + 1, ids, list_transform(x, lambda p, i: list_transform(p, lambda y, k: y + 0.01::DOUBLE * (y * list_sum(w[i]) - list_inner_product(w[i], list_transform(x, lambda q: q[k])))))
  FROM (SELECT *, list_transform(x, lambda p, i: list_transform(list_transform(x, lambda q: greatest(1e-10::DOUBLE, list_distance(p, q))), lambda d, j: CASE WHEN i = j THEN 0 ELSE {_FORCE} END)) AS w FROM s WHERE n < 20)),
e AS (SELECT label, unnest(ids) AS id, unnest(x) AS v FROM s WHERE n = 20) SELECT label, id, (k - 1)::BIGINT AS pos, {R6.format('v[k]')} AS value FROM e, range(1, 9) t(k)""")
def packing_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(horizon.spread_groups(vectors(spark, sf_dir, 8, 4.0), "label"), "label", "id")


# --- hyperbolic ---------------------------------------------------------------------------------------

_HP = sql_pairs(8, 1.0)  # norms up to 0.6 lie in the ball


@query(_HP + f""", n AS (SELECT *, {DOT.format('a', 'a')} AS aa, {DOT.format('b', 'b')} AS bb, {D2.format('a', 'b')} AS d2 FROM p)
SELECT id, {R6.format('acosh(1 + 2 * d2 / ((1 - aa) * (1 - bb)))')} AS distance FROM n""")
def poincare_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 8, 1.0).select("id", r6(hyp.distance(F.col("a"), F.col("b"))).alias("distance"))


_MOBIUS = f""", n AS (SELECT *, {DOT.format('a', 'a')} AS aa, {DOT.format('b', 'b')} AS bb, {DOT.format('a', 'b')} AS ab FROM p)"""


@query(_HP + _MOBIUS + f"""SELECT id, (k - 1)::BIGINT AS pos, {R6.format('((1 + 2 * ab + bb) * a[k] + (1 - aa) * b[k]) / (1 + 2 * ab + aa * bb)')} AS value FROM n, range(1, 9) t(k)""")
def mobius_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(neighbours(spark, sf_dir, 8, 1.0).select("id", hyp.mobius_add(F.col("a"), F.col("b")).alias("v")), "id")


@query(_HP + f"""SELECT id, (k - 1)::BIGINT AS pos, {R6.format('a[k]')} AS start, {R6.format('b[k]')} AS finish FROM p, range(1, 9) t(k)""")
def geodesic_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(spark, sf_dir, 8, 1.0)
    rows = hyp.along(hyp.along(rows, "a", "b", F.lit(0.0), "s"), "a", "b", F.lit(1.0), "f")
    both = rows.select("id", F.arrays_zip(F.col("s"), F.col("f")).alias("z"))
    return both.select("id", F.posexplode("z").alias("pos", "e")).select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("e.s")).alias("start"), r6(F.col("e.f")).alias("finish"))


@query(_HP + f""", n AS (SELECT *, {DOT.format('a', 'a')} AS aa, list_transform(a, lambda x: -x) AS m, {DOT.format('b', 'b')} AS bb, -{DOT.format('a', 'b')} AS ab FROM p),
d AS (SELECT *, list_transform(list_zip(m, b), lambda z: ((1 + 2 * ab + bb) * z[1] + (1 - aa) * z[2]) / (1 + 2 * ab + aa * bb)) AS d FROM n),
l AS (SELECT *, sqrt({DOT.format('d', 'd')}) AS n FROM d)
SELECT id, (k - 1)::BIGINT AS pos, {R6.format('d[k] * atanh(least(1 - 1e-10::DOUBLE, n)) / (n / (1 - aa + 1e-10::DOUBLE) + 1e-10::DOUBLE)')} AS value FROM l, range(1, 9) t(k)""")
def log_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(neighbours(spark, sf_dir, 8, 1.0).select("id", hyp.log_map(F.col("a"), F.col("b")).alias("v")), "id")


@query(_HP + f""", n AS (SELECT *, {DOT.format('a', 'a')} AS aa, list_transform(a, lambda x: -x) AS m, {DOT.format('b', 'b')} AS bb, -{DOT.format('a', 'b')} AS ab FROM p),
d AS (SELECT *, list_transform(list_zip(m, b), lambda z: 0.5::DOUBLE * ((1 + 2 * ab + bb) * z[1] + (1 - aa) * z[2]) / (1 + 2 * ab + aa * bb)) AS d FROM n),
s AS (SELECT *, sqrt({DOT.format('d', 'd')}) AS n FROM d), w AS (SELECT id, a, aa, list_transform(d, lambda x: x * tanh(n / (1 - aa + 1e-10::DOUBLE)) / (n + 1e-10::DOUBLE)) AS w FROM s),
o AS (SELECT *, {DOT.format('w', 'w')} AS ww, {DOT.format('a', 'w')} AS aw FROM w)
SELECT id, (k - 1)::BIGINT AS pos, {R6.format('((1 + 2 * aw + ww) * a[k] + (1 - aa) * w[k]) / (1 + 2 * aw + aa * ww)')} AS value FROM o, range(1, 9) t(k)""")
def geodesic_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(hyp.along(neighbours(spark, sf_dir, 8, 1.0), "a", "b", F.lit(0.5), "v").select("id", "v"), "id")


@query(_HP + f""", n AS (SELECT *, {DOT.format('a', 'a')} AS aa, {DOT.format('b', 'b')} AS bb, {DOT.format('a', 'b')} AS ab FROM p)
SELECT id, {R6.format('(1 + aa) / (1 - aa)')} AS time, {R6.format('a[1]')} AS back_first, {R6.format('acosh(greatest(1, ((1 + aa) * (1 + bb) - 4 * ab) / ((1 - aa) * (1 - bb))))')} AS distance FROM n""")
def lorentz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = neighbours(spark, sf_dir, 8, 1.0).select("id", hyp.to_lorentz(F.col("a")).alias("x"), hyp.to_lorentz(F.col("b")).alias("y"))
    return both.select("id", r6(F.col("x")[0]).alias("time"), r6(hyp.to_poincare(F.col("x"))[0]).alias("back_first"), r6(hyp.lorentz_distance(F.col("x"), F.col("y"))).alias("distance"))


@query(f"""WITH RECURSIVE v AS ({sql_vectors(8, 1.0)}), s AS (SELECT label, 0 AS n, list(v) AS x, [{', '.join(f'avg(v[{i}])' for i in range(1, 9))}] AS m FROM v GROUP BY label
UNION ALL SELECT label, n + 1, x, CASE WHEN size < 1e-7 THEN m ELSE list_transform(list_zip(m, w), lambda z: ((1 + 2 * mw + ww) * z[1] + (1 - mm) * z[2]) / (1 + 2 * mw + mm * ww)) END FROM (
  SELECT *, {DOT.format('w', 'w')} AS ww, {DOT.format('m', 'w')} AS mw FROM (
    SELECT *, list_transform(g, lambda y: y * tanh(size / (1 - mm + 1e-10::DOUBLE)) / (size + 1e-10::DOUBLE)) AS w FROM (
      SELECT *, sqrt({DOT.format('g', 'g')}) AS size FROM (
        SELECT *, list_transform(m, lambda y, k: 0.1::DOUBLE * list_avg(list_transform(logs, lambda l: l[k]))) AS g FROM (
          SELECT *, list_transform(list_transform(x, lambda p: list_transform(list_zip(m, p), lambda z: ((2 * list_inner_product(m, p) - 1 - list_inner_product(p, p)) * z[1] + (1 - mm) * z[2]) / (1 - 2 * list_inner_product(m, p) + mm * list_inner_product(p, p)))),
            lambda d: list_transform(d, lambda y: y * atanh(sqrt(list_inner_product(d, d))) / (sqrt(list_inner_product(d, d)) / (1 - mm + 1e-10::DOUBLE) + 1e-10::DOUBLE))) AS logs FROM (
            SELECT *, {DOT.format('m', 'm')} AS mm FROM s WHERE n < 100))))))
) SELECT label, (k - 1)::BIGINT AS pos, round(m[k], 5) + 0.0 AS value FROM s, range(1, 9) t(k) WHERE n = 100""")
def hyperbolic_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horizon.hyperbolic_centroids(vectors(spark, sf_dir, 8, 1.0), "label", 8)
    return long(out, "label", column="centroid", digits=5)


# --- 8-d lattice ----------------------------------------------------------------------------------------

_ROOTS = ", ".join(f"({k}, {lit(r)})" for k, r in enumerate(e8.roots()))


@query(f"""SELECT root_id, {R6.format("list_sum(root)")} AS total, {R6.format(DOT.format('root', 'root'))} AS norm2, root[1] AS first FROM (VALUES {_ROOTS}) t(root_id, root)""")
def e8_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("root")
    return e8.roots_table(spark).select("root_id", r6(vec.total(r)).alias("total"), r6(vec.norm2(r)).alias("norm2"), r[0].alias("first"))


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), r AS (SELECT * FROM (VALUES {_ROOTS}) t(root_id, root)),
d AS (SELECT id, root_id, sqrt({D2.format('v', 'root')}) AS d FROM v, r),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, root_id) AS n FROM d) SELECT id, root_id, {R6.format('d')} AS dist FROM b WHERE n = 1""")
def e8_nearest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors(spark, sf_dir, 8, 4.0).select("id", e8.nearest_root(F.col("v")).alias("n"))
    return near.select("id", "n.root_id", r6(F.col("n.dist")).alias("dist"))


def _snap_sql(source: str) -> str:
    def snap(v: str, y: str, out: str, odd: int) -> str:
        return (
            f"SELECT *, CASE WHEN ((list_sum({y})::BIGINT % 2) + 2) % 2 = {odd} THEN list_transform({y}, lambda x, i: CASE WHEN i = list_position(off_{out}, list_max(off_{out})) "
            f"THEN CASE WHEN {v}[i] > x THEN x + 1 ELSE x - 1 END ELSE x END) ELSE {y} END AS {out}"
        )

    return f"""WITH v AS ({source}),
s1 AS (SELECT *, list_transform(v, lambda x: round_even(x, 0) + 0.0) AS y, list_transform(v, lambda x: x - 0.5::DOUBLE) AS u FROM v),
s2 AS (SELECT *, list_transform(u, lambda x: round_even(x, 0) + 0.0) AS w, list_transform(list_zip(v, y), lambda z: abs(z[1] - z[2])) AS off_whole FROM s1),
s3 AS (SELECT *, list_transform(list_zip(u, w), lambda z: abs(z[1] - z[2])) AS off_half FROM s2),
s4 AS ({snap('v', 'y', 'whole', 1)} FROM s3), s5 AS ({snap('u', 'w', 'half', 0)} FROM s4),
s6 AS (SELECT *, list_transform(half, lambda x: x + 0.5::DOUBLE) AS half_point FROM s5),
s7 AS (SELECT *, {D2.format('v', 'whole')} AS d0, {D2.format('v', 'half_point')} AS d1 FROM s6),
n AS (SELECT id, label, v, CASE WHEN d0 <= d1 THEN whole ELSE half_point END AS point, least(d0, d1) AS d2 FROM s7)
"""


_SNAP = _snap_sql(sql_vectors(8, 4.0))


@query(_SNAP + f"SELECT id, (k - 1)::BIGINT AS pos, {R6.format('point[k]')} AS value, {R6.format('d2')} AS d2 FROM n, range(1, 9) t(k)")
def e8_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = e8.snapped(vectors(spark, sf_dir, 8, 4.0)).withColumn("d2", r6(F.col("d2")))
    return long(near, "id", "d2", column="point")


@query(_SNAP + f"SELECT id, (k - 1)::BIGINT AS pos, {R6.format('0.3::DOUBLE * v[k] + 0.7::DOUBLE * point[k]')} AS value FROM n, range(1, 9) t(k)")
def e8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = e8.snapped(vectors(spark, sf_dir, 8, 4.0))
    return long(near.select("id", e8.at_temperature(F.col("v"), F.col("point"), 0.7).alias("v")), "id")


@query(_SNAP + f"SELECT id, (k - 1)::BIGINT AS pos, {R6.format('CASE WHEN d2 > 0.5 THEN point[k] ELSE v[k] END')} AS value, d2 > 0.5 AS repaired FROM n, range(1, 9) t(k)")
def e8_strain_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors(spark, sf_dir, 8, 4.0).select("id", "v", e8.nearest_point(F.col("v")).alias("n"))
    return long(near.select("id", (F.col("n.d2") > 0.5).alias("repaired"), e8.healed(F.col("v"), F.col("n")).alias("v")), "id", "repaired")


@query(_SNAP + f"SELECT id, {R6.format('sqrt(' + DOT.format('v', 'v') + ')')} AS norm, {R6.format('list_sum(v)')} AS projection, {R6.format('d2')} AS error, {R6.format('v[1] - point[1]')} AS residual_first FROM n")
def e8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors(spark, sf_dir, 8, 4.0).withColumn("n", e8.nearest_point(F.col("v"))).withColumn("i", e8.invariants(F.col("v"), F.col("n")))
    return near.select("id", r6(F.col("i.norm")).alias("norm"), r6(F.col("i.projection")).alias("projection"), r6(F.col("i.error")).alias("error"), r6(e8.residual(F.col("v"), F.col("n.point"))[0]).alias("residual_first"))


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), x AS (SELECT unnest(v) AS x FROM v), s AS (SELECT var_pop(x) AS variance FROM x)
SELECT {R6.format('variance')} AS variance, {R6.format('greatest(0, least(1, 0.5 * ln(5.0::DOUBLE) / ln(100.0::DOUBLE) + ln(1 + variance) / 10))')} AS temperature FROM s""")
def adaptive_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8.adaptive_temperature(vectors(spark, sf_dir, 8, 4.0)).select(r6(F.col("variance")).alias("variance"), r6(F.col("temperature")).alias("temperature"))


# --- Golay code -------------------------------------------------------------------------------------------

_BITS = " | ".join(f"((bit_count((m & {row})::BIGINT) & 1)::BIGINT << {i})" for i, row in enumerate(golay.PARITY_ROWS))
_BOOK = f"WITH book AS (SELECT m AS message, m | (({_BITS}) << 12) AS codeword FROM range(0, 4096) t(m))"


@query(_BOOK + " SELECT message, codeword::BIGINT AS codeword, bit_count(codeword::BIGINT)::INTEGER AS weight FROM book")
def golay_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.codebook(spark)


@query(_BOOK + " SELECT bit_count(codeword::BIGINT)::INTEGER AS weight, count(*) AS n FROM book GROUP BY 1")
def golay_weight_enumerator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.codebook(spark).groupBy("weight").agg(F.count("*").alias("n"))


@query(_BOOK + """, w AS (SELECT o_orderkey AS id, xor(xor(codeword, 1::BIGINT << (o_orderkey % 24)::INTEGER), 1::BIGINT << ((o_orderkey // 24) % 24)::INTEGER) AS word, codeword, message FROM orders JOIN book ON message = o_orderkey % 4096)
SELECT id, word::BIGINT AS word, codeword::BIGINT AS codeword, message::BIGINT AS message, bit_count(xor(word, codeword)::BIGINT)::INTEGER AS errors FROM w""")
def golay_syndrome_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    word = golay.encode(key % 4096)
    flip = lambda n: F.expr(f"shiftleft(1L, cast({n} as int))")
    words = table(spark, sf_dir, "orders").select(key.alias("id"), word.bitwiseXOR(flip("o_orderkey % 24")).bitwiseXOR(flip("floor(o_orderkey / 24) % 24")).alias("word"))
    return golay.decode(words).select("id", "word", "codeword", "message", "errors")


# --- 24-d lattice -------------------------------------------------------------------------------------------

def _leech_sql(source: str) -> str:
    """Distances by the plain definition: every codeword, both cases, the cheapest flip where the parity asks for one."""
    return _BOOK + f""", g AS (SELECT message, list_transform(range(0, 24), lambda i: ((codeword >> i) & 1)::INTEGER) AS g FROM book), v AS ({source}),
y AS (SELECT id, c, list_transform(v, lambda x: x * sqrt(8.0::DOUBLE)) AS y FROM v, (VALUES (0), (1)) t(c)),
b AS (SELECT id, c, y, list_transform(y, lambda x: 4 * round_even((x - c) / 4, 0) + c) AS a0, list_transform(y, lambda x: 4 * round_even((x - (2 + c) % 4) / 4, 0) + (2 + c) % 4) AS a1 FROM y),
e AS (SELECT id, c, y, a0, a1, list_sum(a0) AS s0, list_transform(list_zip(y, a0), lambda z: abs(z[1] - z[2])) AS r0, list_transform(list_zip(y, a1), lambda z: abs(z[1] - z[2])) AS r1 FROM b),
f AS (SELECT *, list_inner_product(r0, r0) AS q0, list_transform(list_zip(r0, r1), lambda z: z[2] * z[2] - z[1] * z[1]) AS dq, list_transform(list_zip(a0, a1), lambda z: z[2] - z[1]) AS da FROM e),
k AS (SELECT id, c, message, q0 + list_inner_product(dq, g::DOUBLE[]) AS q, ((s0 + list_inner_product(da, g::DOUBLE[]))::BIGINT % 8 + 8) % 8 = 4 * c AS fits,
  list_min(list_transform(list_zip(g, r0, r1), lambda z: 16 - 8 * CASE WHEN z[1] = 0 THEN z[2] ELSE z[3] END)) AS mend FROM f, g)
"""


def _points_sql(source: str) -> str:
    """Table ``site``: id, g, c, y (integers), z and the squared distance, of the cheapest codeword with its mended coordinate."""
    return _leech_sql(source) + """, best AS (SELECT id, arg_min({'c': c, 'm': message, 'fits': fits}, CASE WHEN fits THEN q ELSE q + mend END) AS b, min(CASE WHEN fits THEN q ELSE q + mend END) / 8 AS d2 FROM k GROUP BY id),
p0 AS (SELECT f.id, b.m AS m, b.c AS c, b.fits AS fits, f.y AS v, g.g AS bits, d2, list_transform(list_zip(g.g, a0, a1), lambda z: CASE WHEN z[1] = 0 THEN z[2] ELSE z[3] END) AS p FROM best JOIN f ON f.id = best.id AND f.c = b.c JOIN g ON g.message = b.m),
p1 AS (SELECT *, list_transform(list_zip(v, p), lambda z: abs(z[1] - z[2])) AS off FROM p0),
p2 AS (SELECT *, CASE WHEN fits THEN p ELSE list_transform(p, lambda x, i: CASE WHEN i = list_position(off, list_max(off)) THEN x + 4 * sign(v[i] - x) ELSE x END) END AS y FROM p1),
site AS (SELECT id, m::INTEGER AS g, c::INTEGER AS c, list_transform(y, lambda x: x::INTEGER) AS y, list_transform(list_zip(y, bits), lambda z: ((z[1] - 2 * z[2] - c) / 4)::INTEGER) AS z, d2 FROM p2)
"""


def _site_sql(scale: float) -> str:
    """``site`` of the scaled rows, and the tables ``own`` (rows with their site) and ``sites`` with mass, alpha and |point|^2."""
    return _points_sql(sql_vectors(24, 8.0 * scale)) + f""", own AS (SELECT s.id, s.g, s.c, s.z, s.y, list_transform(e.embedding[1:24], lambda x: x::DOUBLE * 8) AS v FROM site s JOIN embeddings e ON e.vec_id = s.id),
sites AS (SELECT g, c, z, any_value(y) AS y, count(*) AS n, sum({DOT.format('v', 'v')}) AS mass, min(id) AS first_id, {DOT.format('any_value(y)::DOUBLE[]', 'any_value(y)::DOUBLE[]')} / {8 * scale * scale!r} AS base FROM own GROUP BY g, c, z)
"""


@query(_leech_sql(sql_vectors()) + f"SELECT id, {R6.format('sqrt(min(CASE WHEN fits THEN q ELSE q + mend END) / 8)')} AS dist FROM k GROUP BY id")
def leech_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leech.quantize(vectors(spark, sf_dir).select("id", "v")).select("id", r6(F.col("dist")).alias("dist"))


@query(_points_sql(sql_vectors()) + "SELECT id, g::BIGINT AS g, c::BIGINT AS c, array_to_string(z, ',') AS z, true AS consistent FROM site")
def leech_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's index, the SQL index and the SQL point again must agree; rows that do not would show."""
    q = leech.quantize(vectors(spark, sf_dir).select("id", "v")).withColumn("i", leech.index_of(F.col("y")))
    same = (F.col("g") == F.col("i.g")) & (F.col("c") == F.col("i.c")) & (F.col("z") == F.col("i.z")) & (leech.point_of(F.col("g"), F.col("c"), F.col("z")) == F.col("y"))
    return q.select("id", F.col("g").cast("long").alias("g"), F.col("c").cast("long").alias("c"), F.array_join(F.transform("z", lambda x: x.cast("string")), ",").alias("z"), same.alias("consistent"))


@query(_points_sql(sql_vectors()) + f"SELECT ({DOT.format('y::DOUBLE[]', 'y::DOUBLE[]')} / 16)::INTEGER AS shell, count(*) AS n, {R6.format('avg(sqrt(d2))')} AS mean_dist FROM site GROUP BY 1")
def leech_shell_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leech.quantize(vectors(spark, sf_dir).select("id", "v")).groupBy("shell").agg(F.count("*").alias("n"), r6(F.avg("dist")).alias("mean_dist"))


def _cells_sql() -> str:
    parts = [f"SELECT {n} AS scale, id, g, c, z FROM ({_points_sql(sql_vectors(24, 8.0 * s))} SELECT * FROM site)" for n, s in enumerate((0.5, 0.25, 0.125))]
    return f"""WITH v AS ({sql_vectors()}), cells AS ({' UNION ALL '.join(parts)}),
met AS (SELECT q.id AS qid, r.id AS rid, min(q.scale) AS scale FROM cells q JOIN cells r USING (scale, g, c, z) WHERE q.id % 100 = 0 GROUP BY 1, 2),
so AS (SELECT qid, s, count(*) AS n FROM met, range(0, 3) t(s) WHERE scale <= s GROUP BY 1, 2), stop AS (SELECT qid, coalesce(min(s) FILTER (n >= 10), 2) AS stop FROM so GROUP BY qid),
d AS (SELECT met.qid, rid, {D2.format('q.v', 'r.v')} AS d2 FROM met JOIN stop USING (qid) JOIN v q ON q.id = qid JOIN v r ON r.id = rid WHERE scale <= stop),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rank FROM d) SELECT qid, rank, rid, {R6.format('d2')} AS d2 FROM r WHERE rank <= 10"""


@query(_cells_sql())
def recall_lattice_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return recall.by_cell(rows, rows.where(ASKED), 10).withColumn("d2", r6(F.col("d2")))


@query(f"SELECT shell, points::VARCHAR AS points FROM (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate((1, 0, 196560, 16773120, 398034000, 4629381120)))}) t(shell, points)")
def leech_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leech.theta_table(spark, 6).select("shell", F.col("points").cast("string").alias("points"))


@query(f"""WITH t AS (SELECT shell, points * exp(-shell / 16.0::DOUBLE) AS w FROM (VALUES {', '.join(f'({k}, {c}::DOUBLE)' for k, c in enumerate((1, 0, 196560, 16773120, 398034000, 4629381120)))}) t(shell, points))
SELECT shell, {R6.format('w / sum(w) OVER ()')} AS share FROM t""")
def shell_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(leech.shell_prior(6, 4.0))), "shell int, share double").withColumn("share", r6(F.col("share")))


@query(f"""WITH v AS ({sql_vectors()}) SELECT id, {R6.format('list_sum(v[9:16])')} AS second_total, {R6.format('list_sum(v)')} AS total, 24::INTEGER AS width FROM v""")
def leech_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    parts = vectors(spark, sf_dir).select("id", leech.layer(v, "second").alias("b"), leech.combine(leech.layer(v), leech.layer(v, "second"), leech.layer(v, "third")).alias("all"))
    return parts.select("id", r6(vec.total(F.col("b"))).alias("second_total"), r6(vec.total(F.col("all"))).alias("total"), F.size(leech.embed(F.col("b"), "second")).alias("width"))


# --- consolidation --------------------------------------------------------------------------------------------

COARSE = 0.25  # of the scaled rows: sites collapse


def _sites(spark: SparkSession, sf_dir: str, scale: float = COARSE) -> tuple[DataFrame, DataFrame]:
    """Rows with their sites, written once since nearest points are the work, and the sites."""
    assigned = Scratch(spark, "sites").save(consolidate.assign(vectors(spark, sf_dir).select("id", "v"), scale), "assigned")
    return assigned, consolidate.alpha(consolidate.sites(assigned), scale)


@query(_site_sql(COARSE) + f"SELECT g, c, array_to_string(z, ',') AS z, n, {R6.format('mass')} AS mass, CASE WHEN base > 0 THEN {R6.format('sqrt(mass / (n * base))')} END AS alpha, first_id FROM sites")
def consolidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with their mass; alpha is shown off the origin, which has no direction to rescale."""
    _, s = _sites(spark, sf_dir)
    z = F.array_join(F.transform("z", lambda x: x.cast("string")), ",")
    return s.select("g", "c", z.alias("z"), "n", r6(F.col("mass")).alias("mass"), F.when(F.col("origin_mass") == 0, r6(F.col("alpha"))).alias("alpha"), "first_id")


@query(f"""WITH v AS ({sql_vectors()}) SELECT count(*) AS n, round(sum({DOT.format('v', 'v')}), 4) AS mass_in, true AS conserved FROM v""")
def consolidate_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass out (and lost at the origin) equals mass in."""
    return consolidate.audit(*_sites(spark, sf_dir)).select("n", r6(F.col("mass_in"), 4).alias("mass_in"), (F.col("drift") < 1e-9).alias("conserved"))


SCALES = (1.0, 0.5, 0.25, 0.125)


@query(" UNION ALL ".join(f"(SELECT * FROM ({_site_sql(x)} SELECT {x!r}::DOUBLE AS scale, sum(n)::BIGINT AS n, count(*) AS sites, {R6.format('sum(n) / count(*)')} AS collapse, {R6.format('coalesce(sum(mass) FILTER (base = 0), 0)')} AS origin_mass FROM sites))" for x in SCALES))
def collapse_ratio_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for scale in SCALES:
        one = consolidate.audit(*_sites(spark, sf_dir, scale)).select(F.lit(scale).alias("scale"), "n", "sites", r6(F.col("collapse")).alias("collapse"), r6(F.col("origin_mass")).alias("origin_mass"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_site_sql(COARSE) + f""", r AS (SELECT v, list_transform(s.y, lambda x: CASE WHEN base > 0 THEN x / sqrt(8.0::DOUBLE) / {COARSE!r} * sqrt(mass / (n * base)) ELSE 0 END) AS r FROM own JOIN sites s USING (g, c, z))
SELECT count(*) AS n, round(avg(sqrt({D2.format('v', 'r')})), 5) AS mean_error FROM r""")
def mass_scaled_recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = consolidate.reconstruct(*_sites(spark, sf_dir))
    return back.agg(F.count("*").alias("n"), r6(F.avg(F.sqrt(vec.distance2(F.col("v"), F.col("recon")))), 5).alias("mean_error"))


@query(f"""SELECT vec_id AS id, (k - 1)::BIGINT AS pos, round((embedding[k]::DOUBLE * 8)::FLOAT::DOUBLE, 6) + 0.0 AS value FROM embeddings, range(1, 25) t(k)""")
def consolidate_exact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives XOR residuals are the rows, to the last float32 bit."""
    back = consolidate.reconstruct(*_sites(spark, sf_dir))
    rows = consolidate.restore(consolidate.residuals(back))
    return long(rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")), "id")


@query("""WITH x AS (SELECT vec_id AS id, k, (embedding[k] * 8)::FLOAT::DOUBLE AS x FROM embeddings, range(1, 25) t(k)),
e AS (SELECT *, CASE WHEN pow(2::DOUBLE, round(log2(abs(x)))) <= abs(x) THEN round(log2(abs(x))) ELSE round(log2(abs(x))) - 1 END AS e FROM x),
b AS (SELECT id, k, CASE WHEN x = 0 THEN 0 ELSE CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + (e + 127)::BIGINT * 8388608 + (abs(x) / pow(2::DOUBLE, e) * 8388608)::BIGINT - 8388608 END AS b FROM e)
SELECT id, sha256(unhex(string_agg(printf('%02x%02x%02x%02x', b & 255, (b >> 8) & 255, (b >> 16) & 255, b >> 24), '' ORDER BY k)))[1:16] AS member FROM b GROUP BY id""")
def consolidate_member_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", consolidate.member_id("v").alias("member"))


# --- absorbing aggregates --------------------------------------------------------------------------------------

_Q8 = horizon.scrambling(8).tolist()


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), s AS (SELECT label, count(*) AS n, sum(sqrt({DOT.format('v', 'v')})) AS e, [{', '.join(f'sum(v[{i}])' for i in range(1, 9))}] AS s FROM v GROUP BY label),
m AS (SELECT *, 1 + e * 0.01::DOUBLE AS mass FROM s), r AS (SELECT *, pow(mass, 0.2::DOUBLE) AS radius FROM m)
SELECT label, n AS absorbed, {R6.format('mass')} AS mass, {R6.format('radius')} AS radius, {R6.format('pow(radius, 6) / 4')} AS entropy, {R6.format('1 / (4 * pi() * radius)')} AS temperature,
{R6.format(DOT.format('s', lit(_Q8[0])))} AS state_first FROM r""")
def absorb_mass_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horizon.derived(horizon.absorb(vectors(spark, sf_dir, 8, 4.0), ["label"], 8), 8)
    return out.select("label", "absorbed", *(r6(F.col(c)).alias(c) for c in ("mass", "radius", "entropy", "temperature")), r6(F.col("state")[0]).alias("state_first"))


@query()
def horizon_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horizon.horizon_state(horizon.derived(horizon.absorb(vectors(spark, sf_dir, 8, 4.0), ["label"], 8), 8))
    return out.select("label", "absorbed", r6(vec.norm(F.col("encoded")) - F.col("radius")).alias("off_horizon"), "checksum")


_B = horizon.boundary().tolist()


@query(f"""WITH v AS ({sql_vectors()}), e AS (SELECT id, [{', '.join(DOT.format('v', lit(row)) for row in _B)}] AS e FROM v)
SELECT id, (k - 1)::BIGINT AS pos, {R6.format('e[k]')} AS value FROM e, range(1, 24) t(k)""")
def holographic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir).select("id", horizon.holographic(F.col("v")).alias("v")), "id")


# --- trajectories ---------------------------------------------------------------------------------------------

def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label in order of their ids, as one trajectory."""
    return vectors(spark, sf_dir, 8, 4.0).select(F.col("label").alias("key"), F.col("id").alias("pos"), "v")


_PATHS = _SNAP + f""", o AS (SELECT label AS key, id, v, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS length,
  first_value(point) OVER (PARTITION BY label ORDER BY id) AS a, last_value(point) OVER (PARTITION BY label ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM n),
x AS (SELECT *, idx::DOUBLE / (length - 1) AS t FROM o),
w AS (SELECT *, list_transform(list_zip(v, a, b), lambda z: z[1] - ((1 - t) * z[2] + t * z[3])) AS d FROM x),
dev AS (SELECT *, CASE WHEN idx > 0 AND idx < length - 1 THEN sqrt({DOT.format('d', 'd')}) ELSE 0.0 END AS dev_norm FROM w)
"""


@query(_PATHS + f"SELECT key, idx, length, {R6.format('dev_norm')} AS dev_norm FROM dev")
def trajectory_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.deviations(_paths(spark, sf_dir)).select("key", F.col("idx").cast("long").alias("idx"), "length", r6(F.col("dev_norm")).alias("dev_norm"))


@query(_PATHS + f""", s AS (SELECT key, max(length) AS length, count(*) FILTER (idx > 0 AND idx < length - 1 AND dev_norm > 1.5) AS p FROM dev GROUP BY key)
SELECT key, length, p AS perturbations, {R6.format('64 * length / (128 + 68 * p + 1e-10::DOUBLE)')} AS ratio, {R6.format('1 / (1 + p * 1.5::DOUBLE)')} AS fidelity FROM s""")
def trajectory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.summarize(trajectory.deviations(_paths(spark, sf_dir)), 1.5)
    return out.select("key", "length", "perturbations", r6(F.col("ratio")).alias("ratio"), r6(F.col("fidelity")).alias("fidelity"))


@query(_PATHS + f"SELECT key, {R6.format(f'avg(CASE WHEN dev_norm > 0.1 THEN 0 ELSE sqrt({DOT.format('d', 'd')}) END)')} AS error FROM dev GROUP BY key")
def trajectory_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = trajectory.deviations(_paths(spark, sf_dir))
    return trajectory.reconstruction_error(dev.select("key", "idx", "v"), trajectory.decompress(*trajectory.compress(dev, 0.1))).select("key", r6(F.col("error")).alias("error"))


_TRIED = "(low + high) / 2"
_RATIO = f"64 * length / (128 + 68 * len(list_filter(norms, lambda x: x > {_TRIED})) + 1e-10::DOUBLE)"


@query(_PATHS.replace("WITH v AS", "WITH RECURSIVE v AS") + f""", s AS (SELECT key, max(length) AS length, list(dev_norm) FILTER (idx > 0 AND idx < length - 1) AS norms FROM dev GROUP BY key),
step AS (SELECT key, length, norms, 0 AS n, 0.01::DOUBLE AS low, 1::DOUBLE AS high, NULL::DOUBLE AS tolerance, NULL::DOUBLE AS ratio FROM s
  UNION ALL SELECT key, length, norms, n + 1, CASE WHEN now < 2 THEN tried ELSE low END, CASE WHEN now < 2 THEN high ELSE tried END,
    CASE WHEN better THEN tried ELSE tolerance END, CASE WHEN better THEN now ELSE ratio END
  FROM (SELECT *, ratio IS NULL OR (now >= 2 AND abs(now - 2) < abs(ratio - 2)) AS better FROM (SELECT *, {_TRIED} AS tried, {_RATIO} AS now FROM step WHERE n < 10)))
SELECT key, {R6.format('tolerance')} AS tolerance, {R6.format('ratio')} AS ratio, {R6.format('1 / (1 + len(list_filter(norms, lambda x: x > tolerance)) * tolerance)')} AS fidelity FROM step WHERE n = 10""")
def trajectory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.search_tolerance(trajectory.deviations(_paths(spark, sf_dir)), 2.0)
    return out.select("key", *(r6(F.col(c)).alias(c) for c in ("tolerance", "ratio", "fidelity")))


# --- bytes ----------------------------------------------------------------------------------------------------

_HEX = """WITH h AS (SELECT regexp_extract_all(upper(hex(encode(text))), '..') AS h FROM documents WHERE text IS NOT NULL)"""


@query(_HEX + " SELECT sym, count(*) AS n FROM (SELECT unnest(h) AS sym FROM h) GROUP BY sym")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.histogram(table(spark, sf_dir, "documents"), "text")


def _entropy_sql(order: int) -> str:
    ctx = " || ".join(f"h[i + {k}]" for k in range(order)) or "''"
    return _HEX + f""", s AS (SELECT {ctx} AS ctx, h[i + {order}] AS sym FROM (SELECT h, unnest(range(1, greatest(1, len(h) - {order} + 1))) AS i FROM h)),
c AS (SELECT ctx, sym, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT ctx, sum(n) AS total, sum(n * log2(n)) AS part FROM c GROUP BY ctx)
SELECT sum(total)::BIGINT AS n_bytes, count(*) AS contexts, {R6.format('sum(total * log2(total) - part) / sum(total)')} AS bits_per_byte FROM p"""


def _entropy(order: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bytestats.conditional_entropy(table(spark, sf_dir, "documents"), "text", order).withColumn("bits_per_byte", r6(F.col("bits_per_byte")))

    return run


for _n in (0, 1, 2):
    QUERIES[f"byte_entropy_order{_n}"] = _entropy(_n)
    ORACLES[f"byte_entropy_order{_n}"] = _entropy_sql(_n)


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("""SELECT page_id, CASE WHEN html LIKE '<?xml_%' THEN 'text/xml' WHEN html LIKE '<!DOCTYPE_%' OR html LIKE '<html_%' THEN 'text/html' ELSE 'application/octet-stream' END AS mime,
CASE WHEN html LIKE '<?xml_%' OR html LIKE '<!DOCTYPE_%' OR html LIKE '<html_%' THEN 'structured' ELSE 'unknown' END AS category, strlen(html)::BIGINT AS size,
CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE printf('%.1f KB', floor(strlen(html) / 102.4::DOUBLE + 0.5) / 10) END AS size_human FROM pages""")
def sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("page").alias("path"), F.col("html").cast("binary").alias("content"), F.octet_length("html").alias("length"))
    kind = F.coalesce(sniff.by_magic(F.col("content")), F.struct(F.lit("application/octet-stream").alias("mime"), F.lit("unknown").alias("category")))
    return pages.withColumn("k", kind).select("page_id", "k.mime", "k.category", F.col("length").cast("long").alias("size"), bits.format_size(F.col("length")).alias("size_human"))


_RULES = ", ".join(f"('{e}', '{m}', '{c}')" for e, m, c in sniff.extension_rules())


@query(f"""SELECT x.ext, coalesce(mime, 'application/octet-stream') AS mime, coalesce(category, 'unknown') AS category, coalesce(category LIKE 'compressed_%', false) AS is_precompressed,
CASE WHEN category LIKE 'compressed_%' THEN 'fast' WHEN category = 'text' THEN 'mythic' WHEN category = 'structured' THEN 'ultra' ELSE 'normal' END AS mode, n
FROM (SELECT lower('.' || ['jpg', 'TXT', 'csv', 'zip', 'none', 'so'][(o_orderkey % 6)::INTEGER + 1]) AS ext, count(*) AS n FROM orders GROUP BY 1) x LEFT JOIN (VALUES {_RULES}) r(ext, mime, category) USING (ext)""")
def sniff_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("jpg", "TXT", "csv", "zip", "none", "so")))
    path = F.concat(F.lit("/data/file"), F.col("o_orderkey").cast("string"), F.lit("."), F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")))
    named = table(spark, sf_dir, "orders").select(path.alias("path"), F.lit(b"").alias("content"), F.lit(0).alias("length"))
    return sniff.analyze(named).withColumn("ext", bits.suffix(F.col("path"))).groupBy("ext", "mime", "category", "is_precompressed", "mode").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, strlen(text)::BIGINT AS size, (sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) - strlen(text))::BIGINT AS "offset" FROM documents""")
def archive_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return bytestats.offsets(docs, "source", "doc_id", "size").select("doc_id", "size", "offset")


@query("""SELECT event_id, z, CASE WHEN z >= 0 THEN 2 * z ELSE -2 * z - 1 END AS zigzag, z AS back, least(floor(abs(z) / 7), 15)::INTEGER AS bucket FROM (SELECT event_id, round_even(value, 0)::BIGINT - 20 AS z FROM events)""")
def zigzag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "events").select("event_id", (F.rint("value").cast("long") - 20).alias("z")).withColumn("zigzag", bits.zigzag(F.col("z")))
    return z.select("event_id", "z", "zigzag", bits.unzigzag(F.col("zigzag")).alias("back"), bits.shell_bucket(F.abs("z"), 100).alias("bucket"))


@query("""SELECT doc_id, chunk, chunk * 1000 AS "offset", least(1000, n - chunk * 1000)::BIGINT AS length FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, greatest(1, ceil(strlen(text) / 1000.0)::BIGINT))) AS chunk FROM documents)""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.chunk_plan(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), 1000)


_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


@query(f"""WITH RECURSIVE bit AS (SELECT 0 AS n, b::BIGINT AS byte, b::BIGINT AS c FROM range(0, 256) t(b) UNION ALL SELECT n + 1, byte, {_CRC_STEP.format('c')} FROM bit WHERE n < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bit WHERE n = 8),
p AS (SELECT doc_id, chunk, substr(hex(encode(text)), (chunk * 8192 + 1)::BIGINT, 8192) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(strlen(text) / 4096.0)::BIGINT))) AS chunk FROM documents)),
b AS (SELECT doc_id, chunk, len(h) // 2 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)) AS b, t FROM p, tab)
SELECT doc_id, chunk, size::INTEGER AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc32 FROM b""")
def crc32_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(table(spark, sf_dir, "documents"), "doc_id", "text", 4096).select("doc_id", "chunk", F.octet_length("data").alias("size"), "crc32")


# --- codecs ---------------------------------------------------------------------------------------------------

@query("SELECT item_id, sha256(text) AS sha256, strlen(text)::BIGINT AS source_length, 'exact_recovery' AS truth, true AS restored FROM benchmark")
def bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text through the order-1 codec and back; header fields come from SQL alone."""
    packed = codec.inspect(codec.compress_column(table(spark, sf_dir, "benchmark"), "text", mode="fast"))
    back = codec.decompress_column(packed)
    return back.select("item_id", F.col("source_sha256").alias("sha256"), "source_length", "truth", (F.col("data") == F.col("text").cast("binary")).alias("restored"))


@query("""SELECT item_id, mode, CASE WHEN mode <> 'mythic' THEN sha256(text) END AS sha256, strlen(text)::BIGINT AS length FROM benchmark, (SELECT unnest(['fast', 'normal', 'ultra', 'mythic', 'leech', 'quip']) AS mode)""")
def legacy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text through the six legacy modes and back; mythic keeps the length alone."""
    out = None
    for mode in codec.LEGACY:
        back = codec.legacy_back(codec.legacy_column(table(spark, sf_dir, "benchmark"), "text", mode))
        sha = F.sha2("data", 256) if mode != "mythic" else F.lit(None).cast("string")
        one = back.select("item_id", F.lit(mode).alias("mode"), sha.alias("sha256"), F.octet_length("data").cast("long").alias("length"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH v AS ({sql_vectors()}) SELECT label, id::VARCHAR AS id, (k - 1)::BIGINT AS pos, round(v[k]::FLOAT::DOUBLE, 6) + 0.0 AS value FROM v, range(1, 25) t(k)""")
def consolidation_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a label into archives of coded sites, residuals and ids, and back to the last bit."""
    packed = codec.consolidate_groups(vectors(spark, sf_dir), "label", scale=COARSE)
    rows = codec.deconsolidate_column(packed, "label").withColumn("v", F.transform("v", lambda x: x.cast("double")))
    return long(rows, "label", "id")


@query("SELECT item_id, sha256(text) AS sha256, strlen(text)::BIGINT AS source_length, 'exact_recovery' AS truth FROM benchmark")
def predictor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text coded by the n-gram predictor and back."""
    packed = codec.inspect(codec.compress_column(table(spark, sf_dir, "benchmark"), "text", mode="predictor:ngram-mix"))
    return codec.decompress_column(packed).select("item_id", F.sha2("data", 256).alias("sha256"), "source_length", "truth")


@query()
def codec_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    out = None
    for mode in ("fast", "strong", "geometric"):
        one = codec.compress_column(rows, "text", mode=mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), r6(F.sum(F.octet_length("text")) / F.sum(F.octet_length("archive") - codec.HEADER)).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def tensor_rate_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of a label, whole, as one tensor in blocks of 4,096 vec_ids, coded at three scales: more bits, more signal."""
    block = F.floor(F.col("vec_id") / 4096).alias("block")
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("tensor_id"), block).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    tensors = rows.select("tensor_id", F.flatten(F.transform("e", lambda s: F.transform(s["embedding"], lambda x: x.cast("double")))).alias("w"))
    return codec.bits_to_snr(tensors).select("tensor_id", "scale", r6(F.col("bits_per_weight"), 4).alias("bits_per_weight"), r6(F.col("snr_db"), 4).alias("snr_db"))


_TURN = "CASE {i} WHEN p THEN co * {a} - si * {b} WHEN q THEN si * {a} + co * {b} ELSE {c} END"


@query(f"""WITH RECURSIVE v AS ({sql_vectors(8, 4.0)}), s AS (SELECT 0 AS n, [{', '.join(f'covar_pop(v[{i}], v[{j}])' for i in range(1, 9) for j in range(1, 9))}] AS m FROM v
UNION ALL SELECT n + 1, list_transform(h, lambda x, k: {_TURN.format(i='(k - 1) % 8', a='h[(k - 1) // 8 * 8 + p + 1]', b='h[(k - 1) // 8 * 8 + q + 1]', c='x')}) FROM (
  SELECT *, list_transform(m, lambda x, k: {_TURN.format(i='(k - 1) // 8', a='m[p * 8 + (k - 1) % 8 + 1]', b='m[q * 8 + (k - 1) % 8 + 1]', c='x')}) AS h FROM (
    SELECT *, cos(angle) AS co, sin(angle) AS si FROM (
      SELECT *, atan2(2 * m[p * 8 + q + 1], m[q * 9 + 1] - m[p * 9 + 1]) / 2 AS angle FROM s JOIN (VALUES {', '.join(f'({n}, {p}, {q})' for n, (p, q) in enumerate((p, q) for p in range(8) for q in range(p + 1, 8)))}) pair(k, p, q) ON k = n % 28 WHERE n < 280)))
) SELECT (row_number() OVER (ORDER BY m[i * 9 + 1] DESC) - 1)::INTEGER AS axis, {R6.format('m[i * 9 + 1]')} AS variance FROM s, range(0, 8) t(i) WHERE n = 280""")
def learn_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of the vectors along the learned axes, which fall."""
    rows = vectors(spark, sf_dir, 8, 4.0).select("id", "v")
    axes = hadamard.learn_rotation(rows, 8).tolist()
    turned = rows.select(F.posexplode(vec.apply_matrix(axes, F.col("v"))).alias("axis", "x"))
    return turned.groupBy("axis").agg(r6(F.var_pop("x")).alias("variance"))


@query(f"""WITH v AS ({sql_vectors()}), m AS (SELECT id, [{', '.join(DOT.format('v', lit(r)) for r in e8.projection(24))}] AS m FROM v)
SELECT id, (k - 1)::BIGINT AS pos, {R6.format('m[k]')} AS value FROM m, range(1, 9) t(k)""")
def project_to_8d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(vectors(spark, sf_dir).select("id", e8.project(F.col("v"), 24).alias("v")), "id")


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), b AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY id) - 1) AS n, v FROM v)
SELECT label, (n // 3)::BIGINT AS block, round(sum(list_sum(v)), 6) + 0.0 AS total, count(*) * 8 AS filled FROM b GROUP BY 1, 2""")
def triples_to_24d(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    numbered = vectors(spark, sf_dir, 8, 4.0).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1)
    out = e8.triples(numbered, "label", "n")
    filled = F.size(F.filter("v", lambda x: x != 0)).cast("long")
    return out.select("label", "block", r6(vec.total(F.col("v"))).alias("total"), filled.alias("filled"))


_HALVES = ", ".join(f"'{struct.pack('<d', k / 2).hex()}'" for k in range(-64, 65))


@query(_SNAP + f"SELECT id, md5(unhex(array_to_string(list_transform(point, lambda x: list_extract([{_HALVES}], (2 * x)::INTEGER + 65)), '')))[1:8] AS point_id FROM n")
def e8_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = e8.snapped(vectors(spark, sf_dir, 8, 4.0))
    return near.select("id", e8.point_id(F.col("point")).alias("point_id"))


@query(f"""SELECT i::BIGINT AS i, {R6.format("cos(pi() * (3 - sqrt(5.0::DOUBLE)) * i) * sqrt(greatest(0, 1 - pow(1 - 2.0::DOUBLE * i / 99, 2)))")} AS x, {R6.format("1 - 2.0::DOUBLE * i / 99")} AS y FROM range(0, 100) t(i)""")
def fibonacci_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vec.fibonacci_sphere(F.col("id"), 100)
    return spark.range(100).select(F.col("id").alias("i"), r6(p[0]).alias("x"), r6(p[1]).alias("y"))


@query("SELECT item_id, text AS back, strlen(text)::BIGINT * 8 AS n_bits FROM benchmark")
def bits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "benchmark").select("item_id", bits.bit_string(F.col("text").cast("binary")).alias("b"))
    return coded.select("item_id", bits.from_bit_string(F.col("b")).cast("string").alias("back"), F.length("b").cast("long").alias("n_bits"))


@query("""SELECT doc_id, least(n, 67108864)::BIGINT AS chunk, (least(n, 67108864) * 3 + (least(n, 67108864) // 8) * 64 + 15360)::BIGINT AS memory FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def chunk_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = bytestats.recommended_chunk(F.octet_length("text").cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", chunk.alias("chunk")).withColumn("memory", bytestats.memory_estimate(F.col("chunk")))


@query(f"SELECT w AS id, xor(({_BITS.replace('(m &', '((w & 4095) &')}), (w >> 12) & 4095)::BIGINT AS syndrome FROM (SELECT (l_orderkey * 7919 + l_linenumber * 104729) % 16777216 AS w FROM lineitem GROUP BY 1)")
def golay_syndrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 16777216
    return table(spark, sf_dir, "lineitem").select(w.cast("long").alias("id")).distinct().select("id", golay.syndrome(F.col("id")).alias("syndrome"))


@query("""SELECT event_id, user_id::VARCHAR AS name, event_type AS mode, value AS ratio FROM events""")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive metadata as JSON text and back."""
    meta = F.to_json(F.struct(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("mode"), F.col("value").alias("ratio")))
    back = F.from_json(meta, "name string, mode string, ratio double")
    return table(spark, sf_dir, "events").select("event_id", back.alias("m")).select("event_id", "m.*")


@query(f"""WITH v AS ({sql_vectors(8, 4.0)}), s AS (SELECT label, sum(sqrt({DOT.format('v', 'v')})) AS e, [{', '.join(f'sum(v[{i}])' for i in range(1, 9))}] AS s FROM v GROUP BY label),
r AS (SELECT label, [{', '.join(DOT.format('s', lit(q)) for q in _Q8)}] AS state, 1 / (4 * pi() * pow(greatest(0.9::DOUBLE * (1 + e * 0.01::DOUBLE), 0.1), 0.2::DOUBLE)) AS cold FROM s),
h AS (SELECT *, md5('0:' || label || ':' || (k - 1)) AS h FROM r, range(1, 9) t(k)), u AS (SELECT *, (('0x' || h[1:8])::BIGINT + 1) / 4294967297::DOUBLE AS u, (('0x' || h[9:16])::BIGINT + 1) / 4294967297::DOUBLE AS w FROM h)
SELECT label, (k - 1)::BIGINT AS pos, {R6.format('state[k] * 0.1::DOUBLE + sqrt(-2 * ln(u)) * cos(2 * pi() * w) * cold')} AS value FROM u""")
def hawking_radiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = horizon.evaporate(horizon.derived(horizon.absorb(vectors(spark, sf_dir, 8, 4.0), ["label"], 8), 8), ["label"], 8)
    return long(out.select("label", F.col("radiation").alias("v")), "label")


@query("SELECT source, doc_id::VARCHAR AS name, strlen(text)::BIGINT AS original_size, sha256(text) AS sha256 FROM documents")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multi-file archive per source, and its members read back."""
    from gridloom.sources import archive

    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    out = archive.members(archive.bundle(files, "source"), "source")
    return out.select("source", "name", "original_size", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks through the streaming compressor into a table, and whole again."""
    scratch = Scratch(spark, "stream")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, min(spark.sparkContext.defaultParallelism, n_bytes >> 19), n_bytes // entropy.GROUP)  # many chunks each, which are coded in step
    pieces = chunks.split(documents, "doc_id", "text", 1 << 16)
    pieces = scratch.save(pieces.repartition(tasks, "doc_id", "chunk"), "chunks")  # coding is the work, not reading
    source = spark.readStream.schema(pieces.schema).parquet(f"{scratch.root}/01-chunks")
    target = scratch.path("compressed")
    chunks.compress_stream(source, target, scratch.path("progress"), "fast").awaitTermination()
    back = chunks.decompress_table(spark, target)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "data"))), lambda s: F.hex(s["data"])), "")
    return back.groupBy("doc_id").agg(F.when(F.count("data") > 0, F.sha2(F.unhex(whole), 256)).alias("sha256"))  # a null text has one chunk, null
