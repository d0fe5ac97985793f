"""Routing, learned-parameter, training and streaming queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from catalog.network_queries import LEVELS
from catalog.registry import query
from catalog.stand_in import base, flow, network, table, with_tables
from catalog.value_queries import DENSE, GEO_COLUMNS, NATIVE, PHYSICAL, _native, _physical
from rillflow.operators import cleaning, kan, lti
from rillflow.operators.kernel import Scheme
from rillflow.operators.network import gauge_outflow
from rillflow.operators.routing import gauge_hydrographs, hourly, route
from rillflow.plans import comparison
from rillflow.plans import problem as prob
from rillflow.scratch import by_key, scratch_path, store

START = datetime(2024, 1, 1)
HOURS = 720

# All reaches advance together, each at its own time: in round d a reach of level l computes hour d - l.
# Every row keeps its latest unclamped and clamped values, newest first, for the reaches below it.
ROUTED = (
    LEVELS
    + DENSE
    + """, stat AS (SELECT r.reach_id, r.down_id, s.level, b.level AS down_level, (SELECT max(level) + 2 FROM shape) AS keep, r.length_m, greatest(r.slope, 0.001e0) AS slope, r.x,
    n_unit * (0.25e0 - 0.015e0) + 0.015e0 AS n, q_unit + 0.000001e0 AS qe, exp(p_unit * (ln(200e0) - ln(1.000001e0)) + ln(1.000001e0)) AS p,
    l.lat, h.hot FROM reach r JOIN shape s ON s.reach_id = r.reach_id LEFT JOIN shape b ON b.reach_id = r.down_id
    JOIN (SELECT reach_id, list(greatest(qr, 0.0001e0) ORDER BY hour_idx) AS lat FROM dense GROUP BY reach_id) l ON l.reach_id = r.reach_id
    JOIN (SELECT w.below_id AS reach_id, sum(f.qr) AS hot FROM walk w JOIN dense f ON f.reach_id = w.reach_id AND f.hour_idx = 0 GROUP BY 1) h ON h.reach_id = r.reach_id)
, step AS (
  SELECT CAST(0 AS BIGINT) AS d, reach_id, CAST([] AS DOUBLE[]) AS hx, CAST([] AS DOUBLE[]) AS hq FROM stat
  UNION ALL
  SELECT d + 1, reach_id, CASE WHEN t < 0 THEN hx ELSE list_prepend(nx, hx)[1:keep] END,
    CASE WHEN t < 0 THEN hq ELSE list_prepend(greatest(nx, CASE WHEN nx IS NULL THEN NULL ELSE 0.0001e0 END), hq)[1:keep] END
  FROM (SELECT d, reach_id, t, hx, hq, keep, CASE WHEN t < 0 OR t >= 720 THEN NULL WHEN t = 0 THEN hot
      ELSE (3600 - 2 * k * x) / den * sx + (3600 + 2 * k * x) / den * sq + (2 * k * (1 - x) - 3600) / den * qp + 7200 / den * lat[t] END AS nx
    FROM (SELECT *, 2 * k * (1 - x) + 3600 AS den FROM (SELECT *, length_m / (least(greatest(1 / n * power(radius, 2e0 / 3e0) * sqrt(slope), 0.01e0), 15e0) * 5e0 / 3e0) AS k
      FROM (SELECT *, ((top + bottom) * depth / 2) / (bottom + 2 * depth * sqrt(1 + side * side)) AS radius
        FROM (SELECT *, greatest(top - 2 * side * depth, 0.01e0) AS bottom FROM (SELECT *, least(greatest(top * qe / (2 * depth), 0.5e0), 50e0) AS side
          FROM (SELECT *, p * power(depth, qe) AS top FROM (SELECT *, greatest(power(qp * n * (qe + 1) / (p * sqrt(slope) + 0.00000001e0), 3e0 / (5e0 + 3e0 * qe)), 0.01e0) AS depth
            FROM (SELECT g.d, g.reach_id, g.d - c.level AS t, g.hx, g.hq, g.hq[1] AS qp, g.sx, g.sq, c.* EXCLUDE (reach_id)
              FROM (SELECT d, target AS reach_id, any_value(hx) AS hx, any_value(hq) AS hq, sum(xc) AS sx, sum(qc) AS sq
                FROM (SELECT s.d, CASE WHEN i = 0 THEN s.reach_id ELSE c.down_id END AS target, CASE WHEN i = 0 THEN s.hx END AS hx, CASE WHEN i = 0 THEN s.hq END AS hq,
                    CASE WHEN i = 0 THEN 0e0 ELSE coalesce(s.hx[c.down_level - c.level], 0e0) END AS xc,
                    CASE WHEN i = 0 THEN 0e0 ELSE coalesce(s.hq[c.down_level - c.level + 1], 0e0) END AS qc
                  FROM step s JOIN stat c ON c.reach_id = s.reach_id CROSS JOIN range(2) two(i) WHERE i = 0 OR c.down_id IS NOT NULL)
                GROUP BY d, target) g JOIN stat c ON c.reach_id = g.reach_id)))))))))
  WHERE d < 720 + (SELECT max(level) FROM shape))
, routed AS (SELECT s.reach_id, s.d - 1 - c.level AS hour_idx, s.hq[1] AS q FROM step s JOIN stat c ON c.reach_id = s.reach_id
  WHERE s.d - 1 - c.level BETWEEN 0 AND 719)
"""
)


def _params(spark, sf_dir):
    return _physical(spark, sf_dir).select(
        "reach_id", "n", F.col("p").alias("p_spatial"), F.col("q").alias("q_spatial"), "length_m", "slope", "x"
    )


def _routed(spark, sf_dir, scheme, keep=None):
    t = network(spark, sf_dir)
    return route(t["plan"], _params(spark, sf_dir), table(spark, sf_dir, "inflow_hourly"), START, scheme, keep=keep)


@query(
    "x_route",
    with_tables(
        "reach",
        "inflow_hourly",
        recursive=True,
        body=ROUTED + "SELECT reach_id, CAST(floor(hour_idx / 24) AS BIGINT) AS day, round(avg(q), 4) AS q FROM routed GROUP BY 1, 2",
    ),
)
def x_route(spark, sf_dir):
    """Every reach, every hour; compared as daily means."""
    scheme = Scheme(n_hours=HOURS, chunk=240)
    long = hourly(_routed(spark, sf_dir, scheme), START, scheme)
    return long.groupBy("reach_id", F.floor(F.col("hour_idx") / 24).alias("day")).agg(F.round(F.avg("q"), 4).alias("q"))


@query(
    "x_gauge_scatter",
    with_tables(
        "reach",
        "inflow_hourly",
        "gauge",
        recursive=True,
        body=ROUTED + """SELECT g.staid, CAST(o.hour_idx AS BIGINT) AS hour_idx, round(sum(o.q), 4) AS q FROM gauge g
          LEFT JOIN reach r ON r.down_id = g.reach_id JOIN routed o ON o.reach_id = coalesce(r.reach_id, g.reach_id) GROUP BY 1, 2""",
    ),
)
def x_gauge_scatter(spark, sf_dir):
    scheme = Scheme(n_hours=HOURS, chunk=240)
    t = network(spark, sf_dir)
    outflow = gauge_outflow(table(spark, sf_dir, "gauge"), t["pairs"])
    series = gauge_hydrographs(_routed(spark, sf_dir, scheme, outflow), outflow, START, scheme)
    return series.select("staid", F.col("hour_idx").cast("bigint").alias("hour_idx"), F.round("q", 4).alias("q"))


@query(
    "x_route_mass",
    with_tables(
        "reach",
        "inflow_hourly",
        recursive=True,
        body=ROUTED + """SELECT w.below_id AS outlet, round(any_value(o.routed), 6) AS routed, round(sum(f.qr), 6) AS inflow FROM walk w
          JOIN reach r ON r.reach_id = w.below_id AND r.down_id IS NULL JOIN dense f ON f.reach_id = w.reach_id
          JOIN (SELECT reach_id, sum(q) AS routed FROM routed GROUP BY 1) o ON o.reach_id = w.below_id GROUP BY 1""",
    ),
)
def x_route_mass(spark, sf_dir):
    """Water that leaves each basin next to the water that entered it."""
    scheme = Scheme(n_hours=HOURS, chunk=240)
    topo = network(spark, sf_dir)["topo"]
    ends = topo.filter("down_id IS NULL").select("reach_id")
    out = hourly(_routed(spark, sf_dir, scheme, ends), START, scheme)
    out = out.groupBy(F.col("reach_id").alias("outlet")).agg(F.sum("q").alias("routed"))
    given = table(spark, sf_dir, "inflow_hourly").groupBy("reach_id").agg(F.sum("qr").alias("s"), F.count("*").alias("k"))
    per_reach = topo.join(by_key(given), "reach_id", "left").select(
        "outlet", (F.coalesce("s", F.lit(0.0)) + (F.lit(HOURS) - F.coalesce("k", F.lit(0))) * F.lit(0.001)).alias("v")
    )
    into = per_reach.groupBy("outlet").agg(F.sum("v").alias("inflow"))
    return out.join(by_key(into), "outlet").select("outlet", F.round("routed", 6).alias("routed"), F.round("inflow", 6).alias("inflow"))


def _lti(spark, sf_dir, kind):
    t = network(spark, sf_dir)
    scheme = Scheme(n_hours=HOURS, chunk=240)
    params = lti.lti_parameters(flow(spark, sf_dir))
    g = table(spark, sf_dir, "gauge")
    at_gauge = g.select("staid", "reach_id")
    routed = route(
        t["plan"], params, table(spark, sf_dir, "inflow_hourly"), START, scheme, stepper=lti.lti_stepper(kind), keep=at_gauge
    )
    headless = g.join(t["pairs"].select(F.col("dn_id").alias("reach_id")), "reach_id", "left_anti").select("staid")
    series = gauge_hydrographs(routed, at_gauge, START, scheme).join(headless, "staid", "left_anti")
    return series.groupBy("staid", F.floor(F.col("hour_idx") / 24).alias("day")).agg(F.avg("q").alias("q"))


# Unit responses as recursions on the reach's inflow u = lateral + upstream outflow.
# Linear store: y[t] = a * y[t-1] + (1 - a) * u[t], a = exp(-dt/k)
STORE_STEP = """exp(-(1e0 / 24) / 0.1042e0) * coalesce(hy[1], 0e0) + (1 - exp(-(1e0 / 24) / 0.1042e0)) * (lat[t + 1] + sy)"""
# Muskingum: y[t] = c0 * u[t] + c1 * u[t-1] + c2 * y[t-1], starting from rest
MUSKINGUM_STEP = """((1e0 / 24 - 2 * 0.1042e0 * 0.3e0) * (lat[t + 1] + sy) + (1e0 / 24 + 2 * 0.1042e0 * 0.3e0) * coalesce(hu[1], 0e0)
      + (2 * 0.1042e0 * 0.7e0 - 1e0 / 24) * coalesce(hy[1], 0e0)) / (2 * 0.1042e0 * 0.7e0 + 1e0 / 24)"""
LTI_SQL = (
    LEVELS
    + DENSE
    + """, first AS (SELECT count(*) AS n FROM reach)
, stat AS (SELECT r.reach_id, r.down_id, s.level, b.level AS down_level, (SELECT max(level) + 2 FROM shape) AS keep, TAPS AS taps, l.lat FROM reach r JOIN shape s ON s.reach_id = r.reach_id
    LEFT JOIN shape b ON b.reach_id = r.down_id JOIN (SELECT reach_id, list(qr ORDER BY hour_idx) AS lat FROM dense GROUP BY reach_id) l ON l.reach_id = r.reach_id)
, step AS (
  SELECT CAST(0 AS BIGINT) AS d, reach_id, CAST([] AS DOUBLE[]) AS hy, CAST([] AS DOUBLE[]) AS hu FROM stat
  UNION ALL
  SELECT d + 1, reach_id, CASE WHEN t < 0 THEN hy ELSE list_prepend(CASE WHEN t < 720 THEN
      RESPONSE END, hy)[1:keep] END, CASE WHEN t < 0 THEN hu ELSE HISTORY END
  FROM (SELECT g.d, g.reach_id, g.d - c.level AS t, g.hy, g.hu, g.sy, c.lat, c.keep, c.taps
    FROM (SELECT d, target AS reach_id, any_value(hy) AS hy, any_value(hu) AS hu, sum(yc) AS sy
      FROM (SELECT s.d, CASE WHEN i = 0 THEN s.reach_id ELSE c.down_id END AS target, CASE WHEN i = 0 THEN s.hy END AS hy, CASE WHEN i = 0 THEN s.hu END AS hu,
          CASE WHEN i = 0 THEN 0e0 ELSE coalesce(s.hy[c.down_level - c.level], 0e0) END AS yc
        FROM step s JOIN stat c ON c.reach_id = s.reach_id CROSS JOIN range(2) two(i) WHERE i = 0 OR c.down_id IS NOT NULL)
      GROUP BY d, target) g JOIN stat c ON c.reach_id = g.reach_id)
  WHERE d < 720 + (SELECT max(level) FROM shape))
, routed AS (SELECT s.reach_id, s.d - 1 - c.level AS hour_idx, s.hy[1] AS q FROM step s JOIN stat c ON c.reach_id = s.reach_id
  WHERE s.d - 1 - c.level BETWEEN 0 AND 719)
SELECT g.staid, CAST(floor(o.hour_idx / 24) AS BIGINT) AS day, round(avg(o.q), 6) AS q FROM gauge g JOIN routed o ON o.reach_id = g.reach_id
WHERE g.reach_id IN (SELECT down_id FROM reach WHERE down_id IS NOT NULL) GROUP BY 1, 2"""
)


def linear_sql(step: str, history: str = "[lat[t + 1] + sy]", taps: str = "NULL") -> str:
    return LTI_SQL.replace("RESPONSE", step).replace("HISTORY", history).replace("TAPS", taps)


# Any response: dot product with the inflow of the last hours. The taps are the density of the
# diffusive wave at mid-hour, k = 0.1042 d, x = 0.3, scaled to sum to one; after 60 hours 1e-11 of it is left.
HAYAMI_HOURS = 60
HAYAMI_TAPS = f"""(SELECT list_transform(h, lambda v: v / list_sum(h)) FROM (SELECT list_transform(range({HAYAMI_HOURS}), lambda i:
  sqrt(0.1042e0 * 0.1042e0 / (4 * pi() * 0.02084e0 * power((i + 0.5e0) / 24, 3)))
  * exp(-power((i + 0.5e0) / 24 - 0.1042e0, 2) / (4 * 0.02084e0 * (i + 0.5e0) / 24)) / 24) AS h))"""
HAYAMI_STEP = f"list_dot_product(list_prepend(lat[t + 1] + sy, hu)[1:{HAYAMI_HOURS}], taps[1:least(t + 1, {HAYAMI_HOURS})])"


@query("x_lti_storage", with_tables("reach", "inflow_hourly", "gauge", recursive=True, body=linear_sql(STORE_STEP)))
def x_lti_storage(spark, sf_dir):
    return _lti(spark, sf_dir, "linear_storage").withColumn("q", F.round("q", 6))


@query(
    "x_state_carried",
    with_tables("reach", "inflow_hourly", recursive=True, body=ROUTED + "SELECT reach_id, round(q, 4) AS q FROM routed WHERE hour_idx = 719"),
)
def x_state_carried(spark, sf_dir):
    """Two runs of fifteen days, the second from the state of the first; one row per reach."""
    from dataclasses import replace

    from rillflow.operators.routing import final_state

    t = network(spark, sf_dir)
    inflow = table(spark, sf_dir, "inflow_hourly")
    scheme = Scheme(n_hours=361, chunk=240)
    half = route(t["plan"], _params(spark, sf_dir), inflow, START, scheme)
    later = route(
        t["plan"], _params(spark, sf_dir), inflow, datetime(2024, 1, 16), replace(scheme, n_hours=360, carry=True), final_state(half, scheme)
    )
    return final_state(later, replace(scheme, n_hours=360)).select("reach_id", F.round("q", 4).alias("q"))


@query("x_lti_muskingum", with_tables("reach", "inflow_hourly", "gauge", recursive=True, body=linear_sql(MUSKINGUM_STEP)))
def x_lti_muskingum(spark, sf_dir):
    return _lti(spark, sf_dir, "muskingum").withColumn("q", F.round("q", 6))


@query(
    "x_lti_hayami",
    with_tables(
        "reach",
        "inflow_hourly",
        "gauge",
        recursive=True,
        body=linear_sql(HAYAMI_STEP, f"list_prepend(lat[t + 1] + sy, hu)[1:{HAYAMI_HOURS - 1}]", HAYAMI_TAPS),
    ),
)
def x_lti_hayami(spark, sf_dir):
    return _lti(spark, sf_dir, "hayami").withColumn("q", F.round("q", 6))


SHAPE = kan.KanShape(cleaning.NATIVE_ATTRIBUTES, ("n", "q_spatial", "p_spatial"), hidden=21, layers=2, grid=10, k=2)


class StandIn:
    """The stand-in tables behind the interface of a data set."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def flow(self):
        return flow(self.spark, self.dir)

    def reaches(self):
        return table(self.spark, self.dir, "reach").select("reach_id", "length_m", "slope", "x", "top_width", "side_slope")

    def attributes(self):
        return _native(self.spark, self.dir)

    def inflow(self):
        return table(self.spark, self.dir, "inflow_daily").select("reach_id", F.col("d").cast("timestamp_ntz").alias("ts"), "qr")

    def gauges(self):
        return table(self.spark, self.dir, "gauge")

    def observations(self):
        return table(self.spark, self.dir, "observed")


def _learned(spark, sf_dir):
    names = list(SHAPE.inputs)
    native = _native(spark, sf_dir)
    stats = cleaning.attribute_moments(native, names)
    joined = cleaning.join_attributes(flow(spark, sf_dir).select("reach_id"), native, names)
    return kan.predict(cleaning.fill_and_standardize(joined, stats, names), SHAPE, kan.initial_weights(SHAPE, 42))


def _numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}" if "e" in repr(float(v)) else f"{float(v)!r}e0" for v in values) + "]"


def network_sql() -> str:
    """The spline network as list arithmetic: quadratic B-splines in their piecewise form."""
    w = kan.initial_weights(SHAPE, 42)
    first, h = float(kan.knots(SHAPE)[0]), 2.0 / SHAPE.grid
    count = SHAPE.grid + SHAPE.k
    u = f"((v - ({first!r}e0)) / {h!r}e0 - b)"
    bump = (
        f"CASE WHEN {u} >= 0 AND {u} < 1 THEN {u} * {u} / 2 WHEN {u} >= 1 AND {u} < 2 THEN (-2 * {u} * {u} + 6 * {u} - 3) / 2 "
        f"WHEN {u} >= 2 AND {u} < 3 THEN (3 - {u}) * (3 - {u}) / 2 ELSE 0e0 END"
    )
    scores = ", ".join(f"(coalesce({n}, m_{n}) - m_{n}) / s_{n}" for n in SHAPE.inputs)
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in SHAPE.inputs)
    hidden = range(SHAPE.hidden)
    linear = ", ".join(f"list_dot_product(z, {_numbers(w['in_w'][o])}) + ({float(w['in_b'][o])!r}e0)" for o in hidden)
    out = f""", z AS (SELECT reach_id, [{scores}] AS z FROM native, (SELECT {moments} FROM native) s)
, a0 AS (SELECT reach_id, [{linear}] AS a FROM z)
"""
    for i in range(SHAPE.layers):
        mix = w[f"scale_{i}"][..., None] * w[f"coef_{i}"]
        rows = ", ".join(
            f"list_dot_product(smooth, {_numbers(w[f'base_{i}'][o])}) + list_dot_product(bumps, {_numbers(mix[o].ravel())})" for o in hidden
        )
        out += f""", f{i} AS (SELECT reach_id, list_transform(a, lambda v: v / (1 + exp(-v))) AS smooth,
  flatten(list_transform(a, lambda v: list_transform(range({count}), lambda b: {bump}))) AS bumps FROM a{i})
, a{i + 1} AS (SELECT reach_id, [{rows}] AS a FROM f{i})
"""
    final = ", ".join(
        f"1 / (1 + exp(-(list_dot_product(a, {_numbers(w['out_w'][o])}) + ({float(w['out_b'][o])!r}e0)))) AS {n}" for o, n in enumerate(SHAPE.outputs)
    )
    return out + f", learned AS (SELECT reach_id, {final} FROM a{SHAPE.layers})\n"


@query(
    "m_kan",
    with_tables("attributes", body=NATIVE + network_sql() + "SELECT reach_id, " + ", ".join(f"round({n}, 8) AS {n}" for n in SHAPE.outputs) + " FROM learned"),
)
def m_kan(spark, sf_dir):
    return _learned(spark, sf_dir).select("reach_id", *[F.round(n, 8).alias(n) for n in SHAPE.outputs])


@query(
    "x_geometry",
    with_tables(
        "attributes",
        "reach",
        body=NATIVE
        + network_sql()
        + """, phys AS (SELECT r.reach_id, greatest(r.slope, 0.001e0) AS slope, 0.5e0 + r.length_m / 1000 AS flow, l.n * (0.25e0 - 0.015e0) + 0.015e0 AS n,
            l.q_spatial AS q, exp(l.p_spatial * (ln(200e0) - ln(1.000001e0)) + ln(1.000001e0)) AS p FROM reach r JOIN learned l USING (reach_id))
          """
        + PHYSICAL[PHYSICAL.index(", d0 AS") : PHYSICAL.index(", cel AS")]
        + "SELECT reach_id, round(n, 6) AS n, round(p, 5) AS p_spatial, round(q, 6) AS q_spatial, "
        + ", ".join(f"round({c}, 5) AS {c}" for c in GEO_COLUMNS)
        + " FROM geo",
    ),
)
def x_geometry(spark, sf_dir):
    native = _native(spark, sf_dir)
    stats = cleaning.attribute_moments(native, list(SHAPE.inputs))
    at = table(spark, sf_dir, "reach").select("reach_id", "slope", (F.lit(0.5) + F.col("length_m") / 1000).alias("q"))
    out = prob.geometry_prediction(native, stats, SHAPE, kan.initial_weights(SHAPE, 42), at)
    digits = {"n": 6, "q_spatial": 6}
    return out.select("reach_id", *[F.round(c, digits.get(c, 5)).alias(c) for c in out.columns if c != "reach_id"])


@query("x_evaluate")
def x_evaluate(spark, sf_dir):
    """Network to scores: learned parameters, routing of all gauges' basins, daily means, 18 scores."""
    source = StandIn(spark, sf_dir)
    problem = prob.build_problem(
        source, date(2024, 1, 1), date(2024, 1, 30), hold=24, batch=source.gauges(), limit=network(spark, sf_dir)["limit"]
    )
    stats = cleaning.attribute_moments(source.attributes(), list(SHAPE.inputs))
    unit = prob.predict_parameters(problem, source.attributes(), stats, SHAPE, kan.initial_weights(SHAPE, 42))
    routed = prob.run(problem, prob.channel_parameters(problem, unit), source.inflow(), keep=problem.outflow)
    _, scores = prob.evaluate(problem, routed, source.observations(), warmup=3)
    return scores


@query("x_train_step")
def x_train_step(spark, sf_dir):
    """Loss before and after one optimiser step on the gauges that have complete observations."""
    from rillflow.operators.gauges import complete_gauges
    from rillflow.plans.training import Trainer

    source = StandIn(spark, sf_dir)
    full = source.observations().groupBy("staid").agg(F.count("*").alias("n")).filter("n = 30").select("staid")
    full = full.join(by_key(complete_gauges(source.observations())), "staid", "left_semi")
    problem = prob.build_problem(
        source, date(2024, 1, 1), date(2024, 1, 30), hold=24, batch=full, limit=network(spark, sf_dir)["limit"]
    )
    stats = cleaning.attribute_moments(source.attributes(), list(SHAPE.inputs))
    trainer = Trainer(SHAPE, kan.initial_weights(SHAPE, 42), kan.Adam(rate=0.005))
    args = (problem, source.attributes(), stats, source.inflow(), source.observations())
    losses = [trainer.step(*args) for _ in range(2)]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "step int, loss double")


@query(
    "b_stream_route",
    with_tables(
        "reach",
        "inflow_hourly",
        recursive=True,
        body=ROUTED.replace("coalesce(i.qr, 0.001)", "coalesce(i.qr, 0e0)")
        + """SELECT reach_id, CAST(DATE '2024-01-01' + CAST(floor(hour_idx / 24) AS INT) AS DATE) AS d, round(avg(q), 4) AS discharge
          FROM routed WHERE hour_idx BETWEEN 1 AND (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', max(ts)) FROM events) GROUP BY 1, 2""",
    ),
)
def b_stream_route(spark, sf_dir):
    """The event file as a stream, routed hour by hour behind the watermark.

    Unlike the batch run, hours without events carry no inflow, and the values stand at the
    end of each hour.
    """
    from rillflow.streaming.stepwise import StepRouter, stream_router

    t = network(spark, sf_dir)
    events = base(spark, sf_dir, "events")
    n = base(spark, sf_dir, "part").count()
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet").select(
        (F.col("event_id") % n + 1).alias("reach_id"), "ts", (F.col("value") * 0.1).alias("flow")
    )
    router = StepRouter(t["plan"], _params(spark, sf_dir))
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    q = stream_router(stream, router, START, out, check, "0 seconds")
    q.processAllAvailable()
    q.stop()
    done = spark.read.parquet(f"{out}/epoch=*")
    hour = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    day = F.date_add(F.lit(date(2024, 1, 1)), F.floor(hour / 24).cast("int"))
    return done.groupBy("reach_id", day.alias("d")).agg(F.round(F.avg("discharge"), 4).alias("discharge"))


@query(
    "b_stream_daily",
    """SELECT CAST(ts AS DATE) AS d, CAST(event_id % (SELECT count(*) FROM part) + 1 AS BIGINT) AS reach_id, round(avg(value) * 0.1, 7) AS qr
      FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2""",
)
def b_stream_daily(spark, sf_dir):
    """Daily mean inflow as a tumbling window over the event stream; the open last day is held back."""
    events = base(spark, sf_dir, "events")
    n = base(spark, sf_dir, "part").count()
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    # days of the session's time zone
    midnight = spark.range(1).select(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) % 86400).head()[0]
    daily = (
        stream.select((F.col("event_id") % n + 1).alias("reach_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
        .withWatermark("ts", "0 seconds")
        .groupBy(F.window("ts", "1 day", startTime=f"{midnight} seconds").alias("w"), "reach_id")
        .agg(F.round(F.avg("value") * 0.1, 7).alias("qr"))
        .select(F.to_date(F.col("w.start")).alias("d"), "reach_id", "qr")
    )
    out = scratch_path(spark, "daily")
    q = daily.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "daily-checkpoint")).start(out)
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("d date, reach_id bigint, qr double").parquet(out)


COMPARED = (
    ROUTED
    + """, bridge AS (SELECT g.staid, w.reach_id FROM gauge g JOIN walk w ON w.below_id = g.reach_id)
, days AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS d FROM range(30) t(i))
, mc AS (SELECT g.staid, CAST(DATE '2024-01-01' + CAST(floor(o.hour_idx / 24) AS INT) AS DATE) AS d, sum(o.q) / 24 AS pred FROM gauge g
    JOIN reach r ON r.down_id = g.reach_id JOIN routed o ON o.reach_id = r.reach_id GROUP BY 1, 2)
, summed AS (SELECT g.staid, days.d, coalesce(s.q, 0.0) AS pred FROM gauge g CROSS JOIN days
    LEFT JOIN (SELECT b.staid, i.d, sum(i.qr) AS q FROM bridge b JOIN inflow_daily i ON i.reach_id = b.reach_id GROUP BY 1, 2) s ON s.staid = g.staid AND s.d = days.d)
"""
)


def _models(spark, sf_dir):
    from catalog.network_queries import _summed

    scheme = Scheme(n_hours=HOURS, chunk=240)
    t = network(spark, sf_dir)
    g = table(spark, sf_dir, "gauge")
    day = F.date_add(F.lit(date(2024, 1, 1)), F.floor(F.col("hour_idx") / 24).cast("int"))
    outflow = store(gauge_outflow(g, t["pairs"]), "outflow")
    series = gauge_hydrographs(_routed(spark, sf_dir, scheme, outflow), outflow, START, scheme)
    daily = series.groupBy("staid", day.alias("d")).agg(F.avg("q").alias("pred"))
    links = g.join(by_key(t["pairs"].select(F.col("dn_id").alias("reach_id"))), "reach_id", "left_semi")
    return {"muskingum_cunge": comparison.without_headwaters(daily, links), "summed": _summed(spark, sf_dir)}


@query(
    "x_benchmark",
    with_tables(
        "reach",
        "inflow_hourly",
        "inflow_daily",
        "gauge",
        "observed",
        recursive=True,
        body=COMPARED
        + """, stacked AS (SELECT 'muskingum_cunge' AS model, staid, d, pred FROM mc UNION ALL
            SELECT 'summed', s.staid, s.d, s.pred FROM summed s JOIN mc ON mc.staid = s.staid AND mc.d = s.d)
        , pair AS (SELECT b.*, o.streamflow AS t, avg(o.streamflow) OVER (PARTITION BY b.model, b.staid) AS tm FROM stacked b
            LEFT JOIN observed o ON o.staid = b.staid AND o.d = b.d)
        SELECT model, staid, count(t) AS n, round(avg(pred - t), 4) AS bias, round(sqrt(avg((pred - t) * (pred - t))), 4) AS rmse,
          round(1 - sum((t - pred) * (t - pred)) / sum((t - tm) * (t - tm)), 4) AS nse FROM pair GROUP BY 1, 2""",
    ),
)
def x_benchmark(spark, sf_dir):
    """Routed and unrouted predictions at the gauges and days that both have."""
    obs = table(spark, sf_dir, "observed")
    out = comparison.compare(_models(spark, sf_dir), obs)
    return out.select("model", "staid", "n", *[F.round(c, 4).alias(c) for c in ("bias", "rmse", "nse")])


@query(
    "x_mass_balance",
    with_tables(
        "reach",
        "inflow_hourly",
        "inflow_daily",
        "gauge",
        recursive=True,
        body=COMPARED
        + """SELECT s.staid, round(CASE WHEN sum(s.pred) = 0 THEN 1.0 ELSE abs(sum(mc.pred) - sum(s.pred)) / sum(s.pred) END, 5) AS mass_error
          FROM summed s JOIN mc ON mc.staid = s.staid AND mc.d = s.d GROUP BY 1""",
    ),
)
def x_mass_balance(spark, sf_dir):
    m = _models(spark, sf_dir)
    return comparison.balance(m["muskingum_cunge"], m["summed"]).select("staid", F.round("mass_error", 5).alias("mass_error"))


@query(
    "i_resolve",
    with_tables(
        "nexus_network",
        body="""SELECT raw, CASE WHEN raw LIKE 'wb-%' THEN raw WHEN EXISTS (SELECT 1 FROM nexus_network n WHERE n.id = 'wb-' || CAST(TRY_CAST(substr(raw, 5) AS DOUBLE) AS BIGINT))
            THEN 'wb-' || CAST(TRY_CAST(substr(raw, 5) AS DOUBLE) AS BIGINT) END AS id
          FROM (SELECT CASE WHEN substr(id, 4)::INT % 3 = 0 THEN 'cat-' || substr(id, 4) || '.0' ELSE id END AS raw FROM nexus_network WHERE id LIKE 'wb-%')""",
    ),
)
def i_resolve(spark, sf_dir):
    """Ids in another spelling found by their number."""
    from rillflow.operators.network import resolve_ids

    wb = table(spark, sf_dir, "nexus_network").filter(F.col("id").startswith("wb-"))
    number = F.expr("substring(id, 4)")
    raw = F.when(number.cast("int") % 3 == 0, F.concat(F.lit("cat-"), number, F.lit(".0"))).otherwise(F.col("id"))
    return resolve_ids(wb.select(raw.alias("raw")), wb)
