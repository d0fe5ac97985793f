"""A routing problem as a set of tables, and the jobs that run on it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.hydraulics import DEFAULT_X, MINIMUMS, Physics, physical_parameters
from rillflow.operators import cleaning, kan
from rillflow.operators.gauges import segment_flow_scale
from rillflow.operators.kernel import Scheme
from rillflow.operators.layout import layout
from rillflow.operators.network import gauge_outflow, target_network
from rillflow.operators.resample import after_warmup, daily_runoff
from rillflow.operators.routing import gauge_hydrographs, hourly, route
from rillflow.operators.topology import topology
from rillflow.scratch import by_key, store


class RoutingSource(Protocol):
    """What a data set has to offer; implement it to bring one's own."""

    def flow(self) -> DataFrame: ...  # reach_id, down_id

    def reaches(self) -> DataFrame: ...  # reach_id, length_m, slope [, x, top_width, side_slope]

    def attributes(self) -> DataFrame: ...  # reach_id, one column per attribute

    def inflow(self) -> DataFrame: ...  # reach_id, ts, qr

    def gauges(self) -> DataFrame | None: ...  # staid, reach_id [, area columns]

    def observations(self) -> DataFrame | None: ...  # staid, d, streamflow


SOURCES: dict[str, type] = {}


def register_source(name: str, source: type) -> None:
    SOURCES[name] = source


def source_for(name: str) -> type:
    if name not in SOURCES:
        raise ValueError(f"unknown data set {name!r}; available: {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


@dataclass
class RoutingProblem:
    flow: DataFrame
    plan: DataFrame
    limit: int
    reaches: DataFrame
    scheme: Scheme
    start: datetime
    gauges: DataFrame | None = None
    outflow: DataFrame | None = None
    physics: Physics = field(default_factory=Physics)
    extras: dict = field(default_factory=dict)


def piece_limit(n_reaches: int, parallelism: int, low: int = 256, high: int = 4096) -> int:
    """Pieces small enough to occupy all cores, few enough to keep the number of stages low, bounded in memory."""
    return max(low, min(high, n_reaches // max(1, parallelism)))


def build_problem(
    source: RoutingSource,
    start: date,
    end: date,
    chunk_hours: int = 720,
    hold: int = 1,
    targets: DataFrame | None = None,
    batch: DataFrame | None = None,
    limit: int | None = None,
    physics: Physics | None = None,
) -> RoutingProblem:
    """Problem for the given targets, for a batch of gauges, or for all reaches.

    The hourly calendar is left-closed: N days give (N-1)*24 steps. Only the reaches that
    can influence the output are routed.
    """
    flow = source.flow()
    gauges = None
    if targets is not None:
        flow = store(target_network(flow, targets.select("reach_id")), "flow")
    elif batch is not None:
        gauges = source.gauges().join(by_key(batch.select("staid")), "staid", "left_semi")
        flow = store(target_network(flow, gauges.select("reach_id")), "flow")
    topo = topology(flow)
    n = topo.count()
    if n == 0:
        raise ValueError("the network of this problem is empty")
    limit = limit or piece_limit(n, flow.sparkSession.sparkContext.defaultParallelism)
    start_ts = datetime(start.year, start.month, start.day)
    scheme = Scheme(n_hours=(end - start).days * 24, chunk=chunk_hours, hold=hold)
    problem = RoutingProblem(flow, layout(topo, limit), limit, source.reaches(), scheme, start_ts, gauges, physics=physics or Physics())
    if gauges is not None:
        links = flow.filter("down_id IS NOT NULL").select(F.col("down_id").alias("dn_id"), F.col("reach_id").alias("up_id"))
        problem.outflow = store(gauge_outflow(gauges, links), "outflow")
    return problem


def channel_parameters(problem: RoutingProblem, unit: DataFrame) -> DataFrame:
    """Physical parameters of each reach from unit-interval ones, measured lengths and slopes.

    Reaches are aligned to the problem first; then missing lengths, slopes and weights, of absent
    reaches too, take the mean of the finite ones of the problem. A value that stays missing is an
    error. With gauges the inflow of a gauge's own reach is scaled to the part above the gauge.
    """
    p_unit = F.col("p_spatial") if "p_spatial" in unit.columns else None
    p = physical_parameters(F.col("n"), F.col("q_spatial"), p_unit, problem.physics)
    unit = unit.select("reach_id", *[c.alias(n) for n, c in p.items()])
    reaches = problem.reaches
    if "x" not in reaches.columns:
        reaches = reaches.withColumn("x", F.lit(DEFAULT_X))
    names = ["length_m", "slope", "x"]
    aligned = problem.plan.select("reach_id").join(by_key(reaches.select("reach_id", *names)), "reach_id", "left")
    params = cleaning.fill_with_finite_mean(aligned, names).join(by_key(unit), "reach_id", "left")
    params = cleaning.require_values(params, [*names, *p])
    if problem.gauges is not None:
        batch = problem.gauges.select("staid", "reach_id", F.col("staid").alias("pos"))
        scale = segment_flow_scale(batch, problem.gauges)
        params = params.join(by_key(scale), "reach_id", "left").withColumn("flow_scale", F.coalesce("flow_scale", F.lit(1.0)))
    return params


def predict_parameters(problem: RoutingProblem, attributes: DataFrame, stats: DataFrame, shape: kan.KanShape, weights):
    """Unit-interval parameters of every reach of the problem."""
    names = list(shape.inputs)
    joined = cleaning.join_attributes(problem.plan.select("reach_id"), attributes, names)
    return kan.predict(cleaning.fill_and_standardize(joined, stats, names), shape, weights)


def run(
    problem: RoutingProblem, params: DataFrame, inflow: DataFrame, state: DataFrame | None = None, keep: DataFrame | None = None
) -> DataFrame:
    """Routed chunks ``reach_id, chunk, q`` of all reaches, or of those in ``keep`` (see ``route``)."""
    scheme = replace(problem.scheme, carry=state is not None)
    wanted = problem.plan.select("reach_id")
    return route(
        problem.plan, params, inflow.join(by_key(wanted), "reach_id", "left_semi"), problem.start, scheme, state, keep=keep
    )


def gauge_daily(problem: RoutingProblem, routed: DataFrame, tau: int = 3, start_offset: int | None = None) -> DataFrame:
    """``staid, d, pred``: daily means of the trimmed gauge hydrographs.

    The first mean belongs to the second day of the period, as the first hours are cut off.
    """
    series = gauge_hydrographs(routed, problem.outflow, problem.start, problem.scheme)
    daily = daily_runoff(series, "staid", "hour_idx", "q", problem.scheme.n_hours, tau, start_offset)
    first = F.lit((problem.start + timedelta(days=1)).date())
    return daily.select("staid", F.date_add(first, F.col("day").cast("int")).alias("d"), F.col("q").alias("pred"))


def evaluate(problem: RoutingProblem, routed: DataFrame, obs: DataFrame, warmup: int = 0, tau: int = 3):
    """Daily predictions next to observations, and the scores after the warm-up days."""
    from rillflow.operators.baseline import with_observations
    from rillflow.operators.metrics import all_scores

    both = store(with_observations(gauge_daily(problem, routed, tau), obs), "daily")
    first = (problem.start + timedelta(days=1)).date()
    return both, all_scores(after_warmup(both, "d", first, warmup), "staid", "d")


def long_discharge(problem: RoutingProblem, routed: DataFrame) -> DataFrame:
    return hourly(routed, problem.start, problem.scheme)


def geometry_prediction(
    attributes: DataFrame, stats: DataFrame, shape: kan.KanShape, weights, reach_flow: DataFrame, physics: Physics | None = None
) -> DataFrame:
    """Channel geometry of each reach at a given discharge (``reach_id, q, slope``)."""
    from rillflow.functions.hydraulics import at_least, trapezoid

    names = list(shape.inputs)
    native = cleaning.adapt_attributes(attributes) if not set(names) <= set(attributes.columns) else attributes
    unit = kan.predict(cleaning.fill_and_standardize(native.select("reach_id", *names), stats, names), shape, weights)
    p_unit = F.col("p_spatial") if "p_spatial" in unit.columns else None
    p = physical_parameters(F.col("n"), F.col("q_spatial"), p_unit, physics)
    rows = unit.select("reach_id", *[c.alias(n) for n, c in p.items()]).join(reach_flow, "reach_id")
    geo = trapezoid(F.col("n"), F.col("p_spatial"), F.col("q_spatial"), F.col("q"), at_least(F.col("slope"), MINIMUMS["slope"]))
    return rows.select("reach_id", "n", "p_spatial", "q_spatial", *[c.alias(n) for n, c in geo.items()])
