"""Whole runs behind the command line: build, summed inflow, route, test, train, geometry."""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow import __version__
from rillflow.config import Config
from rillflow.functions.ids import number_of
from rillflow.operators import baseline, cleaning, gauges, kan, network, resample, summaries
from rillflow.operators.kernel import Scheme
from rillflow.operators.metrics import all_scores, summarize
from rillflow.operators.pieces import numbered_pieces
from rillflow.operators.topology import check_dendritic, join_link, topology, topology_without_cycles
from rillflow.plans import problem as prob
from rillflow.plans.accumulation import daily_discharge
from rillflow.scratch import by_key, store
from rillflow.sources import readers, sinks


class TableSource:
    """Data set that lives in canonical parquet tables."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.where = spark, config, config.data_sources

    def flow(self) -> DataFrame:
        return readers.read_network(self.spark, self.where.network)[0].select("reach_id", "down_id")

    def pairs(self) -> DataFrame:
        return readers.read_network(self.spark, self.where.network)[1]

    def reaches(self) -> DataFrame:
        return readers.read_table(self.spark, self.where.reaches)

    def attributes(self) -> DataFrame:
        raw = readers.read_table(self.spark, self.where.attributes)
        names = self.config.kan.input_var_names
        return raw if set(names) <= set(raw.columns) else cleaning.adapt_attributes(raw)

    def statistics(self) -> DataFrame:
        return sinks.cached_statistics(self.attributes(), list(self.config.kan.input_var_names), self.where.statistics)

    def inflow(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Inflow of [start, end); the period prunes the months and is pushed to the scan.

        A period that the store does not cover is an error, and so are two values for one reach and time.
        """
        if start is not None and end is not None:
            step = timedelta(hours=1) if self.where.is_hourly else timedelta(days=1)
            resample.check_coverage(readers.read_table(self.spark, self.where.streamflow), "ts", start, end, step)
        return readers.single_values(readers.read_period(self.spark, self.where.streamflow, start, end))

    def gauges(self) -> DataFrame:
        return readers.checked_gauges(readers.read_gauges(self.spark, self.where.gages), with_reach=True)

    def observations(self) -> DataFrame:
        return readers.read_table(self.spark, self.where.observations)


prob.register_source("tables", TableSource)


def build_network(reaches: DataFrame, path: str, dataset: str, gauge_table: DataFrame | None = None) -> int:
    """Write order, adjacency and gauge subsets of integer-id reaches; cycles are removed first."""
    flow = store(network.flow_from_reaches(reaches), "flow")
    if not check_dendritic(flow).isEmpty():
        raise ValueError("a reach has more than one downstream reach")
    flow, topo = topology_without_cycles(flow)
    order = store(network.ordered(flow, topo), "order")
    pairs = store(network.adjacency(order), "pairs")
    sinks.write_network(order, pairs, path, dataset)
    attributes = sinks.merit_attributes(order, reaches)
    if attributes is not None:
        attributes.write.mode("errorifexists").parquet(f"{path}/reaches")
    if gauge_table is None:
        return 0
    pieces = numbered_pieces(topo).order
    sinks.write_labelled_pairs(pairs, pieces, path)
    return sinks.write_gauge_subsets(gauge_table, pieces, order, path)


def build_string_network(
    flowpaths: DataFrame, table: DataFrame, path: str, dataset: str, attributes: DataFrame | None = None, gauge_table: DataFrame | None = None
) -> int:
    """Write order, adjacency, attributes and gauge subsets of flowpaths with string ids (``id, toid``).

    ``table`` links flowpaths and junctions. The order keeps the id; ``reach_id`` is the number behind its
    dash. Gauges are placed on the flowpath that carries their mark.
    """
    ids = store(network.numbered_ids(flowpaths), "ids")
    flow = store(network.string_flow(ids, table), "flow")
    if not check_dendritic(flow).isEmpty():
        raise ValueError("a flowpath has more than one downstream flowpath")
    flow, topo = topology_without_cycles(flow)
    number = ids.select("reach_id", "id", number_of(F.col("id")).cast("long").alias("number"))
    if not number.groupBy("number").agg(F.count("*").alias("n")).filter("n > 1 or number is null").isEmpty():
        raise ValueError("the numbers of the flowpath ids are not distinct")
    dense = store(network.ordered(flow, topo), "order")
    named = number.select(F.col("reach_id").alias("down_id"), F.col("number").alias("down_number"))
    known = number.join(by_key(topo.select("reach_id", "size")), "reach_id")
    order = join_link(dense.join(by_key(known), "reach_id"), "down_id", "reach_id", named)
    columns = "id", F.col("number").alias("reach_id"), F.col("down_number").alias("down_id"), "level", "topo_idx", "size"
    sized = store(order.select(*columns), "named-order")
    order = sized.drop("size")
    pairs = store(network.adjacency(order), "pairs")
    sinks.write_network(order, pairs, path, dataset)
    if attributes is not None:
        sinks.flowpath_attributes(order, flowpaths, attributes).write.mode("errorifexists").parquet(f"{path}/reaches")
    if gauge_table is None:
        return 0
    lost = network.gauges_without_origin(gauge_table, table).select("staid")
    placed = network.gauge_origin(gauge_table.join(lost, "staid", "left_anti"), table, flowpaths)
    found = placed.join(order.select("id", "reach_id"), "id").select("staid", "reach_id")
    # the same forest under other names, so levels and sizes hold
    pieces = numbered_pieces(sized.select("reach_id", "down_id", "level", "size")).order
    sinks.write_labelled_pairs(pairs, pieces, path)
    return sinks.write_gauge_subsets(found, pieces, order, path)


def _shape(config: Config) -> kan.KanShape:
    k = config.kan
    return kan.KanShape(tuple(k.input_var_names), tuple(k.learnable_parameters), k.hidden_size, k.num_hidden_layers, k.grid, k.k)


def _model(spark: SparkSession, config: Config):
    if config.experiment.checkpoint:
        shape, weights, *_ = kan.load_checkpoint(spark, config.experiment.checkpoint)
        return shape, weights
    shape = _shape(config)
    return shape, kan.initial_weights(shape, config.seed)


def _period(config: Config) -> tuple[datetime, datetime]:
    """First midnight of the period and the midnight after its last day."""
    first, last = config.experiment.first, config.experiment.last
    return datetime.combine(first, datetime.min.time()), datetime.combine(last, datetime.min.time()) + timedelta(days=1)


def summed(spark: SparkSession, config: Config) -> DataFrame:
    """Unrouted baseline against observations; writes series and score report."""
    source = TableSource(spark, config)
    flow, wanted = source.flow(), source.gauges()
    stored = f"{source.where.network}/gauges"
    if readers.path_exists(spark, stored):
        wanted = gauges.in_store(wanted, readers.read_table(spark, stored))
    days = resample.daily_calendar(spark, config.experiment.first, config.experiment.last)
    inflow = source.inflow(*_period(config))
    if config.data_sources.is_hourly:
        inflow = resample.hourly_to_daily(inflow, "reach_id", "ts", "qr")
    else:
        inflow = inflow.select("reach_id", F.to_date("ts").alias("d"), "qr")
    topo, segment = baseline.gauge_structure(flow, wanted)
    lacking = resample.unmatched_days(days, inflow.select("d").distinct())
    n_lacking = lacking.count()
    if n_lacking:
        warnings.warn(f"{n_lacking} days of the period have no inflow at all", stacklevel=2)
    pred = baseline.summed_inflow(inflow, wanted, days, topo, segment)
    both = store(baseline.with_observations(pred, source.observations()), "summed")
    sinks.write_results(both, f"{config.params.save_path}/summed_q_prime", version=__version__)
    scores = store(all_scores(both, "staid", "d"), "scores")
    sinks.write_score_report(scores, config.params.save_path, config.experiment.start_time, config.experiment.end_time)
    return summarize(scores)


def _routed(spark: SparkSession, config: Config, source: TableSource, batch: DataFrame | None, at_gauges: bool = False):
    targets = None
    if config.data_sources.target_catchments:
        # ids may come as "cat-12" or bare numbers
        ids = [(int(str(t).split("-")[-1]),) for t in config.data_sources.target_catchments]
        targets, batch = spark.createDataFrame(ids, "reach_id bigint"), None
    hold = 1 if config.data_sources.is_hourly else 24
    problem = prob.build_problem(
        source, config.experiment.first, config.experiment.last, hold=hold, targets=targets, batch=batch,
        physics=config.physics,
    )
    shape, weights = _model(spark, config)
    unit = prob.predict_parameters(problem, source.attributes(), source.statistics(), shape, weights)
    params = prob.channel_parameters(problem, unit)
    return problem, prob.run(problem, params, source.inflow(*_period(config)), keep=problem.outflow if at_gauges else None)


def route(spark: SparkSession, config: Config) -> DataFrame:
    """Route the targets, or the gauges, or everything; writes hourly discharge."""
    source = TableSource(spark, config)
    batch = source.gauges() if config.data_sources.gages else None
    problem, routed = _routed(spark, config, source, batch)
    long = prob.long_discharge(problem, routed)
    sinks.write_by_month(long.select("reach_id", "ts", "q"), f"{config.params.save_path}/chrout", mode="overwrite")
    return summaries.routing_summary(long)


def test(spark: SparkSession, config: Config) -> DataFrame:
    """Route the gauges' basins and score daily means; writes series and report."""
    source = TableSource(spark, config)
    problem, routed = _routed(spark, config, source, source.gauges(), at_gauges=True)
    both, scores = prob.evaluate(problem, routed, source.observations(), config.experiment.warmup, config.params.tau)
    sinks.write_results(both, f"{config.params.save_path}/model_test", version=__version__)
    scores = store(scores, "scores")
    sinks.write_score_report(scores, config.params.save_path, config.experiment.start_time, config.experiment.end_time)
    return summaries.score_log(scores)


def train(spark: SparkSession, config: Config) -> str:
    """Random windows of random gauge batches; a checkpoint after each step. Returns the last one."""
    from rillflow.plans.training import Trainer

    source = TableSource(spark, config)
    exp = config.experiment
    wanted = source.gauges()
    headed = wanted.join(source.pairs().select(F.col("dn_id").alias("reach_id")), "reach_id", "left_semi")
    usable = gauges.training_gauges(wanted.select("staid"), wanted, headed, exp.max_area_diff_sqkm)
    shape = _shape(config)
    weights, adam, first_epoch, next_batch = kan.initial_weights(shape, config.seed), kan.Adam(), 1, 0
    if exp.checkpoint:
        shape, weights, adam, first_epoch, done, _ = kan.load_checkpoint(spark, exp.checkpoint)
        next_batch = done + 1
    trainer = Trainer(shape, weights, adam, config.params.tau, exp.warmup)
    n_days = (exp.last - exp.first).days + 1
    rho = exp.rho or n_days
    hold = 1 if config.data_sources.is_hourly else 24
    last = exp.checkpoint or ""
    for epoch in range(first_epoch, exp.epochs + 1):
        batches = store(gauges.sample_batches(usable, exp.batch_size, config.seed + epoch), "batches")
        n_batches = batches.agg(F.max("batch")).head()[0]
        for b in range(next_batch, (n_batches if n_batches is not None else -1) + 1):
            start, end = resample.random_window(exp.first, n_days, rho, config.seed * 1_000_003 + epoch * 1009 + b)
            one = batches.filter(F.col("batch") == b).select("staid")
            hours = (end - start).days * 24
            problem = prob.build_problem(source, start, end, chunk_hours=hours, hold=hold, batch=one, physics=config.physics)
            midnight = datetime.min.time()
            inflow = source.inflow(datetime.combine(start, midnight), datetime.combine(end, midnight) + timedelta(days=1))
            try:
                trainer.step(
                    problem, source.attributes(), source.statistics(), inflow, source.observations(),
                    kan.learning_rate({int(k): v for k, v in exp.learning_rate.items()}, epoch),
                )
            except ValueError as exc:
                if "complete observations" not in str(exc):
                    raise
                continue  # no gauge of this batch can be scored in this window
            last = f"{config.params.save_path}/checkpoints/epoch_{epoch}_batch_{b}"
            kan.save_checkpoint(spark, last, shape, trainer.weights, trainer.adam, epoch, b, config.seed)
        next_batch = 0
    return last


def train_and_test(spark: SparkSession, config: Config, test_start: str = "1995/10/01", test_end: str = "2010/09/30") -> DataFrame:
    config.experiment.checkpoint = train(spark, config)
    config.experiment.start_time, config.experiment.end_time = test_start, test_end
    return test(spark, config)


def geometry(spark: SparkSession, config: Config) -> DataFrame:
    """Channel geometry statistics of every reach over the period; NULL where there is no inflow."""
    source = TableSource(spark, config)
    flow = source.flow()
    days = resample.daily_calendar(spark, config.experiment.first, config.experiment.last)
    inflow = source.inflow(*_period(config))
    first_hour = inflow.filter(F.hour("ts") == 0).select("reach_id", F.to_date("ts").alias("d"), "qr")
    covered = first_hour.select("reach_id").distinct()
    sub = store(network.target_network(flow, covered), "flow")
    daily = daily_discharge(first_hour, numbered_pieces(topology(sub)), days)
    shape, weights = _model(spark, config)
    names = list(shape.inputs)
    joined = cleaning.join_attributes(flow.select("reach_id"), source.attributes(), names)
    unit = kan.predict(cleaning.fill_and_standardize(joined, source.statistics(), names), shape, weights)
    pseudo = prob.RoutingProblem(flow, flow, 0, source.reaches(), Scheme(1, 1), datetime(1970, 1, 1), physics=config.physics)
    params = store(prob.channel_parameters(pseudo, unit), "params")
    stats = summaries.geometry_statistics(daily, params)
    out = params.select("reach_id", "n", "p_spatial", "q_spatial", "slope").join(stats, "reach_id", "left")
    sinks.write_results(out, f"{config.params.save_path}/geometry_predictions", version=__version__)
    return out
