"""Network tables: links, order, adjacency pairs and the pieces gauges need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.ranking import row_numbers
from rillflow.operators.pieces import inside, intervals
from rillflow.operators.topology import join_link, nearest_marked, topology, upstream_of
from rillflow.scratch import by_key


def flow_from_reaches(reaches: DataFrame, id_col: str = "COMID", down_col: str = "NextDownID") -> DataFrame:
    """Flow table of integer-id reaches, where 0 means "no downstream reach"."""
    down = F.col(down_col).cast("long")
    return reaches.select(F.col(id_col).cast("long").alias("reach_id"), F.when(down > 0, down).alias("down_id"))


def upstream_links(reaches: DataFrame, id_col: str = "COMID", up_cols: tuple[str, ...] = ("up1", "up2", "up3", "up4")):
    """One row ``(dn_id, up_id)`` per listed upstream reach; 0 means none."""
    return (
        reaches.select(F.col(id_col).cast("long").alias("dn_id"), *[F.col(c).cast("long").alias(c) for c in up_cols])
        .unpivot("dn_id", list(up_cols), "slot", "up_id")
        .filter(F.col("up_id") > 0)
        .select("dn_id", "up_id")
    )


def upstream_lists(links: DataFrame) -> DataFrame:
    """Sorted list of direct upstream reaches per reach (bounded by the confluence's degree)."""
    return links.groupBy("dn_id").agg(F.sort_array(F.collect_list("up_id")).alias("up_ids"))


def flow_from_links(links: DataFrame, reaches: DataFrame) -> DataFrame:
    """Flow table from upstream links, every reach of ``reaches`` kept."""
    return reaches.select("reach_id").join(
        links.select(F.col("up_id").alias("reach_id"), F.col("dn_id").alias("down_id")), "reach_id", "left"
    )


def collapse_nexus(network: DataFrame) -> DataFrame:
    """Waterbody-to-waterbody links: direct ones and those through a nexus, without repeats."""
    linked = network.filter(F.col("toid").isNotNull())
    water = linked.filter(F.col("id").startswith("wb-"))
    nexus = linked.filter(F.col("id").startswith("nex-") & F.col("toid").startswith("wb-"))
    direct = water.filter(F.col("toid").startswith("wb-")).select(F.col("id").alias("up_id"), F.col("toid").alias("dn_id"))
    through = (
        water.filter(F.col("toid").startswith("nex-"))
        .select(F.col("id").alias("up_id"), F.col("toid").alias("_nexus"))
        .join(nexus.select(F.col("id").alias("_nexus"), F.col("toid").alias("dn_id")), "_nexus")
        .select("up_id", "dn_id")
    )
    return direct.unionByName(through).distinct()


def link_flowpaths(flowpaths: DataFrame, network: DataFrame, ghost: bool = False) -> DataFrame:
    """``id, down`` for flowpaths that drain through a nexus.

    Of several rows for one nexus the smallest target counts. With ``ghost`` every
    nexus without a target gets one shared terminal node ``ghost-<nexus>``.
    """
    targets = network.groupBy(F.col("id").alias("_nexus")).agg(F.min("toid").alias("down"))
    linked = flowpaths.select("id", F.col("toid").alias("_nexus")).join(targets, "_nexus", "left")
    if not ghost:
        return linked.select("id", "down")
    ghost_id = F.concat(F.lit("ghost-"), F.coalesce("_nexus", F.lit("end")))
    linked = linked.select("id", F.coalesce("down", ghost_id).alias("down"))
    ends = linked.filter(F.col("down").startswith("ghost-")).select(F.col("down").alias("id")).distinct()
    return linked.unionByName(ends.withColumn("down", F.lit(None).cast("string")))


def with_terminal(flowpaths: DataFrame, terminal: str = "wb-0") -> DataFrame:
    """Append the virtual terminal flowpath."""
    end = flowpaths.sparkSession.range(1).select(
        *[
            (F.lit(terminal) if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in flowpaths.schema.fields
        ]
    )
    return flowpaths.unionByName(end)


def terminals(flow: DataFrame) -> DataFrame:
    return flow.filter(F.col("down_id").isNull()).select("reach_id")


def isolated(flow: DataFrame) -> DataFrame:
    """Reaches with neither an upstream nor a downstream reach."""
    has_up = flow.filter(F.col("down_id").isNotNull()).select(F.col("down_id").alias("reach_id"))
    return terminals(flow).join(has_up, "reach_id", "left_anti")


def ordered(flow: DataFrame, topo: DataFrame | None = None) -> DataFrame:
    """Topological index from 0: by level, then id, isolated reaches last in id order."""
    topo = topology(flow) if topo is None else topo
    alone = (F.col("size") == 1) & F.col("down_id").isNull()
    ranked = row_numbers(
        topo.select("reach_id", "down_id", "level", "size", alone.cast("int").alias("_alone")),
        [F.col("_alone"), F.col("level"), F.col("reach_id")],
    )
    return ranked.select("reach_id", "down_id", "level", (F.col("rn") - 1).alias("topo_idx"))


def adjacency(order: DataFrame) -> DataFrame:
    """Adjacency pairs: row index = downstream reach, column index = upstream reach."""
    down = order.select(F.col("reach_id").alias("down_id"), F.col("topo_idx").alias("dn_idx"))
    return order.filter(F.col("down_id").isNotNull()).join(by_key(down), "down_id").select(
        F.col("down_id").alias("dn_id"), F.col("reach_id").alias("up_id"), "dn_idx", F.col("topo_idx").alias("up_idx")
    )


def not_lower_triangular(pairs: DataFrame) -> DataFrame:
    """Adjacency pairs above the diagonal or on it (must be empty)."""
    return pairs.filter(F.col("dn_idx") <= F.col("up_idx"))


def dense_adjacency(pairs: DataFrame) -> DataFrame:
    """To-by-from matrix of a small network, for inspection."""
    return pairs.groupBy("dn_id").pivot("up_id").count().na.fill(0)


def gauge_intervals(order: DataFrame, gauges: DataFrame) -> DataFrame:
    """``staid, reach_id, lo, hi``: a gauge's upstream set is a range of the numbers ``pre`` of a piece order."""
    return intervals(order, gauges.select("staid", F.col("reach_id").cast("long").alias("reach_id")))


def gauge_reaches(order: DataFrame, gauges: DataFrame) -> DataFrame:
    """Bridge ``staid, reach_id``: each gauge with every reach at or above it.

    A gauge that is not in the network has its own reach. The rows are as many as asked for, so
    plans that only test for membership use the ranges instead.
    """
    ranges = gauge_intervals(order, gauges).select("staid", "lo", "hi")
    known = inside(ranges, order.select("reach_id", "pre")).select("staid", "reach_id")
    ids = gauges.select("staid", F.col("reach_id").cast("long").alias("reach_id"))
    return known.unionByName(ids.join(by_key(order.select("reach_id")), "reach_id", "left_anti").select("staid", "reach_id"))


def gauge_forest(flow: DataFrame, gauges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow table of gauge reaches alone, and each reach's nearest gauge at or below it."""
    segment = nearest_marked(flow, gauges).filter(F.col("marked_id").isNotNull())
    points = gauges.select(F.col("reach_id").cast("long")).distinct().join(by_key(flow), "reach_id")
    tree = points.join(
        by_key(segment.select(F.col("reach_id").alias("down_id"), F.col("marked_id").alias("next_gauge"))), "down_id", "left"
    ).select("reach_id", F.col("next_gauge").alias("down_id"))
    return tree, segment


def labelled_pairs(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Adjacency pairs with the number ``pre`` of their downstream end."""
    return pairs.join(by_key(order.select(F.col("reach_id").alias("dn_id"), "pre")), "dn_id")


def subset_pairs(ranges: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per gauge the adjacency pairs with both ends in its subset, in full-network indices.

    In a forest the subset is closed upstream, so a pair belongs to it when its
    downstream end does, that is when its number lies in the gauge's range.
    """
    return inside(ranges.select("staid", "lo", "hi"), labelled).select("staid", "dn_id", "up_id", "dn_idx", "up_idx")


def batch_pairs(gauge_pairs: DataFrame, batch: DataFrame) -> DataFrame:
    """Distinct pairs of all gauges of a batch (gauges without a subset contribute nothing)."""
    return gauge_pairs.join(batch.select("staid"), "staid", "left_semi").select("dn_idx", "up_idx").distinct()


def compress(pairs: DataFrame, gauge_idx: DataFrame) -> DataFrame:
    """New dense indices ``0..M-1`` of the indices in use, order kept: ``idx, new_idx``."""
    active = (
        pairs.select(F.explode(F.array("dn_idx", "up_idx")).alias("idx"))
        .unionByName(gauge_idx.select(F.col("topo_idx").alias("idx")))
        .distinct()
    )
    return row_numbers(active, [F.col("idx")]).select("idx", (F.col("rn") - 1).alias("new_idx"))


def gauge_outflow(gauges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reaches whose discharge makes up a gauge's hydrograph.

    Those that drain into the gauge reach, or the gauge reach itself at a headwater.
    """
    ups = pairs.select(F.col("dn_id").alias("_g"), "up_id")
    joined = gauges.select("staid", F.col("reach_id").cast("long").alias("_g")).join(by_key(ups), "_g", "left")
    return joined.select("staid", F.coalesce("up_id", "_g").alias("reach_id"))


def outflow_mismatches(gauges: DataFrame, outflow: DataFrame, flow: DataFrame) -> DataFrame:
    """Gauges whose outflow reaches do not all drain into the gauge reach (must be empty)."""
    g = gauges.select("staid", F.col("reach_id").cast("long").alias("gauge_reach"))
    inside = outflow.join(flow, "reach_id").join(g, "staid")
    wrong = (F.col("reach_id") != F.col("gauge_reach")) & ~F.col("down_id").eqNullSafe(F.col("gauge_reach"))
    return inside.filter(wrong).select("staid", "reach_id")


def target_network(flow: DataFrame, targets: DataFrame) -> DataFrame:
    """Flow table of everything at or above the targets; single reaches are kept."""
    inside = upstream_of(flow, targets)
    rows = inside.join(by_key(flow), "reach_id", "left")
    known = inside.select(F.col("reach_id").alias("down_id"), F.lit(True).alias("_in"))
    return join_link(rows, "down_id", "reach_id", known).select(
        "reach_id", F.when(F.col("_in"), F.col("down_id")).alias("down_id")
    )


def gauge_origin(gauges: DataFrame, network: DataFrame, flowpaths: DataFrame) -> DataFrame:
    """Flowpath of each gauge; of several candidates the closest drainage area wins, then the id.

    A gauge without a candidate fails the job when its row is read; ``gauges_without_origin`` finds them beforehand.
    """
    marks = network.filter(F.col("id").startswith("wb-") & F.col("hl_uri").startswith("gages-")).select(
        "id", F.expr("substring(hl_uri, 7)").alias("staid")
    )
    area = flowpaths.select("id", "tot_drainage_areasqkm")
    near: Column = F.struct(
        F.abs(F.col("tot_drainage_areasqkm") - F.col("drain_sqkm")).alias("diff"), F.col("id").alias("id")
    )
    best = marks.join(area, "id").join(gauges.select("staid", "drain_sqkm"), "staid").groupBy("staid").agg(F.min(near).alias("_best"))
    lost = F.raise_error(F.concat(F.lit("no flowpath carries gauge "), F.col("staid"))).cast("string")
    return gauges.select("staid").distinct().join(best, "staid", "left").select("staid", F.coalesce("_best.id", lost).alias("id"))


def gauges_without_origin(gauges: DataFrame, network: DataFrame) -> DataFrame:
    """Gauges that no flowpath of ``network`` carries."""
    marks = network.filter(F.col("id").startswith("wb-") & F.col("hl_uri").startswith("gages-"))
    return gauges.join(marks.select(F.expr("substring(hl_uri, 7)").alias("staid")), "staid", "left_anti")


def nexus_targets(flowpaths: DataFrame | None, reaches: DataFrame, position: str = "pos") -> DataFrame:
    """Flowpath that receives what arrives at a nexus; of several in ``reaches`` the last row counts.

    ``position`` numbers the rows of the flowpath table. Without such a table a nexus is taken to
    have the id of its reach.
    """
    from rillflow.functions.ids import number_of

    known = reaches.select(F.col("reach_id").cast("long").alias("reach_id"))
    if flowpaths is None:
        return known.select(F.col("reach_id").alias("nexus_id"), "reach_id")
    rows = flowpaths.filter(F.col("toid").startswith("nex-") & (F.col("id").startswith("wb-") | F.col("id").startswith("cat-")))
    rows = rows.select(
        number_of(F.col("toid")).cast("long").alias("nexus_id"), number_of(F.col("id")).cast("long").alias("reach_id"), F.col(position).alias("_pos")
    )
    return rows.join(known, "reach_id", "left_semi").groupBy("nexus_id").agg(F.max_by("reach_id", "_pos").alias("reach_id"))


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``raw, id``: each raw id as it is stored, else the stored ``wb-<number>`` of the same number."""
    plain = known.select("id").distinct()
    number = F.coalesce(F.split_part("raw", F.lit("-"), F.lit(2)), F.lit(""))
    digits = F.when(number != "", number).otherwise(F.col("raw"))
    rewritten = F.concat(F.lit("wb-"), digits.try_cast("double").cast("long").cast("string"))
    direct = plain.select(F.col("id").alias("raw"), F.col("id").alias("_direct"))
    return (
        wanted.select("raw", rewritten.alias("_other"))
        .join(direct, "raw", "left")
        .join(plain.select(F.col("id").alias("_other"), F.col("id").alias("_found")), "_other", "left")
        .select("raw", F.coalesce("_direct", "_found").alias("id"))
    )


def numbered_ids(flowpaths: DataFrame) -> DataFrame:
    """``id, reach_id``: dense numbers of string ids from 0, in the order of the ids.

    Numbers come from a range partitioning and the counts of its parts; later joins use the numbers.
    """
    return row_numbers(flowpaths.select("id").distinct(), [F.col("id")]).select("id", (F.col("rn") - 1).alias("reach_id"))


def string_flow(ids: DataFrame, network: DataFrame) -> DataFrame:
    """``reach_id, down_id`` of string-id flowpaths, linked directly or through a junction.

    Links to ids that are no flowpaths end there; several downstream reaches show as several rows.
    """
    up = ids.select(F.col("id").alias("up_id"), "reach_id")
    down = ids.select(F.col("id").alias("dn_id"), F.col("reach_id").alias("down_id"))
    links = collapse_nexus(network).join(up, "up_id").join(down, "dn_id").select("reach_id", "down_id")
    return ids.select("reach_id").join(links, "reach_id", "left")


def upstream_ids(network: DataFrame) -> DataFrame:
    """``id, up_ids``: sorted direct upstream flowpaths of each flowpath that has some."""
    return collapse_nexus(network).groupBy(F.col("dn_id").alias("id")).agg(F.sort_array(F.collect_list("up_id")).alias("up_ids"))
