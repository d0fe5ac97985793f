"""Network, gauge and baseline queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.stand_in import flow, network, table, with_tables
from rillflow.functions import ids
from rillflow.operators import baseline, gauges, network as net, resample, topology
from rillflow.scratch import by_key

# Every (reach, reach at or below it), by walking downstream
WALK = """, walk AS (
  SELECT reach_id, reach_id AS below_id, CAST(0 AS BIGINT) AS hops FROM reach
  UNION ALL
  SELECT w.reach_id, r.down_id, w.hops + 1 FROM walk w JOIN reach r ON r.reach_id = w.below_id WHERE r.down_id IS NOT NULL)
"""
LEVELS = WALK + """, shape AS (
  SELECT below_id AS reach_id, max(hops) AS level, count(*) AS size FROM walk GROUP BY below_id)
"""
ORDER = LEVELS + """, topo AS (
  SELECT r.reach_id, r.down_id, s.level,
    row_number() OVER (ORDER BY CASE WHEN s.size = 1 AND r.down_id IS NULL THEN 1 ELSE 0 END, s.level, r.reach_id) - 1 AS topo_idx
  FROM reach r JOIN shape s USING (reach_id))
, pairs AS (
  SELECT d.reach_id AS dn_id, u.reach_id AS up_id, d.topo_idx AS dn_idx, u.topo_idx AS up_idx
  FROM topo u JOIN topo d ON u.down_id = d.reach_id)
"""


@query(
    "g_upstream_list",
    with_tables(
        "flowpath",
        body="""SELECT COMID AS dn_id, array_to_string(list(up ORDER BY up), ',') AS up_ids FROM (
          SELECT COMID, unnest([up1, up2, up3, up4]) AS up FROM flowpath) WHERE up > 0 GROUP BY COMID""",
    ),
)
def g_upstream_list(spark, sf_dir):
    lists = net.upstream_lists(net.upstream_links(table(spark, sf_dir, "flowpath")))
    return lists.select("dn_id", F.array_join(F.col("up_ids").cast("array<string>"), ",").alias("up_ids"))


@query(
    "g_flow_from_upstream",
    with_tables("reach", body="SELECT reach_id, down_id FROM reach"),
)
def g_flow_from_upstream(spark, sf_dir):
    links = net.upstream_links(table(spark, sf_dir, "flowpath"))
    return net.flow_from_links(links, flow(spark, sf_dir))


@query(
    "g_levels",
    with_tables(
        "reach",
        recursive=True,
        body=LEVELS + """SELECT r.reach_id, s.level, s.size, w.below_id AS outlet, w.hops
          FROM reach r JOIN shape s USING (reach_id) JOIN walk w ON w.reach_id = r.reach_id
          JOIN reach o ON o.reach_id = w.below_id WHERE o.down_id IS NULL""",
    ),
)
def g_levels(spark, sf_dir):
    return topology.topology(flow(spark, sf_dir)).select("reach_id", "level", "size", "outlet", "hops")


@query(
    "g_topo_order",
    with_tables("reach", recursive=True, body=ORDER + "SELECT reach_id, down_id, level, topo_idx FROM topo"),
)
def g_topo_order(spark, sf_dir):
    return net.ordered(flow(spark, sf_dir))


@query(
    "g_adjacency",
    with_tables("reach", recursive=True, body=ORDER + "SELECT dn_id, up_id, dn_idx, up_idx FROM pairs"),
)
def g_adjacency(spark, sf_dir):
    return net.adjacency(network(spark, sf_dir)["order"])


@query(
    "g_checks",
    with_tables(
        "reach",
        recursive=True,
        body=ORDER + """SELECT 'not_lower_triangular' AS check_name, count(*) AS n FROM pairs WHERE dn_idx <= up_idx
          UNION ALL SELECT 'several_downstream', count(*) FROM (SELECT up_id FROM pairs GROUP BY up_id HAVING count(*) > 1)
          UNION ALL SELECT 'reaches', count(*) FROM topo""",
    ),
)
def g_checks(spark, sf_dir):
    t = network(spark, sf_dir)
    counts = {
        "not_lower_triangular": net.not_lower_triangular(t["pairs"]),
        "several_downstream": topology.check_dendritic(flow(spark, sf_dir)),
        "reaches": t["order"],
    }
    out = None
    for name, df in counts.items():
        row = df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


CYCLIC = """, looped AS (
  SELECT reach_id, CASE WHEN reach_id BETWEEN 100 AND 179 AND (SELECT count(*) FROM part) >= 180 THEN CASE WHEN reach_id = 179 THEN 100 ELSE reach_id + 1 END
         WHEN reach_id % 97 = 3 AND reach_id % 2 = 0 AND reach_id * 2 <= (SELECT count(*) FROM part)
         THEN reach_id * 2 WHEN reach_id % 97 = 3 AND reach_id % 5 = 0 THEN reach_id ELSE down_id END AS down_id
  FROM reach)
"""


@query(
    "g_drop_cycles",
    with_tables(
        "reach",
        recursive=True,
        body=CYCLIC + """, walk AS (
          SELECT reach_id, down_id AS at_id, 1 AS hops FROM looped WHERE down_id IS NOT NULL
          UNION ALL SELECT w.reach_id, l.down_id, w.hops + 1 FROM walk w JOIN looped l ON l.reach_id = w.at_id
          WHERE l.down_id IS NOT NULL AND w.at_id <> w.reach_id AND w.hops <= (SELECT count(*) FROM part))
        , bad AS (SELECT DISTINCT reach_id FROM walk WHERE at_id = reach_id)
        SELECT reach_id, CASE WHEN down_id IN (SELECT reach_id FROM bad) THEN NULL ELSE down_id END AS down_id
        FROM looped WHERE reach_id NOT IN (SELECT reach_id FROM bad)""",
    ),
)
def g_drop_cycles(spark, sf_dir):
    """Links cut by the stand-in are turned into two-reach cycles, self-loops and one of eighty reaches, then removed again."""
    k = F.col("reach_id")
    n = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    looped = flow(spark, sf_dir).select(
        "reach_id",
        F.when(k.between(100, 179) & (n >= 180), F.when(k == 179, 100).otherwise(k + 1))
        .when((k % 97 == 3) & (k % 2 == 0) & (k * 2 <= n), k * 2)
        .when((k % 97 == 3) & (k % 5 == 0), k)
        .otherwise(F.col("down_id"))
        .alias("down_id"),
    )
    return topology.drop_cycles(looped)


@query(
    "g_isolated",
    with_tables(
        "reach",
        body="""SELECT reach_id FROM reach WHERE down_id IS NULL
          AND reach_id NOT IN (SELECT down_id FROM reach WHERE down_id IS NOT NULL)""",
    ),
)
def g_isolated(spark, sf_dir):
    return net.isolated(flow(spark, sf_dir))


@query("g_terminal", with_tables("reach", body="SELECT reach_id FROM reach WHERE down_id IS NULL"))
def g_terminal(spark, sf_dir):
    return net.terminals(flow(spark, sf_dir))


@query(
    "g_closure_size",
    with_tables("reach", recursive=True, body=LEVELS + "SELECT reach_id, size FROM shape"),
)
def g_closure_size(spark, sf_dir):
    return topology.topology(flow(spark, sf_dir)).select("reach_id", "size")


BRIDGE = """, bridge AS (SELECT g.staid, w.reach_id FROM gauge g JOIN walk w ON w.below_id = g.reach_id)
"""


@query(
    "g_gauge_reaches",
    with_tables("reach", "gauge", recursive=True, body=WALK + BRIDGE + "SELECT staid, reach_id FROM bridge"),
)
def g_gauge_reaches(spark, sf_dir):
    return net.gauge_reaches(network(spark, sf_dir)["pieces"].order, table(spark, sf_dir, "gauge"))


@query(
    "g_subset_edges",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=ORDER + BRIDGE + """SELECT b.staid, p.dn_id, p.up_id, p.dn_idx, p.up_idx FROM pairs p
          JOIN bridge b ON b.reach_id = p.dn_id JOIN bridge c ON c.reach_id = p.up_id AND c.staid = b.staid""",
    ),
)
def g_subset_edges(spark, sf_dir):
    t = network(spark, sf_dir)
    ranges = net.gauge_intervals(t["pieces"].order, table(spark, sf_dir, "gauge"))
    return net.subset_pairs(ranges, net.labelled_pairs(t["pairs"], t["pieces"].order))


def _batch(spark, sf_dir):
    return table(spark, sf_dir, "gauge").filter("da_valid")


@query(
    "g_compress",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=ORDER + BRIDGE + """, active AS (
          SELECT p.dn_idx AS idx FROM pairs p JOIN bridge b ON b.reach_id = p.dn_id JOIN gauge g ON g.staid = b.staid AND g.da_valid
          UNION SELECT p.up_idx FROM pairs p JOIN bridge b ON b.reach_id = p.dn_id JOIN gauge g ON g.staid = b.staid AND g.da_valid
          UNION SELECT t.topo_idx FROM topo t JOIN gauge g ON g.reach_id = t.reach_id AND g.da_valid)
        SELECT idx, dense_rank() OVER (ORDER BY idx) - 1 AS new_idx FROM active""",
    ),
)
def g_compress(spark, sf_dir):
    t = network(spark, sf_dir)
    batch = _batch(spark, sf_dir)
    inside = topology.upstream_of(flow(spark, sf_dir), batch)
    # the union over gauges needs no bridge: a pair is used when its downstream end is upstream of any gauge
    used = t["pairs"].join(by_key(inside.select(F.col("reach_id").alias("dn_id"))), "dn_id", "left_semi")
    return net.compress(used, t["order"].join(by_key(batch.select("reach_id")), "reach_id", "left_semi"))


OUTFLOW = """, outflow AS (
  SELECT g.staid, coalesce(r.reach_id, g.reach_id) AS reach_id FROM gauge g LEFT JOIN reach r ON r.down_id = g.reach_id)
"""


@query("g_outflow_idx", with_tables("reach", "gauge", body=OUTFLOW + "SELECT staid, reach_id FROM outflow"))
def g_outflow_idx(spark, sf_dir):
    return net.gauge_outflow(table(spark, sf_dir, "gauge"), network(spark, sf_dir)["pairs"])


@query(
    "g_outflow_mismatch",
    with_tables(
        "reach",
        "gauge",
        body=OUTFLOW + """SELECT count(*) AS n FROM outflow o JOIN gauge g ON g.staid = o.staid JOIN reach r ON r.reach_id = o.reach_id
          WHERE o.reach_id <> g.reach_id AND (r.down_id IS NULL OR r.down_id <> g.reach_id)""",
    ),
)
def g_outflow_mismatch(spark, sf_dir):
    g = table(spark, sf_dir, "gauge")
    bad = net.outflow_mismatches(g, net.gauge_outflow(g, network(spark, sf_dir)["pairs"]), flow(spark, sf_dir))
    return bad.agg(F.count("*").alias("n"))


@query(
    "g_targets",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=WALK + """, inside AS (SELECT DISTINCT w.reach_id FROM walk w JOIN gauge g ON g.reach_id = w.below_id WHERE g.drain_sqkm > 5000)
        SELECT r.reach_id, CASE WHEN r.down_id IN (SELECT reach_id FROM inside) THEN r.down_id END AS down_id
        FROM reach r JOIN inside i ON i.reach_id = r.reach_id""",
    ),
)
def g_targets(spark, sf_dir):
    targets = table(spark, sf_dir, "gauge").filter("drain_sqkm > 5000").select("reach_id")
    return net.target_network(flow(spark, sf_dir), targets)


@query(
    "g_nearest_gauge",
    with_tables(
        "reach",
        "gauge",
        recursive=True,
        body=WALK + """SELECT r.reach_id, m.marked_id FROM reach r LEFT JOIN (
            SELECT w.reach_id, arg_min(w.below_id, w.hops) AS marked_id FROM walk w
            WHERE w.below_id IN (SELECT reach_id FROM gauge) GROUP BY w.reach_id) m ON m.reach_id = r.reach_id""",
    ),
)
def g_nearest_gauge(spark, sf_dir):
    return topology.nearest_marked(flow(spark, sf_dir), table(spark, sf_dir, "gauge"))


@query(
    "j_collapse_nexus",
    with_tables(
        "nexus_network",
        body="""SELECT DISTINCT a.id AS up_id, b.toid AS dn_id FROM nexus_network a JOIN nexus_network b ON a.toid = b.id
          WHERE a.id LIKE 'wb-%' AND b.id LIKE 'nex-%' AND b.toid LIKE 'wb-%'""",
    ),
)
def j_collapse_nexus(spark, sf_dir):
    return net.collapse_nexus(table(spark, sf_dir, "nexus_network"))


@query(
    "j_ghost_terminals",
    with_tables(
        "nexus_network",
        body=""", linked AS (
          SELECT f.id, coalesce(t.toid, 'ghost-' || f.toid) AS down FROM nexus_network f
          LEFT JOIN (SELECT id, min(toid) AS toid FROM nexus_network GROUP BY id) t ON t.id = f.toid WHERE f.id LIKE 'wb-%')
        SELECT id, down FROM linked UNION ALL SELECT DISTINCT down, NULL FROM linked WHERE down LIKE 'ghost-%'""",
    ),
)
def j_ghost_terminals(spark, sf_dir):
    rows = table(spark, sf_dir, "nexus_network")
    return net.link_flowpaths(rows.filter(F.col("id").startswith("wb-")), rows, ghost=True)


@query(
    "g_virtual_terminal",
    with_tables("nexus_network", body="SELECT id, toid FROM nexus_network WHERE id LIKE 'wb-%' UNION ALL SELECT 'wb-0', NULL"),
)
def g_virtual_terminal(spark, sf_dir):
    rows = table(spark, sf_dir, "nexus_network").filter(F.col("id").startswith("wb-"))
    return net.with_terminal(rows.select("id", "toid"))


@query(
    "j_find_origin",
    with_tables(
        "nexus_network",
        "gauge",
        body="""SELECT staid, id FROM (SELECT g.staid, w.id,
            row_number() OVER (PARTITION BY g.staid ORDER BY abs(w.tot_drainage_areasqkm - g.drain_sqkm), w.id) AS rn
          FROM gauge g JOIN nexus_network w ON w.hl_uri = 'gages-' || g.staid WHERE w.id LIKE 'wb-%') WHERE rn = 1""",
    ),
)
def j_find_origin(spark, sf_dir):
    rows = table(spark, sf_dir, "nexus_network")
    gauges = table(spark, sf_dir, "gauge")
    known = gauges.join(net.gauges_without_origin(gauges, rows).select("staid"), "staid", "left_anti")
    return net.gauge_origin(known, rows, rows.filter(F.col("id").startswith("wb-")))


@query(
    "f_gauges_without_origin",
    with_tables(
        "nexus_network",
        "gauge",
        body="SELECT staid FROM gauge WHERE staid NOT IN (SELECT substr(hl_uri, 7) FROM nexus_network WHERE id LIKE 'wb-%' AND hl_uri LIKE 'gages-%')",
    ),
)
def f_gauges_without_origin(spark, sf_dir):
    return net.gauges_without_origin(table(spark, sf_dir, "gauge"), table(spark, sf_dir, "nexus_network")).select("staid")


@query(
    "j_nexus_targets",
    with_tables(
        "nexus_network",
        body="""SELECT nexus_id, reach_id FROM (SELECT CAST(substr(toid, 5) AS BIGINT) AS nexus_id, CAST(substr(id, 4) AS BIGINT) AS reach_id,
            row_number() OVER (PARTITION BY toid ORDER BY CAST(substr(id, 4) AS BIGINT) * 37 % 10007 DESC) AS rn
          FROM nexus_network WHERE id LIKE 'wb-%' AND toid LIKE 'nex-%' AND CAST(substr(id, 4) AS BIGINT) % 7 <> 0) WHERE rn = 1""",
    ),
)
def j_nexus_targets(spark, sf_dir):
    """Several flowpaths per nexus in a row order of their own; a seventh of them is not routed."""
    rows = table(spark, sf_dir, "nexus_network").filter(F.col("id").startswith("wb-"))
    number = F.substring("id", 4, 20).cast("long")
    routed = rows.select(number.alias("reach_id")).filter("reach_id % 7 <> 0")
    return net.nexus_targets(rows.withColumn("pos", number * 37 % 10007), routed)


@query(
    "j_nexus_identity",
    with_tables("reach", body="SELECT reach_id AS nexus_id, reach_id FROM reach"),
)
def j_nexus_identity(spark, sf_dir):
    """Without a flowpath table every nexus has the id of its reach."""
    return net.nexus_targets(None, flow(spark, sf_dir))


@query(
    "i_convert_ids",
    with_tables(
        "nexus_network",
        "gauge",
        body="""SELECT id AS source_id, CAST(substr(id, 4) AS INT) AS number, 'wb-' || CAST(substr(id, 4) AS INT) AS back,
            'cat-' || substr(id, 4) AS divide_id,
            CASE WHEN length(substr(id, 4)) < 8 THEN lpad(substr(id, 4), 8, '0') ELSE substr(id, 4) END AS station
          FROM nexus_network WHERE id LIKE 'wb-%'""",
    ),
)
def i_convert_ids(spark, sf_dir):
    conv = ids.converter_for("lynker")
    wb = table(spark, sf_dir, "nexus_network").filter(F.col("id").startswith("wb-"))
    number = conv.to_number(F.col("id"))
    bare = ids.strip_prefix(F.col("id"), "wb")
    return wb.select(
        F.col("id").alias("source_id"),
        number.alias("number"),
        conv.from_number(number).alias("back"),
        ids.with_prefix(bare, "cat").alias("divide_id"),
        ids.zero_filled(bare).alias("station"),
    )


@query(
    "f_area_threshold",
    with_tables("gauge", body="SELECT staid FROM gauge WHERE abs_diff <= 30.0"),
)
def f_area_threshold(spark, sf_dir):
    g = table(spark, sf_dir, "gauge")
    return gauges.within_area_gap(g.select("staid"), g, 30.0)


@query("f_da_valid", with_tables("gauge", body="SELECT staid FROM gauge WHERE da_valid"))
def f_da_valid(spark, sf_dir):
    g = table(spark, sf_dir, "gauge")
    return gauges.with_valid_area(g.select("staid"), g)


@query(
    "f_headwater",
    with_tables(
        "reach", "gauge", body="SELECT staid FROM gauge WHERE reach_id IN (SELECT down_id FROM reach WHERE down_id IS NOT NULL)"
    ),
)
def f_headwater(spark, sf_dir):
    g = table(spark, sf_dir, "gauge")
    direct = g.join(network(spark, sf_dir)["pairs"].select(F.col("dn_id").alias("reach_id")), "reach_id", "left_semi")
    return gauges.not_headwater(g.select("staid"), direct)


@query(
    "f_training_gauges",
    with_tables(
        "reach",
        "gauge",
        body="""SELECT staid, 'flag' AS rule FROM gauge WHERE da_valid AND reach_id IN (SELECT down_id FROM reach WHERE down_id IS NOT NULL)
          UNION ALL SELECT staid, 'gap' AS rule FROM gauge WHERE abs_diff <= 20.0 AND reach_id IN (SELECT down_id FROM reach WHERE down_id IS NOT NULL)""",
    ),
)
def f_training_gauges(spark, sf_dir):
    """Both rules of the area check: the validity flag where there is one, else the threshold."""
    g = table(spark, sf_dir, "gauge")
    direct = g.join(network(spark, sf_dir)["pairs"].select(F.col("dn_id").alias("reach_id")), "reach_id", "left_semi")
    by_flag = gauges.training_gauges(g.select("staid"), g, direct, threshold=20.0)
    by_gap = gauges.training_gauges(g.select("staid"), g.drop("da_valid"), direct, threshold=20.0)
    return by_flag.withColumn("rule", F.lit("flag")).unionByName(by_gap.withColumn("rule", F.lit("gap")))


@query(
    "f_complete_gauges",
    with_tables(
        "gauge",
        "observed",
        body="""SELECT g.staid FROM gauge g JOIN observed o ON o.staid = g.staid GROUP BY g.staid HAVING count(*) = 30""",
    ),
)
def f_complete_gauges(spark, sf_dir):
    each = table(spark, sf_dir, "observed").select("staid").distinct().join(table(spark, sf_dir, "gauge").select("staid"), "staid", "left_semi")
    first = F.lit(date(2024, 1, 1))
    grid = each.select("staid", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("_i")).select(
        "staid", F.date_add(first, F.col("_i")).alias("d")
    )
    return gauges.complete_gauges(grid.join(table(spark, sf_dir, "observed"), ["staid", "d"], "left"))


@query(
    "a_flow_scale_segment",
    with_tables(
        "gauge",
        body="""SELECT reach_id DIV_PLACE AS reach_id, arg_max(f, pos) AS flow_scale FROM (
          SELECT reach_id, staid AS pos, CASE WHEN comid_unitarea_sqkm > 0 AND drain_sqkm - comid_drain_sqkm < 0
             AND abs(drain_sqkm - comid_drain_sqkm) < comid_unitarea_sqkm
            THEN round((comid_unitarea_sqkm - abs(drain_sqkm - comid_drain_sqkm)) / comid_unitarea_sqkm, 9) ELSE 1.0 END AS f
          FROM gauge) GROUP BY 1""".replace("reach_id DIV_PLACE", "(reach_id - reach_id % 57)"),
    ),
)
def a_flow_scale_segment(spark, sf_dir):
    """Gauges are moved onto shared reaches, so that the last one per reach has to win."""
    g = table(spark, sf_dir, "gauge")
    batch = g.select("staid", (F.col("reach_id") - F.col("reach_id") % 57).alias("reach_id"), F.col("staid").alias("pos"))
    return gauges.segment_flow_scale(batch, g).select("reach_id", F.round("flow_scale", 9).alias("flow_scale"))


DAYS = """, days AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS d FROM range(30) t(i))
"""


@query(
    "x_summed_q",
    with_tables(
        "reach",
        "gauge",
        "inflow_daily",
        recursive=True,
        body=WALK + BRIDGE + DAYS + """SELECT g.staid, days.d, round(coalesce(s.q, 0.0), 6) + 0.0 AS pred FROM gauge g CROSS JOIN days
          LEFT JOIN (SELECT b.staid, i.d, sum(i.qr) AS q FROM bridge b JOIN inflow_daily i ON i.reach_id = b.reach_id GROUP BY 1, 2) s
          ON s.staid = g.staid AND s.d = days.d""",
    ),
)
def x_summed_q(spark, sf_dir):
    return _summed(spark, sf_dir).select("staid", "d", (F.round("pred", 6) + 0.0).alias("pred"))


def _summed(spark, sf_dir):
    t = network(spark, sf_dir)
    days = resample.daily_calendar(spark, date(2024, 1, 1), date(2024, 1, 30))
    return baseline.summed_inflow(
        table(spark, sf_dir, "inflow_daily"), table(spark, sf_dir, "gauge"), days, t["gauge_topo"], t["segment"]
    )


@query(
    "x_summed_q_nse",
    with_tables(
        "reach",
        "gauge",
        "inflow_daily",
        "observed",
        recursive=True,
        body=WALK + BRIDGE + DAYS + """, pred AS (SELECT g.staid, days.d, coalesce(s.q, 0.0) AS pred FROM gauge g CROSS JOIN days
          LEFT JOIN (SELECT b.staid, i.d, sum(i.qr) AS q FROM bridge b JOIN inflow_daily i ON i.reach_id = b.reach_id GROUP BY 1, 2) s
          ON s.staid = g.staid AND s.d = days.d)
        , pair AS (SELECT p.staid, p.pred, o.streamflow AS t, avg(o.streamflow) OVER (PARTITION BY p.staid) AS tm
          FROM pred p LEFT JOIN observed o ON o.staid = p.staid AND o.d = p.d)
        SELECT staid, round(avg(pred - t), 6) AS bias,
          round(1 - sum((t - pred) * (t - pred)) / sum((t - tm) * (t - tm)), 6) AS nse FROM pair GROUP BY staid""",
    ),
)
def x_summed_q_nse(spark, sf_dir):
    from rillflow.operators.metrics import check_predictions, moment_scores

    both = baseline.with_observations(_summed(spark, sf_dir), table(spark, sf_dir, "observed"))
    scores = moment_scores(check_predictions(both), "staid")
    return scores.select("staid", F.round("bias", 6).alias("bias"), F.round("nse", 6).alias("nse"))


@query(
    "x_hotstart",
    with_tables(
        "reach",
        "inflow_hourly",
        recursive=True,
        body=WALK + """, first_hour AS (SELECT r.reach_id, coalesce(i.qr, 0.001) AS q FROM reach r
            LEFT JOIN inflow_hourly i ON i.reach_id = r.reach_id AND i.ts = TIMESTAMP '2024-01-01 00:00:00')
          SELECT w.below_id AS reach_id, round(greatest(sum(f.q), 0.0001), 6) AS q
          FROM walk w JOIN first_hour f ON f.reach_id = w.reach_id GROUP BY 1""",
    ),
)
def x_hotstart(spark, sf_dir):
    from rillflow.plans.accumulation import hot_start

    hour = table(spark, sf_dir, "inflow_hourly").filter("ts = timestamp_ntz'2024-01-01 00:00:00'")
    pieces = network(spark, sf_dir)["pieces"]
    return hot_start(hour, pieces).select("reach_id", F.round("q", 6).alias("q"))


@query(
    "x_daily_accum",
    with_tables(
        "reach",
        "inflow_daily",
        recursive=True,
        body=WALK + DAYS + """, filled AS (SELECT r.reach_id, days.d, greatest(coalesce(i.qr, 0.001), 0.0001) AS q FROM reach r CROSS JOIN days
            LEFT JOIN inflow_daily i ON i.reach_id = r.reach_id AND i.d = days.d)
          SELECT w.below_id AS reach_id, f.d, round(greatest(sum(f.q), 0.0001), 5) AS q
          FROM walk w JOIN filled f ON f.reach_id = w.reach_id GROUP BY 1, 2""",
    ),
)
def x_daily_accum(spark, sf_dir):
    from rillflow.plans.accumulation import daily_discharge

    days = resample.daily_calendar(spark, date(2024, 1, 1), date(2024, 1, 30))
    q = daily_discharge(table(spark, sf_dir, "inflow_daily"), network(spark, sf_dir)["pieces"], days)
    return q.select("reach_id", "d", F.round("q", 5).alias("q"))
