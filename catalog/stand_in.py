"""The driver's tables read as river data.

``part`` is the list of reaches: reach k drains into reach k div 2, except that every
97th link is cut, which leaves one very large basin, many small ones and some isolated
reaches. ``supplier`` is the list of gauges, ``events`` the lateral inflow, ``orders``
the observations. The SQL of each table runs unchanged in Spark and in the checking
database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

N = "(SELECT count(*) FROM part)"

REACH = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS reach_id,
  CASE WHEN p_partkey = 0 OR (p_partkey + 1) % 97 = 3 THEN NULL
       ELSE CAST(((p_partkey + 1) - (p_partkey + 1) % 2) / 2 AS BIGINT) END AS down_id,
  500.0E0 + 100.0E0 * p_size AS length_m,
  0.0005E0 * (1 + (p_partkey + 1) % 40) AS slope,
  CAST(0.1E0 + 0.01E0 * (p_size % 30) AS DOUBLE) AS x,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 5.0E0 + p_size END AS DOUBLE) AS top_width,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 0.5E0 + p_size / 10.0E0 END AS DOUBLE) AS side_slope,
  CAST(((p_partkey + 1) * 37 % 1000) / 1000.0E0 AS DOUBLE) AS n_unit,
  CAST(((p_partkey + 1) * 91 % 1000) / 1000.0E0 AS DOUBLE) AS q_unit,
  CAST(((p_partkey + 1) * 53 % 1000) / 1000.0E0 AS DOUBLE) AS p_unit
FROM part"""

FLOWPATH = f"""
SELECT reach_id AS COMID, coalesce(down_id, 0) AS NextDownID,
  CASE WHEN reach_id * 2 <= {N} AND (reach_id * 2) % 97 <> 3 THEN reach_id * 2 ELSE 0 END AS up1,
  CASE WHEN reach_id * 2 + 1 <= {N} AND (reach_id * 2 + 1) % 97 <> 3 THEN reach_id * 2 + 1 ELSE 0 END AS up2,
  CAST(0 AS BIGINT) AS up3, CAST(0 AS BIGINT) AS up4
FROM reach"""

NEXUS_NETWORK = """
SELECT concat('wb-', reach_id) AS id,
  CASE WHEN down_id IS NULL THEN concat('nex-', 900000000 + reach_id % 5) ELSE concat('nex-', down_id) END AS toid,
  CASE WHEN reach_id % 19 <= 1 THEN concat('gages-', lpad(CAST(CAST((reach_id - reach_id % 19) / 19 AS BIGINT) AS VARCHAR(12)), 8, '0'))
       ELSE NULL END AS hl_uri,
  CAST(reach_id % 1013 AS DOUBLE) + 0.5E0 AS tot_drainage_areasqkm
FROM reach
UNION ALL
SELECT concat('nex-', down_id) AS id, concat('wb-', down_id) AS toid, NULL AS hl_uri, NULL AS tot_drainage_areasqkm
FROM reach WHERE down_id IS NOT NULL"""

GAUGE = """
SELECT lpad(CAST(s_suppkey AS VARCHAR(12)), 8, '0') AS staid, s_name AS name,
  CAST(s_suppkey * 19 + 1 AS BIGINT) AS reach_id,
  abs(s_acctbal) + 1.0E0 AS drain_sqkm,
  abs(s_acctbal) + 1.0E0 + ((s_suppkey % 9) - 3) * 10.5E0 AS comid_drain_sqkm,
  CAST(CASE WHEN s_suppkey % 11 = 5 THEN NULL ELSE 5.0E0 + s_suppkey % 40 END AS DOUBLE) AS comid_unitarea_sqkm,
  CAST(CASE WHEN s_suppkey % 13 = 7 THEN NULL ELSE abs((s_suppkey % 9) - 3) * 10.5E0 END AS DOUBLE) AS abs_diff,
  CASE WHEN s_suppkey % 17 = 4 THEN NULL ELSE s_suppkey % 5 <> 2 END AS da_valid
FROM supplier"""

INFLOW_HOURLY = f"""
SELECT CAST(event_id % {N} + 1 AS BIGINT) AS reach_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS ts, avg(value) * 0.1E0 AS qr
FROM events GROUP BY 1, 2"""

INFLOW_DAILY = f"""
SELECT CAST(event_id % {N} + 1 AS BIGINT) AS reach_id, CAST(ts AS DATE) AS d, avg(value) * 0.1E0 AS qr
FROM events GROUP BY 1, 2"""

OBSERVED = """
SELECT lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR(12)), 8, '0') AS staid,
  CAST(date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT)) AS DATE) AS d,
  avg(o_totalprice) / 1000.0E0 AS streamflow
FROM orders GROUP BY 1, 2"""

SERIES = """
SELECT o_custkey % 50 AS gauge, o_orderkey AS step, coalesce(s, 0.0E0) / 1000.0E0 AS pred,
  CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000.0E0 END AS DOUBLE) AS target
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey) l
  ON l_orderkey = o_orderkey"""

ATTRIBUTES = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS reach_id,
  CAST(p_size AS DOUBLE) AS cly_pc_sav, p_retailprice / 100.0E0 AS ari_ix_sav,
  CAST(CASE WHEN p_partkey % 10 = 4 THEN NULL ELSE p_retailprice END AS DOUBLE) AS ele_mt_sav,
  CAST(p_partkey % 701 AS DOUBLE) AS pre_mm_syr, p_size / 50.0E0 AS ndv_ix_sav,
  CAST(p_partkey % 37 AS DOUBLE) AS slp_dg_sav, CAST((p_partkey * 7) % 5003 AS DOUBLE) AS upa_sk_smx,
  CAST(100 - p_size AS DOUBLE) AS snd_pc_sav, CAST(p_partkey % 997 AS DOUBLE) AS pet_mm_syr,
  CAST((p_partkey % 89) / 89.0E0 AS DOUBLE) AS por_pc_sav
FROM part"""

DERIVED = {
    "reach": (REACH, ("part",)),
    "flowpath": (FLOWPATH, ("reach", "part")),
    "nexus_network": (NEXUS_NETWORK, ("reach",)),
    "gauge": (GAUGE, ("supplier",)),
    "inflow_hourly": (INFLOW_HOURLY, ("events", "part")),
    "inflow_daily": (INFLOW_DAILY, ("events", "part")),
    "observed": (OBSERVED, ("orders", "supplier")),
    "series": (SERIES, ("orders", "lineitem")),
    "attributes": (ATTRIBUTES, ("part",)),
}


def _portable(sql: str) -> str:
    """Spark's spelling of day arithmetic and zone-free time in the checking database's."""
    sql = sql.replace("CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)", "date_trunc('hour', ts)")
    return sql.replace(
        "CAST(date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT)) AS DATE)",
        "CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS DATE)",
    )


def with_tables(*names: str, recursive: bool = False, body: str = "") -> str:
    """Statement that starts with the definitions of the named tables."""
    todo, done = list(names), []

    def visit(name: str) -> None:
        for needed in DERIVED[name][1]:
            if needed in DERIVED:
                visit(needed)
        if name not in done:
            done.append(name)

    for name in todo:
        visit(name)
    ctes = [f"{n} AS ({_portable(DERIVED[n][0])})" for n in done]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + ("" if body.lstrip().startswith(",") else "\n") + body


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, as a plan over the driver's parquet files."""
    if name not in DERIVED:
        return base(spark, sf_dir, name)
    sql, needs = DERIVED[name]
    inputs = {n: table(spark, sf_dir, n) for n in needs}
    for n in needs:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inputs)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reach").select("reach_id", "down_id")


_BUILT: dict[tuple[str, str], dict] = {}


def _build(spark: SparkSession, sf_dir: str) -> dict:
    from rillflow.operators.baseline import gauge_structure
    from rillflow.operators.layout import staged
    from rillflow.operators.network import adjacency, ordered
    from rillflow.operators.pieces import cut_pieces, piece_order
    from rillflow.operators.topology import topology
    from rillflow.plans.problem import piece_limit
    from rillflow.scratch import store

    links = flow(spark, sf_dir)
    topo = topology(links)
    order = store(ordered(links, topo), "order")
    limit = piece_limit(topo.count(), spark.sparkContext.defaultParallelism)
    placed, forest = cut_pieces(topo, limit)
    gauge_topo, segment = gauge_structure(links, table(spark, sf_dir, "gauge"))
    return {
        "topo": topo,
        "order": order,
        "pairs": store(adjacency(order), "adjacency"),
        "gauge_topo": gauge_topo,
        "segment": segment,
        "limit": limit,
        "plan": staged(placed, forest, limit),
        "pieces": piece_order(placed, forest),
    }


def network(spark: SparkSession, sf_dir: str) -> dict:
    """The network tables, built once per session and kept as written tables.

    Like any network, it is built before it is queried; the building itself is timed and
    checked by its own queries.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = _build(spark, sf_dir)
    return _BUILT[key]
