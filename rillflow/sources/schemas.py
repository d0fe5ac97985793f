"""Column layouts of the canonical parquet tables."""

from __future__ import annotations

REACH = "reach_id bigint, down_id bigint, length_m double, slope double, x double, top_width double, side_slope double"
ORDER = "reach_id bigint, down_id bigint, level bigint, topo_idx bigint"
PAIRS = "dn_id bigint, up_id bigint, dn_idx bigint, up_idx bigint"
INFLOW = "reach_id bigint, ts timestamp_ntz, qr double"
OBSERVED = "staid string, d date, streamflow double"
STATISTICS = "attr string, min double, max double, mean double, std double, p10 double, p90 double"

# Header of gauge tables, and the type of each column
GAUGE_REQUIRED = {
    "STAID": "string",
    "STANAME": "string",
    "DRAIN_SQKM": "double",
    "LAT_GAGE": "double",
    "LNG_GAGE": "double",
}
GAUGE_OPTIONAL = {
    "COMID": "bigint",
    "COMID_DRAIN_SQKM": "double",
    "ABS_DIFF": "double",
    "COMID_UNITAREA_SQKM": "double",
    "DA_VALID": "boolean",
    "FLOW_SCALE": "double",
}
GAUGE_NAMES = {
    "STAID": "staid",
    "STANAME": "name",
    "DRAIN_SQKM": "drain_sqkm",
    "LAT_GAGE": "lat",
    "LNG_GAGE": "lon",
    "COMID": "reach_id",
    "COMID_DRAIN_SQKM": "comid_drain_sqkm",
    "ABS_DIFF": "abs_diff",
    "COMID_UNITAREA_SQKM": "comid_unitarea_sqkm",
    "DA_VALID": "da_valid",
    "FLOW_SCALE": "flow_scale",
}
# Zones of the merged continental inflow
ZONES = ("71", "72", "73", "74", "75", "77", "78")
