"""``python -m rillflow.cli {summed-q-prime,route,test,train,train-and-test,geometry} CONFIG [key=value ...]``."""

from __future__ import annotations

import argparse

from rillflow.config import load_config, save_config
from rillflow.plans import workflows
from rillflow.session import build_session

COMMANDS = {
    "summed-q-prime": workflows.summed,
    "route": workflows.route,
    "test": workflows.test,
    "train": workflows.train,
    "train-and-test": workflows.train_and_test,
    "geometry": workflows.geometry,
}


#: Data sets whose reaches have string ids
STRING_IDS = ("lynker", "hydrofabric_v2.2")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rillflow", description="River-network analytics on Spark")
    parser.add_argument("command", choices=sorted([*COMMANDS, "build-network"]))
    parser.add_argument("config", help="YAML or JSON configuration; for build-network the reach table")
    parser.add_argument("overrides", nargs="*", help="section.key=value; for build-network target folder, data set, then gauge table, or link, attribute and gauge tables of string-id data sets")
    args = parser.parse_args(argv)
    spark = build_session(f"rillflow-{args.command}")
    if args.command == "build-network":
        from rillflow.sources.readers import read_gauges, read_table

        target, dataset, *rest = args.overrides
        if dataset in STRING_IDS:
            # flowpaths, target, data set, link table, then attributes and gauges if there are any
            links, *more = [read_table(spark, p) for p in rest[:2]]
            gauges = read_gauges(spark, rest[2]) if len(rest) > 2 else None
            print(f"{workflows.build_string_network(read_table(spark, args.config), links, target, dataset, *(more or [None]), gauges)} gauges stored")
            return
        gauges = read_gauges(spark, rest[0]) if rest else None
        print(f"{workflows.build_network(read_table(spark, args.config), target, dataset, gauges)} gauges stored")
        return
    config = load_config(args.config, args.overrides)
    save_config(config, config.params.save_path)
    result = COMMANDS[args.command](spark, config)
    if isinstance(result, str):
        print(result)
    else:
        result.show(50, truncate=False)


if __name__ == "__main__":
    main()
