"""Commands that read a raster, apply an operator, and write the result.

    python -m thalweg.cli flow-direction --input_file dem.tif --output_file fdr.tif

Paths are those of thalweg.files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from thalweg import files
from thalweg.functions.d8 import DEFAULT_CHUNK_SIZE, DEFAULT_MAX_PITS, DEFAULT_SEARCH_RADIUS

COMMANDS = {"breach-single-cell-pits": files.breach_single_cell_pits, "flow-direction": files.flow_direction, "breach-paths-least-cost": files.breach_paths_least_cost}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thalweg", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("--input_file", required=True)
        p.add_argument("--output_file", required=True)
        p.add_argument("--chunk_size", type=int, default=DEFAULT_CHUNK_SIZE)
        if name == "breach-paths-least-cost":
            p.add_argument("--search_radius", type=int, default=DEFAULT_SEARCH_RADIUS)
            p.add_argument("--max_pits", type=int, default=DEFAULT_MAX_PITS)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    try:
        COMMANDS[command](args.pop("input_file"), args.pop("output_file"), **args, spark=spark)
    except Exception as e:  # a command reports any failure and ends with a code
        print(f"{command} failed with the following exception: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
