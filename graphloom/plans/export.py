"""`python -m graphloom.plans.export --checkpoint DIR --output DIR`: the bundle of a training run's latest checkpoint."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..sources import bundles


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--checkpoint", default="model/walks")
    parser.add_argument("--output", default="model/bundle")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    chosen = arguments(given)
    for warning in bundles.export(SparkSession.builder.getOrCreate(), chosen.checkpoint, chosen.output):
        print(f"warning: {warning}", file=sys.stderr)


if __name__ == "__main__":
    main()
