"""python -m tagloom --config FILE [--stages NAME ...] [--list] [--workdir DIR] [--keep-going]"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .plans import stages as _  # noqa: F401  registers the stages
from .plans.config import Config
from .plans.runner import ORDER, STAGES, Runner


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tagloom", description="Runs configured stages.")
    args.add_argument("--config")
    args.add_argument("--stages", nargs="*")
    args.add_argument("--list", action="store_true")
    args.add_argument("--workdir")
    args.add_argument("--keep-going", action="store_true")
    given = args.parse_args(argv)
    if given.list:
        print(*ORDER, *[s for s in STAGES if s not in ORDER], sep="\n")
        return 0
    if not given.config:
        args.error("--config is needed")
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(levelname)s %(name)s: %(message)s")
    runner = Runner(SparkSession.builder.appName("tagloom").getOrCreate(), Config.load(given.config, given.workdir))
    results = runner.run(given.stages, stop_on_failure=not given.keep_going)
    for r in results:
        print(f"{r.name}: {r.status} {r.details or ''}")
    return int(any(r.status == "failed" for r in results))


if __name__ == "__main__":
    sys.exit(main())
