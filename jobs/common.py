"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def command(name: str, run: Callable[..., dict], defaults: str) -> None:
    """Parse ``--config FILE`` and ``--key value`` (which counts more), run the job in a session of its own, end that."""
    with open(defaults, encoding="utf-8") as f:
        settings = json.load(f)
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", help=f"a JSON file of settings (as {defaults})")
    for key, value in settings.items():
        parser.add_argument(f"--{key}", type=type(value), help=f"default: {value}")
    given = vars(parser.parse_args())
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            settings |= json.load(f)
    settings |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        log.info("%s: %s", name, run(spark, **settings))
    finally:
        spark.stop()
