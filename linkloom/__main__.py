"""python -m linkloom COMMAND FOLDER [ARGUMENT...]: reports over a source tree, as JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import reports

COMMANDS = {
    "audit": lambda f: reports.audit(f),
    "analyze": lambda f, file: reports.analyze(f, file),
    "affected": lambda f, *files: reports.affected(f, list(files)),
    "barrel": lambda f: reports.barrels(f),
    "find": lambda f, query: reports.search(f, query),
    "naming": lambda f, target=None: reports.names(f, target),
    "organise": lambda f: reports.organise(f),
    "similar": lambda f: reports.similar(f),
    "tidy": lambda f: reports.tidy_up(f),
    "unused": lambda f: reports.unused(f),
}


def as_json(report: DataFrame | dict[str, DataFrame]):
    if isinstance(report, dict):
        return {k: as_json(v) for k, v in report.items()}
    return [json.loads(x) for x in report.toJSON().collect()]


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in COMMANDS:
        print(f"{__doc__}\nCommands: {', '.join(COMMANDS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps(as_json(COMMANDS[args[0]](reports.extract_facts(spark, args[1]), *args[2:])), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
