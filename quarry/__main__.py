"""python -m quarry CONFIG.json [section.key=value ...] runs a pipeline; python -m quarry --plugins lists what there is."""

from __future__ import annotations

import json
import sys

from quarry.plans.pipeline import REGISTRY, PipelineConfig, Runner, compose
from quarry.plans.plugins import discover


def main(args: list[str]) -> int:
    if args[:1] == ["--plugins"]:
        discover(REGISTRY)
        print(REGISTRY.describe())
        return 0
    if not args:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from quarry.operators.grouping import corpus_stats, render_stats

    spark = SparkSession.builder.getOrCreate()
    with open(args[0]) as f:
        config = PipelineConfig.from_dict(compose(json.load(f), args[1:]))
    discover(REGISTRY, spark)
    runner = Runner(spark, config)
    corpora = runner.run()
    for step in runner.report.steps:
        print(step.name, "reused" if step.reused else f"{step.jobs} jobs")
    for name, corpus in corpora.items():
        print(name, *sorted(corpus))
        if {"documents", "train_queries", "validation_queries"} <= set(corpus):
            print(render_stats(corpus_stats({name: corpus})))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
