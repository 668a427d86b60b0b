"""Command line: campaigns over a pool of shards, selections, and any registered query.

    python -m shardloom.cli campaign FOLDER "top_pct(40) AND NOT source:x" --out DIR --name NAME
    python -m shardloom.cli validate "EXPRESSION"
    python -m shardloom.cli compare FOLDER "EXPRESSION" "EXPRESSION"
    python -m shardloom.cli select FOLDER N --iteration I
    python -m shardloom.cli queries [--grep TEXT]
    python -m shardloom.cli run FOLDER QUERY [--rows N] [--out DIR]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .dsl.compiler import decide, evaluate, validate
from .io import table
from .operators import manifests, pool, selection
from .plans import registry
from .session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shardloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("campaign", help="decide over every shard by an expression and write the manifest")
    c.add_argument("folder"), c.add_argument("expression"), c.add_argument("--out"), c.add_argument("--name", default="campaign")
    c.add_argument("--include", nargs="*", default=[]), c.add_argument("--exclude", nargs="*", default=[])
    c.add_argument("--floor", type=float)
    v = sub.add_parser("validate", help="check an expression without data")
    v.add_argument("expression")
    d = sub.add_parser("compare", help="what two expressions share")
    d.add_argument("folder"), d.add_argument("left"), d.add_argument("right")
    s = sub.add_parser("select", help="choose shards for an iteration")
    s.add_argument("folder"), s.add_argument("n", type=int), s.add_argument("--iteration", type=int, default=0), s.add_argument("--hold-out", nargs="*", default=[])
    q = sub.add_parser("queries", help="names of the registered queries")
    q.add_argument("--grep", default="")
    r = sub.add_parser("run", help="run a registered query")
    r.add_argument("folder"), r.add_argument("query"), r.add_argument("--rows", type=int, default=20), r.add_argument("--out")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "validate":
        wrong = [w for w in validate(a.expression) if not w.startswith("unknown selection")]
        print("\n".join(wrong) or "valid")
        return 1 if wrong else 0
    if a.command == "queries":
        print("\n".join(n for n in sorted(registry.queries()) if a.grep in n))
        return 0
    spark = spark or build_session("shardloom")
    if a.command == "run":
        out = registry.queries()[a.query](spark, a.folder)
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        else:
            out.show(a.rows, truncate=False)
        return 0
    shards = pool.load_pool(table(spark, a.folder, "shards"))
    if a.command == "campaign":
        entries = decide(evaluate(shards, a.expression), include=a.include, exclude=a.exclude, floor=a.floor)
        if a.out:
            print(manifests.write_manifest(entries, a.out, a.name))
        entries.groupBy("decision").count().show()
    elif a.command == "compare":
        side = lambda e: evaluate(shards, e).withColumn("decision", F.when(F.col("included"), "include").otherwise("exclude"))
        manifests.selection_overlap(pool.compare_selections(side(a.left), side(a.right))).show(truncate=False)
    else:
        ready = shards.select("shard_id", "source", F.col("final_value_score").alias("effective"), F.col("light_score").alias("composite"), F.lit(0).alias("n_selected"), F.coalesce("has_unified", F.lit(0)).alias("n_scored"))
        selection.select_shards(ready, a.n, iteration=a.iteration, held_out=tuple(a.hold_out)).orderBy("phase", "shard_id").show(a.n, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
