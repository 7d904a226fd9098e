"""Command line: pack, verify, export, convert, lookup, inspect, restore, diff, reduce. Exit code 1: a miss or a loss."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.operators import compare, reduction
from lexweave.operators.compose import GERMAN_LINKERS, PROFILES
from lexweave.operators.lookup import lookup
from lexweave.sources import export, readers


def _session() -> SparkSession:
    return SparkSession.builder.appName("lexweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(a: argparse.Namespace) -> reduction.ReductionConfig:
    return reduction.ReductionConfig(rules=PROFILES[a.profile], max_components=a.max_components, scored=a.scored, recursive=a.recursive, linkers=GERMAN_LINKERS if a.profile == "de-linkers" else ())


def _any(spark: SparkSession, path: str) -> DataFrame:
    """A packed lexicon, or a source file."""
    try:
        return export.open_lexicon(spark, path)
    except Exception:  # not a packed one
        return readers.read_lexicon(spark, path)


def pack(spark, a) -> int:
    meta = dict(x.split("=", 1) for x in a.meta)
    print(json.dumps(export.pack(readers.read_lexicon(spark, a.source, a.format), a.output, meta), ensure_ascii=False))
    return 0


def verify(spark, a) -> int:
    found = export.verify_file(spark, a.asset, a.source, a.format)
    print(json.dumps(found))
    return 0 if found["lossless"] else 1


def export_(spark, a) -> int:
    export.export_file(export.open_lexicon(spark, a.asset), a.output, a.format, a.allow_lossy)
    return 0


def convert(spark, a) -> int:
    export.convert_file(spark, a.source, a.output, a.input_format, a.format, a.allow_lossy)
    return 0


def lookup_(spark, a) -> int:
    asked = spark.createDataFrame([(w,) for w in a.words], "key string")
    rows = lookup(asked, export.open_lexicon(spark, a.asset), a.tag, a.default_tag).select("key", "hit", "kind", "selected").collect()
    for r in rows:
        print(json.dumps(r.asDict(), ensure_ascii=False))
    return 0 if all(r["hit"] for r in rows) else 1


def inspect(spark, a) -> int:
    print(json.dumps(export.inspect(spark, a.asset), ensure_ascii=False))
    return 0


def diff(spark, a) -> int:
    found = compare.diff(_any(spark, a.left), _any(spark, a.right)).first().asDict()
    print(json.dumps(found))
    return 0 if not (found["only_a"] or found["only_b"] or found["different"]) else 1


def reduce(spark, a) -> int:
    source = reduction.legacy_view(_any(spark, a.source))
    decisions, log = reduction.optimize_basis(source, _config(a), a.max_passes, a.candidates) if a.optimizer == "utility" else (reduction.greedy_basis(source, _config(a)), [])
    export.save_reduced(decisions, a.output, {"profile": a.profile, "max_components": a.max_components, "recursive": a.recursive, "scored": a.scored})
    check = reduction.verify_candidate(decisions, source).first().asDict()
    print(json.dumps({**reduction.summary(decisions).first().asDict(), **check, "passes": log}, ensure_ascii=False))
    return 0 if not any(check.values()) else 1


def restore(spark, a) -> int:
    whole = reduction.restore(export.load_reduced(spark, a.asset, _config(a))).withColumn("kind", F.lit("list")).withColumn("items", F.array().cast("array<struct<tag:string,sel_kind:string,values:array<string>>>"))
    export.export_file(whole, a.output, a.format)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, *positional):
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.set_defaults(run=run)
        return p

    p = command("pack", pack, "source", "output")
    p.add_argument("--format", default="auto")
    p.add_argument("--meta", action="append", default=[], metavar="NAME=VALUE")
    command("verify", verify, "asset", "source").add_argument("--format", default="auto")
    for name, run, first in (("export", export_, "asset"), ("convert", convert, "source")):
        p = command(name, run, first, "output")
        p.add_argument("--format", default="auto")
        p.add_argument("--input-format", default="auto")
        p.add_argument("--allow-lossy", action="store_true")
    p = command("lookup", lookup_, "asset")
    p.add_argument("words", nargs="+")
    p.add_argument("--tag", default="DEFAULT")
    p.add_argument("--default-tag", default="DEFAULT")
    command("inspect", inspect, "asset")
    command("diff", diff, "left", "right")
    for name, run, first in (("reduce", reduce, "source"), ("restore", restore, "asset")):
        p = command(name, run, first, "output")
        p.add_argument("--profile", choices=PROFILES, default="de-compound")
        p.add_argument("--max-components", type=int, default=4)
        p.add_argument("--scored", action="store_true")
        p.add_argument("--recursive", action="store_true")
        p.add_argument("--optimizer", choices=("greedy", "utility"), default="greedy")
        p.add_argument("--max-passes", type=int, default=1)
        p.add_argument("--candidates", type=int, default=4)
        p.add_argument("--format", default="auto")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(_session(), a)


if __name__ == "__main__":
    sys.exit(main())
