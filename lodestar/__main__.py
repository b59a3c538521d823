"""python -m lodestar STEP ROOT [options]: the pipeline's steps from a shell."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields

from .operators.split import SplitConfig
from .plans import pipelines
from .session import session, step
from .sources.tables import Paths

STEPS = ("preprocess", "make_split", "retrieve_benchmark", "evaluate_retrievers", "build_candidates", "build_features", "train_reranker", "rerank_benchmark")


def _options(parser: argparse.ArgumentParser, cls) -> None:
    for f in fields(cls):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(flag, type=type(f.default), default=f.default)


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    for name in STEPS:
        own = steps.add_parser(name)
        own.add_argument("root", help="folder of dataset/, processed/, split/, rerank/, results/ and models/")
        if name == "preprocess":
            own.add_argument("--dry-run", action="store_true")
        elif name == "make_split":
            _options(own, SplitConfig)
        elif name == "train_reranker":
            own.add_argument("--name", default="listwise")
            own.add_argument("--drop-features", nargs="*", default=list(pipelines.DROPPED))
            own.add_argument("--kind", default="listwise", choices=list(pipelines.KINDS))
            own.add_argument("--rounds", type=int, default=None)
            own.add_argument("--baseline", default=None, help="an earlier model to compare with")
            own.add_argument("--top-k", type=int, default=50)
        elif name == "rerank_benchmark":
            own.add_argument("--models", nargs="+", default=["listwise"])
            own.add_argument("--top-k", type=int, default=50)
            own.add_argument("--name", default="reranked")
            own.add_argument("--compare", default=None)
        else:
            _options(own, pipelines.Search)
            own.add_argument("--vectors", nargs="*", default=[], metavar="NAME=ITEMS,QUERIES", help="Parquet of (item_id, vector) and (query, vector)")
            if name in ("build_candidates", "build_features"):
                own.add_argument("--parts", nargs="+", default=["train", "val", "benchmark"], choices=["train", "val", "benchmark"])
            else:
                own.add_argument("--no-fill", action="store_true")
                own.add_argument("--name", default="first_stage" if name == "retrieve_benchmark" else "evaluation")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark=None) -> None:
    a = parse(argv)
    spark, p = spark or session(), Paths(a.root)
    pick = lambda cls: cls(**{f.name: getattr(a, f.name) for f in fields(cls)})
    shown = None
    with step(a.step):
        if a.step == "preprocess":
            shown = pipelines.run_preprocess(spark, p, a.dry_run)
        elif a.step == "make_split":
            shown = pipelines.run_split(spark, p, pick(SplitConfig))
        elif a.step == "train_reranker":
            shown = pipelines.run_train(spark, p, a.name, tuple(a.drop_features), a.rounds, a.top_k, a.kind, a.baseline)
        elif a.step == "rerank_benchmark":
            shown = pipelines.run_rerank(spark, p, a.models, a.top_k, a.name, a.compare)
        else:
            if getattr(a, "no_fill", False):
                a.fill = None
            vectors = {n: tuple(spark.read.parquet(x) for x in paths.split(",")) for n, _, paths in (v.partition("=") for v in a.vectors)}
            s = pick(pipelines.Search)
            if a.step == "retrieve_benchmark":
                shown = pipelines.run_retrieve(spark, p, s, vectors, a.name)
            elif a.step == "evaluate_retrievers":
                shown = pipelines.run_evaluate(spark, p, s, vectors, a.name)
            else:
                for part in a.parts:
                    (pipelines.run_candidates if a.step == "build_candidates" else pipelines.run_features)(spark, p, s, part, vectors)
    if shown is not None:
        shown.show(100, truncate=False)
    spark.catalog.clearCache()


if __name__ == "__main__":
    main()
