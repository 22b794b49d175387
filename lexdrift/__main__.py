"""python -m lexdrift TEXTS OUT: from landed texts to drift tables."""

from __future__ import annotations

import argparse
from dataclasses import replace

from lexdrift.operators.train import W2VSettings
from lexdrift.plans.study import Study, texts_to_vectors, vectors_to_drift
from lexdrift.session import log_to, session
from lexdrift.sources.stores import TEXTS, in_years, read_records


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexdrift", description=__doc__)
    p.add_argument("texts", help="JSON records with celex, date, status and paragraphs")
    p.add_argument("out")
    for name, kind in (("start", int), ("end", int), ("window-size", int), ("step", int), ("anchor-top-n", int), ("k", int), ("min-percentile", int), ("min-slices-analysis", int)):
        p.add_argument(f"--{name}", type=kind, default=getattr(Study, name.replace("-", "_")))
    p.add_argument("--vector-size", type=int, default=100)
    p.add_argument("--min-count", type=int, default=50)
    p.add_argument("--epochs", type=int, default=10)
    p.add_argument("--skip-phrases", action="store_true")
    p.add_argument("--single-year", action="store_true")
    a = vars(p.parse_args(args))
    texts, out = a.pop("texts"), a.pop("out")
    w2v = W2VSettings(vector_size=a.pop("vector_size"), min_count=a.pop("min_count"), epochs=a.pop("epochs"))
    study = replace(Study(), w2v=w2v, **a)
    spark, log = session(), log_to()
    rows = in_years(read_records(spark, texts, TEXTS + ", date string"), study.start, study.end).select("celex", "year", "status", "paragraphs")
    tables = texts_to_vectors(spark, rows, out, study)
    for name in vectors_to_drift(spark, tables, out, study):
        log.info("%s/%s", out, name)


if __name__ == "__main__":
    main()
