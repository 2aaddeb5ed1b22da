"""Command line: spark-submit (or python -m gaugewright) COMMAND ...

    inspect CSV                                    columns, types and first rows
    inject CELLS.csv OUT [--share --seed]          cell reports with faults, and the manifest
    learn CELLS.csv UES.csv FOLDER                 baselines as a versioned artifact
    label CELLS.csv UES.csv FOLDER OUT [--size]    labelled feature rows
    train LABELLED FOLDER                          a model of a new version with its metrics; `latest` points there
    predict MODEL FEATURES OUT                     predictions
"""

from __future__ import annotations

import argparse

from gaugewright.operators import convert, faults, features, train, windows
from gaugewright.plans import phases
from gaugewright.session import session
from gaugewright.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, words in {"inspect": "path", "inject": "cells out", "learn": "cells ues folder", "label": "cells ues folder out", "train": "labelled out", "predict": "model features out"}.items():
        p = sub.add_parser(name)
        for w in words.split():
            p.add_argument(w)
        p.add_argument("--size", type=int, default=300, help="window, seconds")
        p.add_argument("--overlap", type=float, default=0.8)
        p.add_argument("--share", type=float, default=0.15, help="windows with faults")
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--bands", default="", help="JSON or YAML of bands: bandwidth_mhz, prb_count or khz, cap")
        p.add_argument("--trials", type=int, default=50, help="models to try at most")
        p.add_argument("--version", default="v1")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session(a.master)
    step = max(1, round(a.size * (1 - a.overlap)))
    cells = lambda: readers.csv_reports(spark, a.cells, readers.CELL_SCHEMA)
    ues = lambda: readers.csv_reports(spark, a.ues, readers.UE_SCHEMA)
    if a.command == "inspect":
        df = readers.csv_inferred(spark, a.path)
        df.printSchema()
        readers.preview(df).show(truncate=False)
    elif a.command == "inject":
        df = convert.convert_cells(cells(), readers.CELL, "timestamp")  # faults come after the conversion
        start, end = windows.span([(df, "timestamp")])
        spine = windows.spine(df, start, end, a.size, step, partial_tail=True)
        faulty, manifest = faults.inject(df, "timestamp", ["timestamp", readers.CELL], spine, start, a.size, step, a.share, seed=a.seed)
        writers.csv(faulty, f"{a.out}/cells")
        writers.csv(manifest, f"{a.out}/manifest")
    elif a.command == "learn":
        print(phases.learn_baseline(cells(), ues(), a.folder, readers.config(a.bands) if a.bands else None))
    elif a.command == "label":
        print(writers.new_version(phases.label_windows(cells(), ues(), readers.baseline(a.folder), a.size, step), a.out))
    elif a.command == "train":
        names = [c for c in features.feature_columns() if not c.startswith("meta_") and c not in ("label", "window_id")]
        model = train.fit(readers.labelled(spark, a.labelled), names, order=("meta_end_time", "meta_start_time"), trials=a.trials, tiebreak="window_id")
        print(model.publish(a.out, a.version, a.size), model.meta)
    else:
        writers.parquet(train.Predictor.load(a.model).predict(spark.read.parquet(a.features)), a.out)


if __name__ == "__main__":
    main()
