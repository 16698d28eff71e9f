"""Command line: ``python -m kindsort --input inv.csv --output out/``, or
``python -m kindsort --folder landing/ --output out/`` for a folder where files arrive.

The flags follow the original command line; answers are read from tables
instead of being requested live:

  --skip-facility / --skip-descriptions      leave a stage out
  --preserve-existing / --no-preserve-existing keep categories already present
  --batch-size N                             size of request batches (L7)
  --description-batch N                      describe only the first N rows
  --form-defaults                            only categories (the form's defaults)
  --completions PATH                         parquet (request_id, response)
  --attempts PATH                            parquet attempt log for descriptions
  --store PATH                               answers kept between runs; new ones are added
  --single-line                              no quoted newlines: large files are split
  --folder PATH                              process the file versions that are new there
                                             (instead of --input); again for the next ones
  --max-files N                              files of a micro-batch

Outputs under --output: table/, csv/, rejects/, requests/ (still unanswered, in
batches), request_kinds/, summary/, run_record/.  With --folder: rows/, counts/, files/,
rejects/, requests/ (each issued once ever), progress/ and the streams' checkpoint/.
The session comes from the usual Spark configuration (spark-submit); it must
name a shared ``spark.checkpoint.dir`` on a cluster.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .plans.batch import CLI_DEFAULTS, FORM_DEFAULTS, Options, run
from .session import ENGINE_CONF, ensure_checkpoint_dir, ship_package
from .sinks.store import AnswerStore
from .streaming.folder import run_folder, stream_progress


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kindsort", description="Classify and report on an inventory with Spark.")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--input", help="inventory CSV file or folder")
    given.add_argument("--folder", help="landing folder, processed file by file")
    p.add_argument("--max-files", type=int, default=None)
    p.add_argument("--output", required=True, help="output folder")
    p.add_argument("--skip-facility", action="store_true")
    p.add_argument("--skip-descriptions", action="store_true")
    p.add_argument("--preserve-existing", dest="preserve_existing", action="store_true", default=True)
    p.add_argument("--no-preserve-existing", dest="preserve_existing", action="store_false")
    p.add_argument("--batch-size", type=int, default=CLI_DEFAULTS.batch_size)
    p.add_argument("--description-batch", type=int, default=None)
    p.add_argument("--form-defaults", action="store_true", help="categories only")
    p.add_argument("--completions", default=None)
    p.add_argument("--attempts", default=None)
    p.add_argument("--store", default=None)
    p.add_argument("--single-line", action="store_true")
    p.add_argument("--no-csv", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    base = FORM_DEFAULTS if a.form_defaults else CLI_DEFAULTS
    opts = Options(
        preserve_existing=a.preserve_existing,
        skip_facility=a.skip_facility or base.skip_facility,
        skip_descriptions=a.skip_descriptions or base.skip_descriptions,
        batch_size=a.batch_size,
        description_batch=a.description_batch,
        multi_line=not a.single_line,
    )
    spark = SparkSession.builder.appName("kindsort").getOrCreate()
    for k, v in ENGINE_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    completions = spark.read.parquet(a.completions) if a.completions else None
    attempts = spark.read.parquet(a.attempts) if a.attempts else None
    if a.folder:
        store = AnswerStore(spark, a.store) if a.store else None
        if store is not None and completions is not None:
            store.append(completions, int(time.time() * 1000))
        run_folder(spark, a.folder, a.output, f"{a.output}/checkpoint", opts, store if store is not None else completions, a.max_files, attempts)
        for r in stream_progress(spark, a.output).orderBy("batch_id", "stage").toLocalIterator():
            print(json.dumps(r.asDict()))
        return 0
    rec = run(spark, a.input, a.output, opts, completions, attempts, csv=not a.no_csv, store=a.store)
    for run_id, stage, seconds, rows in rec.rows:
        print(json.dumps({"run_id": run_id, "stage": stage, "seconds": round(seconds, 3), "rows": rows, **rec.progress.get(stage, {})}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
