"""python -m codelattice passaging|indexing|searching|sweep FLAGS..., or a JSON file of them."""

import sys

from codelattice.plans.arguments import Indexing, Passaging, Searching, Sweep, parse
from codelattice.plans.pipeline import run_indexing, run_passaging, run_searching, run_sweep
from codelattice.session import ship


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("codelattice").getOrCreate()
    ship(spark)
    stage, *flags = argv or ["help"]
    if stage == "passaging":
        print(run_passaging(spark, parse(Passaging, flags)).count(), "passages")
    elif stage == "indexing":
        print(run_indexing(spark, parse(Indexing, flags)))
    elif stage == "searching":
        run, scores = run_searching(spark, parse(Searching, flags))
        print(run.count(), "rows")
        for m, v in scores.collect() if scores is not None else []:
            print(f"{m}\t{v:.4f}")
    elif stage == "sweep":
        for row in run_sweep(spark, parse(Sweep, flags)):
            print("\t".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.items()))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
