"""Long batch runs in slices that can be resumed: a ledger beside the results, and superseding of one slice only.

Records fall into slices by a hash of their id, so that a slice is the same set in every run. Each slice's results
are published as versions of a table of their own, and the ledger is published after them: a run that is killed
between the two runs that slice again, to the same result, and slices in the ledger are not run again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinthwork.sources import sinks

LEDGER = "slice int, slices int, run_id string, total long, records long, matched long, high long, medium long, low long"


def ledger(spark: SparkSession, root: str) -> list:
    """Rows of the slices that are done; none before the first."""
    try:
        return sinks.current(spark, f"{root}/ledger").orderBy("slice").collect()  # one row a slice
    except FileNotFoundError:
        return []


def slice_of(id: str, slices: int):
    """Slice of a record from 0; a null id is in slice 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(slices)), F.lit(0))


def run_slice(records: DataFrame, match: Callable[[DataFrame], DataFrame], root: str, number: int, slices: int, run_id: str, id: str = "id", total: int | None = None) -> bool:
    """Run one slice unless the ledger has it for this run; whether it was run.

    ``match`` turns records into results with a ``band``. A ledger of another run, of another number of
    slices, or of another count of records is for other data: it is begun anew, and results of slices not yet run stay
    as they were.
    """
    spark = records.sparkSession
    total = records.count() if total is None else total
    done = [r for r in ledger(spark, root) if (r["slices"], r["total"], r["run_id"]) == (slices, total, run_id)]
    if any(r["slice"] == number for r in done):
        return False
    mine = records.where(slice_of(id, slices) == number)
    results = match(mine).withColumn("run_id", F.lit(run_id))
    sinks.publish(results, f"{root}/slice-{number}")
    written = sinks.current(spark, f"{root}/slice-{number}")
    band = lambda b: F.count_if(F.col("band") == b)
    n = written.agg(F.count(F.lit(1)).alias("matched"), band("HIGH").alias("high"), band("MEDIUM").alias("medium"), band("LOW").alias("low")).first()
    row = (number, slices, run_id, total, mine.count(), n["matched"], n["high"], n["medium"], n["low"])
    sinks.publish(spark.createDataFrame([*map(tuple, done), row], LEDGER).coalesce(1), f"{root}/ledger")
    return True


def resume(records: DataFrame, match: Callable[[DataFrame], DataFrame], root: str, slices: int, run_id: str, id: str = "id") -> list[int]:
    """Run the slices that the ledger does not have yet, in order; their numbers."""
    total = records.count()
    return [k for k in range(slices) if run_slice(records, match, root, k, slices, run_id, id, total)]


def results(spark: SparkSession, root: str, slices: int) -> DataFrame | None:
    """Current results of all slices that have any."""
    parts = []
    for k in range(slices):
        try:
            parts.append(sinks.current(spark, f"{root}/slice-{k}"))
        except FileNotFoundError:
            continue
    return reduce(DataFrame.unionByName, parts) if parts else None
