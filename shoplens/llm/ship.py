"""Session set-up of this subpackage: the package goes to the executors, which import the operators' Python code by
name, and Arrow batches get a bound in bytes, since texts can be long."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shoplens.session import ship_package

#: Bytes of an Arrow batch that a Python worker gets (a longer row makes a batch of its own).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Bound the batches, and send the package, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)
