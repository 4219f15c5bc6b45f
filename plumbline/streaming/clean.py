"""The row-wise cleaning steps on a stream.

Trimming, repairs, maps, typing and quarantine need no state, so the batch
plan runs unchanged on a streaming frame.  De-duplication, imputation and
minted keys do need it and belong to the batch job.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.cleaning import Policy, quarantined_table, rejected_cells


def quarantined_stream(stream: DataFrame, policy: Policy) -> DataFrame:
    """Typed rows of a stream beside the array of cells that did not fit."""
    return quarantined_table(stream, replace(policy, deduplicate=None))


def clean_stream(stream: DataFrame, policy: Policy, out_dir: str,
                 checkpoint: str) -> StreamingQuery:
    """Write typed rows and rejected cells of each batch, reading it once.

    Each batch writes its own folders, so a repeated batch replaces them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.drop("_rejects").write.mode("overwrite").parquet(
            f"{out_dir}/{policy.table}/batch={batch_id}")
        rejected_cells(batch).write.mode("overwrite").parquet(
            f"{out_dir}/{policy.table}__rejects/batch={batch_id}")
        batch.unpersist()

    return (quarantined_stream(stream, policy).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
