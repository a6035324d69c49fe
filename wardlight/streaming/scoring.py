"""Scoring of incidents as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators.fp_model import LinearModel, fp_features, score_fp
from wardlight.plans.session import materialise


def stream_score(
    model: PipelineModel | LinearModel, incidents: DataFrame, assets: DataFrame, threshold: float,
    path: str, checkpoint: str,
) -> StreamingQuery:
    """Batch scoring of a stream of incidents with the static assets, into a Parquet table.

    Each micro-batch is written once, looked at for hot assets and joined like a batch table, so an asset with
    a third of its incidents is spread over tasks. How much arrives at once is limited where
    the stream is read (``maxFilesPerTrigger``). A batch that runs twice overwrites itself.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = fp_features(materialise(batch), assets)
        score_fp(model, rows, threshold).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        incidents.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
