"""Labelling of arriving scores. The batch operators for it are stateless, so the same functions serve a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import final_labels, threshold_predictions


def label_stream(scores: DataFrame, threshold: float = 0.4, model: str = "model") -> DataFrame:
    """Predicted and final labels of a stream of (txId, class_label, pred_proba)."""
    return final_labels(threshold_predictions(scores, threshold, model))


def write_labels(labelled: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends to a Parquet table; the checkpoint folder makes each row appear once after a restart."""
    return labelled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
