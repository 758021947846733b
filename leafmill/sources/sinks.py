"""Writers of training sets, layout documents and the batch hook for detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_training_set(rows: DataFrame, path: str) -> None:
    """Label texts under family/material/part, and a small manifest of their counts."""
    lines = rows.select("family", "material", "part", F.concat_ws("\t", "uri", "label").alias("value"))
    lines.write.partitionBy("family", "material", "part").mode("overwrite").text(f"{path}/labels")
    rows.groupBy("family", "material", "part").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_layout(regions: DataFrame, path: str) -> None:
    """One JSON document per page with its regions in order of position."""
    body = F.sort_array(F.collect_list(F.struct("pos", "type", "x_min", "y_min", "x_max", "y_max", "confidence")))
    regions.groupBy("page_id").agg(body.alias("regions")).select(F.to_json(F.struct("page_id", "regions")).alias("value")).write.mode("overwrite").text(path)


def detect(images: DataFrame, backend: Callable[[], Callable], schema: str) -> DataFrame:
    """Run a detector over partitions in pandas batches; ``backend()`` loads the model once per task."""

    def run(batches: Iterator):
        model = backend()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)
