"""Quality of page images and the steps that prepare them for recognition, over rasters (doc_id, page, width, height, dpi, gray)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrove.functions import quality
from lexigrove.functions.pixels import STEPS, measures

PARTS = ("resolution", "blur", "noise", "contrast", "skew", "compression")


def _image(w, h, gray) -> np.ndarray | None:
    return np.frombuffer(gray, np.uint8).reshape(h, w) if gray is not None and w and h and len(gray) == w * h else None


def assessed(rasters: DataFrame, binarize: bool = False) -> DataFrame:
    """``rasters`` with the six measures, skew_deg, score, level and plan; null for rasters that are none."""
    names = [*PARTS, "skew_deg"]

    def run(batches):
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in ("width", "height", "dpi", "gray")}
            found = []
            for w, h, dpi, gray in zip(*(b.column(at[k]).to_pylist() for k in at)):
                g = _image(w, h, gray)
                found.append(measures(g, dpi or 0) if g is not None else {})
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f.get(n) for f in found], pa.float64()) for n in names)], names=[*b.schema.names, *names])

    schema = StructType(list(rasters.schema.fields))
    for n in names:
        schema = schema.add(n, "double")
    out = rasters.mapInArrow(run, schema)
    there = F.col("blur").isNotNull()
    out = out.withColumn("score", F.when(there, quality.image_score({k: F.col(k) for k in PARTS})))
    out = out.withColumn("level", F.when(there, quality.image_level(F.col("score"))))
    return out.withColumn("plan", F.when(there, quality.preprocess_plan(F.col("level"), binarize)))


def prepared(judged: DataFrame) -> DataFrame:
    """``assessed`` rasters with ``gray`` after the steps of their plan, and ``bands`` (top, bottom) where these are asked for."""
    def run(batches):
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in ("width", "height", "gray", "plan", "skew_deg")}
            out = []
            for w, h, gray, plan, turned in zip(*(b.column(at[k]).to_pylist() for k in at)):
                g = _image(w, h, gray)
                for step in plan or [] if g is not None else []:
                    g = STEPS[step](g, {"skew_deg": turned}) if step in STEPS else g
                out.append(g.tobytes() if g is not None else gray)
            columns = [pa.array(out, pa.binary()) if i == at["gray"] else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    out = judged.mapInArrow(run, judged.schema)
    return out.withColumn("bands", F.when(F.array_contains("plan", "high_resolution_bands"), quality.horizontal_bands(F.col("height"))))
