"""Plug-in points: recogniser, checks, scorer.

* ``recognise`` runs a user's reader over images or crops (no reader is
  included).
* Gate checks and the corrector are parameters of ``gate.run_gate``.
* The vocabulary scorer is a parameter of ``vocab.snap_text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
DETECTION_SCHEMA = (f"sheet_id long, pass_id int, det_idx long, text string, quad array<{POINT}>, conf double")


def recognise(images: DataFrame, reader: Callable[[dict], list[tuple]], keys: str = "sheet_id long, pass_id int"
              ) -> tuple[DataFrame, DataFrame]:
    """(detections, errors) of a user's reader.

    ``reader`` gets one image row as a dict and returns (quad of four (x, y)
    points, text, confidence) tuples. A failure becomes an error row naming its
    kind, it does not fail the job. Blank texts are dropped.
    """
    names = [k.split()[0] for k in keys.split(",")]
    schema = f"{keys}, det_idx long, text string, quad array<{POINT}>, conf double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = [row[n] for n in names]
                try:
                    found = reader(row) or []
                    found = [(q, str(t).strip(), float(c)) for q, t, c in found if str(t).strip()]
                except Exception as exc:  # noqa: BLE001 - any reader failure is data
                    out.append([*key, None, None, None, None, f"{type(exc).__name__}: {exc}"])
                    continue
                out += [[*key, i, t, [{"x": float(x), "y": float(y)} for x, y in q], c, None]
                        for i, (q, t, c) in enumerate(found)]
            yield pd.DataFrame(out, columns=[*names, "det_idx", "text", "quad", "conf", "error"])

    # by value: executors need the reader, not this package
    import planloom.operators.hooks as here
    cloudpickle.register_pickle_by_value(here)
    rows = images.mapInPandas(run, schema)
    return (rows.where(F.col("error").isNull()).drop("error"),
            rows.where(F.col("error").isNotNull()).select(*names, "error"))
