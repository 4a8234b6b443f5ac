"""Plug-ins for trained models, which are not shipped: a scorer is loaded once a worker and fed Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def scored(rows: DataFrame, column: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], output: str = "probs") -> DataFrame:
    """row_id and the scorer's output for each vector of a column.

    load: called once a worker, gives a function from a matrix (rows x inputs) to a matrix (rows x outputs), such as an
    ONNX session's run or a network's forward pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            if batch.num_rows:
                x = np.stack([np.asarray(v, np.float32) for v in batch.column(column).to_pylist()])
                yield pa.RecordBatch.from_pydict({"row_id": batch.column("row_id"), output: pa.array(list(np.asarray(model(x), np.float64)), pa.list_(pa.float64()))})

    return rows.select("row_id", column).mapInArrow(run, f"row_id bigint, {output} array<double>")


def onnx(path: str, name: str | None = None) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of an ONNX file's first output."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        given = session.get_inputs()[0].name
        return lambda x: session.run([name] if name else None, {given: x})[0]

    return load
