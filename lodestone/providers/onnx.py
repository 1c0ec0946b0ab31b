"""Scores of an ONNX graph, one session for each Python worker.

There are no model files where this was written, so only the plumbing is tested: signature check,
session reuse, batching. Adapters are other files for the same graph, chosen by name.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import onnxruntime
except ImportError:  # the provider is optional; using it without the library is an error
    onnxruntime = None

_sessions: dict[str, object] = {}


def session(path: str, threads: int = 1):
    if onnxruntime is None:
        raise RuntimeError("onnxruntime isn't installed")
    if path not in _sessions:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        _sessions[path] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _sessions[path]


def check_signature(found_inputs, found_outputs, inputs, outputs) -> None:
    """Inputs must be exactly those asked for; outputs may be more."""
    if missing := set(inputs) - set(found_inputs):
        raise ValueError(f"the graph lacks inputs {sorted(missing)}")
    if extra := set(found_inputs) - set(inputs):
        raise ValueError(f"the graph wants inputs {sorted(extra)} too")
    if missing := set(outputs) - set(found_outputs):
        raise ValueError(f"the graph lacks outputs {sorted(missing)}")


class OnnxGraph:
    """Runs a graph over batches: feed makes its inputs from an Arrow batch, emit makes rows from its outputs."""

    def __init__(self, path: str, inputs: list[str], outputs: list[str]):
        self.base, self.path, self.inputs, self.outputs = path, path, inputs, outputs
        self.adapter: str | None = None

    def load_adapter(self, name: str, path: str) -> None:
        self.adapter, self.path = name, path

    def unload_adapter(self) -> None:
        self.adapter, self.path = None, self.base

    def run(self, df: DataFrame, feed: Callable[[pa.RecordBatch], dict], emit: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str) -> DataFrame:
        path, inputs, outputs = self.path, self.inputs, self.outputs

        def batches(stream):
            graph = session(path)
            check_signature([x.name for x in graph.get_inputs()], [x.name for x in graph.get_outputs()], inputs, outputs)
            for batch in stream:
                if batch.num_rows:
                    yield emit(batch, graph.run(outputs, feed(batch)))

        return df.mapInArrow(batches, schema)
