"""Structured Streaming entry points.

The reference has no streaming operators (no watermarks, windows or state); its "incoming
data" retraining check re-reads a batch. The Spark form of that step is ``drift_monitor``:
new files arriving in a folder are processed as micro-batches and each batch runs the batch
drift report (L04) against a reference table, appending the report to the run log (A17).
``sketch_monitor`` does it from mergeable sketches: the reference is read once, and the report of
all batches so far needs no batch again.
"""

from skucast.streaming.drift_monitor import drift_monitor  # noqa: F401
from skucast.streaming.sketch_monitor import sketch_monitor  # noqa: F401
