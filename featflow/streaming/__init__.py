"""Streaming use of fitted stages.

The reference is batch-only (no watermark, window or state operator). A
fitted stage of this library is a pure projection / broadcast lookup, so
the same ``PipelineModel`` scores a streaming DataFrame unchanged.
"""

from featflow.streaming.scoring import score_stream, start_scoring  # noqa: F401
