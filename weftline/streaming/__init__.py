"""Continuous file pickup with stateless transformations."""

from weftline.streaming.streams import batch_files, fan_out_batches, fan_out_stream, run_available, stream_files

__all__ = ["batch_files", "fan_out_batches", "fan_out_stream", "run_available", "stream_files"]
