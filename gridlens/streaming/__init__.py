"""Structured Streaming entry points for the stateless operators."""

from .stream import (event_stream, hourly_stream, run_available,  # noqa: F401
                     stream_anomalies, stream_validation)
