"""Client-lifecycle and sales-pipeline analytics as plain Spark DataFrame functions."""

from clientlens.model import NO_SLICE, Slice, Windows

__all__ = ["NO_SLICE", "Slice", "Windows"]
