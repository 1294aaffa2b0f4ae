"""Change events from a stream into a stored graph."""

from .ingest import changes_into, windowed_counts

__all__ = ["changes_into", "windowed_counts"]
