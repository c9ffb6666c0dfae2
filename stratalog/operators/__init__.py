"""Operators on entry logs: version resolution, lookups, scans, batches, merges and value references."""

from .batch import assign_sequence, batch_frame, frame_of
from .resolve import latest, live
from .scans import first_n, get, multi_get, range_scan, reverse_range_scan, reverse_scan, scan

__all__ = ["assign_sequence", "batch_frame", "first_n", "frame_of", "get", "latest", "live", "multi_get", "range_scan", "reverse_range_scan", "reverse_scan", "scan"]
