"""Merge, verification, report and incremental operators over tables keyed by owner, snapshot order and row order."""
