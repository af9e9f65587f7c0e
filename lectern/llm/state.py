"""Cutting lineage through the folder that every executor can read."""

from __future__ import annotations

from lectern.operators.stages import BROADCAST_ROWS, discard, materialize, replaceable, scratch, shared_dir, small_batches, small_side

__all__ = ["BROADCAST_ROWS", "discard", "materialize", "replaceable", "scratch", "shared_dir", "small_batches", "small_side"]
