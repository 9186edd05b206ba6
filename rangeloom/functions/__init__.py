"""Ranges and column expressions."""

from rangeloom.functions.ranges import LongRange, SquareRange, chunk_order, null_safe_equals, slice_bounds, split_list, split_squares

__all__ = ["LongRange", "SquareRange", "chunk_order", "null_safe_equals", "slice_bounds", "split_list", "split_squares"]
