"""Rangeloom: lists, grids, bags and maps with long indices, as Spark DataFrames."""

from rangeloom.functions.ranges import LongRange, SquareRange, split_list
from rangeloom.operators.accumulate import accept, scatter
from rangeloom.operators.bag import BagFrame
from rangeloom.operators.grid import GridFrame, TiledGrid
from rangeloom.operators.indexed import IndexedFrame, prefix_sum
from rangeloom.operators.keyed import KeyedFrame, MultiMap, RangedKeyedFrame
from rangeloom.operators.product import Product
from rangeloom.operators.rangeset import OverlapError, RangeSet
from rangeloom.operators.reduce import FoldReducer, Reducer, reduce_with, reduction

__all__ = [
    "BagFrame", "FoldReducer", "GridFrame", "IndexedFrame", "KeyedFrame", "LongRange", "MultiMap", "OverlapError", "Product", "RangeSet",
    "RangedKeyedFrame", "Reducer", "SquareRange", "TiledGrid", "accept", "prefix_sum", "reduce_with", "reduction", "scatter", "split_list",
]
