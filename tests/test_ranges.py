"""Range algebra, by brute force over indices."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.functions.ranges import LongRange, SquareRange, chunk_order, slice_bounds, split_list, split_squares, split_two_levels
from rangeloom.operators.rangeset import OverlapError, RangeSet

bounds = st.tuples(st.integers(-20, 20), st.integers(0, 15)).map(lambda x: LongRange(x[0], x[0] + x[1]))


def test_illegal_and_empty():
    with pytest.raises(ValueError):
        LongRange(3, 2)
    assert LongRange(3, 3).size == 0 and list(LongRange(3, 3)) == []
    with pytest.raises(IndexError):
        LongRange(0, 3).check(3)


@given(bounds, bounds)
def test_intersection_and_overlap(a, b):
    common = set(a) & set(b)
    met = a.intersection(b)
    assert (met is None) == (not common)
    if met:
        assert set(met) == common
    if a.size and b.size:
        assert a.overlaps(b) == bool(common)
    assert a.overlaps(a)
    assert a.overlaps(b) == b.overlaps(a)


def test_empty_ranges_overlap_where_they_are():
    assert LongRange(5, 5).overlaps(LongRange(5, 9)) and not LongRange(9, 9).overlaps(LongRange(5, 9))
    assert LongRange(9, 9) in LongRange(5, 9)


@given(bounds, st.integers(1, 7))
def test_split(r, n):
    parts = r.split(n)
    assert [i for p in parts for i in p] == list(r) and len(parts) == n
    sizes = [p.size for p in parts]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert [slice_bounds(r.size, n, k, r.start) for k in range(n)] == [(p.start, p.stop) for p in parts]


@given(st.lists(bounds, max_size=6), st.integers(1, 5))
def test_split_list(ranges, n):
    parts = split_list(n, ranges)
    assert [i for p in parts for r in p for i in r] == [i for r in ranges for i in r]
    sizes = [sum(r.size for r in p) for p in parts]
    assert max(sizes) - min(sizes) <= 1


def test_order_of_chunks():
    far = [LongRange(1 << 40, (1 << 40) + 3), LongRange(0, 5), LongRange(0, 9), LongRange(-5, 0)]
    assert sorted(far, key=chunk_order) == [LongRange(-5, 0), LongRange(0, 9), LongRange(0, 5), far[0]]
    assert sorted(far) == [LongRange(-5, 0), LongRange(0, 5), LongRange(0, 9), far[0]]


squares = st.builds(SquareRange, bounds, bounds, st.booleans(), st.integers(-3, 4))


def cells(s):
    return {(i, j) for i in s.outer for j in s.inner if not s.triangle or j >= i + 1 - s.shift}


@given(squares, squares)
@settings(max_examples=200)
def test_square(a, b):
    mine = cells(a)
    assert a.size == len(mine)
    assert {(i, j) for i in a.outer for j in a.columns(i)} == mine
    assert {(i, j) for j in a.inner for i in a.rows(j)} == mine
    met = a.intersection(b)
    assert (cells(met) if met else set()) <= mine & cells(b)
    if met and not (a.triangle and b.triangle):
        assert cells(met) == mine & cells(b)
    if cells(b) and b in a:
        assert cells(b) <= mine
    tiles = a.split(3, 2)
    assert sorted(x for t in tiles for x in cells(t)) == sorted(mine)
    assert [t for p in split_squares(4, tiles) for t in p] == tiles


def test_known_triangle():
    s = SquareRange(LongRange(1, 10), LongRange(2, 10), True)
    assert s.size == 36 and (1, 2) in s and (2, 2) not in s
    assert s.translate(1, 1) == SquareRange(LongRange(2, 11), LongRange(3, 11))


@given(st.lists(bounds, max_size=8), bounds, st.integers(-25, 40))
def test_range_set(ranges, r, i):
    s, kept = RangeSet(), []
    for x in ranges:
        clash = any(x.overlaps(k) for k in kept)
        assert s.add(x) == (not clash)
        kept += [] if clash else [x]
    kept.sort()
    assert list(s) == kept and list(reversed(s)) == kept[::-1] and s.total_size == sum(k.size for k in kept)
    assert s.overlap(i) == next((k for k in kept if i in k), None)
    assert s.floor(r) == max((k for k in kept if k <= r), default=None) and s.higher(r) == min((k for k in kept if k > r), default=None)
    assert s.lower(r) == max((k for k in kept if k < r), default=None) and s.ceiling(r) == min((k for k in kept if k >= r), default=None)
    assert list(s.overlap_set(r.start, r.stop)) == [k for k in kept if k.overlaps(r)]
    assert list(s.include_set(r.start, r.stop)) == [k for k in kept if k in r]
    assert list(s.head_set(r)) == [k for k in kept if k < r] and list(s.tail_set(r)) == [k for k in kept if k >= r]
    covered = {x for k in kept for x in k}
    assert s.contains_range(r) == (set(r) <= covered)
    s.split(r.start, r.stop)
    assert sorted(x for k in s for x in k) == sorted(covered)
    size = s.total_size
    first = s.poll_first()
    assert s.total_size == size - (first.size if first else 0)


def test_range_set_remove_retain():
    s = RangeSet([LongRange(0, 10), LongRange(15, 20), LongRange(20, 30)])
    assert [list(s.split(5, 18)), len(s)] == [[LongRange(5, 10), LongRange(15, 18)], 5]
    assert s.remove(LongRange(0, 5)) and not s.remove(LongRange(0, 5))
    assert s.retain_all([LongRange(20, 30)]) and list(s) == [LongRange(20, 30)]
    with pytest.raises(OverlapError):
        RangeSet([LongRange(0, 5), LongRange(4, 6)])


def test_two_levels_hold_all_tiles():
    tiles = SquareRange(LongRange(0, 20), LongRange(0, 30)).split(5, 6)
    dealt = split_two_levels(3, 2, tiles, seed=7)
    assert sorted((t.outer, t.inner) for host in dealt for worker in host for t in worker) == sorted((t.outer, t.inner) for t in tiles)
    assert [sum(map(len, host)) for host in dealt] == [10, 10, 10] and dealt == split_two_levels(3, 2, tiles, seed=7)
