"""Greatest and least dot products of all pairs of two blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows of both sides that are multiplied at once.
STEP = 512
#: Pairs beyond which equal ones are worked out once.
MANY = 10_000

TYPE = "ti int, tj int, n long, top double, low double"


def _vectors(column: pa.ChunkedArray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``wide`` doubles with 0 for what is missing, and which there are."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = own.flatten()  # without what is below null lists
    size = np.asarray(own.value_lengths().fill_null(0))
    here = np.arange(wide)[None, :] < size[:, None]
    out, there = np.zeros(here.shape), np.zeros(here.shape, bool)
    out[here] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    there[here] = flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, added up in order of elements."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    with np.errstate(all="ignore"):
        for k in range(x.shape[-1]):
            total = total + x[..., k] * y[..., k]
    return total


def _exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows ``a`` of x with rows ``b`` of y; of many, equal pairs of rows once."""
    if len(a) > MANY:
        ux, xs = np.unique(x[np.unique(a)], axis=0, return_inverse=True)
        uy, ys = np.unique(y[np.unique(b)], axis=0, return_inverse=True)
        kinds = np.unique(xs.ravel()[np.searchsorted(np.unique(a), a)] * np.int64(len(uy)) + ys.ravel()[np.searchsorted(np.unique(b), b)])
        x, y, a, b = ux, uy, kinds // len(uy), kinds % len(uy)
    return np.concatenate([_in_order(x[a[k : k + MANY * 8]], y[b[k : k + MANY * 8]]) for k in range(0, len(a), MANY * 8)])


def _bounds(values: np.ndarray) -> tuple[float, float] | None:
    """As SQL orders: NaN is above all numbers."""
    if not values.size:
        return None
    numbers = values[~np.isnan(values)]
    return (np.nan if numbers.size < values.size else numbers.max()), (numbers.min() if numbers.size else np.nan)


def dot_bounds(left: pa.Table, right: pa.Table, x: str, y: str, first: int | None) -> pa.Table:
    """(ti, tj, n, top, low) for the pairs with ``j >= i + first``, or all, by tile.

    All pairs are multiplied as matrices, whose sums aren't in order; those near enough to the greatest or least to be it
    are worked out again element by element, so the results are those of sums in order. Missing elements add nothing,
    and a pair with no element in both vectors has no dot product.
    """
    i, j = (np.asarray(t.column(c).combine_chunks()) for t, c in ((left, "i"), (right, "j")))
    ti, tj = (np.asarray(t.column(c).combine_chunks()) for t, c in ((left, "ti"), (right, "tj")))
    wide = max([0, *[int(np.asarray(t.column(c).combine_chunks().value_lengths().fill_null(0)).max(initial=0)) for t, c in ((left, x), (right, y))]])
    (u, hu), (v, hv) = _vectors(left.column(x), wide), _vectors(right.column(y), wide)
    found: dict[tuple[int, int], list] = {}
    whole_u, whole_v = (h.all(1) & np.isfinite(m).all(1) & (wide > 0) for m, h in ((u, hu), (v, hv)))

    def put(key: tuple[int, int], n: int, bounds: tuple[float, float] | None) -> None:
        f = found.setdefault(key, [0, [], []])
        f[0] += n
        if bounds is not None:
            f[1].append(bounds[0])
            f[2].append(bounds[1])

    for s in np.unique(ti):
        for t in np.unique(tj):
            rows, columns = (o[np.argsort(k[o], kind="stable")] for o, k in ((np.flatnonzero(ti == s), i), (np.flatnonzero(tj == t), j)))
            for p in range(0, len(rows), STEP):
                a = rows[p : p + STEP]
                for q in range(0, len(columns), STEP):
                    b = columns[q : q + STEP]
                    cut = first is not None and j[b[0]] < i[a[-1]] + first
                    if cut and j[b[-1]] < i[a[0]] + first:
                        continue
                    real = j[b][None, :] >= i[a][:, None] + first if cut else None
                    put((int(s), int(t)), int(real.sum()) if cut else len(a) * len(b), None)
                    plain_a, plain_b = whole_u[a], whole_v[b]
                    if plain_a.all() and plain_b.all():
                        put((int(s), int(t)), 0, _plain(u[a], v[b], real))
                        continue
                    real = np.ones((len(a), len(b)), bool) if real is None else real
                    if plain_a.any() and plain_b.any():
                        put((int(s), int(t)), 0, _plain(u[a[plain_a]], v[b[plain_b]], real[np.ix_(plain_a, plain_b)]))
                    for at in np.flatnonzero(~plain_a):
                        put((int(s), int(t)), 0, _odd(u[a[at]], hu[a[at]], v[b], hv[b], real[at]))
                    for at in np.flatnonzero(~plain_b):
                        put((int(s), int(t)), 0, _odd(v[b[at]], hv[b[at]], u[a[plain_a]], hu[a[plain_a]], real[plain_a, at]))
    keys = [k for k, f in found.items() if f[0]]
    ends = {k: ((_bounds(np.array(found[k][1])) or (None, None))[0], (_bounds(np.array(found[k][2])) or (None, None))[1]) for k in keys}
    return pa.table({
        "ti": pa.array([k[0] for k in keys], pa.int32()), "tj": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([found[k][0] for k in keys], pa.int64()),
        "top": pa.array([ends[k][0] for k in keys], pa.float64()), "low": pa.array([ends[k][1] for k in keys], pa.float64()),
    })


def _plain(x: np.ndarray, y: np.ndarray, real: np.ndarray | None) -> tuple[float, float] | None:
    """Bounds over whole, finite vectors."""
    if real is not None and not real.any():
        return None
    with np.errstate(all="ignore"):
        dots = x @ y.T
        slack = 8 * x.shape[1] * 2.3e-16 * np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) + 1e-300
    if not np.isfinite(slack) or not np.isfinite(dots).all():
        a, b = np.nonzero(np.ones(dots.shape, bool) if real is None else real)
        return _bounds(_exact(x, y, a, b))
    top, low = (dots.max(), dots.min()) if real is None else (dots.max(where=real, initial=-np.inf), dots.min(where=real, initial=np.inf))
    near = [dots >= top - slack, dots <= low + slack]
    near = near if real is None else [m & real for m in near]
    return _exact(x, y, *np.nonzero(near[0])).max(), _exact(x, y, *np.nonzero(near[1])).min()


def _odd(x: np.ndarray, has: np.ndarray, y: np.ndarray, have: np.ndarray, real: np.ndarray) -> tuple[float, float] | None:
    """Bounds of one vector with others, where elements are missing or not finite."""
    both = have[real] & has
    with np.errstate(all="ignore"):
        total = np.zeros(len(both))
        for k in range(len(x)):
            total = np.where(both[:, k], total + x[k] * y[real][:, k], total)
    return _bounds(total[both.any(1)])
