"""The k most similar vectors of every vector by cross-polytope hashing (problem 3).

Unit vectors, shifted by the mean of a bounded sample, are turned by Hadamard pseudo-rotations
(random signs and a fast Walsh-Hadamard transform, three times). The nearest signed axis is the
bucket; the next nearest axes are further probes. There are several independent tables, and the
buckets of each are divided by a second and a third rotation as the collection grows, so that a
bucket holds about as many vectors at every size. A vector is stored in all the buckets it probes,
so two vectors meet wherever their probe sets share a bucket of any table. A bucket compares all
its vectors, on the vectors themselves, and keeps the k best of each; the lists are then merged.

More than BLOCK vectors are first told apart by the parts into which a bounded sample of them falls
(a single part if it falls into none), and hashed around the mean of their part. A part that one
group can search travels once, as one bucket; a larger one by its best buckets as above. A group
too large to compare all its pairs hashes its vectors again in memory, where probes cost no shuffle.

For the shuffle the rows of a batch are packed: one row per bucket and batch with the ids and the
vectors as 16-bit fixed-point numbers relative to their greatest component. That keeps a cosine
within 3e-5; ``knn_pairs_at_least`` recomputes those near its threshold from the exact vectors.

Exact copies are one vector with several ids, merged inside each batch before the shuffle, so a
vector that makes up a third of the table costs a row per batch and probe; its list is handed to
its other ids by a salted join at the end. A bucket with more than BLOCK vectors is cut into sub-blocks and every pair of them becomes a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rankweave.session import Workspace

#: Vectors from which the mean is taken at most, chosen by hash of the id.
SAMPLE = 20_000
#: Vectors in a bucket on average, at most; more buckets are made above it.
LOAD = 20_000
#: Ids of one vector above which its rows are salted when the lists are handed to all its ids.
HOT = 100_000
#: Vectors that one group compares at most.
BLOCK = 100_000
#: Vectors whose lists one merge group holds on average.
MERGE = 50_000
#: Vectors that one group searches at most by hashes of its own.
GROUP = 1 << 19
#: Probes of a part of the collection that is shared out to the 2 * dim buckets of one rotation.
SHARED = 8
SEED = 20_240_229
_POOL = 4


def _signs(seed: int, dim: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(np.array([-1.0, 1.0], np.float32), (3, dim))


def pseudo_rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Walsh-Hadamard transform; columns padded to a power of 2."""
    dim = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), dim), np.float32)
    y[:, : x.shape[1]] = x
    for sign in _signs(seed, dim):
        y *= sign
        h = 1
        while h < dim:
            z = y.reshape(len(x), dim // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), dim)
            h *= 2
        y /= np.float32(np.sqrt(dim))
    return y


class Scheme(NamedTuple):
    """Which buckets there are and how many of each table a vector reaches."""

    axes: tuple[int, ...]  # axes of a second rotation, a third ... that divide each bucket
    counts: tuple[int, ...]  # probes in each table

    def buckets(self, dim: int) -> int:
        """Buckets of one table."""
        return 2 * dim * math.prod(2 * a for a in self.axes)


def scheme(n: int, dim: int) -> Scheme:
    """Buckets in proportion to ``n`` vectors, and probes that never get fewer as ``n`` grows.

    A table has the signed axes of a rotation as buckets. Where a bucket would hold more than LOAD
    vectors on average, it is divided by axes of a second rotation, a third and so on, and each
    table takes more probes: 5 in the first and 2 in the second table, then 5 in each and 1.6 for
    every doubling. A few thousand vectors or less reach more of the buckets.
    """
    dim = 1 << max(0, dim - 1).bit_length()
    least = -(-30_000 // max(n, 1))
    divide = 0
    while True:
        axes, left = [], divide
        while left:
            axes.append(min(left, dim))
            left = -(-left // (2 * dim)) if left > dim else 0
        parts = math.prod(2 * a for a in axes)
        wants = (5 + math.ceil(1.6 * math.log2(parts / 2)),) * 2 if axes else (5, 2)
        got = Scheme(tuple(axes), tuple(min(2 * dim, max(least, w)) for w in wants))
        if n * max(got.counts) <= LOAD * got.buckets(dim):
            return got
        divide = max(1, 2 * divide)


def _best_axes(x: np.ndarray, seed: int, axes: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``count`` of the first ``axes`` signed axes of a rotation, and the coordinates there."""
    y = pseudo_rotate(x, seed)[:, :axes]
    y = np.concatenate([y, -y], axis=1)
    top = np.argsort(-y, axis=1, kind="stable")[:, :count]
    return top, np.take_along_axis(y, top, 1)


def probes(x: np.ndarray, s: Scheme) -> np.ndarray:
    """The best buckets of each row in every table, best first within a table.

    A bucket is a signed axis of each of the table's rotations; the sum of the coordinates ranks
    the combinations. Tables are numbered apart.
    """
    dim = 1 << max(0, x.shape[1] - 1).bit_length()
    found = []
    for t, count in enumerate(s.counts):
        at, value = _best_axes(x, SEED + 10 * t, dim, count)
        for nth, axes in enumerate(s.axes, 1):
            few, more = _best_axes(x, SEED + 10 * t + nth, axes, count)
            both = (value[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(both, best, 1)
            at = np.take_along_axis(at, best // few.shape[1], 1) * (2 * axes) + np.take_along_axis(few, best % few.shape[1], 1)
        found.append(at + t * s.buckets(dim))
    return np.concatenate(found, axis=1).astype(np.int32)


def usable(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors (float64) of the rows with ``dim`` finite values that aren't all 0."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    ok = pc.and_(ok, pc.is_valid(ids))
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    x = np.asarray(flat, np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    x = np.where(good[:, None], x, 0.0)
    x /= np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    good &= norm > 0
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), x[good] / norm[good, None]


def _arrays(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    return batch.column(0), batch.column(1)


class Places(NamedTuple):
    """The buckets of a collection: each part of it lies around a mean and has a scheme of its own."""

    means: np.ndarray
    cells: np.ndarray  # a row belongs to the part of the nearest of these
    part: np.ndarray  # the part of each cell
    schemes: tuple[Scheme, ...]  # without probes: the part is one bucket
    hashed: bool  # large buckets are searched by hashes of their own

    def first(self, dim: int) -> np.ndarray:
        """Where the buckets of each part begin."""
        dim = 1 << max(0, dim - 1).bit_length()
        return np.cumsum([0, *(s.buckets(dim) * len(s.counts) or 1 for s in self.schemes)])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The buckets of each row, -1 where its part has fewer probes than another."""
        part = self.part[nearest(x, self.cells)]
        out = np.full((len(x), max(sum(s.counts) or 1 for s in self.schemes)), -1, np.int32)
        for c, first in zip(np.unique(part), self.first(x.shape[1])[np.unique(part)], strict=True):
            rows, s = np.flatnonzero(part == c), self.schemes[c]
            at = probes((x[rows] - self.means[c]).astype(np.float32), s) if s.counts else np.zeros((len(rows), 1), np.int32)
            out[rows, : at.shape[1]] = at + first
        return out


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nearest mean of each row."""
    if len(means) == 1:
        return np.zeros(len(x), np.int64)
    return (x @ means.T - 0.5 * (means * means).sum(axis=1)).argmax(axis=1)


def part_scheme(size: float, dim: int) -> Scheme:
    """Buckets of a part of ``size`` vectors: one as long as a group can search it."""
    if size <= 0.7 * GROUP:
        return Scheme((), ())
    got = scheme(math.ceil(size * LOAD / (GROUP // 2)), dim)
    return got if got.axes else Scheme((), (SHARED,))


def fit_parts(x: np.ndarray, k: int, kept: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """Means of cells, and the part of each cell, of a sample of unit vectors.

    Cells that are near each other compared with the spread around their means are one part. The
    measure is widened, until a single part is left if need be, as long as the parts tear apart
    more than 1 - ``kept`` of the k nearest neighbours within the sample.
    """
    rng = np.random.RandomState(SEED)
    means = x[rng.permutation(len(x))[: max(1, min(192, len(x) // 50))]]
    least = len(x) // len(means) // 4  # a mean of a few vectors says nothing of a part
    for _ in range(10):
        size = np.bincount(cell := nearest(x, means))
        means = np.stack([x[cell == c].mean(axis=0) for c in np.flatnonzero(size >= min(least, size.max()))])
    cell = nearest(x, means)
    spread = np.bincount(cell, ((x - means[cell]) ** 2).sum(axis=1), len(means)) / np.maximum(np.bincount(cell, minlength=len(means)), 1)
    far = ((means[:, None] - means[None]) ** 2).sum(axis=2)
    asked = rng.permutation(len(x))[:500]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    within = 0.4
    while True:
        tie = (far <= within * (spread[:, None] + spread[None]) / 2) | np.eye(len(means), dtype=bool)
        label = np.arange(len(means))
        while True:
            low = np.where(tie, label[None], len(means)).min(axis=1)
            if (low == label).all():
                break
            label = low
        _, part = np.unique(label, return_inverse=True)
        if part.max() == 0 or (part[cell[near]] == part[cell[asked]][:, None]).mean() >= kept:
            return means, part
        within = within * 1.5 if within < 100 else np.inf


_BLOBS = ("ids", "vectors", "sigs", "copy_at", "copy_id", "home")
_STORED = "bucket int, pair long, side int, " + ", ".join(f"{b} binary" for b in _BLOBS)
_STORED_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("pair", pa.int64()), ("side", pa.int32()), *[(b, pa.binary()) for b in _BLOBS]]
)


def _hash_rows(q: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row; rows with one key are compared before they count as copies."""
    wide = q.view(np.int64)
    odd = np.random.RandomState(SEED).randint(1, 2**62, wide.shape[1], dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        mixed = (wide ^ (wide >> 29)) * odd
        return (mixed ^ (mixed >> 32)).sum(axis=1)


def merge_copies(q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to keep, by ascending id, and for each row the position of the kept row it equals."""
    order = np.argsort(ids, kind="stable")
    key = _hash_rows(q)[order]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if (q[order] == q[order][first[inverse]]).all():
        by = np.argsort(first, kind="stable")
        place = np.empty(len(first), np.int64)
        place[by] = np.arange(len(first))
        at = np.empty(len(ids), np.int64)
        at[order] = place[inverse]
        return order[first[by]], at
    return order, np.argsort(order)  # keys collided: every row stands for itself


def fixed_point(x: np.ndarray) -> np.ndarray:
    """Rows as 16-bit numbers relative to their greatest component; columns padded to four."""
    q = np.round(x * (32767.0 / np.abs(x).max(axis=1))[:, None]).astype(np.int16)
    return np.pad(q, ((0, 0), (0, -x.shape[1] % 4)))


def _store(batches: Iterator[pa.RecordBatch], dim: int, to: Places, k: int, groups: dict):
    """Rows of packed vectors for each bucket (and pair of sub-blocks) that a batch reaches."""
    schema = _STORED_SCHEMA
    for batch in batches:
        ids, x = usable(*_arrays(batch), dim)
        if not len(ids):
            continue
        q = fixed_point(x)
        keep, at = merge_copies(q, ids)
        where = to.of(x[keep])
        s = to.schemes[0]
        sigs = np.zeros((len(keep), 0), np.uint8) if to.hashed else (where - _offsets(s, dim)).astype(_sig_kind(s, dim))
        several = np.bincount(at, minlength=len(keep)) > 1
        rid, rq = ids[keep], q[keep]
        mixed = _hash_rows(rq)
        few = np.zeros(len(ids), bool)
        if several.any():  # the first k + 1 ids of each vector
            o = np.lexsort((ids, at))
            starts = np.r_[0, np.flatnonzero(np.diff(at[o])) + 1]
            nth = np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)]))
            few[o[nth <= k]] = True
        flat, row = where.ravel(), np.repeat(np.arange(len(keep)), where.shape[1])
        is_home = np.tile(np.arange(where.shape[1]) == 0, len(keep))  # the best bucket of the first table
        order = np.argsort(flat, kind="stable")
        order = order[np.count_nonzero(flat < 0) :]
        cut = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0, True])
        out: dict[str, list] = {n: [] for n in schema.names}
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            here = order[a:b]
            bucket, g = int(flat[here[0]]), groups.get(int(flat[here[0]]), 1)
            for u in range(g):
                mine = here if g == 1 else here[_spread(mixed[row[here]], g) == u]
                if not len(mine):
                    continue
                r, home = row[mine], is_home[mine]
                copy_at, copy_id = [], []
                if several[r].any():
                    back = np.full(len(keep), -1, np.int64)
                    back[r] = np.arange(len(r))
                    sel = (back[at] >= 0) & several[at] & few
                    copy_at, copy_id = back[at[sel]], ids[sel]
                data = [
                    rid[r].tobytes(), rq[r].tobytes(), sigs[r].tobytes(),
                    np.asarray(copy_at, np.int64).tobytes(), np.asarray(copy_id, np.int64).tobytes(), home.tobytes(),
                ]
                for t in range(g):  # a group for each pair of sub-blocks, those of one with itself included
                    for n, v in zip(schema.names, [bucket, min(u, t) * g + max(u, t), int(u > t), *data], strict=True):
                        out[n].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _offsets(s: Scheme, dim: int) -> np.ndarray:
    """Where the table of each probe begins."""
    buckets = s.buckets(1 << max(0, dim - 1).bit_length())
    return np.repeat(np.arange(len(s.counts), dtype=np.int32) * buckets, s.counts)


def _sig_kind(s: Scheme, dim: int):
    """The least type that holds a bucket within its table."""
    buckets = s.buckets(1 << max(0, dim - 1).bit_length())
    return np.uint8 if buckets <= 1 << 8 else np.uint16 if buckets <= 1 << 16 else np.int32


def _spread(ids: np.ndarray, g: int) -> np.ndarray:
    """A number below g for each id or row key."""
    with np.errstate(over="ignore"):
        h = (ids ^ (ids >> 31)) * np.int64(0x5851F42D4C957F2D)
    return ((h >> 33) & 0x7FFFFFFF) % g


def block_top(x: np.ndarray, k: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, other, cosine`` of the k best others of each row; equal cosines by lower position.

    Exact within the block. Tiles of the upper triangle serve both directions; a lower bound of
    each row's k-th best, from group maxima of a sample of columns, keeps the candidates few.
    With ``sides`` only pairs of rows on different sides count.
    """
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    if n > 1 << 18:
        raise ValueError("a block holds at most 2**18 vectors")
    bound = np.full(n, -2.0, np.float32)
    for own in [slice(None)] if sides is None else [sides == v for v in np.unique(sides)]:
        _first_bounds(x, bound, np.arange(n)[own], np.arange(n) if sides is None else np.flatnonzero(~own), k)
    found: list[np.ndarray] = []
    held = 0
    for b in range(0, n, 2048):
        xb = x[b : b + 2048]
        for a in range(0, min(n, b + 2048), 512):
            xa = x[a : a + 512]
            s = xa @ xb.T
            inside = a >= b
            if sides is not None:
                s[sides[a : a + 512][:, None] == sides[b : b + 2048][None, :]] = -3.0
            if inside:
                at = np.arange(len(xa))
                s[at, at + (a - b)] = -3.0
            found.append(_hits(s, bound[a : a + 512], a, b, False))
            if not inside:
                found.append(_hits(s, bound[b : b + 2048], a, b, True))
            held += len(found[-1]) + (len(found[-2]) if not inside else 0)
        if held > 15 * n:
            keys = _best(np.concatenate(found), k)
            found, held = [keys], len(keys)
            _raise(bound, keys, k)
    keys = _best(np.concatenate(found), k)
    row = keys >> 45
    cos = 1.0 - ((keys >> 18) & 0x7FFFFFF).astype(np.float64) / (1 << 26)
    return row, keys & 0x3FFFF, cos.astype(np.float32)


def hashed_top(x: np.ndarray, k: int, axes: int, tables: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, other, cosine`` like ``block_top``, for rows that meet in a cell of some table.

    The rows are shifted by their mean; a cell of a table is a signed axis of one rotation and one
    of the first ``axes`` of another, and each row lies in its ``count`` best cells.
    """
    n, dim = len(x), 1 << max(0, x.shape[1] - 1).bit_length()
    bound = np.full(n, -2.0, np.float32)
    _first_bounds(x, bound, np.arange(n), np.arange(n), k, 2048)
    mean = x.mean(axis=0)
    i, j = np.divmod(np.arange(count * count), count)
    i, j = (v[(i + 1) * (j + 1) <= count] for v in (i, j))  # no other pair can be among the best
    found: list[np.ndarray] = []
    held = 0
    products, flags = np.empty(256 * 2048, np.float32), np.zeros(256 * 2048 + 8, bool)

    def best(y: np.ndarray, turn: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
        z = y @ turn[: x.shape[1], :some]
        z = np.concatenate([z, -z], axis=1)
        m = min(count, z.shape[1])
        top = np.argpartition(z, -m, axis=1)[:, -m:]
        v = np.take_along_axis(z, top, 1)
        by = np.argsort(-v, axis=1)
        return np.take_along_axis(top, by, 1), np.take_along_axis(v, by, 1)

    for t in range(tables):
        turns = [pseudo_rotate(np.eye(dim, dtype=np.float32), seed + 2 * t + u) for u in (0, 1)]
        at = np.empty((n, count), np.int64)  # cell and row
        for a in range(0, n, 8192):
            y = x[a : a + 8192] - mean
            first, v = best(y, turns[0], dim)
            second, w = best(y, turns[1], axes)
            ok = (i < first.shape[1]) & (j < second.shape[1])
            top = np.argpartition(v[:, i[ok]] + w[:, j[ok]], -count, axis=1)[:, -count:]
            cell = np.take_along_axis(first, i[ok][top], 1) * (2 * axes) + np.take_along_axis(second, j[ok][top], 1)
            at[a : a + 8192] = (cell << 32) | np.arange(a, a + len(y))[:, None]
        at = at.reshape(-1)
        at.sort()
        ends = np.searchsorted(at, np.arange(4 * dim * axes + 1) << 32)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a < 2:
                continue
            here = at[a:b] & 0xFFFFFFFF
            here = here[np.argsort(bound[here])]
            xc, low = x[here], bound[here]
            for u in range(0, b - a, 256):  # later rows have higher bounds: the test for the earlier one serves both
                xu = xc[u : u + 256]
                for v in range(u, b - a, 2048):
                    xv = xc[v : v + 2048]
                    s = np.matmul(xu, xv.T, out=products[: len(xu) * len(xv)].reshape(len(xu), len(xv)))
                    row, other = _at_least(s, low[u : u + 256], flags)
                    cos = s[row, other]
                    row, other = row + u, other + v
                    later = other > row
                    row, other, cos = row[later], other[later], cos[later]
                    if len(row):
                        both = cos >= low[other]
                        found.append(_pair_keys(here[row], here[other], cos))
                        found.append(_pair_keys(here[other[both]], here[row[both]], cos[both]))
                        held += len(found[-1]) + len(row)
            if held > 2 * k * n:  # up to k * n of these are the best so far
                found = [_best_pairs(np.concatenate(found), k, bound)]
                held = len(found[0])
        if found:
            found = [_best_pairs(np.concatenate(found), k, bound)]
            held = len(found[0])
    keys = found[0] if found else np.zeros(0, np.int64)
    row, other, far = keys >> 44, (keys >> 25) & 0x7FFFF, keys & 0x1FFFFFF
    return row, other, (1.0 - far.astype(np.float64) / (1 << 24)).astype(np.float32)


def _at_least(s: np.ndarray, low: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries not below the row's bound; ``flags`` is scratch space."""
    np.greater_equal(s, low[:, None], out=flags[: s.size].reshape(s.shape))
    words = -(-s.size // 8)
    flags[s.size : 8 * words] = False
    some = np.flatnonzero(flags[: 8 * words].view(np.uint64))  # eight flags at a time
    at, bit = np.nonzero(flags[: 8 * words].reshape(words, 8)[some])
    return np.divmod(some[at] * 8 + bit, s.shape[1])


def _pair_keys(row: np.ndarray, other: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Keys (row, other, 1 - cosine) for rows below 2**19."""
    far = np.clip(np.round((1.0 - cos.astype(np.float64)) * (1 << 24)), 0, 0x1FFFFFF).astype(np.int64)
    return (row.astype(np.int64) << 44) | (other.astype(np.int64) << 25) | far


def _best_pairs(keys: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """The keys of the k best of each row, each pair once; raises the bounds of full rows."""
    keys.sort()
    pair = keys >> 25
    keys = keys[np.r_[True, pair[1:] != pair[:-1]]] if len(keys) else keys
    by = (keys >> 44 << 44) | ((keys & 0x1FFFFFF) << 19) | ((keys >> 25) & 0x7FFFF)
    by.sort()
    row = by >> 44
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(by) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(by)])
    full = first[size >= k] + k - 1
    bound[row[full]] = np.maximum(bound[row[full]], (1.0 - ((by[full] >> 19) & 0x1FFFFFF) / (1 << 24) - 1e-6).astype(np.float32))
    by = by[np.arange(len(by)) - np.repeat(first, size) < k]
    return (by >> 44 << 44) | ((by & 0x7FFFF) << 25) | ((by >> 19) & 0x1FFFFFF)


def searched(n: int, whole: bool) -> tuple[int, int, int] | None:
    """Axes, tables and cells of a row for the hashes of a group; None: all pairs are compared.

    A group that is a part of the collection as a ``whole`` is the only place where its vectors
    meet; others are met in several buckets.
    """
    if whole:
        return None if n <= 60_000 else (32, 4, 24) if n <= 250_000 else (32, 4, 20)
    return None if n <= 30_000 else (8, 4, 12) if n <= 120_000 else (32, 4, 16)


def _first_bounds(x: np.ndarray, bound: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int, most: int = 1 << 18) -> None:
    """Lower bounds of the k-th best of ``rows`` among ``others`` from a sample of the latter."""
    width = 1 << max(5, (2 * k).bit_length())
    m = max(width * 8, min(most, len(others) // 8)) // width * width
    if len(others) < 2 * m:
        return
    sample = np.ascontiguousarray(x[others[:: len(others) // m][:m]])
    for a in range(0, len(rows), 512):
        s = x[rows[a : a + 512]] @ sample.T
        top = s.reshape(len(s), m // width, width).max(axis=1)
        # k + 1: the row itself may be in the sample
        at = width - 1 - k
        bound[rows[a : a + 512]] = np.partition(top, at, axis=1)[:, at] - np.float32(1e-6)


def _hits(s: np.ndarray, bound: np.ndarray, a: int, b: int, turned: bool) -> np.ndarray:
    """Keys (row, 1 - cosine, other) of the entries not below the row's bound."""
    r, c = s.shape
    if turned:
        w = _POOL if r % _POOL == 0 else 1
        pooled = s.reshape(w, r // w, c).max(axis=0) if w > 1 else s
        g, col = np.divmod(np.flatnonzero(pooled >= bound[None, :]), c)
        rows = (g[:, None] + np.arange(w)[None, :] * (r // w)).ravel()
        cols = np.repeat(col, w)
        v = s[rows, cols]
        ok = v >= np.maximum(bound[cols], -2.0)
        row, other, v = cols[ok] + b, rows[ok] + a, v[ok]
    else:
        w = _POOL if c % _POOL == 0 else 1
        pooled = s.reshape(r, w, c // w).max(axis=1) if w > 1 else s
        rw, g = np.divmod(np.flatnonzero(pooled >= bound[:, None]), pooled.shape[1])
        cols = (g[:, None] + np.arange(w)[None, :] * (c // w)).ravel()
        rows = np.repeat(rw, w)
        v = s[rows, cols]
        ok = v >= np.maximum(bound[rows], -2.0)
        row, other, v = rows[ok] + a, cols[ok] + b, v[ok]
    far = np.clip(np.round((1.0 - v.astype(np.float64)) * (1 << 26)), 0, 0x7FFFFFF).astype(np.int64)
    return (row.astype(np.int64) << 45) | (far << 18) | other


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    keys.sort()
    row = keys >> 45
    start = np.r_[True, row[1:] != row[:-1]] if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    nth = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    return keys[nth < k]


def _raise(bound: np.ndarray, keys: np.ndarray, k: int) -> None:
    row = keys >> 45
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    full = first[size >= k] + k - 1
    low = (1.0 - ((keys[full] >> 18) & 0x7FFFFFF) / (1 << 26) - 1e-6).astype(np.float32)
    bound[row[full]] = np.maximum(bound[row[full]], low)


_LISTS = "part int, q binary, n binary, c binary, rep binary, key binary"


def _bucket(table: pa.Table, dim: int, k: int, parts: int, sub: dict[int, int], to: Places) -> pa.Table:
    """The lists of one group: a bucket, or two of its sub-blocks."""

    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])

    bucket, pair = table.column("bucket")[0].as_py(), table.column("pair")[0].as_py()
    groups = sub.get(bucket, 1)
    ids = joined("ids", np.int64)
    q = joined("vectors", np.int16).reshape(len(ids), -1)
    home = joined("home", bool)
    sizes = [len(v.as_buffer()) // 8 for v in table.column("ids")]
    base = np.cumsum([0, *sizes[:-1]])
    copy_at = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) + o for v, o in zip(table.column("copy_at"), base, strict=True)])
    copy_id = joined("copy_id", np.int64)
    side = np.repeat(table.column("side").to_numpy(), sizes)
    keep, at = merge_copies(q, ids)
    x = q[keep, :dim].astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    side = side[keep]
    cross = bool(groups > 1 and pair // groups != pair % groups)
    ids_ = ids[keep]
    s = to.schemes[int(np.searchsorted(to.first(dim), bucket, "right")) - 1]
    how = searched(len(x), not s.counts) if to.hashed and groups == 1 else None
    if how:
        row, other, cos = hashed_top(x, k, *how, SEED + 1000 + 10 * bucket)
    else:
        row, other, cos = block_top(x, k, side if cross else None)
    if not to.hashed:  # a pair is reported by the first bucket that both vectors have
        sigs = (joined("sigs", _sig_kind(s, dim)).reshape(len(ids), -1) + _offsets(s, dim))[keep]
        mine, theirs = sigs[row], sigs[other]
        shared = np.where((mine[:, :, None] == theirs[:, None, :]).any(axis=2), mine, np.iinfo(np.int32).max).min(axis=1)
        ok = shared == bucket
        row, other, cos = row[ok], other[ok], cos[ok]
    qs, ns, cs = [ids_[row]], [ids_[other]], [cos]
    rep, key = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    # copies: those merged in the batches and those merged here
    pairs = np.unique(
        np.concatenate([np.stack([at[copy_at], copy_id], 1), np.stack([at, ids], 1)]), axis=0
    )
    many = np.bincount(pairs[:, 0], minlength=len(keep)) > 1
    if many.any():
        pairs = pairs[many[pairs[:, 0]]]
        first = np.flatnonzero(np.r_[True, np.diff(pairs[:, 0]) > 0])
        span = np.diff(np.r_[first, len(pairs)])
        nth = np.arange(len(pairs)) - np.repeat(first, span)
        low = pairs[nth <= k]
        begin = np.full(len(keep), -1, np.int64)
        f2 = np.flatnonzero(np.r_[True, np.diff(low[:, 0]) > 0])
        n2 = np.diff(np.r_[f2, len(low)])
        begin[low[f2, 0]] = f2
        num = np.zeros(len(keep), np.int64)
        num[low[f2, 0]] = n2
        hit = np.flatnonzero(num[other] > 1)  # a neighbour stands for all its ids
        rep = np.repeat(hit, num[other[hit]])
        off = np.arange(len(rep)) - np.repeat(np.cumsum(num[other[hit]]) - num[other[hit]], num[other[hit]])
        more = low[begin[other[rep]] + off, 1]
        new = more != ids_[other[rep]]
        qs.append(ids_[row[rep]][new])
        ns.append(more[new])
        cs.append(cos[rep][new])
        # its own ids are its neighbours; only where it is at home, once
        at_home = np.zeros(len(keep), bool)
        at_home[at[home]] = not cross
        own = low[at_home[low[:, 0]]]
        qs.append(ids_[own[:, 0]])
        ns.append(own[:, 1])
        cs.append(np.ones(len(own), np.float32))
        # every id of the vector gets its list later, found by key
        mine = np.unique(own[:, 0])
        rep, key = ids_[mine], _keys(q[keep[mine]])
    qq, nn, cc = np.concatenate(qs), np.concatenate(ns), np.concatenate(cs)
    return _lists(qq, nn, cc, rep, key, parts)


def _keys(q: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each row."""
    return np.stack([_hash_rows(q), _hash_rows(np.ascontiguousarray(q[:, ::-1]))], axis=1)


_LISTS_SCHEMA = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("q", "n", "c", "rep", "key")]])


def _lists(q, n, c, rep, key, parts: int) -> pa.Table:
    p, pm = _spread(q, parts), _spread(rep, parts)
    order, orderm = np.argsort(p, kind="stable"), np.argsort(pm, kind="stable")
    at = np.searchsorted(p[order], np.arange(parts + 1))
    atm = np.searchsorted(pm[orderm], np.arange(parts + 1))
    out: dict[str, list] = {x: [] for x in _LISTS_SCHEMA.names}
    for i in range(parts):
        o, om = order[at[i] : at[i + 1]], orderm[atm[i] : atm[i + 1]]
        if len(o) or len(om):
            for name, v in zip(
                _LISTS_SCHEMA.names,
                (i, q[o].tobytes(), n[o].tobytes(), c[o].tobytes(), rep[om].tobytes(), key[om].tobytes()),
                strict=True,
            ):
                out[name].append(v)
    return pa.Table.from_pydict(out, schema=_LISTS_SCHEMA)


def _merge(table: pa.Table, k: int) -> pa.Table:
    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])

    q, n, c = joined("q", np.int64), joined("n", np.int64), joined("c", np.float32)
    rep, key = joined("rep", np.int64), joined("key", np.int64).reshape(-1, 2)
    order = np.lexsort((-c, n, q))  # several buckets may report a pair, with rounding of their own
    q, n, c = q[order], n[order], c[order]
    same = np.r_[False, (q[1:] == q[:-1]) & (n[1:] == n[:-1])] if len(q) else np.zeros(0, bool)
    q, n, c = q[~same], n[~same], c[~same]
    order = np.lexsort((n, -c, q))
    q, n, c = q[order], n[order], c[order]
    grouped = np.isin(q, rep)  # vectors with copies: their lists hold their own ids too
    single = _ranked(q[~grouped], n[~grouped], c[~grouped], k, drop_self=True)
    rep, first = np.unique(rep, return_index=True)
    several = _ranked(q[grouped], n[grouped], c[grouped], k + 1, drop_self=False)
    keys = np.zeros((len(single[0]) + len(several[0]), 2), np.int64)
    if len(rep):
        keys[len(single[0]) :] = key[first][np.searchsorted(rep, several[0])]
    q, n, c, r = (np.concatenate(v) for v in zip(single, several, strict=True))
    many = np.arange(len(q)) >= len(single[0])
    return pa.table({"vec_id": q, "neighbour": n, "cosine": c, "rank": r.astype(np.int32), "many": many, "key_a": keys[:, 0], "key_b": keys[:, 1]})


def _ranked(q, n, c, k: int, drop_self: bool):
    if drop_self:
        ok = q != n
        q, n, c = q[ok], n[ok], c[ok]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    ok = nth < k
    return q[ok], n[ok], c[ok], nth[ok] + 1


def knn(df: DataFrame, vec_id: str, vector: str, dim: int, k: int = 10, plan: Scheme | None = None) -> DataFrame:
    """``vec_id, neighbour, cosine, rank``: the k most similar vectors of every usable vector.

    Usable: ``dim`` finite values, not all 0, and an id. Other rows neither ask nor answer. Equal
    cosines go by ascending id, so exact copies find each other first. A vector that meets fewer
    than k others has fewer rows. ``cosine`` is within 3e-5 of the exact one. Buckets and probes
    are those of ``plan``, by default as ``scheme`` says.
    """
    spark = df.sparkSession
    slim = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    n = slim.count()
    every = max(1, n // SAMPLE)
    picked = slim.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, num = np.zeros(dim), 0
        for batch in batches:
            ids, x = usable(*_arrays(batch), dim)
            total += x.sum(axis=0)
            num += len(ids)
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()], "n": [num]})

    got = picked.mapInArrow(sums, "s binary, n bigint").collect()  # one row a task
    num = sum(r["n"] for r in got)
    mean = sum((np.frombuffer(r["s"]) for r in got), np.zeros(dim)) / max(1, num)
    at = Places(mean[None], mean[None], np.zeros(1, np.int64), (plan or scheme(n, dim),), False)
    if plan is None and n > BLOCK and dim > 32:  # fewer dimensions are divided well enough by scheme
        sample = _sample(picked, dim)
        at = places(sample, n, k) if len(sample) else at
    groups: dict[int, int] = {}

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _store(batches, dim, at, k, groups)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(*_arrays(batch), dim)
            if len(ids):
                keep, _ = merge_copies(fixed_point(x), ids)
                where = at.of(x[keep]).ravel()
                rows = np.bincount(where[where >= 0])
                some = np.flatnonzero(rows)
                yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "rows": rows[some]})

    if n > BLOCK:  # no bucket can exceed a block otherwise
        sizes = slim.mapInArrow(tally, "bucket int, rows bigint").groupBy("bucket").agg(F.sum("rows").alias("rows"))
        # at most (probes of all vectors) / BLOCK buckets can be that large
        for r in sizes.where(F.col("rows") > (GROUP if at.hashed else BLOCK)).collect():
            groups[r["bucket"]] = -(-r["rows"] // (BLOCK // 2))
    parts = max(1, -(-n // MERGE))
    stored = slim.mapInArrow(store, _STORED)
    if at.hashed:  # few bytes and much work in each group: partitions are not to be joined for their size
        least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        stored = stored.repartition(min(int(at.first(dim)[-1]), least), "bucket", "pair")
    lists = stored.groupBy("bucket", "pair").applyInArrow(lambda t: _bucket(t, dim, k, parts, groups, at), _LISTS)
    merged = lists.groupBy("part").applyInArrow(
        lambda t: _merge(t, k),
        "vec_id bigint, neighbour bigint, cosine float, rank int, many boolean, key_a bigint, key_b bigint",
    )
    merged = Workspace(spark, "knn").keep(merged, "lists")
    single = merged.where("NOT many").select("vec_id", "neighbour", "cosine", "rank")
    many = merged.where("many")
    return single if many.isEmpty() else single.unionByName(_to_all_ids(slim, many, dim, k))


def _sample(picked: DataFrame, dim: int) -> np.ndarray:
    """The usable vectors of a bounded sample as unit vectors, by ascending id."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(*_arrays(batch), dim)
            yield pa.RecordBatch.from_pydict({"id": ids, "x": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())})

    rows = sorted((r["id"], bytes(r["x"])) for r in picked.mapInArrow(units, "id bigint, x binary").collect())
    return np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(-1, dim)


def places(x: np.ndarray, n: int, k: int) -> Places:
    """Parts of ``n`` vectors as the sample ``x`` shows them, each with buckets in proportion to its size."""
    cells, part = fit_parts(x, k)
    of = part[nearest(x, cells)]
    parts = [x[of == p] for p in range(part.max() + 1)]
    means = np.stack([v.mean(axis=0) if len(v) else np.zeros(x.shape[1], np.float32) for v in parts])
    return Places(means, cells, part, tuple(part_scheme(n * len(v) / len(x), x.shape[1]) for v in parts), True)


def _to_all_ids(slim: DataFrame, many: DataFrame, dim: int, k: int) -> DataFrame:
    """The list of a repeated vector for each of its ids, the id itself left out.

    A vector may make up a third of the table: a key with more than HOT ids is salted, its list
    copied once per salt. At most (rows) / HOT keys are that large, which bounds the broadcast.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(*_arrays(batch), dim)
            keys = _keys(fixed_point(x)) if len(ids) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_pydict({"id": ids, "key_a": keys[:, 0], "key_b": keys[:, 1]})

    keys = ["key_a", "key_b"]
    of = slim.mapInArrow(keyed, "id bigint, key_a bigint, key_b bigint")
    hot = of.groupBy(keys).count().where(F.col("count") > HOT).select(*keys, F.expr(f"int(count div {HOT}) + 1").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    ids = of.join(F.broadcast(hot), keys, "left").select(*keys, "id", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    list_ = F.sort_array(F.collect_list(F.struct("rank", "neighbour", "cosine"))).alias("list")
    lists = many.groupBy(keys).agg(list_).join(F.broadcast(hot), keys, "left")
    lists = lists.select(*keys, "list", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = F.expr("filter(list, x -> x.neighbour <> id)")
    return ids.join(lists, [*keys, "salt"]).select(
        F.col("id").alias("vec_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x")
    ).select("vec_id", "x.neighbour", "x.cosine", (F.col("at") + 1).alias("rank"))


#: A cosine this near a threshold is computed again from the exact vectors.
NEAR = 1e-4


def knn_pairs_at_least(df: DataFrame, vec_id: str, vector: str, dim: int, threshold: float, k: int = 10) -> DataFrame:
    """``vec_id_a, vec_id_b``, a < b: neighbours (k each) with a cosine of at least ``threshold``.

    A pair counts if either vector has the other in its list. Cosines within NEAR of the
    threshold are decided by the exact double-precision cosine of the stored vectors.
    """
    ws = Workspace(df.sparkSession, "pairs")
    found = knn(df, vec_id, vector, dim, k).where(F.col("cosine") >= threshold - NEAR)
    pairs = ws.keep(
        found.groupBy(F.least("vec_id", "neighbour").alias("a"), F.greatest("vec_id", "neighbour").alias("b")).agg(
            F.max("cosine").alias("c")
        ),
        "pairs",
    )
    sure = pairs.where(F.col("c") > threshold + NEAR).select("a", "b")
    near = pairs.where(F.col("c") <= threshold + NEAR).select("a", "b")
    if not near.isEmpty():
        vectors = df.select(
            F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")
        )
        ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        vectors = ws.keep(vectors.join(ends, "id", "left_semi"), "vectors")
        both = near.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")

        def dot(x: str, y: str):
            return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

        cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
        sure = sure.unionByName(both.where(cosine >= threshold).select("a", "b"))
    return sure.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b")).distinct()
