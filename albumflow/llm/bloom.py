"""Blocked Bloom filters of bounded size, built by Spark tasks over 64-bit hashes.

A key's slots lie in one block of 512, so a filter falls into parts that tasks can merge apart
from each other.  Each task turns its keys into pieces of a filter, at most one for each part and
``PENDING`` keys; a piece lists its slots while they are few and is a bit map beyond that.  Pieces are merged
in two levels, so no task reads more than a share of them, and no key is shuffled.  The
filter that reaches the driver and is broadcast has at most ``MAX_BITS`` slots whatever the
input; with more keys than that serves, more rows are found "possible" and the exact step
that follows has more to do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import U64, mix64, table
from albumflow.llm.shared import arrow_schema, partitions

MAX_BITS = 1 << 28  # 32 MB
BITS_PER_KEY = 16
PROBES = 4
BLOCK = 512
PART = 1 << 18  # slots of one part
PENDING = 1 << 18  # keys that a task holds
SALTS = 16  # ways in which the pieces of a part are merged first
_FEW = PART // 16  # slots up to which a list is the shorter form
_PIECE = "part int, salt int, piece binary"


def places(keys: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """Slot numbers of each key, one row a probe."""
    first, second = mix64(keys.view(U64)), mix64(~keys.view(U64))
    base = (first % U64(bits // BLOCK)) * U64(BLOCK)
    return np.stack([base + ((second >> U64(9 * i)) & U64(BLOCK - 1)) for i in range(probes)]).astype(np.int64)


class Filter:
    """Membership test; may say yes wrongly, never no."""

    def __init__(self, bits: int, data: bytes, probes: int = PROBES):
        self.bits, self.data, self.probes = bits, data, probes

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        at = places(np.ascontiguousarray(keys), self.bits, self.probes)
        words = np.frombuffer(self.data, dtype=np.uint8)
        return ((words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _packed(slots: np.ndarray, hits: np.ndarray) -> bytes:
    """Slots of a part that are hit once or (``hits`` 2) more often: a list, or two bit maps."""
    if len(slots) < _FEW:
        return (slots.astype(np.uint32) * 2 + (hits > 1)).astype("<u4").tobytes()
    planes = np.zeros((2, PART), dtype=bool)
    planes[0, slots] = True
    planes[1, slots[hits > 1]] = True
    return np.packbits(planes, bitorder="little").tobytes()


def _add(piece: bytes, seen: np.ndarray) -> None:
    """Count a piece's hits into ``seen``, up to 2."""
    if len(piece) < 4 * _FEW:
        own = np.frombuffer(piece, "<u4")
        slots = own >> 1
        seen[slots] = np.minimum(2, seen[slots] + 1 + (own & 1)).astype(np.uint8)
    else:
        once, more = np.unpackbits(np.frombuffer(piece, np.uint8), bitorder="little").reshape(2, PART)
        np.minimum(2, seen + once + more, out=seen)


def build(keys: DataFrame, count: int, at_least: int = 1) -> Filter:
    """Filter of the keys (one bigint column) that occur ``at_least`` (1 or 2) times.

    ``count`` is the number of keys expected; it sets the size, up to MAX_BITS, and beyond that
    the number of probes.
    """
    bits = PART
    while bits < min(MAX_BITS, BITS_PER_KEY * count):
        bits *= 2
    probes = max(1, min(PROBES, round(math.log(2) * bits / max(count, 1))))
    schema = arrow_schema(_PIECE)

    def split(held, salt):
        key, times = np.unique(np.concatenate(held), return_counts=True)
        slots, inverse = np.unique(places(key, bits, probes).ravel(), return_inverse=True)
        hits = np.bincount(inverse, np.tile(np.minimum(times, 2), probes))
        ends = np.searchsorted(slots, np.arange(0, bits + 1, PART))
        used = np.flatnonzero(np.diff(ends))
        pieces = [_packed(slots[ends[p] : ends[p + 1]] % PART, hits[ends[p] : ends[p + 1]]) for p in used]
        return table(schema, used, np.full(len(used), salt), pa.array(pieces, pa.binary()))

    def pieces(batches):
        held, pending, salt = [], 0, 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            pending += batch.num_rows
            salt = salt if len(held) > 1 or not batch.num_rows else int(mix64(held[0][:1].view(U64))[0] % U64(SALTS))
            if pending >= PENDING:
                yield split(held, salt)
                held, pending = [], 0
        if pending:
            yield split(held, salt)

    def merged(batches) -> dict[tuple[int, int], np.ndarray]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, salt, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, salt) not in seen:
                    seen[part, salt] = np.zeros(PART, dtype=np.uint8)
                _add(piece, seen[part, salt])
        return seen

    def join(batches):
        for (part, _), hits in merged(batches).items():
            slots = np.flatnonzero(hits)
            yield table(schema, [part], [0], pa.array([_packed(slots, hits[slots])], pa.binary()))

    def fill(batches):
        for (part, _), hits in merged(batches).items():
            yield table(schema, [part], [0], pa.array([np.packbits(hits >= at_least, bitorder="little").tobytes()], pa.binary()))

    tasks = min(partitions(keys), bits // PART * SALTS)
    some = keys.mapInArrow(pieces, _PIECE).repartition(tasks, "part", "salt").mapInArrow(join, _PIECE)
    whole = some.repartition(min(partitions(keys), bits // PART), F.col("part")).mapInArrow(fill, _PIECE)
    data = np.zeros(bits // 8, dtype=np.uint8)
    for row in whole.collect():
        data[row.part * PART // 8 : (row.part + 1) * PART // 8] = np.frombuffer(row.piece, np.uint8)
    return Filter(bits, data.tobytes(), probes)
