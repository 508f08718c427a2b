"""Static binary fuse filters with 8-bit fingerprints, built and probed in numpy.

A filter answers "may be a member" for 64-bit keys: never wrong for members,
wrong for about 1 in 256 others, at about 9 bits a key.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from .common import mixed

_HEAD = struct.Struct("<QIII")  # seed, segment length, segments, slots


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in three neighbouring segments, and its fingerprint."""
    h = mixed(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys, as bytes. Repeated keys count once; no keys give an empty filter."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return b""
    length = 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    slots = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 1
    segments = max(1, -(-slots // length) - 2)
    size = (segments + 2) * length
    for seed in range(1, 200):
        at, prints = _places(keys, seed, length, segments)
        counts = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the indexes of the keys in a slot
        for row in at:
            np.bitwise_xor.at(held, row, np.arange(n))
        layers: list[tuple[np.ndarray, np.ndarray]] = []
        left = n
        while left:
            own = np.flatnonzero(counts == 1)
            if not len(own):
                break
            peeled, first = np.unique(held[own], return_index=True)
            layers.append((peeled, own[first]))
            for row in at[:, peeled]:
                np.subtract.at(counts, row, 1)
                np.bitwise_xor.at(held, row, peeled)
            left -= len(peeled)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for peeled, own in reversed(layers):
            table[own] = 0
            table[own] = prints[peeled] ^ table[at[0, peeled]] ^ table[at[1, peeled]] ^ table[at[2, peeled]]
        return _HEAD.pack(seed, length, segments, size) + table.tobytes()
    raise ValueError(f"no seed peels {n} keys")


def probe(filter_bytes: bytes | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be members."""
    keys = np.asarray(keys, np.uint64)
    if not filter_bytes:
        return np.zeros(len(keys), bool)
    seed, length, segments, _ = _HEAD.unpack_from(filter_bytes)
    table = np.frombuffer(filter_bytes, np.uint8, offset=_HEAD.size)
    at, prints = _places(keys, seed, length, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints
