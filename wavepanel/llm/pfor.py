"""Patched frame-of-reference coding of token ids.

A run of ids is cut into blocks. Each block stores its minimum, the differences
to it packed at a width that a given share of them fits (a percentile of their
bit lengths), and the few that don't fit as an exception list (position, value).
All blocks have the same number of ids, and an index of block starts makes any
one of them readable alone.

Layout (little-endian): magic ``WPF1``, block size u32, ids u64, blocks u32;
index: start of each block u64; block: minimum u32, width u8, exceptions u32,
packed differences, exception positions u32, exception differences u32.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WPF1"
HEAD = struct.Struct("<4sIQI")
BLOCK_HEAD = struct.Struct("<IBI")
BLOCK_IDS = 1024
SHARE = 0.95


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (n, ids) -> rows of bytes, ``width`` bits for each value."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").view(np.uint8).reshape(len(values), -1)
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, axis=1, count=n * width, bitorder="little").reshape(len(raw), n, width)
    out = np.zeros((len(raw), n), np.uint32)
    for i in range(width):
        out |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
    return out


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, share: float = SHARE) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n_blocks = -(-len(ids) // block_ids)
    padded = np.zeros(n_blocks * block_ids, np.uint32)
    padded[:len(ids)] = ids
    if len(ids) and len(ids) < len(padded):
        padded[len(ids):] = ids[-1]
    grid = padded.reshape(n_blocks, block_ids)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    length = np.frexp(diff.astype(np.float64))[1].astype(np.int8)       # bit length; 0 for 0
    at = min(block_ids - 1, max(0, int(np.ceil(share * block_ids)) - 1))
    width = np.partition(length, at, axis=1)[:, at].astype(np.int64) if n_blocks else np.zeros(0, np.int64)
    outlier = length > width[:, None]
    blocks: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(np.where(outlier[rows], 0, diff[rows]), int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        for k, r in enumerate(rows):
            where = np.flatnonzero(outlier[r])
            blocks[r] = b"".join((BLOCK_HEAD.pack(int(low[r]), int(w), len(where)), packed[k].tobytes(),
                                  where.astype("<u4").tobytes(), diff[r, where].astype("<u4").tobytes()))
    sizes = np.fromiter(map(len, blocks), np.uint64, n_blocks)
    first = HEAD.size + 8 * n_blocks
    starts = (np.concatenate(([0], np.cumsum(sizes)[:-1])) + first).astype("<u8") if n_blocks else np.zeros(0, "<u8")
    return b"".join((HEAD.pack(MAGIC, block_ids, len(ids), n_blocks), starts.tobytes(), *blocks))


def decode(raw: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first_block`` up to ``last_block`` (all by default)."""
    magic, block_ids, n, n_blocks = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    starts = np.frombuffer(raw, "<u8", n_blocks, HEAD.size)
    stop = n_blocks if last_block is None else min(last_block, n_blocks)
    heads = [BLOCK_HEAD.unpack_from(raw, int(starts[b])) for b in range(first_block, stop)]
    grid = np.zeros((len(heads), block_ids), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    data = np.frombuffer(raw, np.uint8)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            size = -(-block_ids * int(w) // 8)
            at = starts[first_block + rows].astype(np.int64) + BLOCK_HEAD.size
            packed = np.stack([data[a:a + size] for a in at])
            grid[rows] = _unpack(packed, int(w), block_ids)
    for k, (low, w, n_out) in enumerate(heads):
        if n_out:
            at = int(starts[first_block + k]) + BLOCK_HEAD.size + -(-block_ids * w // 8)
            grid[k, np.frombuffer(raw, "<u4", n_out, at)] = np.frombuffer(raw, "<u4", n_out, at + 4 * n_out)
        grid[k] += np.uint32(low)
    end = min(n, stop * block_ids) - first_block * block_ids
    return grid.reshape(-1)[:max(0, end)]
