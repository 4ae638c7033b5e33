"""Packed exchange of keys: each batch of texts asks once for each of its distinct keys, whatever how often it has them.

A batch (about BATCH_BYTES of text) sends sorted keys as delta-coded blobs, one for each range of keys; a range's task
sees every batch's keys of the range and answers in the same order. A key that a third of all texts hold still arrives
once a batch. Keys are the upper bits of 64-bit hashes: as many as keep chance collisions rare at the input's size, or 64.
"""

import numpy as np
import zstandard

U64 = np.uint64
BATCH_BYTES = 4 << 20


def pack(x: np.ndarray) -> bytes:
    """Any array of integers, small after delta-coding if it rises."""
    v = x.astype(U64)
    d = np.diff(v, prepend=U64(0)) if len(v) else v
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), np.uint8) if b else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(U64), dtype=U64)


def key_bits(partitions: int) -> int:
    """Bits that make chance collisions of keys rare among the texts of so many partitions."""
    return min(64, 34 + int(np.ceil(np.log2(max(2, partitions)))))


def ranges(sorted_keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Places that cut sorted keys of so many bits into n ranges of equal width."""
    edges = np.array([(i << bits) // n for i in range(1, n)], dtype=object)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges.astype(U64)), [len(sorted_keys)]]).astype(np.int64)


def pack_small(x: np.ndarray) -> bytes:
    """Integers in no order, narrow if they are small."""
    wide = 2 if x.max(initial=0) < 1 << 16 else 8
    planes = x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_small(b: bytes) -> np.ndarray:
    wide = b[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b[1:])), np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(f"<u{wide}").ravel().astype(np.int64)
