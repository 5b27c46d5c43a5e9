"""A keyed permutation of 0..n-1: Feistel rounds on the bits, walking the cycle until the value is below n."""

from __future__ import annotations

import numpy as np

ROUNDS = 6
M32 = 0xFFFFFFFF


def mix32(v: np.ndarray) -> np.ndarray:
    v = (v * np.uint64(0x9E3779B1)) & np.uint64(M32)
    v ^= v >> np.uint64(15)
    v = (v * np.uint64(0x85EBCA77)) & np.uint64(M32)
    v ^= v >> np.uint64(13)
    v = (v * np.uint64(0xC2B2AE3D)) & np.uint64(M32)
    return v ^ (v >> np.uint64(16))


def round_keys(key: int) -> list[int]:
    """Six 32-bit round keys of a 64-bit key."""
    out, lo, hi = [], key & M32, key >> 32 & M32
    for i in range(ROUNDS):
        v = mix32(np.array([lo ^ (i * 0x632BE5AB & M32)], dtype=np.uint64))
        out.append(int(mix32(v ^ np.uint64(hi))[0]))
    return out


def half_bits(n: int) -> int:
    """Bits of either half: the least with 4**bits >= n."""
    return max(1, ((max(2, n) - 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, h: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << h) - 1), np.uint64(h)
    left, right = x >> shift, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (mix32(left ^ np.uint64(k)) & mask), left
        else:
            left, right = right, left ^ (mix32(right ^ np.uint64(k)) & mask)
    return left << shift | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Places of the values x (each in 0..n-1); back=True undoes it. n may be up to 2**62."""
    out = np.array(x, dtype=np.uint64)
    if n < 2:
        return out.astype(np.int64)
    h, keys = half_bits(n), round_keys(key)
    todo = np.arange(len(out))
    while len(todo):  # each cycle comes back below n, so this ends
        out[todo] = _rounds(out[todo], h, keys, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)
