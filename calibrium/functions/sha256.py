"""SHA-256 of many texts that differ in a number near their start, in numpy.

Blocks before the last are the same for all that share their first part, so
their state is made once; the last block is the same for all numbers of as many
digits, so its 64 words are scalars. `hashlib` makes an object for each text.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

#: Texts that are hashed side by side; their registers stay in the processor's cache.
LANES = 1 << 14


def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(n: int) -> int:
    x = round(n ** (1 / 3))
    while x**3 > n:
        x -= 1
    while (x + 1) ** 3 <= n:
        x += 1
    return x


#: By their definition: bits after the point of roots of the first primes.
FIRST = [np.uint32(isqrt(p << 64) & 0xFFFFFFFF) for p in _primes(8)]
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_N = [np.array(i, np.uint32) for i in range(33)]


def _turned(x: np.ndarray, *by: int) -> np.ndarray:
    """Exclusive or of x turned right."""
    out = np.zeros_like(x)
    for k in by:
        out ^= (x >> _N[k]) | (x << _N[32 - k])
    return out


def _words(block: np.ndarray) -> list[np.ndarray]:
    """Words of each round, with its constant: block is of 16 numbers of each text, or of one for all."""
    w = [np.ascontiguousarray(c) for c in block]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turned(a, 7, 18) ^ (a >> _N[3])) + (_turned(b, 17, 19) ^ (b >> _N[10])))
    return [x + k for x, k in zip(w, ROUND)]


def _one(block: bytes) -> np.ndarray:
    return np.frombuffer(block, ">u4").astype(np.uint32).reshape(16, 1)


def _rounds(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """(8, texts) after a block."""
    xor, right, left, both, add = np.bitwise_xor, np.right_shift, np.left_shift, np.bitwise_and, np.add
    a, b, c, d, e, f, g, h = state.copy()
    t, u, y = (np.empty_like(a) for _ in range(3))
    x = b ^ c

    def turned(v, r1, r2, r3, l1, l2, l3):  # x turned right by three numbers, from the innermost out
        right(v, r1, t)
        xor(t, v, t)
        right(t, r2, t)
        xor(t, v, t)
        right(t, r3, t)
        left(v, l1, u)
        xor(u, v, u)
        left(u, l2, u)
        xor(u, v, u)
        left(u, l3, u)
        xor(t, u, t)

    of_e, of_a = [_N[k] for k in (14, 5, 6, 5, 14, 7)], [_N[k] for k in (9, 11, 2, 11, 9, 10)]
    for w in words:
        turned(e, *of_e)
        add(h, t, h)
        xor(f, g, t)
        both(t, e, t)
        xor(t, g, t)
        add(h, t, h)
        add(h, w, h)
        add(d, h, d)
        turned(a, *of_a)
        add(h, t, h)
        xor(a, b, y)  # the next round's b ^ c
        both(x, y, x)
        xor(x, b, x)
        add(h, x, h)
        x, y = y, x
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def begun(head: bytes, low: int, high: int, common: bytes) -> tuple[np.ndarray, bytes] | None:
    """(state, what is left over) of texts head, number, common, of numbers from low to high - 1, after their full blocks.

    None if the numbers have not all as many digits, or reach into what is left.
    """
    digits = len(str(low))
    blocks, left = divmod(len(head) + digits + len(common), 64)
    if len(str(high - 1)) != digits or len(head) + digits > 64 * blocks:
        return None
    text = head + b"0" * digits + common
    out = np.empty((8, high - low), np.uint32)
    for at in range(low, high, LANES):
        k = np.arange(at, min(high, at + LANES))
        state = np.repeat(np.array(FIRST, np.uint32)[:, None], len(k), axis=1)
        for i in range(blocks):
            own = text[64 * i : 64 * i + 64]
            spots = [(j, len(head) + j - 64 * i) for j in range(digits) if 0 <= len(head) + j - 64 * i < 64]
            if spots:
                chars = np.repeat(np.frombuffer(own, np.uint8)[:, None], len(k), axis=1)
                for j, spot in spots:
                    chars[spot] = 48 + k // 10 ** (digits - 1 - j) % 10
                four = chars.reshape(16, 4, len(k)).astype(np.uint32)
                state = _rounds(state, _words(four[:, 0] << _N[24] | four[:, 1] << _N[16] | four[:, 2] << _N[8] | four[:, 3]))
            else:
                state = _rounds(state, _words(_one(own)))
        out[:, at - low : at - low + len(k)] = state
    return out, text[len(text) - left :]


def ended(state: np.ndarray, left: bytes, done: int):
    """Digests, (8, LANES at most) at a time, of texts with this state after `done` bytes and as many bytes left, of one block at most."""
    if len(left) > 55:
        raise ValueError("more than a block is left")
    words = _words(_one(left + b"\x80" + bytes(55 - len(left)) + (8 * (done + len(left))).to_bytes(8, "big")))
    for at in range(0, state.shape[1], LANES):
        yield _rounds(state[:, at : at + LANES], words)
