"""Vectorised helpers on whole texts as UTF-8 bytes, used inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A 64-bit value for each byte and an odd multiplier, the same in every process.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n, modulo 2**64; kept for later calls."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        out = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums H with H[e] - H[s] = sum(values[i] * BASE**i for s <= i < e)."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """`span_hash` of every span of one length, by slices."""
    _, down = powers(len(prefix))
    out = prefix[length:] - prefix[:-length]
    out *= down[: len(out)]
    out += np.uint64(length)
    return mix(out)


#: The prime modulus of `Spans`, and a base for each of its two lanes.
PRIME = (1 << 31) - 1
LANE_BASES = (1_342_177_283, 1_879_048_201)
_lane_powers: list[tuple[np.ndarray, np.ndarray]] = []


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller value equal to x modulo PRIME; in place."""
    high = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += high
    return x


def mod_prime(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62; in place."""
    x = fold(fold(x))
    x -= np.uint64(PRIME) * (x >= np.uint64(PRIME))
    return x


def lane_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each lane base**i and base**-i for i in 0..n, modulo PRIME; kept for later calls."""
    if not _lane_powers or len(_lane_powers[0][0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        _lane_powers.clear()
        for base in LANE_BASES:
            both = []
            for b in (base, pow(base, -1, PRIME)):
                p = np.ones(size, np.uint64)
                done = 1
                while done < size:
                    p[done : 2 * done] = mod_prime(p[:done] * np.uint64(pow(b, done, PRIME)))
                    done *= 2
                both.append(p)
            _lane_powers.append((both[0], both[1]))
    return _lane_powers


class Spans:
    """62-bit hashes of spans of one sequence: polynomials modulo a prime in two lanes.

    Unlike sums modulo 2**64, two fixed strings of one length collide for at most length / PRIME of the bases in
    each lane, so no family of strings collides by construction.
    """

    def __init__(self, values: np.ndarray):
        self.prefix = []
        for (up, _), shift in zip(lane_powers(len(values) + 1), (0, 31), strict=True):
            out = np.zeros(len(values) + 1, np.uint64)
            for i in range(0, len(values), 1 << 15):
                terms = values[i : i + (1 << 15)] >> np.uint64(shift)
                terms &= np.uint64(PRIME)
                terms *= up[i : i + len(terms)]
                np.cumsum(fold(terms), out=out[i + 1 : i + 1 + len(terms)])
                out[i + 1 : i + 1 + len(terms)] += out[i]
            self.prefix.append(out)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal spans have equal hashes wherever they stand."""
        low, high = (mod_prime(fold(fold(prefix[end] - prefix[start])) * down[start]) for prefix, (_, down) in zip(self.prefix, lane_powers(len(self.prefix[0])), strict=True))
        return mix(mix(low | high << np.uint64(31)) + (end - start).astype(np.uint64))


def same_spans(text: bytes, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans start..end hold the same bytes as the spans of equal length from `other` on."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray(len(text) + 1, "<u8", data, strides=(1,))
    same, length = np.ones(len(start), bool), end - start
    for done in range(0, 64, 8):
        at = np.flatnonzero((length > done) & (other != start))
        if not len(at):
            break
        unused = np.uint64(8) * np.maximum(done + 8 - length[at], 0).astype(np.uint64)
        same[at] &= (eight[start[at] + done] ^ eight[other[at] + done]) << unused == 0
    for i in np.flatnonzero((length > 64) & (other != start)).tolist():
        same[i] = text[start[i] : end[i]] == text[other[i] : other[i] + length[i]]
    return same


def word_spans(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are not white space."""
    edge = np.diff(np.concatenate(([1], space[data].view(np.int8), [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x
