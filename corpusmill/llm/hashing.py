"""Vectorised 64-bit hashes of words and of windows over flat byte slices."""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, odd bases and their inverses modulo 2**64.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that part words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _run_of_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept per process up to the longest slice seen."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = (_run_of_powers(base, size), _run_of_powers(pow(base, -1, 2**64), size))
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler (xor-shift and multiply), in place on a fresh uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[k] * base**k for i <= k < j."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of [start, end) that do not depend on where the span lies."""
    _, down = powers(base, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


#: A Mersenne prime, and a random base below it.
PRIME = np.uint64((1 << 61) - 1)
PRIME_BASE = int(_rng.integers(1 << 40, (1 << 61) - 2))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it."""
    low = np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = ah * bl + al * bh
    return _reduced(ah * bh * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + al * bl)


class PrimeSums:
    """Polynomial hashes of spans modulo a prime under a random base.

    Different spans of n units have equal hashes with a chance of n / 2**61, however they are built.
    """

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _prime_powers(len(values) + 1)
        terms = times(_reduced(values), up[: len(values)])
        half = np.uint64(32)
        self.low = np.zeros(len(values) + 1, np.uint64)
        self.high = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms & np.uint64((1 << 32) - 1), out=self.low[1:])
        np.cumsum(terms >> half, out=self.high[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) that do not depend on where the span lies."""
        low, high = _reduced(self.low[ends] - self.low[starts]), _reduced(self.high[ends] - self.high[starts])
        total = _reduced(low + times(high, np.full_like(high, 1 << 32)))
        return times(total, self.down[starts])


_primes: list[tuple[np.ndarray, np.ndarray]] = []


def _prime_run(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], np.full(more, step, np.uint64))
        done, step = done + more, step * step % int(PRIME)
    return out


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _primes or len(_primes[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = (_prime_run(PRIME_BASE, size), _prime_run(pow(PRIME_BASE, -1, int(PRIME)), size))
        if size > 1 << 21:
            return have[0][:n], have[1][:n]
        _primes[:] = [have]
    return _primes[0][0][:n], _primes[0][1][:n]


def word_spans(flat: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word index (len(offs) values, the last is the total)."""
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~space[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its length and its eight-byte pieces are scrambled in one after another, so that no word's
    hash is a sum over its bytes."""
    lengths = (ends - starts).astype(np.int64)
    out = mix(lengths.astype(np.uint64) * np.uint64(BASES[0]) + np.uint64(BASES[2]))
    if not len(out):
        return out
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    at_byte = np.ndarray((len(flat) + 1,), "<u8", padded, 0, (1,))
    which = np.arange(len(out)) if lengths.max() <= LONG_WORD else np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(which):
        piece = at_byte[starts[which] + done] & _KEEP[np.minimum(lengths[which] - done, 8)]
        out[which] = mix(out[which] * np.uint64(BASES[1]) ^ piece)
        done += 8
        which = which[lengths[which] > done]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : ends[i]])
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of words[i : i + n] for each i (len(words) - n + 1 values, none if that is not positive)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(words, BASES[1])
    _, down = powers(BASES[1], len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def in_one_text(first: np.ndarray, n: int) -> np.ndarray:
    """For the texts' first unit indices (and the total), which windows of n units stay inside one text."""
    total = int(first[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    if n > 1 and len(ok):
        steps = np.zeros(total + 1, np.int32)
        for_cut = first[1:-1]
        for_cut = for_cut[(for_cut > 0) & (for_cut < total)]
        np.add.at(steps, np.maximum(for_cut - n + 1, 0), 1)
        np.add.at(steps, for_cut, -1)
        ok = np.cumsum(steps)[: len(ok)] == 0
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
