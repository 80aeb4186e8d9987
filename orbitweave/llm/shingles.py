"""Sets of hashed word shingles and their HyperMinHash registers, for use inside tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
#: Registers of a signature, registers in a band, and mantissa bits of a register.
REGISTERS, BAND_ROWS, MANTISSA = 175, 5, 10
BANDS = REGISTERS // BAND_ROWS
#: 64-bit words of a parity sketch.
SKETCH_WORDS = 16
#: Size classes: name, smallest and largest set, hash functions. Neighbours overlap so
#: far that two sets of similarity 0.8 or more always share a class; of smaller sets
#: only equal ones are as similar.
SIZE_CLASSES = (("small", 4, 80, REGISTERS), ("middle", 64, 640, 8), ("large", 512, 1 << 62, 1))

_rng = np.random.default_rng(20240501)
_WORD_FACTORS = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_BAND_FACTORS = _rng.integers(1, 2**63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALTS = _rng.integers(0, 2**63, (len(SIZE_CLASSES), BANDS), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text.

    Only A-Z are lower-cased; words are runs other than space and U+0009 to U+000D.
    Fewer words than a shingle form one shingle together; no word, an empty set.
    """
    split = [(t or b"").lower().split() for t in texts]
    flat = list(chain.from_iterable(split))
    if len(flat) >= SHINGLE_WORDS:
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64)
        words = hashes[coded.indices.to_numpy()]
        count = len(words) - SHINGLE_WORDS + 1
        rolled = mix(sum(words[j : j + count] * _WORD_FACTORS[j] for j in range(SHINGLE_WORDS)))
    sets, at = [], 0
    for words in split:
        n = len(words)
        if n >= SHINGLE_WORDS:
            sets.append(np.unique(rolled[at : at + n - SHINGLE_WORDS + 1]))
        else:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))][: n and 1], np.uint64))
        at += n
    return sets


def _packed(fraction: np.ndarray) -> np.ndarray:
    """Leading-zero count and the bits after the leading one, plus 1; 0 is left for an empty register."""
    m, e = np.frexp(fraction)
    zeros = np.minimum(-e, 61).astype(np.int64)
    tail = np.maximum((m * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return ((zeros << MANTISSA) | tail) + 1


def registers(members: np.ndarray, functions: int) -> np.ndarray:
    """Registers of the smallest hash value in each bucket; 0 where no member falls.

    With as many functions as registers each function has a register of its own,
    so that small sets fill them all; otherwise every function deals the members
    over all buckets.
    """
    hashed = mix(members[:, None] ^ _SEEDS[None, :functions])
    out = np.zeros(REGISTERS, np.int64)
    if functions == REGISTERS:
        return _packed(hashed.min(axis=0) / 2.0**64).astype(np.uint16)
    place = np.sort(hashed.ravel() * (REGISTERS / 2.0**64))
    bucket = place.astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out[np.minimum(bucket[first], REGISTERS - 1)] = _packed(place[first] - bucket[first])
    return out.astype(np.uint16)


def signatures(members: np.ndarray) -> list[np.ndarray | None]:
    """Registers for each of ``SIZE_CLASSES`` that the set belongs to."""
    n = len(members)
    return [registers(members, f) if low <= n < high else None for _, low, high, f in SIZE_CLASSES]


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members that fall on each of 64 * ``SKETCH_WORDS`` bits, as 64-bit words.

    A member that only one of two sets has turns one bit, so the sketches of two sets
    differ in no more bits than the sets differ in members.
    """
    bits = SKETCH_WORDS * 64
    counts = np.bincount((mix(members) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def band_keys(signed: list[np.ndarray | None]) -> np.ndarray:
    """A 64-bit key for each band of each signature that has a filled register."""
    keys = []
    for k, regs in enumerate(signed):
        if regs is not None:
            rows = regs[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
            key = mix(rows @ _BAND_FACTORS + _BAND_SALTS[k])
            keys.append(key[rows.any(axis=1)])
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def chance_agreement(n_a: int, n_b: int, functions: int) -> float:
    """Probability that registers of two unrelated sets agree by chance."""
    load = np.array([max(1.0, n * functions / REGISTERS) for n in (n_a, n_b)])[:, None]
    edge = 0.5 ** np.arange(0, 62)
    above = (1 - edge) ** load
    per_zeros = np.diff(above, axis=1)
    return float((per_zeros[0] * per_zeros[1]).sum() / (1 << MANTISSA))


def estimated_similarity(a: list[bytes | None], b: list[bytes | None], n_a: int, n_b: int) -> float:
    """Jaccard similarity from registers of a common size class, corrected for chance agreement; -1 without one."""
    for x, y, (_, _, _, functions) in zip(a, b, SIZE_CLASSES, strict=True):
        if x is not None and y is not None:
            r, s = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
            filled = int(((r | s) != 0).sum())
            agree = int(((r == s) & (r != 0)).sum())
            chance = chance_agreement(n_a, n_b, functions)
            return (agree / max(1, filled) - chance) / (1 - chance)
    return -1.0
