"""Word shingles of whole texts as 64-bit hashes, and fast similarity sketches."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words_of(text: str) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, parted by the six ASCII white-space characters.

    ``bytes.split`` parts at exactly those six.
    """
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _MULT[1]
    x = (x ^ (x >> _U(27))) * _MULT[2]
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.MOST:
            self[word] = found
        return found


def shingle_set(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        runs = np.full(len(h) - n + 1, _U(n) * _MULT[0])
        for k in range(n):
            runs = mix(runs + h[k : len(h) - n + 1 + k]) if k in (1, 3) else (runs ^ h[k : len(h) - n + 1 + k]) * _MULT[0] + _U(k + 1)
        return np.unique(mix(runs))


def fast_similarity_sketch(elements: np.ndarray, coordinates: int) -> np.ndarray:
    """One value per coordinate; two sets agree on each with their Jaccard similarity.

    In round i every element goes to one hashed bin and offers i plus a hashed
    fraction; from round ``coordinates`` on, all elements go to the round's own bin,
    so every bin fills.  Bins keep their minimum, and once all are filled later
    rounds can change nothing.
    """
    t = coordinates
    least = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    filled, done = 0, 0
    step = max(1, -(-2 * t // max(1, len(elements))))
    with np.errstate(over="ignore"):
        while filled < t and done < 2 * t:
            rounds = np.arange(done, min(done + step, t if done < t else 2 * t), dtype=np.uint64)
            drawn = mix(elements[None, :] + mix(rounds + _U(1))[:, None])
            bins = (drawn >> _U(40)) % _U(t) if done < t else np.broadcast_to((rounds - _U(t))[:, None], drawn.shape)
            offers = (rounds[:, None] << _U(40)) | (drawn & _U((1 << 40) - 1))
            np.minimum.at(least, bins.ravel().astype(np.intp), offers.ravel())
            done += len(rounds)
            filled = int((least != np.iinfo(np.uint64).max).sum())
    return least


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of neighbouring coordinates; bands never share keys."""
    with np.errstate(over="ignore"):
        rows = sketch.reshape(bands, -1)
        key = mix(np.arange(bands, dtype=np.uint64) + _MULT[0])
        for k in range(rows.shape[1]):
            key = mix((key ^ rows[:, k]) * _MULT[0])
    return key


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def set_digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")  # what words_of follows; kept for tests
