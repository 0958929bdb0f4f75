"""Vector functions: cosine in SQL functions, hashed word vectors in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: offset and prime of the 64-bit word hash
OFFSET, PRIME = 1469598103934665603, 1099511628211
#: Texts whose words are held at once.
TEXTS = 1024
# words are what lies between white space, signs included; the separators U+001C to U+001F are none
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for vectors of different or no length or without direction."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(fits, dot(a, b) / size).otherwise(0.0)


def word_hash(word: str) -> int:
    h = OFFSET
    for byte in word.encode():
        h = (h ^ byte) * PRIME % 2**64
    return h


def word_hashes(words: list[str]) -> np.ndarray:
    """``word_hash`` of many words: all words take their next byte at once."""
    if not words:
        return np.empty(0, np.uint64)
    _, ends, coded = pa.array(words, pa.large_string()).buffers()
    ends, coded = np.frombuffer(ends, np.int64)[: len(words) + 1], np.frombuffer(coded or b"", np.uint8)
    order = np.argsort(ends[:-1] - ends[1:], kind="stable")  # the longest first
    starts, sizes = ends[:-1][order], np.diff(ends)[order]
    hashes = np.full(len(words), OFFSET, np.uint64)
    longer = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # how many words have a byte there
    for at, n in enumerate(longer.tolist()):
        hashes[:n] = (hashes[:n] ^ coded[starts[:n] + at]) * np.uint64(PRIME)
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _WORD.findall(low) if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()


def hash_vectors(texts: list[str | None], width: int, known: dict[str, int] | None = None) -> np.ndarray:
    """A row for every text: counts of hashed lower-cased words (parted by white space), scaled to length 1; zeros without words.

    ``known`` are places of words at this width, and gets those that it lacks.
    """
    lists = [_words(text) for text in texts]
    place = {} if known is None else known
    fresh = list(set().union(*lists).difference(place))
    place.update(zip(fresh, (word_hashes(fresh) % np.uint64(width)).astype(np.int64).tolist(), strict=True))
    counts = np.zeros((len(lists), width))
    for row, words in zip(counts, lists, strict=True):
        row[:] = np.bincount(np.fromiter(map(place.__getitem__, words), np.int64, len(words)), minlength=width)
    sizes = np.linalg.norm(counts, axis=1, keepdims=True)
    return np.divide(counts, sizes, out=counts, where=sizes > 0)


def hash_vector(text: str | None, width: int, known: dict[str, int] | None = None) -> np.ndarray:
    return hash_vectors([text], width, known)[0]


def hashed_words(width: int):
    """An embedder that needs no model: equal texts have equal vectors, shared words bring texts near."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), TEXTS):
            rows = hash_vectors(texts.slice(at, TEXTS).to_pylist(), width).astype("float32")
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return embed
