"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece the table keeps one number: the last token of that
prefix's encoding.  A token ``t`` that ends at byte ``i`` is that last token
exactly if the pair (last token before ``t``, ``t``) re-encodes to itself, and
only one token qualifies, so the table is unique and grows by appending.  Walking
it backwards gives the ids.  An edit recomputes the table from the edited byte on
and stops as soon as it agrees with the old one over the longest token's length.

Texts are split by the vocabulary's pattern first; pieces are encoded one by one
and remembered in a bounded table per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, kept, require

#: Stretches one Python worker remembers: two generations of so many; the older goes when the younger is full.
CACHED = 180_000
#: Pairs of tokens whose test one Python worker remembers.
KNOWN_PAIRS = 300_000
#: A space between two white-space characters (or before the end): the only
#: place where cutting a text before its spaces could change the pieces.
_UNSAFE_CUT = regex.compile(r"\s (?:\s|\Z)")


def ranks_of(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, as a rank file lists them."""
    with open(path, "rb") as lines:
        return {base64.b64decode(b): int(i) for b, i in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of byte strings, with the pair test that the prefix table needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length_of = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.known_pairs: dict[int, bool] = {}
        # a token that merging never produces may stand for a whole piece only
        self.reachable = {b: i for b, i in ranks.items() if len(b) == 1 or self.merge(b) == [i]}
        self.tokens_in = ahocorasick.Automaton()  # every token that ends at each byte; bytes as Latin-1
        for data, token in self.reachable.items():
            self.tokens_in.add_word(data.decode("latin-1"), (token, len(data)))
        self.tokens_in.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> "Vocabulary":
        return cls(ranks_of(path))

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first; used for single tokens and for pairs."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair_ok(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their bytes are encoded together."""
        known = self.known_pairs.get(left << 32 | right)
        if known is None:
            if len(self.known_pairs) >= KNOWN_PAIRS:
                self.known_pairs.clear()
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.known_pairs[left << 32 | right] = known
        return known


class PrefixTable:
    """The last token of every prefix of a byte string, open to appends and edits.

    ``last[i]`` belongs to the prefix of ``i`` bytes; ``last[0]`` is -1.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1] + [None] * len(data)
        last, known = self.last, vocabulary.known_pairs
        for end, (token, length) in vocabulary.tokens_in.iter(data.decode("latin-1")):
            end += 1
            if last[end] is None:
                before = last[end - length]
                ok = before < 0 or known.get(before << 32 | token)
                if ok or ok is None and vocabulary.pair_ok(before, token):
                    last[end] = token
        if None in last:
            raise ValueError(f"byte {data[last.index(None) - 1]} is not in the vocabulary")

    def append(self, more: bytes) -> "PrefixTable":
        self.data += more
        while len(self.last) <= len(self.data):
            self.last.append(self._last_at(len(self.last)))
        return self

    def _last_at(self, end: int) -> int:
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = self.vocabulary.reachable.get(self.data[start:end])
            if token is not None and (not start or self.vocabulary.pair_ok(self.last[start], token)):
                return token
        raise ValueError(f"byte {self.data[end - 1]} is not in the vocabulary")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start:end and return how many entries were computed anew."""
        old, old_last, moved = self.data, self.last, len(new) - (end - start)
        self.data = old[:start] + new + old[end:]
        self.last = old_last[: start + 1]
        agreed, fresh = 0, 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            if agreed >= self.vocabulary.longest:  # all that later entries look back on is as before
                self.last += old_last[at - moved :]
                break
            self.last.append(self._last_at(at))
            fresh += 1
            agreed = agreed + 1 if at > start + len(new) and self.last[at] == old_last[at - moved] else 0
        return fresh

    def ids(self) -> list[int]:
        out, at, last, length_of = [], len(self.data), self.last, self.vocabulary.length_of
        while at:
            token = last[at]
            out.append(token)
            at -= length_of[token]
        return out[::-1]


class Encoder:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self.bytes_of = vocabulary.bytes_of

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self.vocabulary, data).ids())

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch that is not known yet.

        The two common shapes, a word after its space and such a word before one
        ASCII punctuation mark, are their own pieces and need no matching.
        """
        if stretch[1:].isalpha() and (stretch[0] == " " or stretch[0].isalpha()):
            return self.piece(stretch)
        if stretch[-1] in ",.;:!?" and stretch[1:-1].isalpha() and (stretch[0] == " " or stretch[0].isalpha()):
            return (self._young.get(stretch[:-1]) or self.piece(stretch[:-1])) + self.piece(stretch[-1])
        return tuple(i for p in self.pattern.findall(stretch) for i in self.piece(p))

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        The text is cut before its spaces; what lies between two cuts is looked
        up whole.  Where a cut could part a run of white space that the pattern
        keeps together, the text is taken in one stretch instead.
        """
        young, old, ids = self._young, self._old, []
        if _UNSAFE_CUT.search(text):
            stretches = self.pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            stretches = [first] if first else []
            stretches += [" " + x for x in rest]
        add = ids.extend
        for stretch in stretches:
            found = young.get(stretch)
            if found is None:
                found = old.get(stretch) or self._stretch(stretch)
                if len(young) >= CACHED:
                    self._young, self._old = young, old = {}, young
                if len(stretch) <= 64:
                    young[stretch] = found
            add(found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; the vocabulary is read once a worker, and again after another operator's tables."""
    return kept((path, pattern), lambda: Encoder(Vocabulary.from_file(path), pattern))


class _Decimal(dict):
    def __missing__(self, i: int) -> str:
        self[i] = text = str(i)
        return text


def ids_digest(ids: list[int], decimal: dict[int, str]) -> str:
    return hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False, digests: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    The ids are decoded again in the same task and the digest is that of the
    decoded bytes.  A null text counts as empty: no tokens, and the digests of
    nothing.  Repeated rows give repeated results, an empty table an empty one;
    other columns, whatever their names, are left out.  Nothing is shuffled: rows
    stream through Arrow, so a lost executor costs its own tasks only.
    ``path`` must be readable on every executor, as installed packages are.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decimal = encoder(path, pattern), _Decimal()
        for batch in batches_of(batches):
            n, shas, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                n.append(len(ids))
                if digests:
                    shas.append(ids_digest(ids, decimal))
                    decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            out = [batch.column(0), pa.array(n, pa.int64())]
            names = [id_col, "n_tokens"]
            if digests:
                out += [pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([x.to_pylist() for x in lists], pa.list_(pa.field("element", pa.int32(), False))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
