"""Byte-level BPE without replaying merges: longest matches, backtracking, memoised compatibility.

Bytes become Latin-1 characters, so that the trie of pyahocorasick over the vocabulary tells how long a
token at any place can be. Tokens are laid from left to right, longest first. A token may follow another
only if merging the bytes of the two by rank gives back exactly these two; a sequence in which all
neighbours are compatible is the one the merges produce. Places that lead nowhere are remembered, so each
byte is left at most once and the work is linear in the text.

Edge cases: NULL and empty texts have no ids; special-token strings are ordinary text; any text round-trips
byte for byte; unknown ids are an error. Equal rows get equal ids; other columns stay as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark.llm.common import KnownChunks

#: Chunks and compatible pairs that an encoder remembers. A Python worker keeps them after its task, beside what runs there next.
KEPT_CHUNKS, KEPT_PAIRS = 500_000, 300_000
#: Texts that are encoded and decoded at once; what is made on the way is as large as they are.
_ROWS = 2000
#: Patterns that end a match wherever kinds of ASCII characters meet (see KnownChunks).
_BY_KIND = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def last_merge(text: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts left when merging by rank has come down to two, or can go no further."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def tokens_of(path: str) -> dict[int, bytes]:
    """Bytes of each id; all that decoding needs."""
    return {rank: token for token, rank in read_ranks(path).items()}


class Encoder:
    """Ids of whole texts for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = read_ranks(path)
        self.bytes_of = tokens_of(path)
        self._split = regex.compile(pattern)
        self._size_of = {rank: len(token) for token, rank in self.ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._tokens: dict[str, int] = {}
        self._trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            parts = last_merge(token, self.ranks)
            if len(parts) == 2:
                self._halves[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            # A token that merging its own bytes does not give can only ever be a whole piece.
            if len(parts) <= 2:
                self._tokens[token.decode("latin-1")] = rank
                self._trie.add_word(token.decode("latin-1"), rank)
        self._fits: dict[tuple[int, int], bool] = {}
        self.chunks = KnownChunks(lambda chunks: [self._chunk(x) for x in chunks], pattern in _BY_KIND, KEPT_CHUNKS)

    def _merges_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two again.

        Undoes the merges of both, latest first. What touches the seam at each moment must not have merged
        across it before the merge just undone; of equal ranks, the one further left comes first.
        """
        limit = len(self.ranks)
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], len(self.ranks)) < limit:
                return False
            a, b = self._halves.get(left), self._halves.get(right)
            if a is None and b is None:
                return True
            if b is not None and (a is None or right >= left):
                limit, right = right + 1, b[0]
            else:
                limit, left = left, a[1]

    def _compatible(self, left: int, right: int) -> bool:
        pair = left, right
        if (known := self._fits.get(pair)) is None:
            if len(self._fits) > KEPT_PAIRS:  # only saves time
                self._fits.clear()
            known = self._fits[pair] = self._merges_apart(left, right)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        text, size_of, tokens, longest = data.decode("latin-1"), self._size_of, self._tokens, self._trie.longest_prefix
        dead = bytearray(len(text) + 1)
        laid: list[int] = []
        at, size = 0, longest(text)
        while at < len(text):
            while size:
                token = tokens.get(text[at : at + size])
                if token is not None and not dead[at + size] and (not laid or self._compatible(laid[-1], token)):
                    break
                size -= 1
            if size:
                laid.append(token)
                at += size
                size = longest(text[at:])
            else:
                dead[at] = 1
                size = size_of[laid.pop()]
                at -= size
                size -= 1
        return laid

    def _chunk(self, chunk: str) -> list[int]:
        return [rank for match in self._split.findall(chunk) for rank in self.piece(match.encode("utf-8"))]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), np.uint32).tolist()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit numbers side by side."""
        return map(b"".join, self.chunks(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each file and pattern in a Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _ids(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    ids = list(encoder(path, pattern).encode_all([x or "" for x in texts.to_pylist()]))
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _bytes(lists: pa.ListArray, path: str) -> pa.Array:
    find, every = tokens_of(path).__getitem__, lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
    return pa.array([b"".join(map(find, every[a:b].tolist())) for a, b in pairwise(ends)], pa.binary())


def encoded(text: Column, path: str, pattern: str) -> Column:
    """array<int>: ids of the whole text."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _ids(texts, path, pattern)

    return encode(text.cast("string"))


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes the ids stand for; empty for NULL. Takes what ``encoded`` took; the file is all it needs."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return _bytes(lists, path)

    return decode(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, data>: ids of the whole text, and the bytes that these ids stand for.

    Beside ``encoded``, ``decoded`` of its ids makes Spark run the chain of both again, which encodes every text twice.
    """

    @F.arrow_udf("struct<ids: array<int>, data: binary>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), _ROWS):
            ids = _ids(texts.slice(at, _ROWS), path, pattern)
            parts.append(pa.StructArray.from_arrays([ids, _bytes(ids, path)], ["ids", "data"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("data", pa.binary())]))

    return there_and_back(text.cast("string"))
