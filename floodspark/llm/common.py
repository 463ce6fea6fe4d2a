"""Small helpers that several operators share: scratch folders, row keys, word-by-word caches."""

from __future__ import annotations

import contextlib
import gc
import re
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in spark.checkpoint.dir.

    Where none is named, it lies below the warehouse, which driver and executors share as well. No setting is changed.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a table that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, outlives executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def row_keys(id_column: str = "doc_id", text_column: str = "text") -> tuple[Column, Column]:
    """128 bits that tell documents apart even where ids are NULL or repeated.

    Rows that agree in id and text share the key; every operator treats such rows alike.
    """
    ident = F.col(f"`{id_column}`")
    return F.xxhash64(ident, ident.isNull()), F.xxhash64(F.lit(7), text_or_empty(text_column))


# --- texts, chunk by chunk ---------------------------------------------------------------------------

#: A blank after something that is not white space. Patterns of byte-level BPE never match across such a
#: place from the left, so what lies between two of them can be encoded on its own.
CUT = re.compile(r"(?<=\S)(?= )")
#: Last bytes of white space, and some others; a blank after any other byte is such a place.
_STICKING = np.zeros(256, dtype=bool)
_STICKING[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
#: Letters, digits, other signs and white space of ASCII. The pattern of the ByteLevel pre-tokenizer ends a match wherever one
#: of the first three meets another kind, and looks at nothing to the left; an apostrophe goes on with what follows.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x09:0x0E] = 4
_KIND_BEFORE = np.where(_KIND == 4, 0, _KIND)
_KIND_BEFORE[ord("'")] = 0
LETTERS = re.compile(" ?[A-Za-z]+")


class KnownChunks:
    """Applies ``encode`` to the chunks of texts, once to each different one, and lays the ids side by side.

    Arrow numbers the chunks of some megabytes of text; only the different ones are looked up, and ``encode(list of
    chunks) -> ids of each`` gets those that are not yet known. What is kept only saves time; it is emptied when it holds
    ``bound`` chunks or 16 times as many ids. With ``kinds``, texts are cut where kinds of ASCII characters meet, too.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], kinds: bool, bound: int = 1_200_000) -> None:
        self._encode, self._kinds, self._bound = encode, kinds, bound
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._ends = array("I"), array("q", [0])

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        new = [x for x in chunks if x not in self._known]
        if len(self._known) + len(new) > self._bound or len(self._ids) > 16 * self._bound:
            self._clear()
            new = chunks
        for at in range(0, len(new), 1 << 13):
            part = new[at : at + (1 << 13)]
            for chunk, ids in zip(part, self._encode(part), strict=True):
                self._known[chunk] = len(self._ends) - 1
                self._ids.extend(ids)
                self._ends.append(len(self._ids))
        return np.fromiter(map(self._known.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text its ids as 32-bit numbers, in one piece."""
        for group in slices(texts, 1 << 23):
            yield from self._found([texts[i] for i in group])

    def _found(self, texts: list[str]) -> Iterator[list[bytes]]:
        column = pa.array(texts, pa.string())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(texts) + 1)
        octets = np.frombuffer(data, np.uint8, bounds[-1]) if bounds[-1] else np.zeros(0, np.uint8)
        begins = np.zeros(len(octets), dtype=bool)
        begins[1:] = (octets[1:] == 0x20) & ~_STICKING[octets[:-1]]
        if self._kinds:
            left, right = _KIND_BEFORE[octets[:-1]], _KIND[octets[1:]]
            begins[1:] |= (left > 0) & (right > 0) & (left != right)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.append(np.flatnonzero(begins), len(octets)).astype(np.int32)
        first = np.searchsorted(starts, bounds)
        cut = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data or pa.py_buffer(b"")).dictionary_encode()
        with no_collections():
            numbers = self._numbers(cut.dictionary.to_pylist())
        ends, every, codes = np.array(self._ends), np.array(self._ids), cut.indices.to_numpy()
        begin, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 18), "right")) - 1)
            code = codes[first[at] : first[stop]]
            sizes = size[code]
            after = np.concatenate([[0], np.cumsum(sizes)])
            ids = every[np.arange(after[-1]) + np.repeat(begin[code] - after[:-1], sizes)].astype(np.uint32)
            for a, b in pairwise(after[first[at : stop + 1] - first[at]].tolist()):
                yield [ids[a:b].tobytes()]
            at = stop


@contextlib.contextmanager
def no_collections() -> Iterator[None]:
    """Pauses the search for reference cycles where none arise: it would walk the whole cache each time."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def slices(texts: list, limit: int) -> Iterator[list[int]]:
    """Indices of consecutive texts, together no longer than ``limit`` unless one alone is."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield group
