"""Token ids in patched frame-of-reference blocks.

A block of ids is stored as its minimum, a width chosen from a percentile of the block, the differences
packed at that width, and an exception list of positions and values for the differences that are wider.
A segment is a run of blocks with a header and an index of block starts, so a reader can go to any id
without decoding what lies before. Segments are binary cells of a Parquet table, which every store that
Spark writes to can hold, and which commits atomically when tasks are repeated.

Segment, little-endian: ``PFR1``, block size, ids, blocks (u32 each); for each block its byte offset (u32);
then the blocks: minimum u32, width u8, exceptions u16, packed differences, positions u16, values u32.

Edge cases: NULL text counts as empty, and every document has its end id; repeated rows are documents of
their own; NULL ids come first; documents of one id are ordered by text hash. An empty table gives an
empty file set.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodspark.llm.common import LETTERS, KnownChunks, text_or_empty

BLOCK = 512
PERCENTILE = 90
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"PFR1"
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}  # widths that are packed as they are


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """One segment of the ids (uint32)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    count = -(-len(ids) // block) if len(ids) else 0
    full = np.zeros((count, block), dtype=np.uint32)
    full.reshape(-1)[: len(ids)] = ids
    if count and len(ids) % block:
        full[-1, len(ids) % block :] = ids[-1]  # filling that never widens a block
    low = full.min(axis=1) if count else np.zeros(0, np.uint32)
    deltas = full - low[:, None]
    widths = np.frexp(deltas.astype(np.float64))[1].astype(np.uint8)  # bits of each difference
    rank = min(block - 1, block * percentile // 100)
    chosen = np.partition(widths, rank, axis=1)[:, rank] if count else np.zeros(0, np.uint8)
    packed: list[bytes] = [b""] * count
    for width in np.unique(chosen):
        rows = np.flatnonzero(chosen == width)
        for part in np.array_split(rows, -(-len(rows) // 256)):
            if width in _WHOLE:
                for row in part:
                    packed[row] = deltas[row].astype(_WHOLE[width]).tobytes()
                continue
            octets = deltas[part].astype("<u4").view(np.uint8).reshape(len(part), block, 4)
            bits = np.unpackbits(octets, axis=2, bitorder="little")[:, :, :width].reshape(len(part), -1)
            for row, data in zip(part, np.packbits(bits, axis=1, bitorder="little"), strict=True):
                packed[row] = data.tobytes()
    blocks = []
    for row in range(count):
        out = np.flatnonzero(widths[row] > chosen[row])
        blocks.append(b"".join((
            struct.pack("<IBH", int(low[row]), int(chosen[row]), len(out)), packed[row],
            out.astype("<u2").tobytes(), deltas[row][out].astype("<u4").tobytes(),
        )))
    start = _HEAD.size + 4 * count
    starts = start + np.concatenate([[0], np.cumsum([len(x) for x in blocks])])[:count]
    return b"".join((_HEAD.pack(_MAGIC, block, len(ids), count), starts.astype("<u4").tobytes(), *blocks))


def read_block(segment: bytes, number: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    magic, block, total, count = _HEAD.unpack_from(segment)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    if not 0 <= number < count:
        raise IndexError(number)
    at = struct.unpack_from("<I", segment, _HEAD.size + 4 * number)[0]
    low, width, exceptions = struct.unpack_from("<IBH", segment, at)
    at += 7
    size = block * width // 8 + (block * width % 8 > 0)
    deltas = np.zeros(block, dtype=np.uint32)
    if width in _WHOLE:
        deltas = np.frombuffer(segment, _WHOLE[width], block, at).astype(np.uint32)
    elif width:
        bits = np.zeros((block, 32), dtype=np.uint8)
        packed = np.frombuffer(segment, np.uint8, size, at)
        bits[:, :width] = np.unpackbits(packed, bitorder="little", count=block * width).reshape(block, width)
        deltas = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(block).astype(np.uint32)
    at += size
    positions = np.frombuffer(segment, "<u2", exceptions, at)
    deltas[positions] = np.frombuffer(segment, "<u4", exceptions, at + 2 * exceptions)
    return (deltas + np.uint32(low))[: min(block, total - number * block)]


def read_ids(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment; only the blocks that hold them are decoded."""
    _, block, total, _ = _HEAD.unpack_from(segment)
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first = start // block
    found = np.concatenate([read_block(segment, k) for k in range(first, (stop - 1) // block + 1)])
    return found[start - first * block : stop - first * block]


_TOKENIZERS: dict[tuple[str, bool], Callable[[list[str]], Iterator[list[bytes]]]] = {}


def _id_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _split_at_added(tokenizer) -> Callable[[str], list[str | bytes]]:
    """Cuts a text as the library does before anything else: texts between added tokens, and ids of these as bytes.

    Tokens that are sought in the raw text go first, then the others; of several at one place the longest counts.
    """
    added = tokenizer.get_added_tokens_decoder()
    passes = []
    for normalized in (False, True):
        ids = {x.content: _id_bytes([i]) for i, x in added.items() if x.content and x.normalized == normalized}
        if ids:
            passes.append((ids, re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")))

    def split(text: str) -> list[str | bytes]:
        found: list[str | bytes] = [text]
        for ids, pattern in passes:
            if any(x in text for x in ids):
                cut = [[x] if isinstance(x, bytes) else pattern.split(x) for x in found]
                found = [y if isinstance(y, bytes) or not k % 2 else ids[y] for x in cut for k, y in enumerate(x)]
        return found

    return split


def _encoder(path: str, added_tokens: bool) -> Callable[[list[str]], Iterator[list[bytes]]]:
    if (path, added_tokens) not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # Split and merged by the file's own rules, with nothing sought in the raw text.
        file = json.loads(tokenizer.to_str())
        bare = Tokenizer.from_str(json.dumps(
            file | {"added_tokens": [], "normalizer": None, "post_processor": None, "truncation": None, "padding": None}
        ))

        split_by = file["pre_tokenizer"] or {}
        byte_level = split_by.get("type") == "ByteLevel" and split_by.get("use_regex", True) and not split_by["add_prefix_space"]
        merge = bare.model.tokenize

        def encode(chunks: list[str]) -> list[list[int]]:
            # Letters after a blank at most are one match; the blank's byte is written as a letter of its own.
            found = [[x.id for x in merge(chunk.replace(" ", "\u0120"))] if byte_level and LETTERS.fullmatch(chunk) else None for chunk in chunks]
            others = [i for i, ids in enumerate(found) if ids is None]
            for i, x in zip(others, bare.encode_batch_fast([chunks[i] for i in others], add_special_tokens=False), strict=True):
                found[i] = x.ids
            return found

        cache, split_at_added = KnownChunks(encode, byte_level), _split_at_added(tokenizer)

        def split_texts(texts: list[str]) -> Iterator[list[bytes]]:
            cut = [split_at_added(x) for x in texts]
            found = cache([x for row in cut for x in row if isinstance(x, str)])
            for row in cut:
                yield [y for x in row for y in (next(found) if isinstance(x, str) else [x])]

        def whole_texts(texts: list[str]) -> Iterator[list[bytes]]:
            for text in texts:
                yield [_id_bytes(tokenizer.encode(text, add_special_tokens=False).ids)]

        # Tokens that look at their surroundings, or at a normalised text, are left to the library.
        plain = tokenizer.normalizer is None and not any(
            x.single_word or x.lstrip or x.rstrip for x in tokenizer.get_added_tokens_decoder().values()
        )
        if not plain:
            tokenizer.no_truncation()
            tokenizer.no_padding()
        _TOKENIZERS[path, added_tokens] = cache if not added_tokens else split_texts if plain else whole_texts
    return _TOKENIZERS[path, added_tokens]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text",
    segment_ids: int = 1 << 18, partitions: int | None = None, added_tokens: bool = True,
) -> None:
    """Encode whole texts and write ``folder/segments``, in ascending order of the id.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library on every executor. A row
    holds ``segment_ids`` ids, or one document where that is longer: its part, the ids of the part before
    it (``inside``), the payload, and for each document its id and token count. With ``added_tokens``,
    strings of the file's added tokens in a text become their ids, as in ``Tokenizer.encode``; without, they
    are ordinary text.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text).alias("text"))
    id_type = source.schema["doc_id"].dataType
    spread = partitions or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = source.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, inside = _encoder(tokenizer, added_tokens), 0
        end = np.uint32(end_id).tobytes()
        held: list[bytes] = []
        names: list = []
        counts: list[int] = []
        size, part = 0, 0

        def flush() -> pa.RecordBatch:
            payload = pack_blocks(np.frombuffer(b"".join(held), dtype=np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([inside], pa.int64()), pa.array([names], pa.list_(kind)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "inside", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            names_in, parts = batch.column("doc_id").to_pylist(), batch.column("part")
            for i, chunks in enumerate(encode(batch.column("text").to_pylist())):
                ids = b"".join([*chunks, end])
                if size and size + len(ids) > 4 * segment_ids:
                    yield flush()
                    held, names, counts, size, inside = [], [], [], 0, inside + size // 4
                part = parts[i].as_py()
                held.append(ids)
                names.append(names_in[i])
                counts.append(len(ids) // 4)
                size += len(ids)
        if size:
            yield flush()

    schema = f"part int, inside bigint, doc_ids array<{id_type.simpleString()}>, n_tokens array<bigint>, payload binary"
    ordered.mapInArrow(segments, schema).write.parquet(f"{folder}/segments")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a file set; ids are little-endian uint32 bytes.

    A segment knows its place within its part; what lies before a part is summed over one row for each
    part, and ``partitions`` of the writer bounds those rows.
    """
    table = spark.read.parquet(f"{folder}/segments")
    id_type = table.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        table.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))
        .groupBy("part").agg(F.sum("size").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = read_ids(batch.column("payload")[i].as_py()).astype("<u4").tobytes()
                counts = np.array(batch.column("n_tokens")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(counts)
                start = batch.column("part_start")[i].as_py() + batch.column("inside")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(start + ends - counts), pa.array(counts),
                     pa.array([data[4 * (e - c) : 4 * e] for c, e in zip(counts, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    located = table.join(F.broadcast(parts), "part")
    return located.mapInArrow(documents, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")
