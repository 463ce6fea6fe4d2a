"""Two tokenizers' cuts of the same texts, aligned byte by byte.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model; A gets a blank and the text, B adds that
blank itself. Both sets of tokens of a text are intervals of its bytes. They are sorted together by start; a group ends
where a start reaches the running maximum of the ends before it, that is where tokens of A and of B end together. Every
token of A in a group is linked with every token of B in it.

Neither tokenizer joins anything across a blank that follows another character, so both end there and groups never span
such a place. Texts are cut there, and each different chunk is encoded and coalesced once per task, as long as a
bounded memory of chunks lasts. Documents are handled in blocks of a few megabytes. A block's different linked pairs
of ids, with the number of its documents that hold each, are what goes into the corpus-wide counts; the counts come back
to the block as one list in the order of its pairs. So the shuffles carry pairs of blocks and not of tokens, and a pair
that all documents hold is one row for each block.

A pair's count is the number of documents that hold it linked. Nothing is broadcast and nothing is capped. A group
that never ends, in a text without blanks on which the tokenizers disagree throughout, is expanded by its different ids.

Edge cases: NULL and empty texts, and texts whose tokens do not give back the bytes of blank and text (such as those with
characters that B does not know or with U+2581), have no tokens: zeros and an empty column of groups. Rows that agree
in id and text count as two documents. An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import CUT, no_collections, scratch, slices, staged

#: Characters of text in a block, and bytes of chunks and results that a task remembers.
BLOCK, MEMORY = 4 << 20, 120 << 20
#: New chunks that are tokenized as one text.
_RUN = 4096
#: A pair of ids is one number: 17 bits for A's id, then 17 for B's.
_B_BITS, _PAIR_BITS = 17, 34
_LOW, _PAIR = (1 << 32) - 1, (1 << _PAIR_BITS) - 1
_IRREGULAR = re.compile(r"\s ")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_STAGED = (
    "block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "places binary, times binary, pairs array<bigint>, holders array<bigint>"
)


@lru_cache(maxsize=1)
def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, then from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes and the decimal form of each id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.blank = self.b.piece_to_id("▁")
        values = byte_values()
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(values[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Chunks are cut at blanks only if no piece of B goes on across one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def __call__(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For A and for B the ids of every text; each text goes without the blank that it begins with."""
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        # B adds no blank to an empty text.
        b = [np.array(x or [self.blank], np.int64) for x in self.b.encode(texts, num_threads=1)]
        return [a, b]

    def data(self, side: int, ids: np.ndarray) -> bytes:
        return b"".join(map((self.bytes_a, self.bytes_b)[side].__getitem__, ids.tolist()))


def chunks(text: str) -> list[str]:
    """A text in pieces that are tokenized on their own, each without the blank that it begins with."""
    if not _IRREGULAR.search(text) and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in CUT.split(" " + text)]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals sorted by start, and the number of the group of each in that order."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def expanded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of every member of rows of these lengths."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, with the sum of their weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


class Numbers(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        return number


class ChunkTable:
    """What coalescing gives for each chunk met so far: counts, the written groups, and linked pairs of ids."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (tokenizers.bytes_a, tokenizers.bytes_b)]
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.texts: list[str | None] = []
        self.counts = np.empty((0, len(_COUNTS)), np.int64)
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.size = 0

    def numbers(self, flat: list[str]) -> list[int]:
        """Numbers of the chunks of a block; the table is emptied before, if it has grown too large."""
        if self.size > MEMORY:
            self.clear()
        before = len(self.known)
        found = list(map(self.known.__getitem__, flat))
        self._add(list(islice(self.known, before, None)))
        return found

    def _add(self, new: list[str]) -> None:
        at = len(self.texts)
        self.texts += [None] * len(new)
        self.counts = np.concatenate([self.counts, np.zeros((len(new), len(_COUNTS)), np.int64)])
        length = np.zeros(len(new), np.int64)
        # One after the other they are one text again, unless one ends in a blank.
        runs: list[list[int]] = [[]]
        for i, chunk in enumerate(new):
            runs[-1].append(i)
            if len(runs[-1]) == _RUN or not chunk or chunk[-1].isspace():
                runs.append([])
        pairs, times = [self.pairs], [self.times]
        # From the last one on, so that a run which fails can be followed by its halves, in order.
        runs = [x for x in reversed(runs) if x]
        while runs:
            run = runs.pop()
            sides = [x[0] for x in self.tokenizers([" ".join([new[i] for i in run])])]
            data = "".join([" " + new[i] for i in run]).encode()
            if all(self.tokenizers.data(k, ids) == data for k, ids in enumerate(sides)):
                more = self._coalesce(sides, np.array([len(new[i].encode()) + 1 for i in run]), np.array(run) + at)
                pairs.append(more[0])
                times.append(more[1])
                length[run] = more[2]
            elif len(run) > 1:
                runs += [run[len(run) // 2 :], run[: len(run) // 2]]
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pairs, self.times = np.concatenate(pairs), np.concatenate(times)
        # Two strings, an entry of the dictionary and the numbers of a chunk.
        self.size += sum(map(len, new)) + sum(len(x) for x in self.texts[at:] if x) + 260 * len(new) + 16 * int(length.sum())

    def _coalesce(self, ids: list[np.ndarray], sizes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
        """Groups of the tokens of A and B over the same bytes, which are those of chunks of these sizes.

        Fills counts and texts of the owners; returns (pairs, times, number of pairs of each chunk).
        """
        ends = [np.cumsum(self.sizes[k][ids[k]]) for k in (0, 1)]
        starts = [ends[k] - self.sizes[k][ids[k]] for k in (0, 1)]
        order, group = coalesced(np.concatenate(starts), np.concatenate(ends))
        kind = np.repeat([0, 1], [len(x) for x in ids])[order]
        # Within a group A's tokens first, each side in its order.
        place = np.argsort(group << 1 | kind, kind="stable")
        order, kind = order[place], kind[place]
        token = np.concatenate(ids)[order]
        chunk = np.searchsorted(np.cumsum(sizes), np.concatenate(starts)[order], side="right")
        n_groups, n = int(group[-1]) + 1, len(sizes)
        in_group = [np.bincount(group[kind == k], minlength=n_groups) for k in (0, 1)]
        chunk_of = np.zeros(n_groups, np.int64)
        chunk_of[group] = chunk
        self.counts[owners, 0], self.counts[owners, 1] = (np.bincount(chunk[kind == k], minlength=n) for k in (0, 1))
        self.counts[owners, 2] = np.bincount(chunk_of, minlength=n)
        bounds = np.searchsorted(chunk_of, np.arange(n))
        self.counts[owners, 3] = np.add.reduceat(in_group[0] * in_group[1], bounds)
        # A token is followed by a comma, by a bar before B's first one, by a semicolon before the next group.
        after = np.zeros(len(token), np.int64)
        after[:-1][kind[1:] > kind[:-1]] = 1
        after[:-1][group[1:] > group[:-1]] = 2
        written = list(map(str.__add__, map(str, token.tolist()), map(",|;".__getitem__, after.tolist())))
        cuts = np.searchsorted(chunk, np.arange(n + 1)).tolist()
        for i, owner in enumerate(owners.tolist()):
            self.texts[owner] = "".join(written[cuts[i] : cuts[i + 1]])[:-1]
        # Different ids of each side of a group, with their numbers, and from them the pairs.
        side = [summed(group[kind == k] << 32 | token[kind == k], np.ones(len(ids[k]), np.int64)) for k in (0, 1)]
        held = [np.bincount(keys >> 32, minlength=n_groups) for keys, _ in side]
        from_b = np.cumsum(held[1]) - held[1]
        of = side[0][0] >> 32
        row, at = expanded(held[1][of])
        other = from_b[of][row] + at
        pair = (side[0][0][row] & _LOW) << _B_BITS | (side[1][0][other] & _LOW)
        # A chunk holds each of its pairs once.
        keys, times = summed(chunk_of[of[row]] << _PAIR_BITS | pair, side[0][1][row] * side[1][1][other])
        return keys & _PAIR, times, np.bincount(keys >> _PAIR_BITS, minlength=n)


def _block(table: ChunkTable, texts: list[str]) -> dict[str, list]:
    """Columns of one block: a row for each text, then one for the block's pairs."""
    with no_collections():
        cut = [(chunks(x) if table.tokenizers.cuts else [x]) if x else [] for x in texts]
        numbers = table.numbers([c for x in cut for c in x])
    n = len(texts)
    size = np.array([len(x) for x in cut], np.int64)
    del cut
    bounds = [0, *np.cumsum(size).tolist()]
    flat, doc = np.array(numbers, np.int64), np.repeat(np.arange(n), size)
    # A chunk without groups does not give back its bytes; its document has no tokens.
    good = np.bincount(doc, weights=table.counts[flat, 2] == 0, minlength=n) == 0
    shas = [
        hashlib.sha256(";".join(map(table.texts.__getitem__, numbers[bounds[i] : bounds[i + 1]])).encode()).hexdigest() if size[i] and good[i] else ""
        for i in range(n)
    ]
    flat, doc = flat[good[doc]], doc[good[doc]]
    counts = [np.bincount(doc, weights=table.counts[flat, k], minlength=n).astype(np.int64).tolist() for k in range(len(_COUNTS))]
    # Chunks of each document with their numbers, then its pairs with theirs.
    keys, often = summed(doc << 32 | flat, np.ones(len(flat), np.int64))
    chunk = keys & _LOW
    row, at = expanded(table.length[chunk])
    source = table.first[chunk][row] + at
    keys, times = summed((keys >> 32)[row] << _PAIR_BITS | table.pairs[source], table.times[source] * often[row])
    different, place, holders = np.unique(keys & _PAIR, return_inverse=True, return_counts=True)
    ends = np.searchsorted(keys >> _PAIR_BITS, np.arange(n + 1))
    place = place.astype(np.int32)
    packed = [
        (place[i:j].tobytes(), times[i:j].astype(np.min_scalar_type(int(times[i:j].max(initial=0)))).tobytes())
        for i, j in zip(ends, ends[1:], strict=False)
    ]
    return {
        **{name: [*counts[k], None] for k, name in enumerate(_COUNTS)}, "groups_sha256": [*shas, None],
        "places": [*[x for x, _ in packed], None], "times": [*[x for _, x in packed], None],
        "pairs": [None] * n + [different], "holders": [None] * n + [holders],
    }


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents with their counts and links, and one row of different pairs for each block."""
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
             ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = ChunkTable(Tokenizers(path_a, path_b)), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for rows in slices(texts, BLOCK):
                columns = _block(table, [texts[i] for i in rows])
                ids = pa.concat_arrays([batch.column("doc_id").slice(rows[0], len(rows)), pa.nulls(1, batch.column("doc_id").type)])
                block = pa.array(np.full(len(rows) + 1, number), pa.int64())
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [block, ids, *[pa.array(columns[n], k) for n, k in kinds]], ["block", "doc_id", *[n for n, _ in kinds]]
                )

    return source.mapInArrow(align, _STAGED.format(kind=source.schema["doc_id"].dataType.simpleString()))


def _weighed(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents, from the counts of the block's pairs."""
    places = counts["place"].to_numpy()
    count, best = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    count[places], best[places] = counts["count"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    sums = []
    for place, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at = np.frombuffer(place, np.int32)
        n = np.frombuffer(times, f"u{len(times) // len(at)}").astype(np.int64) if len(at) else np.empty(0, np.int64)
        sums.append((int(n[best[at]].sum()), int((n * count[at]).sum())))
    names = ["doc_id", *_COUNTS, "groups_sha256"]
    return pa.table([*[docs[n] for n in names], pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.int64())],
                    names=[*names, "n_best", "count_sum"])


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``n_best`` counts the links whose pair is the one that most documents hold for its id of A, ``count_sum`` adds up
    the counts of the pairs of all links.
    """
    folder = scratch(docs.sparkSession)
    rows = staged(aligned(docs, path_a, path_b, key, text), folder, "aligned")
    pairs = rows.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select(
        "block", "place", "p.pairs", "p.holders"
    )
    counts = pair_counts(pairs, folder)
    priced = pairs.select("block", "place", "pairs").join(counts, "pairs").select(
        F.col("block").alias("of_block"), "place", "count", "best"
    )
    kept = rows.where("pairs IS NULL").drop("pairs", "holders")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return kept.groupBy("block").cogroup(priced.groupBy("of_block")).applyInArrow(
        _weighed, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    )


def pair_counts(pairs: DataFrame, folder: str) -> DataFrame:
    """(pairs, count, best): documents that hold each pair linked, and whether no pair of its id of A has more."""
    counts = staged(pairs.groupBy("pairs").agg(F.sum("holders").alias("count")).withColumn("a", F.shiftright("pairs", _B_BITS)), folder, "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
