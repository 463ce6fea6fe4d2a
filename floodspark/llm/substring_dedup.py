"""Removal of long repeated strings by prefix-free parsing.

Every 400-byte window of a text holds a trigger: the place in it whose rolling hash over 64 bytes is the
smallest. Triggers depend on the window's bytes alone, so they cut equal strings into equal phrases wherever
these stand. A *stretch* is what one trigger's consecutive windows cover; it consists of a phrase before the
trigger (dictionary) and the text from the trigger on (parse).

1. Triggers whose 64 bytes occur once drop out: no window of theirs can repeat.
2. Stretches that occur as a whole several times are repeated, all windows of them.
3. What is left is sorted for each trigger, which stands in for suffix arrays of a dictionary and of a parse:
   the distinct phrases, read backwards from the trigger, and the parses are sorted as whole strings, and a
   window's place is the pair of both ranks at its split. Windows that agree for 400 bytes stand together; common-prefix lengths of
   neighbours tell where.
4. Triggers with more than ``IN_ONE_TASK`` different stretches, say of a passage that a third of all texts
   share, are not sorted in one task: their windows are counted by 128-bit names.

The work is exact up to 128-bit hashes. Keys, not texts, are shuffled for steps 1 and 2.

Edge cases: NULL text counts as empty; texts under 400 bytes lose nothing; rows that agree in id and text
count as two occurrences and get the same result; very long texts are parsed in blocks. The input row is
handed on as one struct, so no column name clashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import row_keys, scratch, slices, staged, text_or_empty

LENGTH = 400
CORE = 64
IN_ONE_TASK = 1000
_BLOCK = 1 << 19  # windows handled at once
_REACH = LENGTH - CORE + 1
_PLACE = np.uint64(20)  # bits of a place within a block and its windows

_random = np.random.default_rng(977)
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = _BLOCK + LENGTH + 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _UNPOWER = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 2**64))


def _cores(data: np.ndarray) -> np.ndarray:
    """Mixed rolling hash of the 64 bytes from each place on."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=total[1:])
    h = (total[CORE:] - total[:-CORE]) * _UNPOWER[: len(data) - CORE + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, from running minima of blocks of that width."""
    count = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def parse(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Stretches of whole texts: text number, core, trigger, first and last window, 128-bit name."""
    found: dict[str, list] = {x: [] for x in ("text", "core", "at", "first", "last", "w1", "w2")}
    for group in slices(texts, _BLOCK):
        joined = b"".join(texts[i] for i in group)
        ends = np.cumsum([len(texts[i]) for i in group])
        for start in range(0, max(1, len(joined) - LENGTH + 1), _BLOCK):
            part = joined[start : start + _BLOCK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            core = _cores(np.frombuffer(part, dtype=np.uint8))
            places = np.arange(len(core), dtype=np.uint64)
            at = (_least((core >> _PLACE << _PLACE) | places, _REACH) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
            windows = np.arange(len(at)) + start
            text = np.searchsorted(ends, windows, side="right")
            inside = np.flatnonzero(windows + LENGTH <= ends[np.minimum(text, len(ends) - 1)])
            if not len(inside):
                continue
            new = np.flatnonzero(np.diff(at[inside]) | (np.diff(inside) > 1) | np.diff(text[inside])) + 1
            first, last = inside[np.concatenate([[0], new])], inside[np.concatenate([new - 1, [len(inside) - 1]])]
            trigger = at[first]
            names = np.frombuffer(b"".join(
                xxhash.xxh3_128_digest(part[a : b + LENGTH], seed=t - a)
                for a, b, t in zip(first.tolist(), last.tolist(), trigger.tolist(), strict=True)
            ), dtype=np.int64).reshape(-1, 2)
            number = text[first]
            begin = np.concatenate([[0], ends[:-1]])[number] - start
            for name, values in (
                ("text", np.array(group)[number]), ("core", core[trigger].view(np.int64)), ("at", trigger - begin),
                ("first", first - begin), ("last", last - begin), ("w1", names[:, 0]), ("w2", names[:, 1]),
            ):
                found[name].append(values)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in that order."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
    width = max(map(len, strings)) + 1
    table = np.zeros((len(strings), width), dtype=np.uint16)
    for row, i in enumerate(order):
        table[row, : len(strings[i])] = np.frombuffer(strings[i], np.uint8)
        table[row, len(strings[i]) :] = 256 + row % 2  # ends differ from bytes and from each other
    common = np.zeros(len(strings), dtype=np.int64)
    common[1:] = (table[1:] != table[:-1]).argmax(axis=1)
    return order, common


def repeated_windows(pieces: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
    """For each stretch (phrase, parse, shortest split) which of its windows another one holds too.

    Windows are told by their split, the bytes before the trigger, from the shortest on up to the whole
    phrase. Ranks of phrase suffixes and of parses give the corpus order; equal ranks at a split are equal
    windows.
    """
    count = len(pieces)
    shortest = np.array([x[2] for x in pieces])
    longest = np.array([len(x[0]) for x in pieces])
    flags = [np.zeros(b - a + 1, dtype=bool) for a, b in zip(shortest, longest, strict=True)]
    if count < 2:
        return flags
    phrase_order, phrase_common = _prefixes([x[0][::-1] for x in pieces])
    parse_order, parse_common = _prefixes([x[1] for x in pieces])
    phrase_rank, parse_rank = np.empty(count, np.int64), np.empty(count, np.int64)
    for split in range(int(shortest.min()), int(longest.max()) + 1):
        rows = np.flatnonzero((shortest <= split) & (split <= longest))
        if len(rows) < 2:
            continue
        phrase_rank[phrase_order] = np.cumsum(phrase_common < split)
        parse_rank[parse_order] = np.cumsum(parse_common < LENGTH - split)
        _, group, size = np.unique(phrase_rank[rows] * (count + 1) + parse_rank[rows], return_inverse=True, return_counts=True)
        for row in rows[size[group] > 1]:
            flags[row][split - shortest[row]] = True
    return flags


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_KEYS = "k1 bigint, k2 bigint"


def _stretches(source: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parse(batch.column("text").cast(pa.binary()).to_pylist())
            of = pa.array(found["text"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(of), batch.column("k2").take(of), *[pa.array(found[x]) for x in ("core", "w1", "w2")],
                 *[pa.array(found[x], pa.int32()) for x in ("at", "first", "last")]],
                ["k1", "k2", "core", "w1", "w2", "at", "first", "last"],
            )

    return source.mapInArrow(cut, f"{_KEYS}, core bigint, w1 bigint, w2 bigint, at int, first int, last int")


def _pieces(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Phrase and parse of the wanted stretches; the texts are joined with them once."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode("utf-8")
                rows = batch.column("stretches")[i].as_py()
                count = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("k1")[i].as_py()] * count, pa.int64()), pa.array([batch.column("k2")[i].as_py()] * count, pa.int64()),
                     pa.array([r["core"] for r in rows], pa.int64()), pa.array([r["kinds"] for r in rows], pa.int64()),
                     pa.array([r["decided"] for r in rows], pa.bool_()), pa.array([r["at"] for r in rows], pa.int32()),
                     pa.array([r["at"] - r["last"] for r in rows], pa.int32()),
                     pa.array([text[r["first"] : r["at"]] for r in rows], pa.binary()),
                     pa.array([text[r["at"] : r["last"] + LENGTH] for r in rows], pa.binary())],
                    ["k1", "k2", "core", "kinds", "decided", "at", "shortest", "phrase", "parse"],
                )

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "kinds", "decided", "at", "first", "last")).alias("stretches"))
    return source.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "stretches").mapInArrow(
        extract, f"{_KEYS}, core bigint, kinds bigint, decided boolean, at int, shortest int, phrase binary, parse binary"
    )


_SPANS = f"{_KEYS}, first int, last int"


def _in_corpus_order(pieces: DataFrame) -> DataFrame:
    """Repeated windows of stretches whose trigger has few kinds: those of a trigger meet in one task."""
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            rows = []
            for piece, flags in zip(held, repeated_windows([(x["phrase"], x["parse"], x["shortest"]) for x in held]), strict=True):
                if not piece["decided"]:
                    # The window of split s starts s bytes before the trigger.
                    rows += [(piece["k1"], piece["k2"], piece["at"] - piece["shortest"] - b, piece["at"] - piece["shortest"] - a) for a, b in _runs(flags)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "first", "last"])

        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= 8 * IN_ONE_TASK and row["core"] != held[-1]["core"]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    count = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(count, "core").sortWithinPartitions("core").mapInArrow(order, _SPANS)


def _by_names(pieces: DataFrame) -> DataFrame:
    """Repeated windows of stretches whose trigger has many kinds: counted by name, wherever they are."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, size = row["phrase"] + row["parse"], len(row["phrase"]) - row["shortest"] + 1
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + LENGTH]) for i in range(size)), np.int64).reshape(-1, 2)
                start = row["at"] - len(row["phrase"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, row["k1"])), pa.array(np.full(size, row["k2"])), pa.array(np.full(size, row["decided"])),
                     pa.array(np.arange(start, start + size), pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1])],
                    ["k1", "k2", "decided", "first", "n1", "n2"],
                )

    named = pieces.mapInArrow(name, f"{_KEYS}, decided boolean, first int, n1 bigint, n2 bigint")
    often = named.groupBy("n1", "n2").agg(F.count("*").alias("n")).where("n > 1").select("n1", "n2")
    return named.where("not decided").join(often, ["n1", "n2"], "left_semi").select("k1", "k2", "first", F.col("first").alias("last"))


def repeated_spans(source: DataFrame, folder: str) -> DataFrame:
    """(k1, k2, windows): for each text with repeated windows the ranges of their first bytes.

    ``source`` has k1, k2 and text.
    """
    stretches = staged(_stretches(source), folder, "stretches")
    # The two sides of a join on the trigger are tables, so that a frequent one can be split.
    cores = staged(stretches.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), folder, "cores")
    likely = staged(stretches.join(cores, "core", "left_semi"), folder, "likely")
    whole = staged(
        likely.groupBy("core", "w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "first", "last")).alias("r")), folder, "whole"
    )
    kinds = staged(whole.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), folder, "kinds")
    decided = likely.join(whole.where("n > 1").select("core", "w1", "w2"), ["core", "w1", "w2"], "left_semi").select("k1", "k2", "first", "last")
    wanted = whole.join(kinds, "core").select("core", "kinds", (F.col("n") > 1).alias("decided"), "r.*")
    pieces = staged(_pieces(source, wanted), folder, "pieces")
    few, many = pieces.where(F.col("kinds") <= IN_ONE_TASK), pieces.where(F.col("kinds") > IN_ONE_TASK)
    spans = decided.unionByName(_in_corpus_order(few)).unionByName(_by_names(many))
    return staged(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("windows")), folder, "windows")


def _merged(windows: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for x in sorted(windows or (), key=lambda w: w["first"]):
        if out and x["first"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], x["last"] + LENGTH)
        else:
            out.append((x["first"], x["last"] + LENGTH))
    return out


def _kept(text: Column, windows: Column) -> Column:
    @F.arrow_udf("struct<n_bytes: bigint, spans: array<struct<start: bigint, stop: bigint>>, kept: binary>")
    def keep(texts: pa.Array, windows: pa.Array) -> pa.Array:
        sizes, spans, rest = [], [], []
        for text, found in zip(texts.cast(pa.binary()).to_pylist(), windows.to_pylist(), strict=True):
            ranges = _merged(found)
            cuts = [0, *[x for r in ranges for x in r], len(text)]
            sizes.append(len(text))
            spans.append([{"start": a, "stop": b} for a, b in ranges])
            rest.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], ["n_bytes", "spans", "kept"]
        )

    return keep(text, windows)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_bytes, spans, kept): the input row as a struct, the removed byte ranges, what is left."""
    folder = scratch(docs.sparkSession)
    k1, k2 = row_keys(key, text)
    source = docs.select(k1.alias("k1"), k2.alias("k2"), text_or_empty(text).alias("text"))
    windows = repeated_spans(source, folder)
    # The text leaves the row for the join, so that it is shuffled once.
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), rest.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = rows.join(windows, ["k1", "k2"], "left").select("row", "text", _kept(text_or_empty(), F.col("windows")).alias("r"))
    return joined.select("row", "text", "r.*")
