"""Benchmark decontamination with a positional inverted index of the training texts.

The index holds postings of terms: document, position, and the words around the position, as far as a
window of a benchmark item reaches. Only terms that are the rarest of some window are stored, because a
window occurs exactly where a posting of its rarest term, moved back by the term's offset, is followed by
the window's words. Rarity is counted over all texts. Phrase search joins windows and postings on the term;
proximity search joins groups of terms and postings on the group's rarest term, and asks for the others among
the words around the posting. In both, the words kept with a posting stand in for intersecting posting lists.
Every text also has one posting of ``END`` behind its last word, so the index knows the lengths of the texts.

DataFrame operations only. Edge cases: NULL and empty texts have no words; an item without words is never
found; repeated rows get equal results; equal windows of several items count for each; empty tables give no
matches. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import row_keys, scratch, staged

WINDOW = 10
#: Words on either side of a posting that are kept at least; no proximity search can reach farther.
SPAN = 20
#: The term of the posting behind the last word of a text; words are never empty.
END = ""
#: Terms in one broadcast table; more terms are looked up in several passes over the texts.
TERMS_IN_BLOCK = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); none for NULL."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    # Pure ASCII is lowered at once; elsewhere other letters must keep their case.
    lowered = F.when(F.octet_length(known) == F.char_length(known), F.lower(known)).otherwise(F.translate(known, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, window): every run of ``size`` words of an item; shorter items are one window."""
    split = items.select(F.col(f"`{key}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        split.where(F.size("w") > 0).withColumn("start", F.explode(starts))
        .select("item", F.slice("w", F.col("start"), F.lit(size)).alias("window")).distinct()
    )


def _blocks(spark, terms: DataFrame) -> list[DataFrame]:
    """A table of terms in parts that are small enough to broadcast."""
    count = max(1, -(-terms.count() // TERMS_IN_BLOCK))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(count)) == k) for k in range(count)]


@dataclass(frozen=True)
class Postings:
    """The index: (term, k1, k2, position, before, context), the corpus counts of all asked terms, and the
    indexed terms; ``span`` words on either side of a posting are in its context."""

    table: DataFrame
    counts: DataFrame
    terms: DataFrame
    span: int


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, term, offset): the rarest term of each window, the first of equals; none may be missing.

    A window with a term that no text holds occurs nowhere and drops out.
    """
    placed = windows.select("window", F.posexplode("window").alias("offset", "term"))
    counted = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("window").agg(F.min(F.struct("n", "offset", "term")).alias("b"))
    return best.where(F.col("b.n") > 0).select("window", F.col("b.term").alias("term"), F.col("b.offset").alias("offset"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences of the terms in all texts."""
    found = None
    for block in _blocks(docs.sparkSession, terms):
        part = (
            docs.select(words(F.col(f"`{text}`")).alias("w")).select(F.explode("w").alias("term"))
            .join(F.broadcast(block), "term").groupBy("term").agg(F.count("*").alias("n"))
        )
        found = part if found is None else found.unionByName(part)
    return found


def build_index(docs: DataFrame, rarest: DataFrame, counts: DataFrame, folder: str, key: str = "doc_id", text: str = "text", span: int = SPAN) -> Postings:
    """Postings of the chosen terms in all texts, stored below ``folder``.

    Beside the position a posting keeps the words up to the farthest start and end of a window around it,
    and ``span`` words on either side at least.
    """
    reach = rarest.groupBy("term").agg(
        F.greatest(F.max("offset"), F.lit(span)).alias("back"),
        F.greatest(F.max(F.size("window") - F.col("offset")), F.lit(span + 1)).alias("ahead"),
    )
    reach = reach.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(0).alias("back"), F.lit(0).alias("ahead")))
    k1, k2 = row_keys(key, text)
    split = docs.select(k1.alias("k1"), k2.alias("k2"), words(F.col(f"`{text}`")).alias("w"))
    exploded = split.select("k1", "k2", "w", F.posexplode(F.array_append("w", F.lit(END))).alias("position", "term"))
    found = None
    for block in _blocks(docs.sparkSession, reach):
        start = F.greatest(F.col("position") - F.col("back"), F.lit(0))
        part = exploded.join(F.broadcast(block), "term").select(
            "term", "k1", "k2", "position", (F.col("position") - start).alias("before"),
            F.slice("w", start + 1, F.col("position") - start + F.col("ahead")).alias("context"),
        )
        found = part if found is None else found.unionByName(part)
    return Postings(staged(found, folder, "postings"), counts, rarest.select("term").distinct(), span)


def phrase_matches(index: Postings, rarest: DataFrame) -> DataFrame:
    """(k1, k2, start, window): every occurrence of a window, by the moved postings of its rarest term."""
    at = F.col("before") - F.col("offset")
    same = (at >= 0) & (F.slice("context", at + 1, F.size("window")) == F.col("window"))
    return (
        index.table.join(rarest, "term").where(F.when(at >= 0, same).otherwise(False))
        .select("k1", "k2", (F.col("position") - F.col("offset")).alias("start"), "window")
    )


def _near(span: int) -> Column:
    """Whether all ``terms`` stand within ``span`` words of a posting."""
    start = F.greatest(F.col("before") - span, F.lit(0))
    around = F.slice("context", start + 1, F.col("before") - start + span + 1)
    return F.size(F.array_except("terms", around)) == 0


def group_leads(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(group, term, n, terms): the rarest term of each group, the first of equals, and all its terms."""
    counted = groups.select("group", "term").distinct().join(counts, "term", "left")
    return counted.groupBy("group").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("lead"), F.collect_set("term").alias("terms")
    ).select("group", "lead.term", "lead.n", "terms")


def proximity_matches(index: Postings, groups: DataFrame, span: int) -> DataFrame:
    """(group, k1, k2): texts that hold all terms of a group within ``span`` words of its rarest one.

    ``groups`` has ``group`` and ``term``. Only the rarest term must be in the index, as the others are
    sought around its postings; a group for which that is not so is an error and not left out, unless no
    text holds its rarest term.
    """
    if span > index.span:
        raise ValueError(f"the index keeps {index.span} words around a posting, not {span}")
    known = index.terms.withColumn("indexed", F.lit(True))
    absent = index.counts.where("n = 0").select("term")
    led = group_leads(groups, index.counts).join(absent, "term", "left_anti").join(known, "term", "left")
    message = F.concat(F.lit("the index has no postings of the rarest term of a group: "), F.col("term"))
    sure = led.where(F.when(F.col("indexed"), True).otherwise(F.raise_error(message).cast("boolean")))
    return index.table.join(sure, "term").where(_near(span)).select("group", "k1", "k2").distinct()


@dataclass(frozen=True)
class ItemIndex:
    """(item, window), (window, term, offset), the index with both, and the folder for what is made of it."""

    windows: DataFrame
    rarest: DataFrame
    postings: Postings
    folder: str


def item_index(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = WINDOW, span: int = SPAN, groups: DataFrame | None = None,
) -> ItemIndex:
    """Index of the terms that phrase search for the windows of items needs, and of those that proximity
    search for them and for further ``groups`` (group, term) needs."""
    folder = scratch(docs.sparkSession)
    windows = staged(item_windows(items, item_key, item_text, size), folder, "windows")
    distinct = windows.select("window").distinct()
    terms = distinct.select(F.explode("window").alias("term"))
    terms = (terms if groups is None else terms.unionByName(groups.select("term"))).distinct()
    found = terms.join(term_counts(docs, terms, text), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = staged(found, folder, "counts")
    rarest = staged(rarest_terms(distinct, counts), folder, "rarest")
    chosen = rarest
    if groups is not None:
        leads = group_leads(groups, counts).where("n > 0")
        chosen = rarest.unionByName(leads.select(F.array("term").alias("window"), "term", F.lit(0).alias("offset")))
    return ItemIndex(windows, rarest, build_index(docs, chosen, counts, folder, key, text, span), folder)


def _items(matches: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """(k1, k2, name): the sorted items of the matched windows."""
    return (
        matches.select("k1", "k2", "window").distinct().join(windows, "window")
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias(name))
    )


def _hits(matches: DataFrame, windows: DataFrame) -> DataFrame:
    ranges = F.struct(F.col("start"), (F.col("start") + F.size("window")).alias("stop"))
    hits = matches.groupBy("k1", "k2").agg(F.collect_set(ranges).alias("hits"))
    return hits.join(_items(matches, windows, "items"), ["k1", "k2"])


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = WINDOW,
) -> DataFrame:
    """(k1, k2, hits, items) of the documents in which a window occurs.

    ``hits`` are the (start, stop) word ranges of the occurrences, ``items`` the sorted items they come from.
    """
    index = item_index(docs, items, key, text, item_key, item_text, size, span=0)
    return _hits(staged(phrase_matches(index.postings, index.rarest), index.folder, "matches"), index.windows)


def window_proximity(index: ItemIndex, span: int) -> DataFrame:
    """(k1, k2, position, window): postings of the rarest term of a window within ``span`` words of which
    all its words stand, in any order and with any between them."""
    if span > index.postings.span:
        raise ValueError(f"the index keeps {index.postings.span} words around a posting, not {span}")
    led = index.rarest.withColumn("terms", F.array_distinct("window"))
    return index.postings.table.join(led, "term").where(_near(span)).select("k1", "k2", "position", "window")


def hit_words(hits: Column) -> Column:
    """Words inside any of the ranges."""
    ordered = F.array_sort(hits)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("stop"))

    def add(state: Column, x: Column) -> Column:
        gain = F.greatest(x["stop"] - F.greatest(x["start"], state["stop"]), F.lit(0))
        return F.struct((state["n"] + gain).alias("n"), F.greatest(state["stop"], x["stop"]).alias("stop"))

    return F.aggregate(ordered, start, add)["n"]


def word_counts(docs: DataFrame, index: Postings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, k1, k2) of every row, from the postings of the ends of texts."""
    k1, k2 = row_keys(key, text)
    # Rows that agree in id and text have one length and several postings.
    ends = index.table.where(F.col("term") == END).groupBy("k1", "k2").agg(F.max("position").cast("bigint").alias("n_words"))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), k1.alias("k1"), k2.alias("k2")).join(ends, ["k1", "k2"])


def report(docs: DataFrame, items: DataFrame, span: int = SPAN, **columns) -> DataFrame:
    """Every document with its words, hit words and items, and its proximity matches.

    ``n_near`` counts the words around which, within ``span`` words, all words of a window stand;
    ``near_items`` are the sorted items of those windows. Where ``span`` is at least a window less one word,
    every exact match is also one by proximity.
    """
    key, text = columns.get("key", "doc_id"), columns.get("text", "text")
    index = item_index(docs, items, **columns, span=span)
    found = _hits(staged(phrase_matches(index.postings, index.rarest), index.folder, "matches"), index.windows)
    near = staged(window_proximity(index, span), index.folder, "near")
    places = near.groupBy("k1", "k2").agg(F.countDistinct("position").alias("n_near"))
    close = places.join(_items(near, index.windows, "near_items"), ["k1", "k2"])
    joined = word_counts(docs, index.postings, key, text).join(found, ["k1", "k2"], "left").join(close, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce(hit_words(F.col("hits")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.coalesce("near_items", none).alias("near_items"),
    )
