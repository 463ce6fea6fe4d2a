"""Learned decision lists for text quality.

Sequential covering grows threshold conjunctions on labelled statistics, prunes each on rows it was not
grown on, and emits the list as one ordered Spark conditional expression.

Edge cases: a NULL text has no words; an empty or NULL text fails the base rule; ties between rules are
settled by the order of features and thresholds; repeated rows get equal verdicts; without labelled rows
of both classes the list is empty and keeps everything. Columns of the input are left alone; the name of
the added statistics column is an argument.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_FOLLOWING = bytes(range(0x80, 0xC0))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_END = b".!?,;:"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs",
    "n_bars", "n_distinct", "n_same_next", "n_lines", "n_ends",
)
STATISTICS_TYPE = "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ">"

#: Features of the rules: name -> (numerator, denominator), both counts; a denominator of 0 counts as 1.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "bang_share": ("n_bangs", "n_words"),
    "bar_share": ("n_bars", "n_words"), "distinct_share": ("n_distinct", "n_words"),
    "same_next_share": ("n_same_next", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"), "end_share": ("n_ends", "n_words"),
}


def _repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    twice = np.zeros(len(windows), dtype=bool)
    for i, window in enumerate(windows):
        at = first.setdefault(window, i)
        if at != i:
            twice[at] = twice[i] = True
    change = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change) > 0).sum())


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts named in COUNTS of one whole text in UTF-8."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()  # of bytes: parts at exactly the six ASCII white-space characters

    def number(characters: bytes) -> int:
        return len(text) - len(text.translate(None, characters))

    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return (
        len(words), len(text.translate(None, _BLANK + _FOLLOWING)), number(SYMBOLS), len(lines) - len(set(lines)),
        _repeated_words(words), number(_UPPER), number(_DIGIT), text.count(b"!"), text.count(b"|"), len(set(words)),
        sum(map(operator.eq, words, words[1:])), len(lines), number(_END),
    )


def _count_batch(texts: pa.Array) -> pa.Array:
    rows = [count_text(x.as_py()) for x in texts.cast(pa.binary())]
    columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(len(COUNTS))], list(COUNTS))


def statistics(text: Column) -> Column:
    """struct of the counts of each whole text.

    Spark takes it for one that may differ from call to call. Otherwise a filter on the counts is pushed below them and counts
    every text again, in a second Python worker of each task.
    """
    return F.arrow_udf(_count_batch, STATISTICS_TYPE).asNondeterministic()(text.cast("string"))


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """The rows with a struct column of counts over the whole text."""
    return docs.withColumn(name, statistics(F.col(f"`{text}`")))


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def feature(counts: Column, name: str) -> Column:
    above, below = RATIOS[name]
    return counts[above].cast("double") / F.greatest(counts[below], F.lit(1)).cast("double")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; a row that any of them covers is rejected."""

    rules: tuple[tuple[Literal, ...], ...] = ()

    def keeps(self, counts: Column) -> Column:
        """One ordered conditional expression: the first rule that holds decides."""
        verdict = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            holds = F.lit(True)
            for x in rule:
                value = feature(counts, x.feature)
                holds = holds & ((value >= x.threshold) if x.above else (value < x.threshold))
            verdict = verdict.when(holds, F.lit(False))
        return verdict.otherwise(F.lit(True))


def _cover(x: np.ndarray, names: list[str], rule: list[Literal]) -> np.ndarray:
    covered = np.ones(len(x), dtype=bool)
    for literal in rule:
        value = x[:, names.index(literal.feature)]
        covered &= (value >= literal.threshold) if literal.above else (value < literal.threshold)
    return covered


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> list[Literal]:
    """Adds the literal of the largest information gain until no good row is covered."""
    rule: list[Literal] = []
    while len(rule) < most:
        covered = _cover(x, names, rule)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p or not n:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for k, name in enumerate(names):
            bad_values, good_values = np.sort(x[covered & bad, k]), np.sort(x[covered & ~bad, k])
            p_below, n_below = np.searchsorted(bad_values, cuts[k]), np.searchsorted(good_values, cuts[k])
            for above, ps, ns in ((True, p - p_below, n - n_below), (False, p_below, n_below)):
                value = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - before), -1.0)
                at = int(value.argmax()) if len(value) else -1
                if at >= 0 and value[at] > gain:
                    best, gain = Literal(name, above, float(cuts[k][at])), value[at]
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rule: list[Literal], x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[list[Literal], int, int]:
    """Shortest head of the rule with the largest (p - n) / (p + n) on the pruning rows."""
    best, worth, found = rule, -2.0, (0, 0)
    for size in range(1, len(rule) + 1):
        covered = _cover(x, names, rule[:size])
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth, found = rule[:size], value, (p, n)
    return best, *found


def learn(
    x: np.ndarray, bad: np.ndarray, names: list[str], most_rules: int = 12, most_literals: int = 4,
    least_precision: float = 0.95, least_rows: int = 3, bins: int = 64,
) -> DecisionList:
    """Sequential covering. Every third row prunes; a rule is added if it reaches the precision there."""
    prune = np.arange(len(x)) % 3 == 2
    # Thresholds lie half-way between neighbouring quantiles, so that no cut sits on a frequent value.
    cuts = []
    for k in range(x.shape[1]):
        levels = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1))) if len(x) else np.array([])
        cuts.append((levels[1:] + levels[:-1]) / 2)
    left, spent, rules = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=bool), []
    while len(rules) < most_rules and (left & bad & ~prune & ~spent).any():
        growing, pruning = left & ~prune & ~spent, left & prune
        rule = _grow(x[growing], bad[growing], names, cuts, most_literals)
        if not rule:
            break
        rule, p, n = _prune(rule, x[pruning], bad[pruning], names)
        covered = _cover(x, names, rule)
        if p and p / (p + n) >= least_precision and (covered & left & bad).sum() >= least_rows:
            rules.append(tuple(rule))
            left &= ~covered
        else:
            spent |= covered & growing & bad  # what it found is set aside, the search goes on
    return DecisionList(tuple(rules))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality",
    most_rows: int = 20_000, **options,
) -> DecisionList:
    """Decision list from labelled documents.

    ``most_rows`` bounds the labelled rows that are used (those of the smallest hashes of their key), so
    what reaches the driver, a few numbers per row, does not grow with the corpus. Rows without key or
    label are not used; a key labelled several times counts with its lowest label.
    """
    sample = (
        labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.min(quality).alias("_quality"))
        .orderBy(F.xxhash64("_key"), "_key").limit(most_rows)
    )
    rows = (
        docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
        .join(F.broadcast(sample), "_key")  # most_rows keys at most
        .select("_key", "_quality", statistics(F.col("_text")).alias("s"))
        .where(~base_failed(F.col("s")))
        .select("_key", "_quality", *[feature(F.col("s"), name).alias(name) for name in RATIOS])
        .orderBy(F.xxhash64("_key"), "_key", *RATIOS).limit(2 * most_rows).toPandas()
    )
    names = list(RATIOS)
    return learn(rows[names].to_numpy(dtype=float), rows["_quality"].to_numpy() == 0, names, **options)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", name: str = "statistics") -> DataFrame:
    """The rows with their statistics, ``base_failed`` and ``kept``, as fields of one struct column."""
    counted = with_statistics(docs, text, name)
    failed = base_failed(F.col(name))
    kept = F.when(failed, F.lit(False)).otherwise(rules.keeps(F.col(name)))
    return counted.withColumn(name, F.struct(f"{name}.*", failed.alias("base_failed"), kept.alias("kept")))
