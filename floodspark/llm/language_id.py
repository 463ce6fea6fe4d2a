"""Hierarchical language identification.

A first set of linear support vector machines, one for each family against the rest, chooses the language
family; within it one machine for each pair of languages votes. Features are hashed counts of the byte
n-grams (1 to 3) of the whole lower-case text, square-rooted and normalised, so a long text costs one pass.

Edge cases: a NULL text, or one without letters, is ``und`` with score 0; equal texts get equal results, ties
go to the first family or language in alphabetical order; with one language it is always that one, with none
every text is ``und``. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 2048
UNKNOWN = "und"

#: Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "si", "ur"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
}

_PLAIN = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
_GRAMS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def family_of(lang: str, families: dict[str, tuple[str, ...]] | None = None) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in (families or FAMILIES).items() if code in codes), lang)


def vector(text: str) -> np.ndarray:
    """Normalised features of a whole text (float32)."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8").translate(_PLAIN) + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(WIDTH)
    code = data
    for k, odd in enumerate(_GRAMS):
        if k:
            code = code[:-1] * np.uint32(257) + data[k:]
        counts += np.bincount((code * odd) >> np.uint32(21), minlength=WIDTH)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train_machine(x: np.ndarray, y: np.ndarray, epochs: int = 30, penalty: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights and bias of a linear machine by stochastic subgradients of the hinge loss; y is -1 or 1."""
    weights, total = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    balance = np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y < 0).mean()))
    shuffle, batch, step = np.random.default_rng(seed), 32, 0
    for epoch in range(epochs):
        for at in np.array_split(shuffle.permutation(len(x)), -(-len(x) // batch)):
            step += 1
            rate = 1.0 / (penalty * (step + 1000))
            wrong = at[y[at] * (x[at] @ weights[:-1] + weights[-1]) < 1]
            weights[:-1] *= 1 - rate * penalty
            push = rate * (balance[wrong] * y[wrong]) / len(at)
            weights[:-1] += push @ x[wrong]
            weights[-1] += 0.1 * push.sum()
            if epoch >= epochs // 2:
                total += weights
    return total / np.linalg.norm(total[:-1]).clip(1e-9) * 10


@dataclass(frozen=True)
class LanguageModel:
    """Family machines (one row each), and pair machines for the languages of each family."""

    families: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letters(text):
            return UNKNOWN, 0.0
        x = np.append(vector(text), np.float32(1))
        margins = self.family_weights @ x
        chosen = int(margins.argmax())
        score = 1 / (1 + np.exp(-margins[chosen])) if len(self.families) > 1 else 1.0
        languages = self.families[chosen]
        votes = dict.fromkeys(languages, 0)
        strength = dict.fromkeys(languages, 0.0)
        for (a, b), weights in self.pairs.items():
            if a in votes and b in votes:
                margin = float(weights @ x)
                votes[a if margin >= 0 else b] += 1
                strength[a] += margin
                strength[b] -= margin
        best = max(languages, key=lambda lang: (votes[lang], strength[lang]))
        if len(languages) > 1:
            score *= 1 / (1 + np.exp(-strength[best] / (len(languages) - 1)))
        return best, float(min(1.0, max(0.0, score)))

    def predicted(self, text: Column) -> Column:
        """struct<lang_pred, score> of each whole text."""
        model = self

        @F.arrow_udf("struct<lang_pred: string, score: double>")
        def predict(texts: pa.Array) -> pa.Array:
            found = [model.predict(x) for x in texts.to_pylist()]
            return pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["lang_pred", "score"],
            )

        return predict(text.cast("string"))


def train(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] | None = None) -> LanguageModel:
    """Machines from feature rows and their languages."""
    codes = np.array(langs, dtype=object)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(family_of(lang, families), []).append(lang)
    names = sorted(groups)
    weights = np.zeros((len(names), WIDTH + 1))
    if len(names) > 1:
        for k, name in enumerate(names):
            weights[k] = train_machine(x, np.where(np.isin(codes, groups[name]), 1.0, -1.0))
    pairs = {}
    for members in groups.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = np.isin(codes, [a, b])
                pairs[a, b] = train_machine(x[rows], np.where(codes[rows] == a, 1.0, -1.0))
    return LanguageModel(tuple(tuple(groups[n]) for n in names), weights, pairs)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 4000, least_rows: int = 50) -> LanguageModel:
    """Model from the documents that have a language and letters.

    ``most_rows`` bounds the documents that are used. Every language has an equal share of it, or
    ``least_rows`` where there are so many languages that the share is smaller, taken by the smallest hashes
    of the key among its own documents, so that no language crowds out another. Only feature vectors, 8 KB
    each, reach the driver; the languages are few (tens to a few hundred).
    """
    order, name = F.xxhash64(F.col(f"`{key}`")), F.col(f"`{lang}`").cast("string")
    known = docs.where(name.isNotNull()).select(order.alias("h"), name.alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    languages = known.select("lang").distinct().count()
    share = max(most_rows // max(languages, 1), least_rows)
    first = Window.partitionBy("lang").orderBy("h")
    bounds = (
        known.select("lang", "h").withColumn("r", F.row_number().over(first)).where(F.col("r") <= share)
        .groupBy("lang").agg(F.max("h").alias("bound"))
    )

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([vector(x).tobytes() if has_letters(x) else None for x in texts.to_pylist()], pa.binary())

    # Rows of equal keys may pass the bound, and are told apart by their texts.
    tied = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    chosen = known.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("bound"))
    chosen = chosen.withColumn("r", F.row_number().over(tied)).where(F.col("r") <= share)
    rows = chosen.select("h", "lang", features("text").alias("x")).where(F.col("x").isNotNull()).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(-1, WIDTH)
    return train(x, [r["lang"] for r in rows])
