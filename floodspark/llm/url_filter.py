"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on URLs whose verdict is known, and use the text of the URL only: lengths, depth,
digit ratio, character entropy, parameter counts, and how often labelled URLs of the same suffix are blocked.
Everything is DataFrame and Spark ML code in the JVM.

Labels come from rules, and rules name suffixes, so a suffix rate could repeat the label. Hence rates count each
labelled URL once, over all of them; a suffix whose labelled URLs all have one verdict gets the prior like a
suffix never seen; and training is out of fold: half of the sampled URLs see the rates of the other half's fold
of all labelled URLs, the rest see the prior, so the trees also learn what to do without a rate.

Edge cases: a NULL URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees like any other; repeated rows get equal verdicts; without labelled URLs of both classes the verdict is
the only class there is, or ``allow``; the names of added columns are fixed and replace none of the input's,
as only the key and the URL are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import scratch, staged

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
    "query_length", "has_fragment", "is_secure", "suffix_rate",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        below = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return below & F.startswith(path, F.lit(self.path))


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def split_urls(pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, host, path, rule, ruled): the longest rule that fits, and its verdict."""
    text = F.col(f"`{url}`").cast("string")
    host, path = parts(text)
    split = pages.select(F.col(f"`{key}`").alias(key), text.alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = x.fits(F.col("host"), F.col("path"))
        rule, ruled = F.when(fits, F.lit(x.name)).otherwise(rule), F.when(fits, F.lit(x.verdict)).otherwise(ruled)
    return split.withColumns({"rule": rule, "ruled": ruled})


def entropy(text: Column) -> Column:
    """Bits for each character, over the distinct characters of a short text."""
    size = F.length(text).cast("double")

    def share(character: Column) -> Column:
        return (size - F.length(F.replace(text, character, F.lit(""))).cast("double")) / size

    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(size > 0, F.aggregate(characters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(0.0)


def count_of(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("double")


def lexical(split: DataFrame) -> DataFrame:
    """Adds the features of the URL's text and its ``suffix``, the last label of the host."""
    text = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    digits = (F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))).cast("double")
    return split.withColumns({
        "url_length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": count_of(F.col("path"), "/"),
        "labels": count_of(F.col("host"), "."), "digit_ratio": digits / F.greatest(F.length(text), F.lit(1)),
        "hyphens": count_of(F.col("host"), "-"), "entropy": entropy(text),
        "parameters": F.when(query != "", count_of(query, "&") + 1).otherwise(0.0),
        "query_length": F.length(query).cast("double"), "has_fragment": F.contains(text, F.lit("#")).cast("double"),
        "is_secure": F.startswith(text, F.lit("https:")).cast("double"),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0),
    })


@dataclass(frozen=True)
class UrlModel:
    """Trained trees with the stored table of suffix rates, or one fixed verdict."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float

    def judge(self, features: DataFrame) -> DataFrame:
        """Adds ``judged`` (allow or block) and ``block_score`` (0 to 1)."""
        if self.trees is None:
            verdict = "block" if self.prior > 0.5 else "allow"
            return features.withColumns({"judged": F.lit(verdict), "block_score": F.lit(float(self.prior > 0.5))})
        rated = features.join(self.suffixes, "suffix", "left").fillna(self.prior, ["suffix_rate"])
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated))
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        # The log-odds of the trees; the raw prediction column is a vector of -2 F and 2 F.
        from pyspark.ml.functions import vector_to_array

        return scored.withColumns({"judged": verdict, "block_score": vector_to_array("probability")[1]})


def suffix_rates(labelled: DataFrame, prior: float, smooth: float) -> DataFrame:
    """(suffix, suffix_rate) of the suffixes with labelled URLs of both verdicts, drawn towards the prior."""
    counts = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    mixed = counts.where((F.col("blocked") > 0) & (F.col("blocked") < F.col("n")))
    return mixed.select("suffix", ((F.col("blocked") + smooth * prior) / (F.col("n") + smooth)).alias("suffix_rate"))


def fit(features: DataFrame, most_rows: int = 10_000, trees: int = 12, depth: int = 4, smooth: float = 20.0) -> UrlModel:
    """Trees from the different URLs that a rule decided.

    ``most_rows`` bounds the URLs that the trees are trained on (those of the smallest hashes). The prior and the
    suffix rates are counted over all labelled URLs and kept in a table, however many suffixes there are.
    """
    spark = features.sparkSession
    folder = scratch(spark)
    ruled = features.where(F.col("ruled").isNotNull()).select("url", "host", "path", "suffix", "ruled").distinct()
    label, fold = (F.col("ruled") == "block").cast("double"), F.pmod(F.xxhash64(F.lit(11), "url"), F.lit(2))
    labelled = staged(ruled.withColumns({"label": label, "fold": fold}), folder, "labelled")
    rows, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = blocked / rows if rows else 0.0
    if not 0.0 < prior < 1.0:
        return UrlModel(None, None, prior)
    suffixes = staged(suffix_rates(labelled, prior, smooth), folder, "suffixes")
    unseen = suffix_rates(labelled.where("fold = 1"), prior, smooth).withColumn("fold", F.lit(0).cast("bigint"))
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(most_rows)
    rated = lexical(sample).join(unseen, ["suffix", "fold"], "left").fillna(prior, ["suffix_rate"])
    # The table has no more than most_rows rows.
    table = staged(rated.select("url", "label", *FEATURES), folder, "training").orderBy("url")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    boost = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7)
    return UrlModel(boost.fit(vectors.select("label", "features")), suffixes, prior)


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url", **options,
) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) of every URL."""
    features = lexical(split_urls(pages, rules, key, url))
    judged = fit(features, **options).judge(features)
    return judged.select(
        key, "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "block_score",
    )
