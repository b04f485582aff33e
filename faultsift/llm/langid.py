"""Language identification by Bayesian evidence fusion.

The likelihood of a text under each language comes from byte trigrams (a hashed naive Bayes model).
It is combined with the declared markup language, the address suffix, and a prior for the host that
is smoothed towards that of its domain, which is smoothed towards that of the whole corpus. How
declarations and suffixes relate to languages, and all priors, are computed over all rows by grouped
aggregation of the texts' posteriors; only the trigram model is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import staged, text_of, with_arrow

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled texts that the trigram model is fitted on, about.
FIT_ROWS = 4000
BUCKETS = 1 << 16
#: Share of each language's probability that all buckets have in common, seen or not: the same for all languages.
UNSEEN = 0.01
#: Text evidence counts as that of so many independent trigrams at most: neighbouring ones repeat each other.
MOST_TRIGRAMS = 40.0
#: Rows of a host or domain that weigh as much as the prior above it.
PRIOR_WEIGHT = 20.0
LEAST_CONFIDENCE = 0.5
_FACTOR = np.uint32(2654435761)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words, a space at both ends of the text; letters only."""
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    raw = np.frombuffer((" " + " ".join(kept.split()) + " ").encode("utf-8"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * _FACTOR) >> np.uint32(16)).astype(np.int64)


def fit(docs: DataFrame, text: str, declared: str, languages: Sequence[str] = LANGUAGES, rows: int = FIT_ROWS) -> np.ndarray:
    """Log probabilities of trigram buckets, (language, bucket).

    The sample holds about rows different texts, or all if there are fewer: those whose hash lies in
    the share that rows has of all labelled rows. Copies count once, with the first of their labels.
    """
    labelled = docs.where(F.col(declared).isin(list(languages)) & F.col(text).isNotNull())
    share = min(1.0, rows / max(1, labelled.count()))
    sample = (
        labelled.select(F.col(declared).alias("label"), F.col(text).alias("text"), F.xxhash64(text, F.lit(5)).alias("_by"))
        .where(F.pmod("_by", F.lit(1 << 30)) < int(share * (1 << 30)))
        .groupBy("_by")
        .agg(F.min("label").alias("label"), F.min("text").alias("text"))
    )

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t in batch.column("text"):
            bucket, n = np.unique(trigrams(t.as_py()), return_counts=True)
            out.append([{"bucket": b, "n": k} for b, k in zip(bucket.tolist(), n.tolist(), strict=True)])
        return [pa.array(out, pa.list_(pa.struct([("bucket", pa.int64()), ("n", pa.int64())])))]

    kind = T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())]))
    counted = with_arrow(sample, ["text"], [T.StructField("grams", kind)], count, ["label"])
    table = counted.select("label", F.inline("grams")).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[[list(languages).index(x) for x in table["label"]], table["bucket"].to_numpy(int)] += table["n"].to_numpy(float)
    total = counts.sum(axis=1, keepdims=True)
    share = np.divide(counts, total, out=np.full_like(counts, 1 / BUCKETS), where=total > 0)
    return np.log((1 - UNSEEN) * share + UNSEEN / BUCKETS)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weight = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weight, lambda x: x / total)


def _sums(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group the number of rows (n) and the sum of their posteriors (sums)."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col("posterior")[i]).alias(f"_{i}") for i in range(n)))
    return out.select(*by, "n", F.array(*(F.col(f"_{i}") for i in range(n))).alias("sums"))


def _domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def identify(
    docs: DataFrame,
    text: str = "text",
    declared: str | None = "lang",
    host: Column | None = None,
    suffix: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    fit_rows: int = FIT_ROWS,
    keep: list[str] | None = None,
    model: np.ndarray | None = None,
) -> DataFrame:
    """docs (or its columns in keep) with language, confidence, text_language and accepted.

    declared is the column of declared languages; the sample that fits the trigram model takes its
    labels from it unless a model is given. host and suffix are columns of the address. Missing evidence (null) counts
    as none. A row without letters is judged by the rest of its evidence but not accepted, nor is one
    whose confidence is below LEAST_CONFIDENCE, nor one whose text no language explains better than
    trigrams drawn at random do. Ties go to the language named first. Repeated rows
    count as often as they occur; an empty table gives an empty result.
    """
    spark, n = docs.sparkSession, len(languages)
    names = F.array(*map(F.lit, languages))
    kept = list(docs.columns if keep is None else keep)
    rows = docs.select(
        *(F.col(c) for c in kept),
        text_of(text).alias("_text"),
        (F.lit(None).cast("string") if declared is None else F.lower(F.col(declared).cast("string"))).alias("_declared"),
        (F.lit(None).cast("string") if host is None else host).alias("_host"),
        (F.lit(None).cast("string") if suffix is None else suffix).alias("_suffix"),
    )
    if model is None:
        model = fit(rows, "_text", "_declared", languages, fit_rows)
    shared = spark.sparkContext.broadcast(model.astype(np.float32))  # languages x buckets

    def likelihood(batch: pa.RecordBatch) -> list[pa.Array]:
        table, scores, sizes, known = shared.value, [], [], []
        for t in batch.column("_text"):
            codes = trigrams(t.as_py())
            sizes.append(len(codes))
            mean = table[:, codes].mean(axis=1, dtype=np.float64) if len(codes) else np.zeros(n)
            scores.append((mean * min(len(codes), MOST_TRIGRAMS)).tolist())
            known.append(bool(len(codes)) and float(mean.max()) > -np.log(BUCKETS))
        return [pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(known, pa.bool_())]

    fields = [T.StructField("_score", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType()), T.StructField("_known", T.BooleanType())]
    told = with_arrow(rows, ["_text"], fields, likelihood, [*kept, "_declared", "_host", "_suffix"])
    told = staged(told.withColumn("_domain", _domain(F.col("_host"))), "langid")
    seen = told.select("_declared", "_host", "_domain", "_suffix", _softmax(F.col("_score")).alias("posterior"))
    everywhere = _sums(seen, [], n).first()
    total = max(1, everywhere["n"] or 0)
    share = [((s or 0.0) + 1.0) / (total + n) for s in everywhere["sums"]]
    shares = F.array(*map(F.lit, share))

    def smoothed(sums: Column, count: Column, above: Column) -> Column:
        return F.zip_with(sums, above, lambda s, a: (s + PRIOR_WEIGHT * a) / (count + PRIOR_WEIGHT))

    domains = _sums(seen.where("_domain is not null"), ["_domain"], n).select(
        F.col("_domain").alias("d"), smoothed(F.col("sums"), F.col("n"), shares).alias("of_domain")
    )
    hosts = _sums(seen.where("_host is not null"), ["_host", "_domain"], n)
    hosts = hosts.join(domains, F.col("_domain") == F.col("d"), "left").select(
        F.col("_host").alias("_of_h"),
        smoothed(F.col("sums"), F.col("n"), F.coalesce("of_domain", shares)).alias("_of_host"),
    )

    def evidence(column: str, alias: str) -> DataFrame:
        """log P(value | language) up to a constant for each language: Bayes' rule on the sums, smoothed."""
        of = _sums(seen.where(F.col(column).isNotNull()), [column], n)
        return of.select(
            F.col(column).alias(f"_k{column}"),
            F.zip_with(F.col("sums"), shares, lambda s, a: F.log((s + a) / (F.col("n") + 1.0) / a)).alias(alias),
        )

    hosts, by_declared, by_suffix = (
        staged(hosts, "langid-hosts"),
        staged(evidence("_declared", "_e_declared"), "langid-declared"),
        staged(evidence("_suffix", "_e_suffix"), "langid-suffix"),
    )
    joined = (
        # rows without a host meet none, and not all in one task
        told.join(hosts, F.coalesce("_host", F.concat(F.lit("\n"), F.xxhash64("_score").cast("string"))) == F.col("_of_h"), "left")
        .join(by_declared, F.col("_declared") == F.col("_k_declared"), "left")
        .join(by_suffix, F.col("_suffix") == F.col("_k_suffix"), "left")
    )
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("_of_host", shares), lambda p: F.log(p))
    fused = add(add(F.col("_score"), prior), add(F.coalesce("_e_declared", none), F.coalesce("_e_suffix", none)))
    out = joined.withColumn("_posterior", _softmax(fused)).withColumn("confidence", F.array_max("_posterior"))
    return out.select(
        *(F.col(c) for c in kept if c not in ("language", "confidence", "text_language", "accepted")),
        F.element_at(names, F.array_position("_posterior", F.col("confidence")).cast("int")).alias("language"),
        "confidence",
        F.when(F.col("_n") > 0, F.element_at(names, F.array_position("_score", F.array_max("_score")).cast("int"))).alias("text_language"),
        (F.col("_known") & (F.col("confidence") >= LEAST_CONFIDENCE)).alias("accepted"),
    )
