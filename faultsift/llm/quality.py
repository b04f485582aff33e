"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and its histogram of its language's common words are
compared with those of all documents of that language that pass the base rules, by the Jensen-Shannon distance (the root of
the divergence to base 2, from 0 to 1). Short documents are not judged: their histograms are noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import staged, text_of

#: Parameters: common words whose shares describe a language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf".split(),
    "en": "the of and to in a is that it for was with".split(),
    "es": "de la que el en y los se del las un por".split(),
    "fr": "de la le et les des en un que est pour dans".split(),
}
SYMBOLS = "#*$%&|<>"
#: Different repeated windows that are looked up one by one; more are found by sorting.
FEW = 64
WHITE = " \t\n\x0b\x0c\r"
#: Fixed values of the base rules: fewest words, and most words in repeated windows (per cent).
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Documents with fewer characters or words are not compared.
LEAST_CHARS = 400
LEAST_COMPARED_WORDS = 100
MOST_CHAR_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.285


def _counts(words: Column, language: str) -> list[Column]:
    """How often each common word occurs; words stand between double spaces, so that no two share one."""
    return [
        ((F.length(words) - F.length(F.replace(words, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in COMMON[language]
    ]


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either sums to zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x: F.transform(x, lambda v: F.try_divide(v, total(x)))
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(share(a), share(b), lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2)
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))))


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """keep (id_col by default), _lang, and the counts and histograms of each text."""
    kept = [id_col] if keep is None else keep
    t = docs.select(*kept, F.when(F.col(language).isin(list(COMMON)), F.col(language)).otherwise("*").alias("_lang"), text_of(text).alias("_t"))
    t = t.withColumn("_words", F.array_remove(F.split("_t", r"[ \t-\r]+"), "")).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(F.translate(x, WHITE, " " * len(WHITE)))) > 0)
    # what is neither a small letter nor a space is a small part of most texts
    t = (
        t.withColumn("_lines", lines)
        .withColumn("_rare", F.regexp_replace("_t", r"[\p{Ll} \t-\r]+", ""))
        .withColumn("_windows", _windows())
    )
    t = t.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array("_windows")).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, i: (i > 0) & (F.get("_sorted", i - 1) == h))))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("_pairs", F.when(F.size("_twice") > FEW, pairs)).withColumn("_places", _places())
    covered = F.array_distinct(F.flatten(F.transform("_places", lambda i: F.array(i, i + 1, i + 2))))
    listed = sorted({v for ws in COMMON.values() for w in ws for v in (w, w.capitalize(), w.upper())})
    common = F.array_join(F.filter("_words", lambda w: w.isin(listed)), "  ")
    t = t.withColumn("_joined", F.concat(F.lit(" "), F.lower(common), F.lit(" ")))
    symbols = F.col("_rare")
    for s in SYMBOLS:
        symbols = F.replace(symbols, F.lit(s), F.lit(""))
    t = t.select(
        *kept,
        "_lang",
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_rare") - F.length(symbols)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.length("_t").cast("long").alias("_chars"),
        F.regexp_count("_rare", F.lit(r"\p{Lu}")).cast("long").alias("_upper"),
        F.regexp_count("_rare", F.lit(r"\p{Nd}")).cast("long").alias("_digits"),
        F.regexp_count("_rare", F.lit(r"[.,;:!?'\"()\-]")).cast("long").alias("_points"),
        _words_of("_joined").alias("_common"),
    )
    other = F.col("word_chars") - F.col("_upper") - F.col("_digits") - F.col("_points") - F.col("n_symbols")
    classes = (F.greatest(other, F.lit(0)), F.col("_upper"), F.col("_digits"), F.col("_points"), F.col("n_symbols"), F.col("_chars") - F.col("word_chars"))
    found = F.transform("_common", lambda x: x.cast("double"))
    rest = F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("_found", F.lit(0.0), lambda a, x: a + x))
    return (
        t.withColumn("_classes", F.array(*(c.cast("double") for c in classes)))
        .withColumn("_found", found)
        .withColumn("_histogram", F.concat("_found", F.array(rest)))
        .drop("_upper", "_digits", "_points", "_common", "_found")
    )


def _windows() -> Column:
    """A 64-bit hash of each three consecutive words."""
    at = lambda i: F.get("_words", i)
    hashed = F.transform("_words", lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2)))
    return F.when(F.col("n_words") >= 3, F.slice(hashed, F.lit(1), F.size("_words") - 2)).otherwise(F.array().cast("array<bigint>"))


def _places() -> Column:
    """Where the windows stand that occur twice: by lookup if there are few different ones, else by sorting."""
    few = F.filter(
        F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull()
    )
    twin = lambda x, i: F.coalesce(F.get("_pairs", i)["h"] == x["h"], F.lit(False))
    many = F.transform(F.filter("_pairs", lambda x, i: ((i > 0) & twin(x, i - 1)) | twin(x, i + 1)), lambda x: x["i"])
    none = F.array().cast("array<int>")
    return F.when(F.size("_twice") == 0, none).when(F.size("_twice") <= FEW, few).otherwise(many)


def _words_of(joined: str) -> Column:
    size = len(next(iter(COMMON.values())))
    out = F.when(F.lit(False), F.array(*[F.lit(0).cast("long")] * size))
    for lang in COMMON:
        out = out.when(F.col("_lang") == lang, F.array(*_counts(F.col(joined), lang)))
    return out.otherwise(F.array(*[F.lit(0).cast("long")] * size))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """keep (id_col by default) with the base counts, base_failed, char_distance, word_distance and kept.

    A null text has no words and fails. A language that is null or has no common words listed shares
    one reference, and is compared by character classes only. Distances of documents too short to
    compare are null and count as passed, as are those of a language without a reference. The references are
    the sums over all documents of a language that pass the base rules; an empty table gives an empty result.
    """
    kept = [id_col] if keep is None else keep
    t = staged(features(docs, id_col, text, language, kept), "quality")
    n, m = 6, len(next(iter(COMMON.values()))) + 1
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    sums = t.where(~failed).groupBy("_lang").agg(
        F.array(*(F.sum(F.col("_classes")[i]) for i in range(n))).alias("_all_classes"),
        F.array(*(F.sum(F.col("_histogram")[i]) for i in range(m))).alias("_all_histogram"),
    )
    # one row for each listed language and one for the rest
    t = t.join(F.broadcast(sums), "_lang", "left")
    char = F.when(F.col("_chars") >= LEAST_CHARS, js_distance(F.col("_classes"), F.col("_all_classes")))
    word = F.when((F.col("_lang") != "*") & (F.col("n_words") >= LEAST_COMPARED_WORDS), js_distance(F.col("_histogram"), F.col("_all_histogram")))
    t = t.withColumn("char_distance", char).withColumn("word_distance", word).withColumn("base_failed", failed)
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return t.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance",
        (~F.col("base_failed") & fits).alias("kept"),
    )
