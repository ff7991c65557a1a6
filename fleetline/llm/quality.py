"""Quality rules by distribution divergence.

Every document gets two histograms: character classes, and the common words of
its language (with one bin for all other words).  References are the pooled
histograms of each language, counted over all documents.  The verdict compares
a document with its language's reference by Jensen-Shannon distance (base 2, so
0 to 1); a document shorter than a guard is not judged by that histogram.  The
base rules (word count, repeated three-word windows) are computed beside it.

Everything is one narrow pass of built-in expressions over the texts; only the
small histogram rows are checkpointed, summed per language and joined back.

Defined results: a null or empty text has no words and fails the base rule; a
null lang is a language of its own; lines and windows are counted within one
document only, so repeated rows do not matter; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, checkpointed

# Words that any text of the language repeats.
COMMON_WORDS = {
    "en": "the of and to a in that is was he for it with as his on be at by i this had not are but from or have an they",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
# Character classes: all but the first and last count in what is left when lower-case ASCII letters are cut out.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "space": r"[^ \x09-\x0D]+", "mark": r"[^.,;:!?'\"()-]+",
           "symbol": r"[^#*$%&|<>]+", "beyond_ascii": r"[\x00-\x7F]+"}

CHAR_DISTANCE = 0.30
WORD_DISTANCE = 0.55
MIN_CHARS = 200
MIN_WORDS = 50


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[ \x09-\x0D]+|[ \x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+"))


def with_repeated_window_words(d: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the count of words inside three-word windows that the text has
    twice or more.  A window is one long: the upper bits of its 64-bit hash,
    and its place in the lower bits (as many as the text needs), so one sort
    of longs makes equal windows neighbours; their words are then compared."""
    d = d.withColumn("_bits", F.ceil(F.log2(F.size(words) + 2)).cast("int"))
    w, bits = F.col(words), F.col("_bits")
    up = lambda x: F.call_function("shiftright", x, bits)
    window = lambda i: F.call_function("shiftleft", up(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), bits) + i
    d = d.withColumn("_s", F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))))
    s = F.col("_s")
    place = lambda i: (F.get(s, i) - F.call_function("shiftleft", up(F.get(s, i)), bits)).cast("int")
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    d = d.withColumn("_two", F.when(F.size(s) < 2, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(F.lit(0), F.size(s) - 2),
        lambda i: (up(F.get(s, i)) == up(F.get(s, i + 1))) & same(place(i), place(i + 1)))))
    covered = F.flatten(F.transform("_two", lambda i: F.array(
        *[place(i + a) + b for a in (0, 1) for b in (0, 1, 2)])))
    return d.withColumn(out, F.size(F.array_distinct(covered)).cast("long")).drop("_bits", "_s", "_two")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^ \x09-\x0D]")))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def word_histogram(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words.  Each
    common word found becomes one letter, and the letters are counted."""
    def of(listed: list[str]) -> Column:
        listed = list(dict.fromkeys(listed))
        names = F.array(*[F.lit(w) for w in listed])
        found = F.filter(F.transform(words, F.lower), lambda w: w.isin(listed))
        line = F.array_join(F.transform(found, lambda w: F.chr(F.array_position(names, w) + 64)), "")
        return bind(line, lambda x: F.array(
            *[F.length(x) - F.length(F.replace(x, F.lit(chr(65 + i)), F.lit(""))) for i in range(len(listed))],
            F.size(words) - F.length(x)))

    out = None
    for code, text in COMMON_WORDS.items():
        out = (F if out is None else out).when(lang == code, of(text.split()))
    return out


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if one
    of them is null or has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)

    def of(pair: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            m = (a + b) / 2
            return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)
        parts = F.zip_with(pair["p"], pair["q"], lambda a, b: term(a / pair["np"], b / pair["nq"]))
        return F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0)))

    asdouble = lambda x: F.transform(x, lambda y: y.cast("double"))
    return bind(F.struct(asdouble(p).alias("p"), asdouble(q).alias("q"), total(p).alias("np"), total(q).alias("nq")),
                lambda s: F.when((s["np"] > 0) & (s["nq"] > 0), of(s)))


def quality_features(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base counts and both histograms."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", words_of(F.col("text")).alias("words"), F.length("text").alias("n"),
                 duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
                 F.regexp_replace("text", "[a-z]+", "").alias("rest"))
    d = with_repeated_window_words(d, "words", "n_repeat_words")
    counts = {k: F.length(F.regexp_replace("rest", F.lit(p), F.lit(""))) for k, p in CLASSES.items()}
    d = d.select("doc_id", "lang", "n", "n_dup_lines", "n_repeat_words", F.size("words").cast("long").alias("n_words"),
                 word_histogram(F.col("words"), F.col("lang")).alias("common"),
                 F.struct((F.col("n") - F.length("rest")).alias("lower"), *[c.alias(k) for k, c in counts.items()]).alias("c"))
    known = F.aggregate(F.array(*[f"c.{k}" for k in ("lower", *CLASSES)]), F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "lang", "n_words", (F.col("n") - F.col("c.space")).cast("long").alias("word_chars"),
                    F.col("c.symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "common",
                    F.array(*[f"c.{k}" for k in ("lower", *CLASSES)], F.col("n") - known).alias("classes"))


def language_references(features: DataFrame) -> DataFrame:
    """Pooled histograms per language, summed over all documents."""
    bins = len(CLASSES) + 2
    words = max(len(set(x.split())) for x in COMMON_WORDS.values()) + 1
    sums = [F.sum(F.get("classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(bins)] + [
        F.sum(F.get("common", F.lit(i)).cast("long")).alias(f"w{i}") for i in range(words)]
    # numbers of a list shorter than the longest stay null and are cut off again
    return features.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"), F.array(*[f"c{i}" for i in range(bins)]).alias("ref_classes"),
        F.filter(F.array(*[f"w{i}" for i in range(words)]), F.isnotnull).alias("ref_common"))


def quality_rules(docs: DataFrame, char_distance: float = CHAR_DISTANCE, word_distance: float = WORD_DISTANCE,
                  min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: base counts, ``base_failed``, both distances (null where
    the guard or the language leaves a histogram unjudged) and ``kept``."""
    f = checkpointed(quality_features(docs))
    j = f.join(language_references(f), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    j = j.withColumn("char_js", F.when(F.col("word_chars") >= min_chars, divergence(F.col("classes"), F.col("ref_classes")))) \
        .withColumn("word_js", F.when(F.col("n_words") >= min_words, divergence(F.col("common"), F.col("ref_common")))) \
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.coalesce("char_js", F.lit(0.0)) > char_distance) | (F.coalesce("word_js", F.lit(0.0)) > word_distance)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~far).alias("kept"), "char_js", "word_js")
