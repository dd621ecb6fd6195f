"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of its language by the
Jensen-Shannon distance.  The references are sums over all documents of a language that pass the base rules and have few symbols.  Short texts
have noisy histograms, so each distance only counts from a minimum length on.  Odd characters alone reject a text, and so do
both histograms together when each is only somewhat odd, as in lists of words.  Everything is built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import written
from starfold.llm.common import SPACES, checkpoint, join_small

# Marks of the base rule, and frequent function words of English, German, French and Spanish.
SYMBOLS = "#*$%&|<>"
COMMON = sorted({
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "with",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "des", "ist", "nicht", "ein",
    "le", "la", "les", "de", "et", "un", "une", "en", "que", "qui", "du", "pour",
    "el", "los", "las", "y", "por", "con", "una", "del", "se", "su",
})
# Character classes that are counted by a pattern; blanks, wide characters and the rest follow from lengths.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "point": r"[.,;:!?'\"()\-]"}

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
GUARD_CHARS, GUARD_WORDS = 200, 100  # shorter texts are not judged by that histogram
MAX_CLASS_DISTANCE, MAX_SUM = 0.34, 0.44  # of the class distance alone, and of both distances together
REFERENCE_WORDS_PER_SYMBOL = 20  # texts with more symbols stay out of the references
REFERENCE_WORDS = 2_000  # languages with fewer words have no reference of their own


def split_words(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x09-\x0D\x20]+"))


def joined_hash(hashes: Column, n: Column, step: int) -> Column:
    """Hash of elements ``i`` and ``i + step``; ``n`` is the size of ``hashes``."""
    m = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, m), F.slice(hashes, F.lit(step + 1), m), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """Add the base counts to a frame with a non-null text column ``text``; helper columns start with ``__``."""
    t = F.col(text)
    d = docs.withColumn("__words", split_words(t))
    d = d.withColumns({"__hash": F.transform("__words", lambda w: F.xxhash64(w)), "n_words": F.size("__words").cast("long")})
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumns({
        "word_chars": F.char_length(F.concat_ws("", "__words")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__lines": lines, "__size": F.size("__hash"),
    })
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    for step in (1, 2, 4):  # runs of 2, 4 and 8 words
        d = d.withColumn("__hash", joined_hash(F.col("__hash"), F.col("__size"), step)).withColumn("__size", F.size("__hash"))
    # sort (hash, place) only where a run comes twice; neighbours with equal hashes are the repeated runs
    repeated = F.size(F.array_distinct("__hash")) < F.col("__size")
    d = d.withColumn("__runs", F.when(repeated, F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    runs = F.col("__runs")
    twice = F.filter(runs, lambda x, i: (F.get(runs, i - 1)["h"] == x["h"]) | (F.get(runs, i + 1)["h"] == x["h"]))
    d = d.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with("__places", F.slice("__places", F.lit(2), F.size("__places")), lambda a, b: F.least(F.lit(WINDOW), b - a))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def class_counts(text: Column, word_chars: Column, n_symbols: Column) -> list[Column]:
    """Characters by class: upper, digit, point, symbol, blank, wide (bytes beyond the first), rest."""
    found = [F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()]
    blank = F.char_length(text) - word_chars
    wide = F.octet_length(text) - F.char_length(text)
    return [*found, n_symbols, blank.cast("long"), wide.cast("long")]


def common_words(words: Column) -> Column:
    """The common words among ``words``, lower case, sorted."""
    return F.sort_array(F.transform(F.filter(words, lambda w: F.lower(w).isin(COMMON)), lambda w: F.lower(w)))


def counted(hits: str, distinct: str) -> Column:
    """``(w, c)`` of each distinct value of a sorted array column: the distance of its first place to the next one's."""
    first = F.transform(distinct, lambda w: F.array_position(hits, w))
    after = F.concat(F.slice(first, F.lit(2), F.size(distinct)), F.array(F.size(hits).cast("long") + 1))
    sizes = F.slice(F.zip_with(first, after, lambda a, b: b - a), F.lit(1), F.size(distinct))  # none for an empty array
    return F.zip_with(F.col(distinct), sizes, lambda w, c: F.struct(w.alias("w"), c.alias("c")))


def divergence(p: Column, q: Column) -> Column:
    """One bin's part of twice the Jensen-Shannon divergence, in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return part(p) + part(q)


def distance(twice: Column) -> Column:
    """Jensen-Shannon distance from twice the divergence, 0 to 1."""
    return F.round(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), twice / 2))), 9)


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, text hash, base counts and both histograms of every whole text, in the checkpoint folder; null texts count as empty.

    With ``whole`` the document itself goes along as ``__row``, in a table by columns: what is judged reads the features alone,
    and the documents that stay need no join with their texts.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("__row")] if whole else []
    d = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), F.xxhash64("text").alias("text_hash"), *row)
    d = base_counts(d, "__text")
    t = F.col("__text")
    counts = class_counts(t, F.col("word_chars"), F.col("n_symbols"))
    d = d.withColumns({"n_chars": F.char_length(t).cast("long"), "__found": F.array(*counts)})
    total = F.col("word_chars") + reduce(lambda a, b: a + b, [F.get("__found", F.lit(k)) for k in (4, 5)])
    rest = total - reduce(lambda a, b: a + b, [F.get("__found", F.lit(k)) for k in range(6)])
    d = d.withColumn("classes", F.concat("__found", F.array(rest))).withColumn("__hits", common_words(F.col("__words")))
    d = d.withColumn("__kinds", F.array_distinct("__hits")).withColumn("common", counted("__hits", "__kinds"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = written if whole else checkpoint
    return keep(d.select("doc_id", "lang", "text_hash", "n_chars", *base, "classes", "common", *(["__row"] if whole else [])))


def references(found: DataFrame) -> tuple[DataFrame, int]:
    """Histograms of each language from all its documents that pass the base rules and have few symbols; the null language stands for all documents."""
    good = found.where(~F.col("base_failed") & (REFERENCE_WORDS_PER_SYMBOL * F.col("n_symbols") <= F.col("n_words")))
    n = len(CLASSES) + 4
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n)]
    # two groupings instead of one over doubled rows: both combine before the shuffle
    whole = good.agg(F.sum("n_words").alias("r_words"), *sums).select(F.lit(None).cast("string").alias("r_lang"), "*")
    each = good.where("lang is not null").groupBy(F.col("lang").alias("r_lang")).agg(F.sum("n_words").alias("r_words"), *sums)
    rows = each.where(F.col("r_words") >= REFERENCE_WORDS).unionByName(whole.where("r_words > 0"))
    words = good.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.w").agg(F.sum("x.c").alias("c"))
    words = words.where("lang is not null").unionByName(words.groupBy("w").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("lang"), "w", "c"))
    # at most as many words per language as the fixed list has
    maps = words.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("r_common")).withColumnRenamed("lang", "__l")
    rows = rows.join(maps, F.col("r_lang").eqNullSafe(F.col("__l")), "left").drop("__l")
    out = checkpoint(rows.select("r_lang", "r_words", F.array(*[f"c{k}" for k in range(n)]).alias("r_classes"), F.coalesce("r_common", F.create_map().cast("map<string,bigint>")).alias("r_common")))
    return out, out.count()


def distances(words: Column, classes: Column, common: Column) -> Column:
    """``(class_distance, word_distance)`` of a document to a reference; reads the columns that ``judged`` adds to the features."""
    share = lambda a, k, total: F.get(a, F.lit(k)) / total
    n_classes = len(CLASSES) + 4
    all_ref = F.greatest(reduce(lambda a, b: a + b, [F.get(classes, F.lit(k)) for k in range(n_classes)]), F.lit(1))
    twice = reduce(lambda a, b: a + b, [divergence(share(F.col("classes"), k, F.col("__own")), share(classes, k, all_ref)) for k in range(n_classes)])

    # words outside the list share one bin; bins that only the reference has add their whole share
    n_own, n_ref = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(words, F.lit(1))
    zero = F.lit(0.0)
    q_of = lambda w: F.coalesce(F.try_element_at(common, w), F.lit(0)) / n_ref
    seen = F.aggregate("common", zero, lambda s, x: s + divergence(x["c"] / n_own, q_of(x["w"])) - q_of(x["w"]))
    q_in = F.aggregate(F.map_values(common), zero, lambda s, c: s + c / n_ref)
    both = seen + q_in + divergence(1 - F.col("__p_in"), 1 - q_in)
    return F.struct(
        F.when(classes.isNotNull() & (F.col("n_chars") >= GUARD_CHARS), distance(twice)).alias("class_distance"),
        F.when(common.isNotNull() & (F.col("n_words") >= GUARD_WORDS), distance(both)).alias("word_distance"),
    )


def nearby(found: Column) -> Column:
    """Whether a pair of distances is within the bounds; a missing distance decides nothing."""
    zero = F.lit(0.0)
    return (F.coalesce(found["class_distance"], zero) <= MAX_CLASS_DISTANCE) & (F.coalesce(found["class_distance"] + found["word_distance"], zero) <= MAX_SUM)


def judged(found: DataFrame) -> DataFrame:
    """Features with class_distance, word_distance and ``kept``.  Without any reference nothing but the base rules decides."""
    refs, n = references(found)
    all_own = reduce(lambda a, b: a + b, [F.get("classes", F.lit(k)) for k in range(len(CLASSES) + 4)])
    p_in = F.aggregate("common", F.lit(0.0), lambda s, x: s + x["c"] / F.greatest(F.col("n_words"), F.lit(1)))
    found = found.withColumns({"__own": F.greatest(all_own, F.lit(1)), "__p_in": p_in})
    named = refs.where("r_lang is not null")
    same = found["lang"] == named["r_lang"]
    own = join_small(found, named, n, same).withColumn("__d", distances(F.col("r_words"), F.col("r_classes"), F.col("r_common")))

    # without a reference of its own: the nearest language, and all languages together only if there is none; one row of references
    each = F.struct("r_words", "r_classes", "r_common")
    lists = refs.agg(F.collect_list(F.when(F.col("r_lang").isNotNull(), each)).alias("__named"), F.collect_list(F.when(F.col("r_lang").isNull(), each)).alias("__mixed"))
    lists = lists.select(F.when(F.size("__named") > 0, F.col("__named")).otherwise(F.col("__mixed")).alias("__refs"))
    other = join_small(found, named, n, same, "left_anti").join(F.broadcast(lists), how="left")
    other = other.withColumn("__all", F.transform("__refs", lambda r: distances(r["r_words"], r["r_classes"], r["r_common"])))
    total = lambda x: F.coalesce(x["class_distance"], F.lit(0.0)) + F.coalesce(x["word_distance"], F.lit(0.0))
    best = F.array_min(F.transform("__all", lambda x: F.struct((~nearby(x)).alias("far"), total(x).alias("sum"), x.alias("d"))))
    other = other.withColumn("__d", best["d"])

    d = own.select(*found.columns, "__d").unionByName(other.select(*found.columns, "__d"))
    d = d.withColumns({"class_distance": F.col("__d")["class_distance"], "word_distance": F.col("__d")["word_distance"]})
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(nearby(F.col("__d")), F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, base counts, base_failed, class_distance, word_distance, kept.

    Null and empty texts have no words and fail the base rules.  A document without a language, or of a language with few
    words, is compared with the references of all languages and has the distances of the nearest; only without any such
    reference it is compared with all languages together.  Distances are null below the length guards and then decide nothing.
    Repeated rows are judged alike.  Columns other than doc_id, text and lang are not read.
    """
    return judged(features(docs)).select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns.  Texts are not shuffled."""
    kept = judged(features(docs, whole=True)).where("kept").select("__row")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
