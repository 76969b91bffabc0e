"""Quality rules by distribution divergence, in DataFrame expressions alone.

A document is held against references learned from the corpus: per language, the
shares of eight character classes, and the shares of the words that make up at
least half a percent of that language (at most 200, by that share). Both
histograms are compared by Jensen-Shannon distance (base 2, 0 to 1). A document
passes if one language accepts both; each histogram is only held against a text
long enough to fill it.

Counts of words and classes are summed per task before any shuffle. A reference
is kept for each language with a hundredth of all words, and for each with
``least_words`` words however small its share. A document whose own language has
fewer is held against the classes alone, since the words of other languages say
nothing about it. The largest ``INLINE`` references are constants of the
expressions; all others are one broadcast row, met by the documents that the
largest do not accept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.llm.common import SPACE

PLAIN = r"[a-z \n]+"  # most of a text, and of no class below
#: Each class is what a text keeps when the rest is taken out. Letters that are not capitals, and all else, are the remainder.
CLASSES = {
    "upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "mark": r"[^.,;:?'()\-]+", "cry": r"[^!]+",
    "quote": r"[^\"`~@^_=+/\\\[\]{}]+", "symbol": r"[^#*$%&|<>]+",
}
HISTOGRAM = ("space", *CLASSES, "rest")
INLINE = 16  # references that expressions carry as constants; the verdicts do not depend on it


@dataclass(frozen=True)
class Rules:
    """Limits of the two distances and the lengths from which they are used.

    A short text is far from any reference by chance, by about one over the root of
    its length, so its word limit is ``short_base + short_slope / sqrt(words)`` where
    that is the larger.
    """

    class_limit: float = 0.30
    word_limit: float = 0.255
    short_base: float = 0.17
    short_slope: float = 0.95
    class_chars: int = 200
    word_words: int = 50
    word_share: float = 0.005
    language_share: float = 0.01
    least_words: int = 10_000  # a word of half a percent is then seen 50 times


@dataclass(frozen=True)
class Reference:
    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]  # of the words, and of all others together
    n_words: int = 0


def _measured(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Words, and characters by class, of each row; a NULL text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"))
    rows = rows.select(*keep, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"), F.char_length("_t").alias("_n"))
    rows = rows.withColumn("_r", F.regexp_replace("_t", PLAIN, ""))
    sized = {name: F.char_length(F.regexp_replace("_r", rest, "")) for name, rest in CLASSES.items()}
    sized["space"] = F.col("_n") - F.char_length(F.array_join("_w", ""))
    rows = rows.select(*keep, "_t", "_w", "_n", *[c.cast("long").alias(f"_c_{k}") for k, c in sized.items()])
    others = sum((F.col(f"_c_{k}") for k in HISTOGRAM[:-1]), F.lit(0))
    return rows.withColumn("_c_rest", F.col("_n") - others)


def learn(docs: DataFrame, rules: Rules = Rules()) -> list[Reference]:
    """References of the languages named in column ``lang`` (NULL: not used), over all rows."""
    known = docs.filter("lang is not null")
    rows = _measured(known, ["lang"])
    sums = rows.groupBy("lang").agg(F.sum(F.size("_w")).alias("n"), *[F.sum(f"_c_{k}").alias(k) for k in HISTOGRAM])
    total = F.sum("n").over(_all())
    enough = (F.col("n") >= rules.language_share * F.col("_all")) | (F.col("n") >= rules.least_words)
    found = {r["lang"]: r for r in sums.withColumn("_all", total).filter((F.col("n") > 0) & enough).collect()}
    if not found:
        return []
    least = docs.sparkSession.createDataFrame([(k, float(rules.word_share * r["n"])) for k, r in found.items()], "lang string, _least double")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = known.join(F.broadcast(least.select("lang")), "lang", "left_semi").select("lang", F.explode(F.split(F.lower(text), SPACE)).alias("w"))
    common = words.filter("w <> ''").groupBy("lang", "w").count().join(F.broadcast(least), "lang").filter("count >= _least")
    lists: dict[str, list] = {k: [] for k in found}
    for r in common.collect():
        lists[r["lang"]].append((-r["count"], r["w"]))
    out = []
    for lang in sorted(found):
        row, top = found[lang], sorted(lists[lang])
        chars = max(1, sum(row[k] for k in HISTOGRAM))
        shares = [-n / row["n"] for n, _ in top]
        rest = max(0.0, 1 - sum(shares))
        out.append(Reference(lang, tuple(row[k] / chars for k in HISTOGRAM), tuple(w for _, w in top), (*shares, rest), row["n"]))
    return out


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over the sums of the languages


def distance(counts: Column, total: Column, shares: Sequence[float] | Column) -> Column:
    """Jensen-Shannon distance of an array of counts to fixed shares; 1 if ``total`` is 0."""

    def term(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    fixed = shares if isinstance(shares, Column) else F.array(*[F.lit(float(s)) for s in shares])
    terms = F.zip_with(counts, fixed, term)
    sum_ = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(sum_ / 2, F.lit(0.0)))).otherwise(1.0)


def _base(rows: DataFrame) -> DataFrame:
    """The base counts. Windows are compared by a 64-bit hash of their three words."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    steps = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(F.col("_w"), i)
    window = F.transform(steps, lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("p")))
    rows = rows.withColumn("_z", F.sort_array(window))
    near = lambda x, i: (F.get(F.col("_z"), i + 1)["h"] == x["h"]) | (F.get(F.col("_z"), i - 1)["h"] == x["h"])
    rows = rows.withColumn("_again", F.transform(F.filter("_z", near), lambda x: x["p"])).drop("_z")
    covered = F.flatten(F.transform("_again", lambda p: F.array(p, p + 1, p + 2)))
    return rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.col("_n") - F.col("_c_space"),
            "n_symbols": F.col("_c_symbol"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
        }
    ).drop("_lines", "_again")


def _one_row(spark: SparkSession, references: Sequence[Reference]) -> DataFrame:
    """One row with the array ``_others`` of all ``references``."""
    fields = "struct<lang:string,classes:array<double>,words:array<string>,shares:array<double>>"
    packed = [(r.lang, [float(x) for x in r.classes], list(r.words), [float(x) for x in r.shares]) for r in references]
    return spark.createDataFrame([(packed,)], f"_others array<{fields}>")


def _pair(r: Column) -> dict[str, Column]:
    """Both distances of a row to a reference of ``_one_row``; only words the two share are counted."""
    shared = F.array_intersect(r["words"], "_lower")
    here = F.filter("_lower", lambda x: F.array_contains(shared, x))
    own = F.transform(r["words"], lambda w: F.size(F.filter(here, lambda x: x == w)).cast("long"))
    rest = F.col("n_words") - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    by_word = distance(F.concat(own, F.array(rest)), F.col("n_words"), r["shares"])
    return {"c": distance(F.col("_classes"), F.col("_n"), r["classes"]), "w": by_word}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, references: list[Reference], rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept`` per row.

    The distances are those to the nearest language. A NULL or empty text has no
    words and fails the base rules. Without references (no row with a language) the
    distances are NULL and the base rules decide. A row with a ``lang`` that has no
    reference passes if the classes of any reference accept it. Rows with a NULL or
    repeated id are judged like any others; columns beyond doc_id, text and lang are
    ignored, and without lang all rows count as of unknown language.
    """
    references = sorted(references, key=lambda r: (-r.n_words, r.lang))
    references, others = references[:INLINE], references[INLINE:]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = _base(_measured(docs.withColumn("_lang", lang), ["doc_id", "_lang"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    every = sorted({w for r in references for w in r.words})
    if every:
        # Every word is there once more, so the runs of the sorted array are the words in order.
        common = F.filter(F.transform("_w", lambda x: F.lower(x)), lambda x: x.isin(*every))
        rows = rows.withColumn("_common", F.sort_array(F.concat(F.array(*[F.lit(w) for w in every]), common)))
        first = lambda i: (i == 0) | (F.get(F.col("_common"), i) != F.get(F.col("_common"), i - 1))
        rows = rows.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_common") - 1), first))
        until = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_common"))
        rows = rows.withColumn("_counts", F.transform("_starts", lambda i, k: until(k) - i - 1)).drop("_common", "_starts")
    rows = rows.drop("_t", *([] if others else ["_w"]))
    classes = F.array(*[F.col(f"_c_{k}") for k in HISTOGRAM])
    rows = rows.withColumn("_classes", classes)
    place = {w: i for i, w in enumerate(every)}
    pairs = []
    for r in references:
        own = F.array(*[F.get(F.col("_counts"), F.lit(place[w])) for w in r.words]) if r.words else F.array().cast("array<int>")
        rest = F.col("n_words") - F.aggregate(own, F.lit(0), lambda a, x: a + x)
        by_word = distance(F.concat(own.cast("array<bigint>"), F.array(rest)), F.col("n_words"), r.shares)
        pairs.append(F.struct(distance(F.col("_classes"), F.col("_n"), r.classes).alias("c"), by_word.alias("w")))
    if pairs:
        rows = rows.withColumn("_pairs", F.array(*pairs))

        def class_accepts(x: Column) -> Column:
            return (F.col("_n") < rules.class_chars) | (x["c"] <= rules.class_limit)

        def accepts(x: Column) -> Column:
            limit = F.greatest(F.lit(rules.word_limit), rules.short_base + rules.short_slope / F.sqrt("n_words"))
            return class_accepts(x) & ((F.col("n_words") < rules.word_words) | (x["w"] <= limit))

        nearest = lambda k: F.array_min(F.transform("_pairs", lambda x: x[k]))
        fine, by_class, by_word = F.exists("_pairs", accepts), nearest("c"), nearest("w")
        known = F.col("_lang").isNull() | F.col("_lang").isin(*[r.lang for r in references])
        alien = F.exists("_pairs", class_accepts)
        if others:
            rows = rows.crossJoin(F.broadcast(_one_row(docs.sparkSession, others))).withColumn("_lower", F.transform("_w", F.lower))
            own = F.filter("_others", lambda r: r["lang"] == F.col("_lang"))
            known = known | F.exists("_others", lambda r: r["lang"] == F.col("_lang"))
            # Most documents end here before the other languages are asked, their own first.
            passes = lambda r: accepts(_pair(r))
            fine = fine | (~failed & (F.exists(own, passes) | F.exists("_others", passes)))
            alien = alien | F.exists("_others", lambda r: class_accepts(_pair(r)))
            by_class = F.least(by_class, F.array_min(F.transform("_others", lambda r: _pair(r)["c"])))
            by_word = F.least(by_word, F.array_min(F.transform("_others", lambda r: _pair(r)["w"])))
        rows = rows.withColumns({"_fine": fine | (~known & alien), "class_distance": by_class, "word_distance": by_word})
    else:
        rows = rows.withColumns({"_fine": F.lit(True), "class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    verdict = {"base_failed": failed, "kept": ~failed & F.col("_fine")}
    return rows.withColumns(verdict).select("doc_id", *BASE, "base_failed", "kept", "class_distance", "word_distance")
