"""Quality rules: repetition and length rules, and a hashed n-gram log-likelihood ratio (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stored

#: Hash buckets of the two multinomials; the table of ratios has this many doubles (512 KB).
BUCKETS = 1 << 16
#: Counts of the raw distribution that the target one is smoothed with: without evidence a ratio is near 0.
PRIOR = 1 << 16
#: A kept document's ratio lies at most so many standard deviations below the mean of trusted documents.
DEVIATIONS = 4.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though the body's lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of a text's words and pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.when(F.size(w) > 1, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(w: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more, first ones included."""

    def cover(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ranked: Column) -> Column:
        twice = F.filter(ranked, lambda x, i: (x["h"] == F.get(ranked, i + 1)["h"]).eqNullSafe(True) | ((i > 0) & (x["h"] == F.get(ranked, i - 1)["h"])).eqNullSafe(True))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def windows(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ranked, lambda r: let(places(r), cover)))

    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))
    return F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(let(hashes, windows))


def _halves(trusted: DataFrame, id_col: str) -> DataFrame:
    """(_id, _half) of all trusted ids; a hash deals them into two halves.

    Spark chooses the join by their size: few ids are sent to all tasks, many are joined by a shuffle."""
    ids = trusted.select(F.col(id_col).cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    return ids.withColumn("_half", F.pmod(F.xxhash64("_id"), F.lit(2)))


def ratio_table(docs: DataFrame, halves: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One row (first, second, both): for every bucket the log ratio of target to raw frequency, up to a constant, with each
    half of the trusted documents as target, and their mean.

    The raw multinomial counts every document.  The target ones are smoothed by ``PRIOR`` counts of the raw one, so that
    a bucket without evidence has the ratio 0, however few documents are trusted."""
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    rows = rows.join(halves, F.col("_doc") == F.col("_id"), "left").select("_half", words(F.col("_text")).alias("_w")).select("_half", F.explode(let(F.col("_w"), lambda w: ngram_buckets(w, buckets))).alias("b"))
    seen = rows.groupBy("b").agg(F.count("*").alias("raw"), F.count_if(F.col("_half") == 0).alias("t0"), F.count_if(F.col("_half") == 1).alias("t1"))
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    counted = all_buckets.join(seen, "b", "left").select("b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "t0", "t1")))
    packed = counted.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "t0", "t1"))).alias("x"), F.sum("raw").alias("r"))

    def ratio(name: str) -> Column:
        return F.transform("x", lambda c: F.log1p(c[name] * (F.col("r") + buckets) / (PRIOR * (c["raw"] + 1))))

    halves_of = packed.select(ratio("t0").alias("first"), ratio("t1").alias("second"))
    return halves_of.withColumn("both", F.zip_with("first", "second", lambda a, b: (a + b) / 2))


def derived_threshold(docs: DataFrame, halves: DataFrame, table: DataFrame, id_col: str, text_col: str, buckets: int, base: Column, deviations: float) -> DataFrame:
    """One row: the least ratio of a kept document.

    Each trusted document that passes the ``base`` rules is scored by the half that it isn't in, as any other document
    would be; the threshold lies ``deviations`` standard deviations below their mean.  Null without such documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text")).join(halves, F.col("_doc") == F.col("_id"))
    # A generator of one row: else the filter would split the text anew for each use of its words.
    rows = rows.select("_half", F.inline(F.array(F.struct(words(F.col("text")).alias("w")))))
    rows = rows.where(base).select("_half", let(F.col("w"), lambda w: ngram_buckets(w, buckets)).alias("grams")).where(F.size("grams") > 0)
    other = rows.withColumn("table", F.when(F.col("_half") == 0, table.select("second").scalar()).otherwise(table.select("first").scalar()))
    score = F.aggregate("grams", F.lit(0.0), lambda a, x: a + F.get("table", x)) / F.size("grams")
    return other.select(score.alias("s")).agg((F.mean("s") - deviations * F.stddev_pop("s")).alias("threshold"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, deviations: float = DEVIATIONS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """All rows of ``docs`` with the measures, the score and the verdict of the quality rules.

    Measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.  base_failed: fewer than ``min_words`` words,
    or repeated 3-word windows over ``max_repeat_percent`` of the words.  llr: mean over the text's words and word pairs
    of the log ratio between hashed multinomials of trusted documents and of the whole corpus.  kept: not base_failed and
    llr at least a threshold that the trusted documents' own ratios give (``derived_threshold``), the same for all.

    ``trusted`` holds ids of trusted documents.  The fewer they are, the nearer to 0 are all ratios and the wider, beside
    them, the margin: little evidence rejects nothing.  Without any (an empty table), the base rules alone decide.  Null or empty text: no words, llr 0, base_failed.  Ids may be null or repeated; each row is judged by
    itself.  The input's columns are returned unchanged under ``doc``.
    """
    halves = stored(_halves(trusted, id_col), "halves")
    tables = stored(ratio_table(docs, halves, id_col, text_col, buckets), "ratios")
    passes = (F.size("w") >= min_words) & (100 * repeat_words(F.col("w")) <= max_repeat_percent * F.size("w"))
    threshold = derived_threshold(docs, halves, tables, id_col, text_col, buckets, passes, deviations).scalar()
    table = tables.select("both").scalar()
    text = F.col(f"doc.{text_col}")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("w", words(text))
    df = df.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        let(F.col("w"), lambda w: ngram_buckets(w, buckets)).alias("grams"),
    )
    # The table is a scalar subquery: computed once, and read in place by the aggregate below.
    total = F.aggregate("grams", F.lit(0.0), lambda a, x: a + F.get("table", x))
    df = df.withColumn("table", table)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # A generator of one row keeps later filters on the measures from copying these expressions below themselves.
    once = F.struct(*measures, total.alias("total"), F.size("grams").alias("n_grams"))
    df = df.select("doc", F.inline(F.array(once)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("llr", F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True))).drop("total", "n_grams")
