"""Quality rules: plain base rules, then a hashed n-gram log-likelihood ratio between trusted text and the whole corpus.

Words and word pairs are hashed into ``buckets``.  A bucket's log ratio compares its count over the trusted documents
with the count expected from the whole corpus, both without the judged document's own words and with ``prior`` added, so
that a bucket tells more the more often it was to be seen, at any size of the corpus.  A document's score is the mean of
these over its words and pairs.  As its own words don't count, trusted and other documents are judged alike, and text
that occurs nowhere else scores zero.  Text whose n-grams are rarer in trusted documents than in the corpus scores below.

A document is kept when it passes the base rules and its score lies at most ``most_errors`` errors below the median of the
trusted documents' own scores.  The error is the document's own: of its mean, from the number and the spread of its terms,
and of what trusted documents differ by beyond that, from the distance of their median to their 16th percentile (so that
some wrong labels don't move it).  Little trusted text differs more, and long documents have smaller errors, so one limit
in these units serves every size.

Base rules: at least ``least_words`` words, and at most ``most_repeated`` percent of the words inside 8-word windows
that occur twice or more.  Windows are compared by 64-bit hashes of their words, inside one document only.

Defined results: a null text has no words, fails the base rules and isn't kept.  With fewer than ``least_trusted`` trusted
documents of ``least_words`` words the base rules decide, and without any the score is 0.  A null id never is trusted.  Repeated rows are judged each, and count each in the corpus.
Extra columns pass through ``kept_rows``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .base import let, text_of, with_known_size, words_of, written

BUCKETS = 1 << 16
PRIOR = 20.0
MOST_ERRORS = 4.0
LEAST_TRUSTED = 20
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pairwise(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` later."""
    return let(hashes, lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(h, i + step))))


def _covered(windows: Column, width: int = 8) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twin = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        let(ordered, repeated), start,
        lambda a, i: F.struct((a["n"] + i + width - F.greatest(i, a["end"])).alias("n"), (i + width).alias("end")),
        lambda a: a["n"])


def with_hashes(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_h1`` and ``_h2``, hashes of its words and of its word pairs."""
    hashed = docs.withColumn("_h1", F.transform(words_of(text_of(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn("_h2", _pairwise(F.col("_h1"), 1))


def with_base(hashed: DataFrame, text: str, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Base figures and ``base_failed``; ``hashed`` comes from ``with_hashes``."""
    content = text_of(text)
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    halves = hashed.withColumn("_h4", _pairwise(F.col("_h2"), 2))  # a window that occurs twice has a first half that does
    out = halves.withColumns({
        "n_words": F.size("_h1").cast("long"),
        "word_chars": F.length(functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, content)).cast("long"),
        "n_symbols": F.regexp_count(content, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_h4")) == F.size("_h4"), F.lit(0))
                           .otherwise(let(_pairwise(F.col("_h4"), 4), lambda w: _covered(w))).cast("long"),
    }).drop("_h4")
    return out.withColumn("base_failed", (F.col("n_words") < least_words)
                          | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))


def _buckets(buckets: int) -> Column:
    """Buckets of words and pairs; ``buckets`` is a power of two."""
    return F.transform(F.concat("_h1", "_h2"), lambda h: h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int"))


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, trusted) over all words and word pairs; combined before the shuffle, so at most ``buckets`` rows a task."""
    grams = with_hashes(rows.select("_text", "_trusted"), "_text").select("_trusted", F.explode(_buckets(buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("_trusted").alias("trusted"))


def expectations(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """At most ``buckets`` rows: ``bucket``, its count ``n``, the trusted one ``t``, and ``share``, trusted words among all."""
    counted = materialize(bucket_counts(rows, buckets))
    whole = counted.agg((F.sum("trusted") / F.greatest(F.sum("n"), F.lit(1))).alias("share"))
    return materialize(counted.select("bucket", F.col("n").cast("double").alias("n"), F.col("trusted").cast("double").alias("t"))
                       .join(F.broadcast(whole)))  # one row


def _runs(ordered: Column) -> Column:
    """One number for each bucket of a sorted array: how often it stands there, times 2 to the 32nd, and the bucket."""
    starts = F.filter(F.transform(ordered, lambda x, i: F.when(F.coalesce(x != F.get(ordered, i - 1), F.lit(True)), i)),
                      lambda i: i.isNotNull())
    return let(starts, lambda p: F.transform(p, lambda i, j: F.shiftleft(
        (F.coalesce(F.get(p, j + 1), F.size(ordered)) - i).cast("long"), 32).bitwiseOR(F.get(ordered, i).cast("long"))))


def scored(hashed: DataFrame, counts: DataFrame, columns: list[str], buckets: int, prior: float) -> DataFrame:
    """``columns`` of each row of ``hashed`` with ``llr``, the mean log ratio, and ``_error``, the square of that mean's error.

    A row's own words are taken out of the counts.  Its buckets, each once, are looked up in the short table of counts and
    added up again before the shuffle.
    """
    ordered = hashed.withColumn("_g", F.sort_array(_buckets(buckets)))
    narrow = ordered.select(*columns, F.monotonically_increasing_id().alias("_row_number"), F.size("_g").alias("_grams"),
                            _runs(F.col("_g")).alias("_runs"))
    each = narrow.select(*columns, "_row_number", "_grams", F.explode_outer("_runs").alias("_run"))
    each = each.withColumn("bucket", F.col("_run").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    found = each.join(F.broadcast(counts), "bucket", "left")  # at most ``buckets`` rows
    k = F.shiftright("_run", 32).cast("double")
    known = F.greatest(F.col("t") - F.when(F.col("_trusted"), k).otherwise(0.0), F.lit(0.0))
    ratio = F.log((known + prior) / ((F.col("n") - k) * F.col("share") + prior))
    sums = (found.select(*columns, "_row_number", "_grams", k.alias("_k"), ratio.alias("_r"))
            .groupBy(*columns, "_row_number", "_grams").agg(F.sum(F.col("_k") * F.col("_r")).alias("_s"), F.sum(F.col("_k") * F.col("_r") * F.col("_r")).alias("_q")))
    mean = F.coalesce(F.col("_s") / F.col("_grams"), F.lit(0.0))
    error = F.when(F.col("_grams") > 0, F.greatest(F.col("_q") / F.col("_grams") - F.col("llr") * F.col("llr"), F.lit(0.0)) / F.col("_grams"))
    return sums.withColumn("llr", F.when(F.col("_grams") > 0, mean).otherwise(0.0)).withColumn(
        "_error", F.coalesce(error, F.lit(0.0))).select(*columns, "llr", "_error")


def trusted_spread(scores: DataFrame, least_words: int = LEAST_WORDS, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """One row: ``middle``, the median of the trusted documents' scores, and ``spread``, the square of what they differ by beyond
    their own errors; null with too few documents."""
    bins = scores.where((F.col("n_words") >= least_words) & F.col("_trusted")).groupBy(
        F.floor(F.col("llr") * 10_000).alias("_bin")).agg(  # bounded by the range of the score
        F.count(F.lit(1)).alias("_n"), F.sum("_error").alias("_e"))
    at = bins.agg(F.percentile("_bin", F.lit(0.5), F.col("_n")).alias("mid"), F.percentile("_bin", F.lit(0.16), F.col("_n")).alias("low"),
                  F.sum("_n").alias("n"), (F.sum("_e") / F.sum("_n")).alias("e"))
    enough, wide = F.col("n") >= least_trusted, (F.col("mid") - F.col("low")) / 10_000
    return at.select(F.when(enough, F.col("mid") / 10_000).alias("middle"),
                     F.when(enough, F.greatest(wide * wide - F.col("e"), F.lit(1e-8))).alias("spread"))


def _judged(rows: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR,
            most_errors: float = MOST_ERRORS) -> DataFrame:
    """One row per row of ``rows`` (``_id``, ``_text``): ``_id``, ``_at`` (hash of the text), the base figures, ``base_failed``,
    ``llr``, ``errors`` and ``kept``.  Texts are read twice, for the counts and for the scores, which are written."""
    ids = with_known_size(trusted_ids.where("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(True)))
    flagged = rows.join(ids, "_id", "left").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    counts = expectations(flagged, buckets)
    based = with_base(with_hashes(flagged, "_text"), "_text").withColumn("_at", F.xxhash64(text_of("_text")))
    narrow = written(scored(based, counts, ["_id", "_at", "_trusted", *BASE, "base_failed"], buckets, prior), "scores")
    errors = (F.col("llr") - F.col("middle")) / F.sqrt(F.col("_error") + F.col("spread"))
    out = narrow.join(F.broadcast(trusted_spread(narrow))).withColumn("errors", F.coalesce(errors, F.lit(0.0)))  # one row
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("errors") >= -most_errors)).drop(
        "_trusted", "_error", "middle", "spread")


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Id, base figures, ``base_failed``, ``llr``, ``errors`` (of the score, from the trusted median) and ``kept`` of each row;
    ``trusted_ids`` has the column ``id_col``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    judged = _judged(rows, trusted_ids.select(F.col(id_col).alias("_id")), **more)
    return judged.select(F.col("_id").alias(id_col), *BASE, "base_failed", "llr", "errors", "kept")


def kept_rows(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.  Rows with the same id and text have the same verdict."""
    name, at = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(text_of(f"`{text}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    judged = _judged(rows, trusted_ids.select(F.col(id_col).alias("_id")), **more).where("NOT kept")
    gone = judged.select(F.col("_id").isNull().alias("_none"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_name"), "_at")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(f"`{id_col}`").isNull().alias("_none"), name.alias("_name"), at.alias("_at"))
    return packed.join(with_known_size(materialize(gone.distinct())), ["_none", "_name", "_at"], "left_anti").select("_row.*")
