"""Quality rules and hashed n-gram importance of documents, with DataFrame and SQL functions only.

Method. Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets, with one
added to each, are counted: that of the trusted target (documents labelled good and not toxic) and that of the raw
corpus (all documents). A document's score is the mean over its n-grams of the log ratio of the two; a document is
kept if it passes the base rules and its score is at least THRESHOLD, the same for every document.

The target is fitted on the TRUSTED labelled documents with the smallest hashes, a bound stated here; raw counts cover
every document. Counting sends at most BUCKETS sums a task, and the driver gets BUCKETS weights. All the rest is done
row by row, so a document's words never leave its task.

Cases. A null text has no words and fails the base rules. Repeated rows count each. Without trusted documents all
weights are 0 and only the base rules reject. An empty table gives an empty result. Other columns stay as they are;
columns that begin with __ are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
TRUSTED = 1 << 14
THRESHOLD = -0.06
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

#: White space between words, symbols that count.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
_STRIP = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_STRIP))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _grams(codes: Column) -> Column:
    """Buckets of words and of pairs, from the words' CRC-32."""
    pairs = F.when(F.size(codes) > 1, F.transform(F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda c, i: F.pmod(F.get(codes, i) * 31 + c, F.lit(BUCKETS)).cast("int")))
    return F.concat(F.transform(codes, lambda c: F.pmod(c, F.lit(BUCKETS)).cast("int")), F.coalesce(pairs, F.array().cast("array<int>")))


def _coded(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn("__text", text).withColumn("__words", _words(F.col("__text"))).withColumn("__codes", F.transform("__words", lambda w: F.crc32(w.cast("binary"))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the trusted target: labelled good and not toxic, the TRUSTED with the smallest hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    return good.orderBy(F.xxhash64("__trusted"), "__trusted").limit(TRUSTED)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log ratio of target to raw by bucket."""
    marked = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__raw")).join(F.broadcast(trusted_ids(labels)), F.col("__id") == F.col("__trusted"), "left")
    grams = _coded(marked, "__raw").select(F.explode(_grams(F.col("__codes"))).alias("bucket"), F.col("__trusted").isNotNull().cast("long").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    if all_target == BUCKETS:
        return [0.0] * BUCKETS
    return [math.log((t + 1) / all_target) - math.log((r + 1) / all_raw) for t, r in zip(target, raw)]


def _repeated() -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first occurrence included.

    Hashes of windows show whether any can repeat; where one does, the windows themselves are sorted and compared.
    """
    words, codes, n = F.col("__words"), F.col("__hashes"), F.size("__words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(WINDOW))))
    return F.when(n > WINDOW, F.size(hashes) - F.size(F.array_distinct(hashes))).otherwise(F.lit(0))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and __codes."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    out = _coded(df, text_col).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).withColumn("__copies", _repeated())
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - WINDOW + 1), lambda i: F.struct(F.array_join(F.slice("__words", i, WINDOW), " ").alias("text"), i.alias("at")))
    out = out.withColumn("__sorted", F.when(F.col("__copies") > 0, F.array_sort(windows)))
    s, size = F.col("__sorted"), F.size("__sorted")
    twice = F.transform(s, lambda w, i: F.when(((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["text"] == w["text"])) | ((i + 1 < size) & (F.get(s, i + 1)["text"] == w["text"])), w["at"]))
    out = out.withColumn("__at", F.when(F.col("__copies") > 0, F.array_sort(F.filter(twice, lambda a: a.isNotNull()))))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines)
    out = out.select(
        *kept, "__codes", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with the base measures, score and kept."""
    listed = ",".join(map(repr, weights(df, labels, id_col, text_col)))
    table = F.split(F.lit(listed), ",").cast("array<double>")  # folded to one literal of BUCKETS numbers
    measured = measure(df.drop("score", "kept"), text_col).withColumn("__grams", _grams(F.col("__codes")))
    total = F.aggregate("__grams", F.lit(0.0), lambda a, g: a + F.get(table, g))
    scored = measured.withColumn("score", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(0.0)).drop("__grams", "__codes")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that judge() keeps.

    The choice is a generator of one or no row, not a filter: the optimizer would push a filter below the measures and
    put every measure's expression, many times over, into its condition.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    one = F.explode(F.when(F.col("kept"), F.array(F.monotonically_increasing_id())))
    return judge(df, labels, id_col, text_col).select(*columns, one.alias("__one")).drop("__one")
