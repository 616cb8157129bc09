"""From triples to one item set a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import ntriples as nt
from tributary.session import materialize

#: Predicates whose object is a type, and the mark of a type among items.
TYPE_PREDICATES = (
    "http://www.wikidata.org/prop/direct/P31",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type",
    "http://dbpedia.org/ontology/type",
)
TYPE_MARK = "t#"


#: Consecutive line numbers that are numbered together.
STRETCH = 1 << 20


def blocks(triples: DataFrame, subject: str = "s", order: str = "line_no", first_n: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """The rows with block: the number, from 1, of the run of lines with one subject; those up to first_n.

    Runs are numbered within stretches of line numbers, in parallel. The driver gets one row a stretch (first and last
    subject, and how many runs begin inside) and sums them up, so this runs a job; the sums go back by a broadcast of
    16 bytes a stretch. Line numbers must be unique.
    """
    rows = triples.withColumn("__stretch", F.floor(F.col(order) / stretch).cast("long") if stretch > 1 else F.col(order))
    w = Window.partitionBy("__stretch").orderBy(order)
    fresh = F.coalesce(F.col(subject) != F.lag(subject).over(w), F.lit(True)) & (F.row_number().over(w) > 1)
    rows = rows.withColumn("__fresh", fresh.cast("long")).withColumn("__run", F.sum("__fresh").over(w)).drop("__fresh")
    ends = rows.groupBy("__stretch").agg(F.min_by(subject, order).alias("first"), F.max_by(subject, order).alias("last"), F.max("__run").alias("more"))
    starts, number, last = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["__stretch"]):
        number += 1 if last is None or r["first"] is None or r["first"] != last else 0
        if first_n is not None and number > first_n:
            break
        starts.append((r["__stretch"], number))
        number, last = number + r["more"], r["last"]
    begins = triples.sparkSession.createDataFrame(starts, "__stretch long, __start long")
    rows = rows.join(F.broadcast(begins), "__stretch").withColumn("block", F.col("__start") + F.col("__run"))
    return (rows if first_n is None else rows.where(F.col("block") <= first_n)).drop("__stretch", "__run", "__start")


def to_transactions(triples: DataFrame, typed: bool = False, first_n: int | None = None, contiguous: bool = True) -> DataFrame:
    """subject, items, num_predicates, num_type_predicates: one row a run of a subject's lines (or a subject).

    A run whose lines are all left out still is a transaction, without items. Items are distinct; counts are not.
    """
    rows = triples.select("line_no", F.regexp_replace("s", "^<|>$", "").alias("s"), nt.iri(F.col("p")).alias("p"), nt.nth(nt.words(F.col("o")), 0).alias("o"))
    if contiguous:
        rows = materialize(rows, "lines")  # parsed once: the ends of stretches, items and patterns all read it
        rows = blocks(rows, first_n=first_n)
        keys = ["block", "s"]
    else:
        keys = ["s"]
    used = nt.is_direct(F.col("p"))
    kind = used & F.col("p").isin(*TYPE_PREDICATES)
    item = F.when(used, F.array("p"))
    if typed:
        item = F.when(kind, F.array("p", F.concat(F.lit(TYPE_MARK), "o"))).otherwise(item)
    grouped = rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(item))).alias("items"), F.count_if(used).alias("num_predicates"), F.count_if(kind).alias("num_type_predicates"))
    return grouped.select(F.col("s").alias("subject"), "items", "num_predicates", "num_type_predicates")


def from_pairs(pairs: DataFrame) -> DataFrame:
    """subject and items from (subject, item) rows, which may repeat."""
    return pairs.groupBy("subject").agg(F.collect_set("item").alias("items"))


#: Items in a word of bits, and words of a set at most.
WORD, MOST_WORDS = 63, 4
#: Rows of pairs a task, about.
PAIR_ROWS = 1 << 18


def coded(item: Column | str, names: list[str]) -> list[Column]:
    """word and bit of an item by its place among the names; nulls for one that is not there."""
    at = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col(item) if isinstance(item, str) else item) - 1
    at = F.when(at >= 0, at)
    return [F.floor(at / WORD).cast("int").alias("word"), F.element_at(F.array(*(F.lit(1 << n) for n in range(WORD))), (at % WORD + 1).cast("int")).alias("bit")]


def sets_of_bits(pairs: DataFrame, names: list[str], n_pairs: int) -> DataFrame:
    """(subject, items, times): the distinct sets, items sorted, each with its smallest subject and how many subjects have it.

    From (subject, word, bit) rows, which may repeat, of sorted names, WORD * MOST_WORDS at most. A subject whose rows are all
    null has the empty set. Words are summed up in hash tables; sets of strings would be sorted. Parts follow the number of
    pairs, which also are shuffled before they are looked at: a scan's task holds many subjects, but few lines of each.
    """
    words = [f"w{n}" for n in range(max(1, -(-len(names) // WORD)))]
    dealt = pairs.repartition(max(8, -(-n_pairs // PAIR_ROWS)), "subject")
    own = dealt.groupBy("subject").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == n, F.col("bit"))), F.lit(0).cast("long")).alias(w) for n, w in enumerate(words)))
    sets = own.groupBy(*words).agg(F.min("subject").alias("subject"), F.count("*").alias("times"))

    def named(n: int, word: str) -> Column:
        part = names[n * WORD:(n + 1) * WORD]
        return F.concat(*(F.when(F.col(word).bitwiseAND(1 << at) != 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for at, name in enumerate(part)))

    items = F.concat(*(named(n, w) for n, w in enumerate(words))) if names else F.array().cast("array<string>")
    return sets.select("subject", items.alias("items"), "times")


def distinct_sets(transactions: DataFrame) -> DataFrame:
    """As sets_of_bits, from (subject, items)."""
    return transactions.groupBy(F.array_sort("items").alias("items")).agg(F.min("subject").alias("subject"), F.count("*").alias("times")).select("subject", "items", "times")
