"""Mixing sources to target weights by Pareto order sampling, with DataFrame and SQL functions only.

Method. The sources, in the order of their names, have weights and share a part of all sizes by them; no source's target
is more than `most` times its size, and what is beyond that is shared anew among the others. A source's ratio of target to
size gives each of its documents the ratio's whole part as certain copies. The fraction is sampled: the documents of a source
are put into classes of nearly equal size, each class has a fixed number of documents to draw, and in it those with the
smallest rank are drawn, where a rank is the odds of the document's uniform number over the odds of its inclusion
probability. Inclusion probabilities differ by source and class and, where documents are favoured, by document.

The number of a class is what is wanted of its words and of what the larger classes left over or took too much, over its
mean size, rounded by a uniform number of the class: so a source's words come near its target (what is left over is about
one document of its smallest class), and no class is left out for its place. All uniform numbers are digests of the seed
and of an id or name, so reruns agree, whatever the partitions.

No class is sorted whole: ranks are counted in CELLS, and only rows of the cell in which a class's number is reached are
ordered. Tables of classes are broadcast up to BROADCAST_ROWS rows and joined by salted keys beyond. The sources get their
places from ranges of their names (ranks.py).

Cases. A null size or id counts as 0 or as an id of its own; a document of size 0 is in no class and gets certain copies
only. A null source is the last source. Rows that repeat an id have the same uniform number; ties go by size and then by
`tie`. Sources without words have target 0. An empty table gives none. Columns named source_size, target or copies are
replaced; names that begin with __ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.ranks import placed
from tributary.session import materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A doubling of size is cut into 1 << FINE_BITS classes; ranks are counted in CELLS.
FINE_BITS, CELLS = 6, 4096
BROADCAST_ROWS = 1 << 17
#: Keys over which a class's rows are dealt where its table isn't broadcast.
SALTS = 256

#: Fixed value: a word.
SPACE = r"[\x20\x09-\x0D]+"
_STRIP = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_STRIP))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def uniform(seed: int, *names: Column) -> Column:
    """A number between 0 and 1 from the digest of the names; a null one has none."""
    parts = [F.coalesce(n.cast("string"), F.lit("")) for n in names]
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def size_class(size: Column) -> Column:
    """The class of a size above 0: 1 << FINE_BITS of them to a doubling."""
    exponent = F.length(F.bin(size)) - 1
    fine = F.call_function("shiftright", size, F.greatest(exponent - FINE_BITS, F.lit(0))) - (1 << FINE_BITS)
    return (exponent * (1 << FINE_BITS) + F.when(exponent >= FINE_BITS, fine).otherwise(size)).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The sources (source, source_size) with target.

    The excess is shared again until no source is above its most; the driver gets two sums a round.
    """
    order = [F.asc_nulls_last("source")]
    place = F.col("place") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double")
    own = materialize(placed(sources, order, "place").withColumn("__weight", weight).drop("place"), "sources")
    full = F.col("source_size") * most
    total = own.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    each, capped = 0.0, -1
    while True:
        above = F.lit(each) * F.col("__weight") > full if capped >= 0 else F.lit(False)
        n, held, left = own.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, full)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("__weight"))), F.lit(0.0))).first()
        if n == capped:
            break
        capped, each = n, (share * total - held) / left if left else 0.0
        if not left:
            return own.withColumn("target", full.cast("double")).drop("__weight")
    return own.withColumn("target", F.when(F.lit(each) * F.col("__weight") > full, full).otherwise(F.lit(each) * F.col("__weight")).cast("double")).drop("__weight")


def _numbers(classes: DataFrame, seed: int) -> DataFrame:
    """(source key, class, n, draw) from rows (key, class, n, words, fraction): how many of a class's documents are drawn.

    A source's classes, 64 to a doubling of size, go from the largest to the smallest with what is left over.
    """
    mean = F.col("words") / F.col("n")
    row = F.struct((-F.col("class")).alias("down"), "n", mean.alias("mean"), (F.col("fraction") * F.col("words")).alias("want"), uniform(seed, F.col("key"), F.col("class")).alias("at"))
    listed = classes.groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<struct<class: int, n: bigint, draw: bigint>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        want = state["over"] + r["want"]
        draw = F.least(F.greatest(F.floor(want / r["mean"] + r["at"]), F.lit(0)), r["n"]).cast("long")
        one = F.struct((-r["down"]).alias("class"), r["n"].alias("n"), draw.alias("draw"))
        return F.struct((want - draw * r["mean"]).alias("over"), F.concat(state["out"], F.array(one)).alias("out"))

    return listed.select("key", F.explode(F.aggregate("rows", start, step)["out"]).alias("c")).select("key", "c.class", "c.n", "c.draw")


def _with(rows: DataFrame, small: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """The rows joined with a table of one row a key; hot keys are dealt over SALTS where it is too large for a broadcast."""
    small = materialize(small, "classes")
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.hash(salt), F.lit(SALTS))).join(many, [*keys, "__salt"]).drop("__salt")


def mix(df: DataFrame, size: str = "size", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: int = MOST, seed: int = 12, favour: Column | None = None, tie: Column | None = None) -> DataFrame:
    """The input with source_size, target (both of its source) and copies, at most `most`.

    favour: a number above 0 to which inclusion probabilities are proportional within a class of equal size (1 at most); all
    equal by default. The input is read several times, so what is costly in it should be written before.
    """
    own = df.drop("source_size", "target", "copies")
    columns = own.columns
    # a name's mark keeps a null source apart from an empty one
    rows = own.withColumns({"__key": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), "__size": F.coalesce(F.col(size).cast("long"), F.lit(0)),
                            "__u": uniform(seed, F.col(id_col)), "__x": F.lit(1.0) if favour is None else favour.cast("double"), "__tie": F.lit(0) if tie is None else tie})
    rows = rows.withColumn("__class", F.when(F.col("__size") > 0, size_class(F.col("__size"))).otherwise(-1))
    sums = rows.groupBy("__key", "__class").agg(F.count("*").alias("n"), F.sum("__size").alias("words"), F.sum("__x").alias("x"))
    sums = materialize(sums.select(F.col("__key").alias("key"), F.col("__class").alias("class"), "n", "words", "x"), "size-classes")
    named = sums.groupBy("key").agg(F.sum("words").alias("source_size")).select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"), "source_size", "key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(most)).cast("int")
    goals = materialize(targets(named, weights, share, most).select("key", "source_size", "target", whole.alias("whole"), (ratio - whole).alias("fraction")), "goals")
    drawn = _numbers(sums.where("class >= 0").join(goals, "key"), seed)
    strata = sums.select("key", "class", "x").join(goals.drop("fraction"), "key").join(drawn, ["key", "class"], "left")
    strata = strata.select(F.col("key").alias("__key"), F.col("class").alias("__class"), "source_size", "target", F.col("whole").alias("__whole"), F.coalesce("draw", F.lit(0)).alias("__draw"), F.col("x").alias("__all"))
    rows = _with(rows, strata, ["__key", "__class"], "__u")
    p = F.least(F.col("__draw") * F.col("__x") / F.col("__all"), F.lit(1.0))
    u = F.col("__u")
    rows = rows.withColumn("__rank", F.when(F.col("__draw") > 0, u * (1 - p) / ((1 - u) * p)))
    rows = rows.withColumn("__cell", F.floor(F.lit(float(CELLS)) * F.col("__rank") / (1 + F.col("__rank"))).cast("int"))
    # where a class's number is reached
    cells = rows.where("__draw > 0").groupBy("__key", "__class", "__cell").agg(F.count("*").alias("n"), F.first("__draw").alias("draw"))
    upto = F.sum("n").over(Window.partitionBy("__key", "__class").orderBy("__cell"))
    edges = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("draw")) & (F.col("upto") - F.col("n") < F.col("draw")))
    edges = edges.select("__key", "__class", F.col("__cell").alias("__edge"), (F.col("draw") - F.col("upto") + F.col("n")).alias("__left"))
    rows = _with(rows.where("__draw > 0"), edges, ["__key", "__class"], "__u").unionByName(rows.where("__draw = 0"), allowMissingColumns=True)
    at_edge = F.coalesce(F.col("__cell") == F.col("__edge"), F.lit(False))
    # each side's last column says whether a row is drawn
    sure = rows.where(~at_edge).withColumn("__in", F.coalesce(F.col("__cell") < F.col("__edge"), F.lit(False)))
    close = Window.partitionBy("__key", "__class").orderBy("__rank", "__u", "__size", "__tie")
    ranked = rows.where(at_edge).withColumn("__in", F.row_number().over(close) <= F.col("__left"))
    copies = (F.col("__whole") + F.col("__in").cast("int")).alias("copies")
    return sure.unionByName(ranked).select(*(F.col(f"`{c}`") for c in columns), "source_size", "target", copies)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("__n")
