"""The model: a ranked dictionary and the distinct item patterns with their supports.

A recommender's prefix tree is here a table: patterns of rank-sorted items. All its answers are sums of supports of
patterns that contain a set.

A written model also has two tables to answer from, bucketed and sorted by what is asked for, so that a request reads one
bucket and nothing of it is shuffled:

* postings: each pattern once for each of its items, by place. An item's places are numbers of its own, one for each
  PLACE_ROWS postings or so: no bucket holds more of a frequent item than that for its sake.
* pairs: how many transactions hold an item and another, by item. It answers requests of one item.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators.transactions import TYPE_MARK, TYPE_PREDICATES
from tributary.session import exists, materialize

#: Always in the dictionary of a model read from triples.
ALWAYS = ("root", *TYPE_PREDICATES)


#: Postings a place, about; places of an item at most; buckets of a table at least and at most.
PLACE_ROWS, MOST_PLACES, BUCKETS = 1 << 20, 1 << 16, (16, 1 << 15)
#: Items with several places that are broadcast, and dictionary entries that the driver keeps; with more, they are joined.
BROADCAST_ITEMS, KEPT_ENTRIES = 1 << 16, 1 << 18


def ranked(counts: DataFrame) -> DataFrame:
    """item (rank from 0: most frequent first, ties by iri), iri, is_type, total_count.

    One task ranks the dictionary: its size is that of the schema, not of the data.
    """
    order = Window.orderBy(F.desc("total_count"), "iri")
    return counts.select((F.row_number().over(order) - 1).alias("item"), "iri", F.col("iri").startswith(TYPE_MARK).alias("is_type"), "total_count")


def place(item: Column | str, part: Column) -> Column:
    return (F.col(item) if isinstance(item, str) else item).cast("long") * MOST_PLACES + part


def _write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A file a bucket, sorted by the key; the catalog's entry is by the path."""
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(_name(path))


def _name(path: str) -> str:
    return f"tributary_{hashlib.md5(path.encode()).hexdigest()}"


def _bucketed(spark: SparkSession, path: str, key: str, buckets: int, schema: str) -> DataFrame:
    """A table that _write_bucketed wrote, in this session or another."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(_name(path))
    return spark.table(_name(path))


POSTINGS = "place bigint, items array<int>, support bigint"
PAIRS = "item int, iri string, other int, other_iri string, other_is_type boolean, support bigint"


@dataclass
class Model:
    items: DataFrame
    patterns: DataFrame
    #: Of written models: the tables to answer from, (item, places) of items with more than one, how many those are, and transactions.
    postings: DataFrame | None = None
    pairs: DataFrame | None = None
    places: DataFrame | None = None
    n_placed: int = 0
    total: int | None = None
    _entries: dict[str, tuple[int, bool, int]] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, transactions: DataFrame, always: tuple[str, ...] = ()) -> Model:
        """From (items array<string>), one row a transaction; always: entries that are there even if unseen."""
        return cls.of_patterns(transactions.select(F.array_sort("items").alias("items"), F.lit(1).cast("long").alias("support")), always)

    def n_transactions(self) -> DataFrame:
        """One row: n, the number of transactions, which is the root's support."""
        if self.total is not None:
            return self.items.sparkSession.range(1).select(F.lit(self.total).cast("long").alias("n"))
        return self.patterns.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("n"))

    def nodes(self) -> DataFrame:
        """path, item, depth, support of the prefix tree's nodes; the root is the empty path."""
        prefixes = self.patterns.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("items")), lambda n: F.slice("items", F.lit(1), n))).alias("path"), "support")
        nodes = prefixes.groupBy("path").agg(F.sum("support").alias("support"))
        return nodes.select("path", F.get("path", F.size("path") - 1).alias("item"), F.size("path").alias("depth"), "support")

    def insert(self, transactions: DataFrame) -> Model:
        """The model of both: patterns by iri are merged and everything is ranked anew, so counts and ranks stay right."""
        known = self.items.select("item", "iri")
        old = self.patterns.withColumn("id", F.monotonically_increasing_id())
        named = old.select("id", "support", F.explode_outer("items").alias("item")).join(known, "item", "left").groupBy("id", "support").agg(F.collect_list("iri").alias("items"))
        new = transactions.select(F.array_sort("items").alias("items"), F.lit(1).cast("long").alias("support"))
        both = Model.of_patterns(named.select(F.array_sort("items").alias("items"), "support").unionByName(new), known=self.items.select("iri"))
        if self.pairs is not None:  # pairs go by iri too: those that are there need no pattern
            more = _named_pairs(new.groupBy("items").agg(F.sum("support").alias("support")))
            both.pairs = _ranked_pairs(self.pairs.select("iri", "other_iri", "support").unionByName(more), both.items)
        return both

    @classmethod
    def of_patterns(cls, named: DataFrame, always: tuple[str, ...] = (), known: DataFrame | None = None) -> Model:
        """From (items array<string>, support), items sorted; sets may repeat. Equal sets meet before anything else.

        always, and known (iri): entries that are there even if no pattern has them.
        """
        merged = materialize(named.groupBy("items").agg(F.sum("support").alias("support")), "merged")  # entries and patterns both read it
        entries = merged.select(F.explode("items").alias("iri"), "support")
        if always:
            entries = entries.unionByName(merged.sparkSession.createDataFrame([(a, 0) for a in always], "iri string, support long"))
        if known is not None:
            entries = entries.unionByName(known.select("iri", F.lit(0).cast("long").alias("support")))
        items = ranked(entries.groupBy("iri").agg(F.sum("support").alias("total_count")))
        pairs = merged.select(F.col("items").alias("named"), "support", F.explode_outer("items").alias("iri")).join(items.select("iri", "item"), "iri", "left")
        return cls(items, pairs.groupBy("named", "support").agg(F.sort_array(F.collect_list("item")).alias("items")).select("items", "support"))

    def made_postings(self) -> tuple[DataFrame, DataFrame]:
        """The postings, and (item, places) of items with more than one place; the latter is counted here."""
        rows = self.patterns.select("items", "support", F.explode("items").alias("item"))
        n = F.least(F.ceil(F.col("n") / PLACE_ROWS), F.lit(MOST_PLACES)).cast("int")
        placed = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > PLACE_ROWS).select("item", n.alias("places")).persist()
        few = placed.count() <= BROADCAST_ITEMS
        part = F.pmod(F.xxhash64("items"), F.coalesce("places", F.lit(1)))
        return rows.join(F.broadcast(placed) if few else placed, "item", "left").select(place("item", part).alias("place"), "items", "support"), placed

    def made_pairs(self) -> DataFrame:
        """(item, iri, other, other_iri, other_is_type, support): transactions that hold both."""
        if self.pairs is not None:
            return self.pairs
        rows = self.patterns.select("support", F.explode("items").alias("item"), "items").select("support", "item", F.explode("items").alias("other")).where("item <> other")
        counts = rows.groupBy("item", "other").agg(F.sum("support").alias("support"))
        names = self.items.select("item", "iri")
        others = self.items.select(F.col("item").alias("other"), F.col("iri").alias("other_iri"), F.col("is_type").alias("other_is_type"))
        return counts.join(names, "item").join(others, "other").select("item", "iri", "other", "other_iri", "other_is_type", "support")

    def save(self, path: str) -> None:
        """The dictionary, the patterns, and the tables to answer from."""
        spark = self.items.sparkSession
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.patterns.write.mode("overwrite").parquet(f"{path}/patterns")
        own = Model(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/patterns"), pairs=self.pairs)
        n, total = own.patterns.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)), F.coalesce(F.sum("support"), F.lit(0))).first()
        buckets = min(max(BUCKETS[0], -(-n // PLACE_ROWS)), BUCKETS[1])
        postings, placed = own.made_postings()
        _write_bucketed(postings, f"{path}/postings", "place", buckets)
        placed.write.mode("overwrite").parquet(f"{path}/places")
        _write_bucketed(own.made_pairs(), f"{path}/pairs", "item", buckets)
        about = spark.createDataFrame([(buckets, placed.count(), total)], "buckets int, placed long, total long")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        placed.unpersist()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        items, patterns = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/patterns")
        if not exists(spark, f"{path}/about"):
            return cls(items, patterns)
        buckets, n_placed, total = spark.read.parquet(f"{path}/about").first()
        postings = _bucketed(spark, f"{path}/postings", "place", buckets, POSTINGS)
        pairs = _bucketed(spark, f"{path}/pairs", "item", buckets, PAIRS)
        return cls(items, patterns, postings, pairs, spark.read.parquet(f"{path}/places"), n_placed, total)

    def entries(self, names: list[str]) -> dict[str, tuple[int, bool, int]]:
        """Item, is_type and count of those of the names that are in the dictionary; the driver keeps one of up to KEPT_ENTRIES."""
        columns = self.items.select("iri", "item", "is_type", "total_count")
        if self._entries is None:
            few = columns.limit(KEPT_ENTRIES + 1).collect()
            self._entries = {r[0]: tuple(r)[1:] for r in few} if len(few) <= KEPT_ENTRIES else {}
        if self._entries:
            return {n: self._entries[n] for n in names if n in self._entries}
        return {r[0]: tuple(r)[1:] for r in columns.where(F.col("iri").isin(names)).collect()} if names else {}

    def persist(self) -> Model:
        """Keeps both tables for several requests."""
        return Model(self.items.persist(), self.patterns.persist())

    def frequencies(self, types: bool) -> DataFrame:
        """URI and Frequency of properties or of types, a type without its mark."""
        name = F.regexp_replace("iri", f"^{TYPE_MARK}", "") if types else F.col("iri")
        return self.items.where(F.col("is_type") == types).select(name.alias("URI"), F.col("total_count").alias("Frequency"))

    def write_frequencies(self, path: str, types: bool) -> None:
        self.frequencies(types).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)

    def dot_edges(self, least: int = 100_000) -> DataFrame:
        """parent, child, support, weight: edges to nodes of at least this support, for drawing."""
        totals = self.items.select("item", F.col("iri").alias("child_iri"), "total_count")
        nodes = self.nodes().where((F.col("support") >= least) & (F.col("depth") > 0)).join(totals, "item")

        def label(path):
            return F.concat(F.lit("n"), F.array_join(path, "_"))

        return nodes.select(label(F.slice("path", F.lit(1), F.size("path") - 1)).alias("parent"), label(F.col("path")).alias("child"), F.col("child_iri").alias("label"), "support", F.col("total_count").alias("weight"))

    def dot(self, least: int = 100_000) -> DataFrame:
        """Lines of a DOT graph, one column named value."""
        edges = self.dot_edges(least)
        line = F.format_string('  "%s" -> "%s" [label="%s: %d" weight=%d];', "parent", "child", "label", "support", "weight")
        spark = edges.sparkSession
        return spark.createDataFrame([("digraph schema {",)], "value string").unionByName(edges.select(line.alias("value"))).unionByName(spark.createDataFrame([("}",)], "value string"))


def _named_pairs(named: DataFrame) -> DataFrame:
    """(iri, other_iri, support) from (items array<string>, support)."""
    rows = named.select("support", F.explode("items").alias("iri"), "items").select("support", "iri", F.explode("items").alias("other_iri"))
    return rows.where("iri <> other_iri").groupBy("iri", "other_iri").agg(F.sum("support").alias("support"))


def _ranked_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs by name, summed, with the dictionary's ranks."""
    sums = pairs.groupBy("iri", "other_iri").agg(F.sum("support").alias("support"))
    others = items.select(F.col("iri").alias("other_iri"), F.col("item").alias("other"), F.col("is_type").alias("other_is_type"))
    return sums.join(items.select("iri", "item"), "iri").join(others, "other_iri").select("item", "iri", "other", "other_iri", "other_is_type", "support")
