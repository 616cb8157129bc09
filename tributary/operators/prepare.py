"""Filtering, splitting and sampling of triples (line_no, s, p, o, line); tokens keep their brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import ntriples as nt
from tributary.operators.transactions import blocks

#: Predicates and classes of the filters and splitters.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"
PREF_LABEL = "<http://www.w3.org/2004/02/skos/core#prefLabel>"
ALT_LABEL = "<http://www.w3.org/2004/02/skos/core#altLabel>"
NAME = "<http://schema.org/name>"
DESCRIPTION = "<http://schema.org/description>"
FOR_MODEL = (RDF_TYPE, RDFS_LABEL, PREF_LABEL, ALT_LABEL, NAME, DESCRIPTION)
FOR_GLOSSARY = (RDF_TYPE, RDFS_LABEL, PREF_LABEL)
FOR_EVALUATION = FOR_MODEL
ITEM_CLASSES = ("<http://wikiba.se/ontology#Item>", "<http://wikiba.se/ontology-beta#Item>")
PROPERTY_CLASSES = ("<http://wikiba.se/ontology#Property>", "<http://www.wikidata.org/ontology#Property>")
ITEM_PREFIX, PROPERTY_PREFIX = "<http://www.wikidata.org/entity/Q", "<http://www.wikidata.org/entity/P"


def filter_predicates(triples: DataFrame, removed: tuple[str, ...]) -> DataFrame:
    return triples.where(~F.col("p").isin(*removed))


def filter_stats(triples: DataFrame, removed: tuple[str, ...]) -> DataFrame:
    """kept and lost triples."""
    gone = F.col("p").isin(*removed)
    return triples.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("lost"))


def kind_by_prefix(s: Column) -> Column:
    return F.when(s.startswith(ITEM_PREFIX), "item").when(s.startswith(PROPERTY_PREFIX), "prop").otherwise("misc")


def split_by_prefix(triples: DataFrame) -> DataFrame:
    """With kind: item, prop or misc, by the subject's prefix."""
    return triples.withColumn("kind", kind_by_prefix(F.col("s")))


def kind_of_class(p: Column, o: Column, type_predicate: str = RDF_TYPE, items: tuple[str, ...] = ITEM_CLASSES, properties: tuple[str, ...] = PROPERTY_CLASSES) -> Column:
    return F.when(p == type_predicate, F.when(o.isin(*items), "item").when(o.isin(*properties), "prop"))


def split_by_type(triples: DataFrame, kind: Column | None = None) -> DataFrame:
    """With kind by the subject's classes anywhere in the input; the last line that names one decides."""
    kind = kind_of_class(F.col("p"), F.col("o")) if kind is None else kind
    kinds = triples.select("s", "line_no", kind.alias("kind")).where("kind is not null").groupBy("s").agg(F.max_by("kind", "line_no").alias("kind"))
    return triples.join(kinds, "s", "left").withColumn("kind", F.coalesce("kind", F.lit("misc")))


def split_by_type_in_blocks(triples: DataFrame, kind: Column | None = None) -> DataFrame:
    """With kind by the classes in the subject's run of lines; the first line that names one decides."""
    kind = kind_of_class(F.col("p"), F.col("o")) if kind is None else kind
    rows = blocks(triples).withColumn("__kind", kind)
    first = F.min_by("__kind", F.when(F.col("__kind").isNotNull(), F.col("line_no"))).over(Window.partitionBy("block"))
    return rows.withColumn("kind", F.coalesce(first, F.lit("misc"))).drop("__kind", "block")


def kind_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("kind").agg(F.count("*").alias("triples"))


def write_split(split: DataFrame, path: str) -> None:
    """One folder a kind, with the lines as text."""
    split.select("kind", "line").write.mode("overwrite").partitionBy("kind").option("compression", "gzip").text(path)


def sample_1_in_n(triples: DataFrame, n: int) -> DataFrame:
    """With is_test: each n-th run of a subject's lines, from the n-th on; lines of indirect properties are left out."""
    if n < 1:
        raise ValueError("n must be positive")
    direct = nt.is_direct(nt.iri(F.col("p")))
    return blocks(triples).where(direct).withColumn("is_test", F.col("block") % n == 0).drop("block")
