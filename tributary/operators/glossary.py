"""Labels and descriptions of properties by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import ntriples as nt
from tributary.operators.prepare import DESCRIPTION, NAME

FALLBACK = "en"


def _entries(triples: DataFrame) -> DataFrame:
    literal = nt.lang_literal(F.col("o"))
    rows = triples.where(F.col("p").isin(NAME, DESCRIPTION)).select(nt.iri(F.col("s")).alias("property"), (F.col("p") == NAME).alias("is_label"), literal.alias("literal"), "line_no")
    return rows.select("property", "is_label", F.col("literal.text").alias("text"), F.col("literal.lang").alias("lang"), "line_no").where("text <> '' and lang <> ''")


def build(triples: DataFrame) -> DataFrame:
    """property, lang, label, description; of several values the last line's counts, a missing one is empty."""
    def last(is_label: bool):
        own = F.col("is_label") == is_label
        return F.coalesce(F.max_by(F.when(own, F.col("text")), F.when(own, F.col("line_no"))), F.lit(""))

    return _entries(triples).groupBy("property", "lang").agg(last(True).alias("label"), last(False).alias("description"))


def stats(triples: DataFrame) -> DataFrame:
    """n_keys, n_labels, n_descriptions: keys, and triples of either kind."""
    rows = _entries(triples)
    return rows.agg(F.count_distinct("property", "lang").alias("n_keys"), F.count_if("is_label").alias("n_labels"), F.count_if(~F.col("is_label")).alias("n_descriptions"))


def languages(triples: DataFrame) -> DataFrame:
    """Properties by language."""
    return _entries(triples).select("property", "lang").distinct().groupBy("lang").agg(F.count("*").alias("properties"))


def translate(recommended: DataFrame, glossary: DataFrame) -> DataFrame:
    """Rows with property and lang, with label and description: of that language, else English, else the iri."""
    own = glossary.select("property", "lang", F.col("label").alias("__l"), F.col("description").alias("__d"))
    english = glossary.where(F.col("lang") == FALLBACK).select("property", F.col("label").alias("__el"), F.col("description").alias("__ed"))
    out = recommended.join(own, ["property", "lang"], "left").join(english, "property", "left")
    here = F.col("__l").isNotNull()
    label = F.when(here, F.col("__l")).otherwise(F.coalesce("__el", F.lit("")))
    description = F.when(here, F.col("__d")).otherwise(F.coalesce("__ed", F.lit("")))
    return out.withColumns({"label": F.when(label == "", F.col("property")).otherwise(label), "description": description}).drop("__l", "__d", "__el", "__ed")
