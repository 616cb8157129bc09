"""The serving surface: whole tables of requests, and single requests as dictionaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import glossary as glossaries
from tributary.operators import recommend, workflow
from tributary.operators.model import Model
from tributary.operators.rules import DIRECT
from tributary.operators.transactions import TYPE_MARK

#: What a request without a language gets.
LANGUAGE = "en"


def request_items(requests: DataFrame) -> DataFrame:
    """(qid, items) from (qid, properties array<string>, types array<string>): types with their mark."""
    none = F.array().cast("array<string>")
    types = F.transform(F.coalesce("types", none), lambda t: F.concat(F.lit(TYPE_MARK), t))
    return requests.select("qid", F.concat(F.coalesce("properties", none), types).alias("items"))


@dataclass
class Engine:
    model: Model
    layers: list[workflow.Layer]
    glossary: DataFrame | None = None
    limit: int = recommend.LIMIT

    def _asked(self, requests: DataFrame) -> DataFrame:
        return recommend.requests(self.model, request_items(requests))

    def lean(self, requests: DataFrame) -> DataFrame:
        """(qid, property, total_count, item, probability, rank) by the workflow, without labels."""
        found = workflow.run(self.model, self._asked(requests), self.layers, self.limit)
        items = self.model.items.select("item", F.col("iri").alias("property"), "total_count")
        return found.join(items, "item").select("qid", "property", "total_count", "item", "probability", "rank")

    def recommend(self, requests: DataFrame) -> DataFrame:
        """(qid, property, label, description, probability, rank); requests with lang, types and properties."""
        if self.glossary is None:
            raise ValueError("labels need a glossary")
        language = requests.select("qid", F.coalesce("lang", F.lit(LANGUAGE)).alias("lang"))
        rows = self.lean(requests).join(language, "qid")
        return glossaries.translate(rows, self.glossary).select("qid", "property", "label", "description", "probability", "rank")

    def support(self, requests: DataFrame) -> DataFrame:
        """(qid, support, fraction)."""
        return recommend.support(self.model, self._asked(requests))

    def properties_and_types(self, requests: DataFrame) -> DataFrame:
        """(qid, property, probability, rank) with types, without a limit or labels."""
        found = recommend.recommend(self.model, self._asked(requests), include_types=True, limit=None)
        return recommend.named(self.model, found).select("qid", "property", "probability", "rank")

    def short_ids(self, requests: DataFrame) -> DataFrame:
        """(qid, property, probability, rank) for requests of Wikidata ids such as P31, without types or a limit."""
        asked = requests.select("qid", F.transform("properties", lambda p: F.concat(F.lit(DIRECT), p)).alias("properties"), F.array().cast("array<string>").alias("types"))
        found = recommend.named(self.model, recommend.recommend(self.model, self._asked(asked), limit=None))
        return found.where(F.startswith("property", F.lit(DIRECT))).select("qid", F.substring("property", len(DIRECT) + 1, 1 << 30).alias("property"), "probability", "rank")

    def one(self, endpoint: str, request: dict) -> list[dict]:
        """A single request's rows, best first; the driver holds no more than one answer.

        Where the workflow is the direct answer, the request's names are constants of the plan, which reads one bucket of
        the written model.
        """
        spark = self.model.items.sparkSession
        if endpoint in DIRECT_ENDPOINTS and (endpoint == "propType" or self._is_direct()):
            rows = self._direct(endpoint, request)
        else:
            row = [(0, request.get("lang"), request.get("types") or [], request.get("properties") or [])]
            frame = spark.createDataFrame(row, "qid long, lang string, types array<string>, properties array<string>")
            rows = ENDPOINTS[endpoint](self, frame).drop("qid")
        return [r.asDict() for r in (rows.orderBy("rank") if "rank" in rows.columns else rows).collect()]

    def _is_direct(self) -> bool:
        return self.layers[0].procedure is None and self.layers[0].condition is workflow.always()

    def _direct(self, endpoint: str, request: dict) -> DataFrame:
        names = [*(request.get("properties") or []), *(f"{TYPE_MARK}{t}" for t in request.get("types") or [])]
        both = endpoint == "propType"
        found = recommend.one(self.model, names, both, None if both else self.limit)
        if endpoint == "lean-recommender":
            counts = self.model.items.select("item", "total_count")
            return found.join(counts, "item").select("property", "total_count", "item", "probability", "rank")
        if endpoint == "recommender":
            if self.glossary is None:
                raise ValueError("labels need a glossary")
            rows = found.withColumn("lang", F.lit(request.get("lang") or LANGUAGE))
            return glossaries.translate(rows, self.glossary).select("property", "label", "description", "probability", "rank")
        return found.select("property", "probability", "rank")


ENDPOINTS: dict[str, Callable[[Engine, DataFrame], DataFrame]] = {
    "recommender": Engine.recommend, "lean-recommender": Engine.lean, "support": Engine.support, "propType": Engine.properties_and_types,
    "wikiRecommender": Engine.short_ids,
}
#: Those that a written model answers by `recommend.one`.
DIRECT_ENDPOINTS = ("recommender", "lean-recommender", "propType")
