"""Entities of the rule suggester from CSV, JSON and XML dumps, and its CSV files.

An entity is (title string, claims array<struct<mainsnak, qualifiers, references>>), a snak (property_id int,
datatype string, value string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities of a written file at most; a file of an export, or a compressed one, is read by one task.
FILE_ROWS = 1 << 14
SNAK = "struct<property_id: int, datatype: string, value: string>"
CLAIM = f"struct<mainsnak: {SNAK}, qualifiers: array<{SNAK}>, references: array<{SNAK}>>"
#: Data types whose value is plain text, and those whose value is an entity.
PLAIN = ("string", "commonsMedia", "url", "math", "external-id", "geo-shape", "tabular-data", "musical-notation")
ENTITY = ("wikibase-item", "wikibase-property", "wikibase-lexeme", "wikibase-sense", "wikibase-form")

_RAW = "struct<snaktype: string, property: string, datatype: string, datavalue: struct<value: string, type: string>>"
_STATEMENT = f"struct<mainsnak: {_RAW}, qualifiers: map<string, array<{_RAW}>>, `references`: array<struct<snaks: map<string, array<{_RAW}>>>>>"
_CLAIMS = f"map<string, array<{_STATEMENT}>>"
_ENTITY = f"struct<type: string, id: string, claims: {_CLAIMS}>"
#: The older form in MediaWiki pages; a snak is [snaktype, property, datatype, value].
_LISTED = "array<struct<m: array<string>, q: array<array<string>>, refs: array<array<array<string>>>>>"


def from_rows(rows: DataFrame) -> DataFrame:
    """Entities from (line_no, title, typ, property_id, datatype, value) rows; a qualifier belongs to the claim above it.

    Rows of another typ, without a title or with a property that is no number are left out.
    """
    rows = rows.withColumn("property_id", F.col("property_id").try_cast("int")).where("typ in ('claim', 'qualifier', 'reference') and title is not null and property_id is not null")
    kind = F.when(F.col("typ") == "claim", 0).when(F.col("typ") == "qualifier", 1).otherwise(2)
    line = F.struct("line_no", kind.alias("kind"), F.struct("property_id", "datatype", "value").alias("snak"))
    # one shuffle; a claim's lines are those up to the next claim
    whole = rows.groupBy("title").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count_if(F.col("typ") == "claim").alias("n")).where("n > 0")
    whole = whole.select("title", "lines", F.array_compact(F.transform("lines", lambda x, i: F.when(x["kind"] == 0, i))).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines")))
    whole = whole.select("title", F.zip_with("starts", ends, lambda start, end: F.slice("lines", start + 1, end - start)).alias("runs"))

    def own(run: Column, kind: int) -> Column:
        return F.transform(F.filter(run, lambda x: x["kind"] == kind), lambda x: x["snak"])

    claims = F.transform("runs", lambda run: F.struct(F.get(run, F.lit(0))["snak"].alias("mainsnak"), own(run, 1).alias("qualifiers"), own(run, 2).alias("references")))
    return whole.select("title", claims.alias("claims"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    schema = "title string, typ string, property_id string, datatype string, value string, more string"
    rows = spark.read.option("sep", delimiter).option("escape", '"').schema(schema).csv(path)
    whole = "more is null and value is not null"  # five fields, no less and no more
    return from_rows(rows.withColumn("line_no", F.monotonically_increasing_id()).where(whole).drop("more"))


def to_rows(entities: DataFrame) -> DataFrame:
    """(title, typ, property_id, datatype, value): each claim, then its qualifiers, then its references."""
    def tagged(snaks: Column, typ: str) -> Column:
        return F.transform(snaks, lambda s: F.struct(F.lit(typ).alias("typ"), s.alias("snak")))

    # explode's own filters would make its arrays anew; the outer form has none
    claims = entities.select("title", F.posexplode_outer("claims").alias("n", "claim")).where("n is not null")
    every = F.concat(tagged(F.array("claim.mainsnak"), "claim"), tagged(F.col("claim.qualifiers"), "qualifier"), tagged(F.col("claim.references"), "reference"))
    rows = claims.select("title", F.posexplode_outer(every).alias("n", "row")).where("n is not null")
    return rows.select("title", "row.typ", "row.snak.property_id", "row.snak.datatype", "row.snak.value")


def write_csv(entities: DataFrame, path: str, delimiter: str = ",", compression: str = "none") -> None:
    to_rows(entities).write.mode("overwrite").option("sep", delimiter).option("escape", '"').option("compression", compression).csv(path)


def _number(prefixed: Column) -> Column:
    return F.regexp_extract(prefixed, r"(\d+)$", 1).try_cast("int")


def _snak(raw: Column) -> Column:
    """The decoded snak, without its property or its value where that cannot be read."""
    value, kind = raw["datavalue"]["value"], raw["datatype"]

    def at(path: str) -> Column:
        return F.get_json_object(value, f"$.{path}")

    text = (F.when(kind.isin(*PLAIN), value).when(kind.isin(*ENTITY), at("id")).when(kind == "time", at("time")).when(kind == "quantity", at("amount"))
            .when(kind == "globe-coordinate", F.concat(F.lit("N"), at("latitude"), F.lit(", E"), at("longitude")))
            .when(kind == "monolingualtext", F.concat(at("text"), F.lit(" ("), at("language"), F.lit(")"))))
    known = raw["snaktype"] == "value"
    return F.struct(_number(raw["property"]).alias("property_id"), F.when(known, kind).otherwise("unknown").alias("datatype"), F.when(known, text).otherwise(raw["snaktype"]).alias("value"))


def _whole(snak: Column) -> Column:
    """Whether a decoded snak could be read. It is asked of decoded arrays: a condition on the decoding itself decodes again."""
    return snak["property_id"].isNotNull() & snak["value"].isNotNull()


def _all(by_property: Column) -> Column:
    """Decoded snaks of a map by property, in the order of its keys."""
    lists = F.transform(F.array_sort(F.map_keys(by_property)), lambda k: F.element_at(by_property, k))
    return F.filter(F.transform(F.flatten(lists), _snak), _whole)


def _claims(by_property: Column) -> Column:
    """Claims of a map of statements by property."""
    empty = F.array().cast(f"array<{SNAK}>")
    keys = F.array_sort(F.map_keys(by_property))
    statements = F.flatten(F.transform(keys, lambda k: F.element_at(by_property, k)))

    def claim(s: Column) -> Column:
        references = F.flatten(F.transform(s["references"], lambda r: _all(r["snaks"])))
        return F.struct(_snak(s["mainsnak"]).alias("mainsnak"), F.coalesce(_all(s["qualifiers"]), empty).alias("qualifiers"), F.coalesce(references, empty).alias("references"))

    claims = F.filter(F.transform(statements, claim), lambda c: _whole(c["mainsnak"]))
    return F.coalesce(claims, F.array().cast(f"array<{CLAIM}>"))


def _listed_snak(raw: Column) -> Column:
    """The decoded snak of a list, without its property or its value where that cannot be read, such as of datatype `bad`."""
    kind, value = F.get(raw, F.lit(2)), F.get(raw, F.lit(3))

    def at(path: str) -> Column:
        return F.get_json_object(value, f"$.{path}")

    text = (F.when(kind == "string", value).when((kind == "wikibase-entityid") & (at("entity-type") == "item"), F.concat(F.lit("Q"), at("numeric-id")))
            .when(kind == "time", at("time")).when(kind == "quantity", at("amount"))
            .when(kind == "globecoordinate", F.concat(F.lit("N"), at("latitude"), F.lit(", E"), at("longitude"))))
    snaktype = F.get(raw, F.lit(0))
    known, named = snaktype == "value", F.when(kind == "wikibase-entityid", "wikibase-item").otherwise(kind)
    return F.struct(F.get(raw, F.lit(1)).try_cast("int").alias("property_id"), F.when(known, named).otherwise("unknown").alias("datatype"), F.when(known, text).otherwise(snaktype).alias("value"))


def _listed_claims(statements: Column) -> Column:
    """Claims of a list of {m, q, refs}."""
    def snaks(raw: Column) -> Column:
        return F.coalesce(F.filter(F.transform(raw, _listed_snak), _whole), F.array().cast(f"array<{SNAK}>"))

    claims = F.transform(statements, lambda s: F.struct(_listed_snak(s["m"]).alias("mainsnak"), snaks(s["q"]).alias("qualifiers"), snaks(F.flatten(s["refs"])).alias("references")))
    return F.filter(claims, lambda c: _whole(c["mainsnak"]))


def from_json(lines: DataFrame) -> DataFrame:
    """Entities from a column `value` of JSON texts; only those of type item."""
    parsed = lines.select(F.inline_outer(F.array(F.from_json("value", _ENTITY)))).where("type = 'item'")  # parsed once, a row of its own
    return parsed.select(F.col("id").alias("title"), _claims(F.col("claims")).alias("claims"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Entities from (title, value) pages, value a JSON object with claims as a map by property or as a list.

    A page without claims gives an entity without claims; one whose text is no JSON object is left out.
    """
    parsed = pages.where(F.json_object_keys("value").isNotNull()).select("title", F.from_json("value", "struct<id: string, claims: string>").alias("e"))
    listed = F.from_json("e.claims", _LISTED)
    claims = F.when(F.ltrim("e.claims").startswith("["), _listed_claims(listed)).otherwise(_claims(F.from_json("e.claims", _CLAIMS)))
    return parsed.select(F.coalesce("title", "e.id").alias("title"), F.coalesce(claims, F.array().cast(f"array<{CLAIM}>")).alias("claims"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A dump with one entity a line, in an array or not."""
    lines = spark.read.text(path).where(F.col("value").startswith("{"))
    return from_json(lines.select(F.regexp_replace("value", r"[,\r\n]+$", "").alias("value")))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """A MediaWiki export: pages of the item model hold an entity's JSON, and their title is the entity's."""
    schema = "title string, revision struct<model: string, text: string>"
    text = "struct<_VALUE: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema.replace("text: string", f"text: {text}")).load(path)
    return from_pages(pages.where("revision.model = 'wikibase-item'").select("title", F.col("revision.text._VALUE").alias("value")))


def write_xml(pages: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """(title, value) as MediaWiki exports of up to so many pages, each a whole file, that read_xml reads."""
    page = pages.select("title", F.struct(F.lit("wikibase-item").alias("model"), F.col("value").alias("text")).alias("revision"))
    page.write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "gzip").option("maxRecordsPerFile", rows).save(path)


def read_pairs(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The rules' CSV: pid1, qid1, pid2, count, probability, context; a qid1 that is no number is 0."""
    schema = "pid1 int, qid1 string, pid2 int, count long, probability double, context string"
    rows = spark.read.option("header", True).option("sep", delimiter).option("enforceSchema", False).schema(schema).csv(path)
    return rows.withColumn("qid1", F.coalesce(F.col("qid1").try_cast("int"), F.lit(0)))


def write_pairs(rules: DataFrame, path: str, delimiter: str = ",") -> None:
    rules.select("pid1", "qid1", "pid2", "count", "probability", "context").write.mode("overwrite").option("header", True).option("sep", delimiter).option("nullValue", "").option("emptyValue", "").csv(path)
