"""Requests in SQL: a model's tables as views, and table functions over them.

The functions are bodies of SQL, so a call is part of the caller's plan: it is optimized with it and runs without Python. They
live as long as the session. A call's names must be constants or columns of a lateral join.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tributary.operators.model import Model
from tributary.operators.recommend import LIMIT

#: Names that the views and functions begin with.
FUNCTIONS = ("recommend", "recommend_with_types", "support")


def _answer(prefix: str, types: bool) -> str:
    own = "" if types else "where not i.is_type"
    return f"""
        with asked as (select i.item from {prefix}_items i where array_contains(names, i.iri)),
        request as (select sort_array(collect_list(item)) as s from asked),
        met as (select p.items, p.support, r.s from {prefix}_patterns p join request r
            on size(r.s) > 0 and size(p.items) >= size(r.s) and size(array_except(r.s, p.items)) = 0),
        total as (select sum(support) as n from met),
        counts as (select item, sum(support) as n from (select explode(array_except(items, s)) as item, support from met) group by item),
        popular as (select i.item, i.total_count as n from {prefix}_items i join request r on size(r.s) = 0),
        found as (select item, n / (select n from total) as probability from counts
            union all select item, n / (select sum(support) from {prefix}_patterns) from popular),
        ranked as (select i.iri as property, f.probability, row_number() over (order by f.probability desc, i.item) as rank
            from found f join {prefix}_items i on i.item = f.item {own if types else own + ' or (select size(s) from request) = 0'})
        select property, probability, rank from ranked where rank <= {LIMIT}"""


def register(model: Model, prefix: str) -> list[str]:
    """Makes the views <prefix>_items and <prefix>_patterns, and the functions

    <prefix>_recommend(names) and <prefix>_recommend_with_types(names): property, probability, rank, up to the limit;
    <prefix>_support(names): support, fraction.

    names is an array of strings, in which unknown and repeated ones don't count. The functions' names are returned.
    """
    spark: SparkSession = model.items.sparkSession
    if not prefix.isidentifier():
        raise ValueError("the prefix must be a plain name")
    model.items.select("item", "iri", "is_type", F.col("total_count").cast("long").alias("total_count")).createOrReplaceTempView(f"{prefix}_items")
    model.patterns.select("items", "support").createOrReplaceTempView(f"{prefix}_patterns")
    for name, types in (("recommend", False), ("recommend_with_types", True)):
        spark.sql(f"create or replace temporary function {prefix}_{name}(names array<string>) returns table (property string, probability double, rank int) return {_answer(prefix, types)}")
    spark.sql(f"""create or replace temporary function {prefix}_support(names array<string>) returns table (support bigint, fraction double) return
        with request as (select collect_list(i.item) as s from {prefix}_items i where array_contains(names, i.iri)),
        n as (select coalesce(sum(p.support), 0) as every, coalesce(sum(case when size(array_except(r.s, p.items)) = 0 then p.support end), 0) as met from {prefix}_patterns p cross join request r)
        select met, met / every from n""")
    return [f"{prefix}_{name}" for name in FUNCTIONS]
