"""Filters on keyword classes: Spark moves them below the projections, and the words of a text must not be made anew for each mention."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsweave.config import DEFAULT
from newsweave.functions import scalars as S
from newsweave.operators import filters
from newsweave.plans.bindings import SURROGATE_KEYWORDS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["P15_accepted", "P16_prefilter"])
def test_words_are_made_once_for_each_condition(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_extract_all") <= 2  # topic and relevance


@pytest.mark.parametrize("keywords", [SURROGATE_KEYWORDS, DEFAULT.keywords])
def test_filtered_rows_are_those_of_the_classes(spark, keywords):
    rows = spark.createDataFrame([
        (1, "The art of the one and only", "to be"), (2, None, "the of and to"), (3, "the of and to", None), (4, "", ""), (5, "pizza", "dinner"),
        (6, "DER und die Frau", "das le la"), (7, "New GPT-5 model release", "LLM benchmark, open-source"), (8, "x", "y" * 500 + " the of and"),
    ], "id int, title string, full_text string")
    classed = S.with_keyword_class(rows, keywords=keywords)
    found = {r.id: r for r in classed.collect()}
    assert (found[2].topic, found[2].matches, found[2].relevance) == (None, 0, 0.0) and found[4].topic is None
    wanted = [i for i, r in sorted(found.items()) if r.topic in DEFAULT.topics and r.relevance >= 0.2]
    assert wanted and [r.id for r in classed.where(filters.accepted(0.2, DEFAULT.topics)).orderBy("id").collect()] == wanted
    assert classed.where(F.col("topic").isNull()).count() == sum(r.topic is None for r in found.values())
