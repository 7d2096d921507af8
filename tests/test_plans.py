"""The physical plans that matter at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lumenrec.operators import prep
from lumenrec.plans import catalogue
from lumenrec.sources import fixtures

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(fixtures.interactions(spark, DATA))
    assert "GreaterThan(l_quantity,30.0)" in p
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", p))
    assert schemas == ["l_orderkey:bigint,l_partkey:bigint,l_quantity:double", "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz"]


def test_top_k_windows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("item_id"), F.rand(1).alias("s"))
    assert plan(prep.top_per_user(df, "s", 5)).count("WindowGroupLimit") == 2
    assert plan(prep.last_n(df.withColumnRenamed("s", "ts"), 5)).count("WindowGroupLimit") == 2


def test_counts_combine_before_the_shuffle(spark):
    p = plan(prep.popularity(fixtures.train(spark, DATA)))
    assert "partial_count" in p and p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["item_similarity", "kg_pairwise_features", "candidate_labels", "corpus_dedupe", "rank_metrics_at_k"])
def test_no_cartesian_product_and_no_python_in_relational_queries(spark, name):
    p = plan(catalogue.queries()[name](spark, DATA))
    assert "CartesianProduct" not in p and "Python" not in p and "Pandas" not in p
