"""Whole inputs and whole results, beyond what the queries' SQL shows."""

from pairstone.operators import matching
from pairstone.plans import catalogue
from pairstone.plans.matching_queries import ALL_EXPLANATIONS
from pairstone.sources.messages import messages
from test_queries import SF, duck, plain  # noqa: F401


def test_explanations_of_all_pairs(spark, duck):  # noqa: F811
    """The operator over every pair of the pool, blocked ones, too; the query has the ranked ones."""
    df = matching.explained(matching.scored(matching.all_pairs(spark, SF)))
    columns = sorted(df.columns)
    rel = duck.sql(ALL_EXPLANATIONS)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert len(want) > 1000 and sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_bodies_are_whole(spark):
    long = spark.read.parquet(f"{SF}/conversations.parquet").where("length(text) > 80").count()
    assert messages(spark, SF).where("length(body) > 80").count() == long > 0


def test_no_query_on_pairs_has_a_nested_loop(spark):
    for name in ("bucket_assignment", "pool_summary", "rank_donors", "rank_donors_for_one", "explanations", "presence_vector", "systematic_sample", "pool_distribution"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_ten_are_ranked(spark):
    most = {x: catalogue.QUERIES[x](spark, SF).groupBy("anchor").count().agg({"count": "max"}).first()[0] for x in ("rank_donors", "rank_recipients")}
    assert 3 < most["rank_donors"] <= most["rank_recipients"] == 10  # there are ten donors here
