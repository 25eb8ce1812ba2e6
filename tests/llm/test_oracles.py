"""Registered queries, digests and all, against SQL that states what they must find."""

import pytest

from oracle import DATA, of_duck, of_spark
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duck(sf_dir, ORACLES[name])
