"""Searches over an index of trigrams give what a scan gives."""

import random

import pytest

from loomgraph.operators.postings import candidates, index_texts
from loomgraph.plans.lenses import search
from tests.webs import bees, make, post, uri


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(2)
    noise = [post(uri("n", k), "n", k, "".join(rng.choice("abBé 😀\n") for _ in range(rng.randrange(30))), f"2025-01-{k % 28 + 1:02d}") for k in range(300)]
    return make(spark, [*bees(), *noise])


@pytest.fixture(scope="module")
def index(web, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index_texts(web.posts, path)
    return path


@pytest.mark.parametrize("query", ["the", "BEES", "bab", "aB\na", "😀a ", "éé", "a", "nothing like it", "aaaaaa"])
def test_equals_the_scan(spark, web, index, query):
    among = candidates(spark, index, query)
    assert (among is None) == (len(query) < 3)
    got, want = ([(r.n, r.uri, r.snippet) for r in search(web, query, among=x).orderBy("n").collect()] for x in (among, None))
    assert got == want
    if among is not None:
        assert among.count() >= len(want)


def test_the_plan_reads_the_grams_folders_and_rows(spark, index):
    plan = candidates(spark, index, "bees")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan
