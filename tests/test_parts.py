"""Documents and texts of webs in parts."""

from __future__ import annotations

import json

import pytest

from loomgraph.operators import positions
from loomgraph.sources import webjson
from tests.webs import HIVES, SLOPE, SOUTH, YAY, bees, make, post, uri


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(positions, "PART_BLOCKS", 3)


def test_a_document_comes_in_parts(spark, small_parts):
    again = [post(HIVES, "mia", "h1", "We moved them south", "2025-06-03T07:30:00Z", likes=22)]
    web = make(spark, bees() + again, threads=["empty"])
    web = type(web)(web.webs, web.threads.where(f"thread_root <> '{SOUTH}'"), web.posts, web.edges)
    parts = sorted(webjson.document_parts(web).collect(), key=lambda r: r.part)
    assert len(parts) > 3 and [r.part for r in parts] == list(range(len(parts)))
    body = "".join(r.json for r in parts)
    data = json.loads(body)
    assert list(data["threads"]) == [HIVES, YAY, "empty", SOUTH] and data["threads"]["empty"]["posts"] == {}
    assert list(data["threads"][HIVES]["posts"]) == [HIVES, SLOPE, uri("mia", "m3")]
    assert data["threads"][HIVES]["posts"][HIVES]["text"] == "We moved them south"
    assert data["meta"]["node_count"] == 6 and len(data["quote_edges"]) == 2
    assert body == json.dumps(data, indent=2, ensure_ascii=False)


def test_a_document_of_an_empty_web(spark, small_parts):
    web = make(spark, bees())
    empty = type(web)(web.webs, web.threads.limit(0), web.posts.limit(0), web.edges.limit(0))
    body = "".join(r.json for r in sorted(webjson.document_parts(empty).collect(), key=lambda r: r.part))
    assert body == json.dumps(json.loads(body), indent=2) and json.loads(body)["threads"] == {}
