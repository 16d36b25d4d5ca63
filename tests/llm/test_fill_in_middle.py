"""Fill-in-the-middle against a version of a few lines of Python."""

import hashlib

import pytest

from loomgraph.llm.fill_in_middle import COLUMNS, FillInMiddle, fill_in_middle
from tests.llm.test_documents import awkward


def plain_version(doc_id, text, how):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = how.marks
    if not n or any(x in text for x in how.marks) or h3 % 100 >= 100 - how.plain:
        return n, "plain", None, None, text
    if h4 % 100 < how.spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def texts():
    rows = [(r[0], r[1]) for r in awkward()]
    rows += [(k, ("ä😀\n" * 90)[: k % 260]) for k in range(5000, 5600)]  # cuts in the same and in neighbouring pieces
    return rows + [(k, t) for k, t in enumerate(["a <P> b", "<S>", "x<M", "<", "<M>" * 9, "a\0b" * 99, "é" * 300_000, "P>" * 200], 7000)] + [(-3, "negative id " * 9), (-3, "negative id " * 9)]


@pytest.mark.parametrize("how", [FillInMiddle(), FillInMiddle(plain=0, spm=50, marks=("[p]", "[s]", "[m]"), seed=9)])
def test_equals_the_plain_version_and_can_be_undone(spark, how):
    rows = texts()
    table = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, form string, n int")
    got = fill_in_middle(table, how, tuple(COLUMNS)).collect()
    want = [(d, *plain_version(d, t, how), t or "") for d, t in rows]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got))) == sorted(map(repr, want))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert all(r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.restored) for r in got)


def test_empty_table_and_bytes_that_are_no_text(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    bad = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert fill_in_middle(bad, FillInMiddle(plain=100)).first().output == "a�b"
