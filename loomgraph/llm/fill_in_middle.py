"""Fill-in-the-middle texts by DuckDB inside ``mapInArrow``: each batch is registered as a table, cut, put in a
new order and hashed by SQL, and goes back as Arrow. No Python runs for a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.worker import hold, parts

_BATCH_BYTES = 1 << 20  # of text that DuckDB cuts at a time; a longer text is a batch of its own
_CHUNK = 64  # code points of a piece of text; only pieces that hold a cut are taken apart further

#: What a column of the result is, over the columns of ``_SQL``.
COLUMNS = {
    "n": ("long", "n"),
    "form": ("string", "form"),
    "prefix_chars": ("long", "if(form = 'plain', null, a)"),
    "middle_chars": ("long", "if(form = 'plain', null, b - a)"),
    "output": ("string", "output"),
    "restored": ("string", "restored"),
    "output_sha256": ("string", "sha256(output)"),
    "restored_sha256": ("string", "sha256(restored)"),
}


@dataclass(frozen=True)
class FillInMiddle:
    """Percent of texts that stay plain, percent of the others whose suffix comes first (spm), the marks before
    prefix, suffix and middle, and a seed that makes another choice of cuts and forms."""

    plain: int = 10
    spm: int = 20
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: int = 1


#: The batch is the view ``given`` (doc_id, text). ``units`` are a text's code points around its cuts and pieces of
#: 64 code points elsewhere: list_slice cuts them before unit ``i`` and ``j``.
_SQL = """
with hashed as (
    select doc_id, coalesce(text, '') as text, sha256($seed || ':' || coalesce(cast(doc_id as varchar), '')) as h from given
), drawn as (
    select doc_id, text, length(text) as n, {words} from hashed
), formed as (
    select doc_id, text, n,
        least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(text, $p) or contains(text, $s) or contains(text, $m) or h3 % 100 >= 100 - $plain then 'plain' when h4 % 100 < $spm then 'spm' else 'psm' end as form
    from drawn
), chunked as (
    select *, if(form = 'plain', [], regexp_extract_all(text, '.{{1,{chunk}}}', 0, 's')) as chunks, a // {chunk} as ca, b // {chunk} as cb from formed
), spread as (
    select *,
        list_slice(chunks, 1, ca) || regexp_extract_all(coalesce(chunks[ca + 1], ''), '.', 0, 's')
            || if(cb = ca, [], list_slice(chunks, ca + 2, cb) || regexp_extract_all(coalesce(chunks[cb + 1], ''), '.', 0, 's'))
            || list_slice(chunks, cb + 2, len(chunks)) as units,
        ca + a % {chunk} as i, if(cb = ca, ca, cb + {chunk} - 1) + b % {chunk} as j
    from chunked
), cut as (
    select *, array_to_string(list_slice(units, 1, i), '') as prefix, array_to_string(list_slice(units, i + 1, j), '') as middle, array_to_string(list_slice(units, j + 1, len(units)), '') as suffix from spread
), ordered as (
    select *, case form when 'plain' then text when 'psm' then $p || prefix || $s || suffix || $m || middle else $s || suffix || $p || prefix || $m || middle end as output from cut
), parted as (
    select *, if(form = 'psm', $p, $s) as lead, if(form = 'psm', $s, $p) as next from ordered
), undone as (
    select *, split_part(substr(output, length(lead) + 1), next, 1) as first, split_part(split_part(output, next, 2), $m, 1) as second, split_part(output, $m, 2) as last from parted
), whole as (
    select *, case form when 'plain' then output when 'psm' then first || last || second else second || last || first end as restored from undone
)
select doc_id, {columns} from whole
"""


def _sql(columns: tuple[str, ...]) -> str:
    words = ", ".join(f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint) as h{k + 1}" for k in range(4))
    return _SQL.format(words=words, chunk=_CHUNK, columns=", ".join(f"{COLUMNS[c][1]} as {c}" for c in columns))


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _transformed(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], how: FillInMiddle) -> Iterator[pa.RecordBatch]:
    con, sql = hold("duckdb", _connection), _sql(columns)
    p, s, m = how.marks
    given = {"p": p, "s": s, "m": m, "seed": str(how.seed), "plain": how.plain, "spm": how.spm}
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((c, kinds[COLUMNS[c][0]]) for c in columns)])
    for batch in batches:
        for part in parts(batch.column("text"), _BATCH_BYTES):
            con.register("given", batch.slice(part.start, part.stop - part.start))
            yield from con.sql(sql, params=given).to_arrow_table().cast(schema).to_batches()
            con.unregister("given")


def fill_in_middle(documents: DataFrame, how: FillInMiddle = FillInMiddle(), columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """doc_id and the ``columns`` (of ``COLUMNS``) for every row of ``documents`` (doc_id, text; others are ignored).

    A text of n code points is cut at two places drawn from the SHA-256 of the seed and doc_id, and written as
    prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its mark. Empty texts, texts that
    hold a mark and a share of all others stay plain. ``restored`` is the text that a reader rebuilds from output
    and form. A null text is empty; rows that share a doc_id are cut alike, those without one as if it were the
    empty string; bytes that are no UTF-8 are replaced by U+FFFD first. A text of any length is cut in one piece;
    memory follows the longest text. An empty table gives an empty result. Nothing is shuffled.
    """
    text = F.make_valid_utf8(F.col("text").cast("string"))
    schema = ", ".join(["doc_id long", *(f"{c} {COLUMNS[c][0]}" for c in columns)])
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(partial(_transformed, columns=columns, how=how), schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' texts and of the texts rebuilt from them."""
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


#: By character positions instead of lists of units.
ORACLE = """
with h as (
    select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || cast(doc_id as varchar)) as h from documents
), d as (
    select doc_id, t, n, cast('0x' || h[1:8] as bigint) % (n + 1) as x, cast('0x' || h[9:16] as bigint) % (n + 1) as y,
        cast('0x' || h[17:24] as bigint) % 100 as k3, cast('0x' || h[25:32] as bigint) % 100 as k4 from h
), f as (
    select doc_id, t, n, least(x, y) as a, greatest(x, y) as b,
        case when n = 0 or t like '%<P>%' or t like '%<S>%' or t like '%<M>%' or k3 >= 90 then 'plain' when k4 < 20 then 'spm' else 'psm' end as form from d
), o as (
    select *, case form when 'plain' then t
        when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end as out from f
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(out) as output_sha256, sha256(t) as restored_sha256
from o
"""
