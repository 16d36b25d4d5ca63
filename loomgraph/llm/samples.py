"""Bounded samples of labelled rows, to fit a classifier on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SAMPLE_BYTES = 16 << 20  # of text of each label
_LONGEST = 1 << 20  # bytes of a text that a sample may hold
_STEPS = 1 << 40


def held_out(modulus: int, remainder: int):
    """Whether a document is kept from training: crc32 of its id as text leaves this remainder; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def placed(documents: DataFrame) -> DataFrame:
    """The documents of up to 1 MB with ``place``, by a hash of doc_id and text, and ``size`` in bytes. Before any
    join with labels, so that only the chosen texts are shuffled."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_STEPS))
    return documents.withColumns({"place": place, "size": F.octet_length("text")}).where(F.col("size") <= _LONGEST)


def labelled_sample(rows: DataFrame, label: str, bound: int, max_bytes: int = SAMPLE_BYTES) -> list[Row]:
    """At most ``bound`` of the ``placed`` rows and ``max_bytes`` of text of each label (few distinct ones), by place;
    equal rows count once, so one key that many rows share, or no key, fills no sample.

    Columns text, place, size and ``label``, none null. Whole texts. Places and sizes of about 1.3 times
    ``bound`` rows reach the driver first, then the texts of the chosen alone.
    """
    short = rows.select(label, "place", "size")
    counts = {r[0]: r[1] for r in short.groupBy(label).agg(F.approx_count_distinct("place")).collect()}
    ahead = lambda limits: reduce(lambda a, b: a | b, [(F.col(label) == v) & (F.col("place") <= n) for v, n in limits.items()], F.lit(False))
    near = short.where(ahead({v: int(_STEPS * min(1.0, 1.3 * bound / max(n, 1))) for v, n in counts.items()})).distinct()
    last, held = {}, {v: [0, 0] for v in counts}
    for value, place, size in sorted(map(tuple, near.collect()), key=lambda r: r[1:]):
        held[value] = [held[value][0] + 1, held[value][1] + size]
        if held[value][0] <= bound and held[value][1] <= max_bytes:
            last[value] = place
    chosen = rows.select("text", label, "place").where(ahead(last)).dropDuplicates([label, "place"]).collect()
    return sorted(chosen, key=lambda r: (r["place"], str(r[label])))
