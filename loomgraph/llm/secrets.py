"""Secret scanning with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch
from loomgraph.llm.worker import parts, release


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``hints``: lower-case strings of which a text with a match has one, so that others are passed over fast;
    none: every text is searched.
    """

    kind: str
    pattern: re.Pattern
    group: int
    least: int
    hints: tuple[str, ...] = ()


#: The base rules. A run of hex digits is found where 32 of them stand together.
RULES = (
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("akia",)),
    Rule("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    """A name that changes with the rules."""
    return hashlib.sha256(repr([(r.kind, r.pattern.pattern, r.pattern.flags, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def find_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in code points, end exclusive, by start and then by rule."""
    low, found = None, []
    for k, rule in enumerate(rules):
        if rule.hints:
            low = text.lower() if low is None else low
            if not any(h in low for h in rule.hints):
                continue
        for m in rule.pattern.finditer(text):
            a, b = m.span(rule.group)
            if b - a >= rule.least:
                found.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    release()
    for batch in batches:
        for part in parts(batch.column("content"), 1 << 20):
            rows = batch.slice(part.start, part.stop - part.start)
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, rules)] for t in rows.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("blob"), pa.array(spans, spans_type)], ["blob", "spans"])


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every version of every path.

    ``versions``: ``content`` and any columns that name a path and version. Each content is addressed by
    its SHA-256; contents that ``ledger`` (a Parquet folder of blob, rules, spans; made where missing) has
    under this version of the rules are not scanned again, and of equal contents one is scanned; copies are
    combined before that shuffle. New findings, empty ones too, are appended to the ledger and joined back to
    all versions: adds blob and spans (array of kind, start, end), in place of columns that have these names.
    That join deals versions by blob; Spark splits the large partition that a group of copies makes. A null
    content is an empty one.
    """
    spark = versions.sparkSession
    text = F.coalesce("content", F.lit(""))
    versions = versions.drop("blob", "spans").withColumn("content", text).withColumn("blob", F.sha2(text.cast("binary"), 256))
    version = rules_version(rules)
    known = _ledger(spark, ledger)
    blobs = versions.groupBy("blob").agg(F.any_value("content").alias("content"))
    if known is not None:
        blobs = blobs.join(known.where(F.col("rules") == version).select("blob").distinct(), "blob", "left_anti")
    found = blobs.mapInArrow(partial(_scan, rules=rules), "blob string, spans array<struct<kind:string,start:long,end:long>>")
    found.withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    findings = _ledger(spark, ledger).where((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans")
    joined = versions.drop("content").join(findings.dropDuplicates(["blob"]), "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's table; None where it has not been begun."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("blob string, spans array<struct<kind:string,start:bigint,end:bigint>>, rules string").parquet(path)


def joined_spans(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of each span, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


LEDGER = "spark.loomgraph.secrets.ledger"


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. The session's setting ``spark.loomgraph.secrets.ledger`` names a ledger that
    outlives the run; where it is unset, each run begins its own."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    found = scan_versions(documents, spark.conf.get(LEDGER, None) or f"{Scratch(spark, 'secrets').root}/ledger")
    base = tuple(r.kind for r in RULES)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined_spans(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
