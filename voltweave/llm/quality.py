"""Quality rules with host verdicts.

Each document is measured once from its whole text. Rule failures are summed by host (the `source`
column), the hosts' failure rates are shrunk with a beta prior fitted to all hosts by moments, and a host
whose shrunk rate passes one half loses all its documents. Only counts by host and one row of moments
leave the documents' tasks; the verdicts come back by an equi-join that Spark may split where a host is hot.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own; repeated
rows count and are returned as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .tables import WorkTable

# The rules' limits.
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
MOST_SYMBOLS_PER_TEN_WORDS = 1
MOST_DUP_LINES_PERCENT = 50
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (2.0, 1000.0)

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(block: B.Block) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    found = B.words(block)
    inside = ~B.SPACE[block.buf]
    head = (block.buf & 0xC0) != 0x80  # first bytes of code points
    cuts = np.unique(np.concatenate([block.at, np.flatnonzero(block.buf == 10) + 1]))
    start, end = cuts[:-1], cuts[1:].copy()
    if len(end):
        end -= block.buf[end - 1] == 10
    worded = np.searchsorted(found.start, start) < np.searchsorted(found.start, end)
    start, end = start[worded], end[worded]
    line_at = np.searchsorted(start, block.at)
    of = np.repeat(np.arange(len(block)), np.diff(line_at)).astype(np.uint64)
    lines = B.mix(B.fingerprint(B.bytes_prefix(block.buf), start, end) ^ B.mix(of + B.U64(1)))
    again = np.ones(len(lines), bool)
    again[np.unique(lines, return_index=True)[1]] = False
    at = B.windows(found, 5)
    keys = B.fingerprint(B.prefix(B.word_hashes(block, found)), at, at + 5)
    keys = B.mix(keys ^ B.mix(found.doc[at].astype(np.uint64) + B.U64(1)))
    _, of_key, times = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[times[of_key] > 1]
    return {
        "n_words": np.diff(found.at),
        "word_chars": B.per_document(inside & head, block.at),
        "n_symbols": B.per_document(SYMBOL[block.buf], block.at),
        "n_lines": np.diff(line_at),
        "n_dup_lines": B.per_document(again, line_at),
        "n_repeat_words": B.per_document(B.covered(at, at + 5, len(found)), found.at),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in B.blocks(batch):
            got = measure(block)
            yield pa.record_batch([block.ids, block.column("host"), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], names=["doc_id", "host", *MEASURES])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed and rule_failed, a row per document."""
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    rules = (10 * F.col("n_symbols") > MOST_SYMBOLS_PER_TEN_WORDS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES_PERCENT * F.col("n_lines"))
    return got.withColumns({"base_failed": base}).withColumn("rule_failed", F.col("base_failed") | rules)


def host_verdicts(docs: DataFrame) -> DataFrame:
    """host, host_failed: from measured documents. The prior comes from one row of moments over all hosts."""
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    hosts = WorkTable(hosts, "hosts").read()  # documents are measured once
    sums = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square")).first()
    n, failed = sums["n"] or 0, sums["failed"] or 0
    mean = failed / n if n else 0.0
    spread = max((sums["square"] or 0.0) / n - mean * mean, 0.0) if n else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1 if spread else STRENGTH[1], STRENGTH[0]), STRENGTH[1])
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", (rate > HOST_LIMIT).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every document with its counts and verdict: kept unless a rule or its host rejects it."""
    base = WorkTable(measured(docs, host), "quality").read()
    verdicts = host_verdicts(base).withColumnRenamed("host", "of_host")
    out = base.join(verdicts, base["host"].eqNullSafe(verdicts["of_host"]), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("rule_failed") & ~F.col("host_failed")).alias("kept"))


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass the rules and whose host passes, with all their columns. Texts are not shuffled unless failed hosts are many."""
    failed = host_verdicts(measured(docs, host)).where("host_failed").select(F.col("host").alias("_failed_host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for block in B.blocks(batch, key="text"):
                m = measure(block)
                keep.append((m["n_words"] >= LEAST_WORDS) & (100 * m["n_repeat_words"] <= MOST_REPEAT_PERCENT * m["n_words"]) & (10 * m["n_symbols"] <= MOST_SYMBOLS_PER_TEN_WORDS * m["n_words"]) & (100 * m["n_dup_lines"] <= MOST_DUP_LINES_PERCENT * m["n_lines"]))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    passed = docs.mapInArrow(run, docs.schema)
    return passed.join(failed, passed[host].cast("string").eqNullSafe(failed["_failed_host"]), "left_anti")
