"""Removal of repeated word windows by recompression.

Token runs and then, round by round, pairs are replaced by symbols. A symbol's name is a fingerprint of
what it stands for, so every task gives the same name to equal content: naming is global without a table
of names. Whether two neighbours form a pair depends on a bit of each name only. A symbol therefore has a
context, the words that decide that it exists there, and any two equal windows have the same symbols
wherever a context lies within the window. Each window is represented by its longest such symbol, ties by
name; a window without any by itself.

1. Each task sends the names of its documents' symbols to the names' buckets. Names that occur in one
   document only end here.
2. The windows that a shared name represents are verified: two independent prints of each window's words, 64
   bits each, go to the window's bucket, and a window goes if a smaller document has it. A name that many
   windows share, as a common phrase has in any surroundings, is thus dealt out by its windows.
3. The ranges found are joined back to the texts.

Names and windows that one task holds several times are settled in that task and sent once, so a name that
a third of all rows share costs a shuffle one entry for each task.

Defined cases: a null or empty text has no words; a null doc_id counts as larger than all others; rows
that share a doc_id are one document, so nothing is removed for another of them; text shorter than a
window loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from . import exchange as X
from .tables import WorkTable, bucket_count, release

SIZE = 13
ROUNDS = 5
LAST_ID = (1 << 63) - 1

NAME = {"key": "<u8", "rid": "<i8", "at": "<u4"}
WINDOW = {"window": "<u8", "check": "<u8", "doc": "<i8", "rid": "<i8", "at": "<u4"}
RANGE = {"rid": "<i8", "start": "<u4", "end": "<u4"}
SINGLE, SEVERAL, MARK = 0, 1, 2


def symbols(names: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """(name, start, end, context start, context end) of the runs and of each round's pairs. A context may reach past its document; no window does."""
    n = len(names)
    if not n:
        return []
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    times = (end - start).astype(np.uint64)
    name = np.where(times > 1, B.mix(names[start] * B.U64(3) + times), names[start])
    doc, low, high = doc[start], start - 1, end + 1
    out = [(name, start, end, low, high)]
    for k in range(rounds):
        right = (B.mix(name + B.U64(0x51ED270B * (k + 1))) & B.U64(1)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & near
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # the neighbour whose class left a symbol alone belongs to its context
        look = np.where(right, -1, 1)
        place = np.arange(len(name)) + look
        there = (place >= 0) & (place < len(name))
        there[there] = doc[place[there]] == doc[there]
        place = np.where(there, place, 0)
        alone = ~pair & ~second
        wide_low = np.where(alone, np.where(there, np.minimum(low, low[place]), np.where(right, start - 1, low)), low)
        wide_high = np.where(alone, np.where(there, np.maximum(high, high[place]), np.where(right, high, end + 1)), high)
        first = np.flatnonzero(pair)
        keep = np.flatnonzero(~second)
        joined = pair[keep]
        after = np.minimum(keep + 1, len(name) - 1)
        made = B.mix(name[keep] * B.U64(0x9E3779B97F4A7C15) + B.mix(name[after] + B.U64(0x632BE59BD9B4E019)))
        name, start, end, low, high, doc = (
            np.where(joined, made, name[keep]), start[keep], np.where(joined, end[after], end[keep]),
            np.where(joined, np.minimum(low[keep], low[after]), wide_low[keep]), np.where(joined, np.maximum(high[keep], high[after]), wide_high[keep]), doc[keep],
        )
        if not len(first):
            break
        out.append(tuple(x[joined] for x in (name, start, end, low, high)))
    return out


def representatives(block: B.Block, found: B.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of neighbouring windows with one representative: its key, the first window, how many; and the fingerprint of every window by its first word."""
    hashes = B.word_hashes(block, found)
    n = len(found)
    where = B.windows(found, size)
    prints = np.zeros(n, np.uint64)
    prints[where] = B.fingerprint(B.prefix(hashes), where, where + size)
    if not len(where):
        return np.zeros(0, np.uint64), where, where, prints
    name, start, end, low, high = (np.concatenate(x) for x in zip(*symbols(hashes, found.at), strict=True))
    fits = high - low <= size
    name, start, end, low, high = (x[fits] for x in (name, start, end, low, high))
    open_ = np.zeros(n + 1, bool)
    open_[where] = True
    last = np.searchsorted(found.at, start, side="right")
    first = np.maximum(high - size, found.at[last - 1])
    final = np.minimum(low, found.at[last] - size)
    best, chosen = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    priority = B.mix(name) | B.U64(1)
    for length in range(size - 2, 0, -1):
        total = np.zeros(n + 2, np.int64)
        np.cumsum(open_, out=total[1:])
        of = np.flatnonzero((end - start == length) & (first <= final))
        of = of[total[final[of] + 1] > total[first[of]]]
        if not len(of):
            continue
        span = final[of] - first[of] + 1
        spot, who = B.ragged(first[of], span), np.repeat(of, span)
        free = open_[spot]
        spot, who = spot[free], who[free]
        np.maximum.at(best, spot, priority[who])
        wins = priority[who] == best[spot]
        spot, who = spot[wins][::-1], who[wins][::-1]
        chosen[spot] = who  # of one name the leftmost
        open_[spot] = False
    keys = np.where(chosen[where] >= 0, B.mix(name[chosen[where]] + (end - start)[chosen[where]].astype(np.uint64)) if len(name) else B.U64(0), B.mix(prints[where] + B.U64(0x2545F4914F6CDD1D)))
    chosen = np.where(chosen[where] >= 0, chosen[where], -1 - where)
    new = np.ones(len(where), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (where[1:] != where[:-1] + 1)
    at = np.flatnonzero(new)
    return keys[at], where[at], np.diff(np.append(at, len(where))), prints


def _names(buckets: int, size: int):
    def flush(got: X.Gather) -> Iterator[pa.RecordBatch]:
        e = got.take()
        order, start = X.groups(e["key"], e["rid"])
        keys = e["key"][order[start]]
        several = np.zeros(len(start), bool)
        several[1:] = keys[1:] == keys[:-1]
        lead = ~several
        several[:-1] |= several[1:].copy()
        times = np.diff(np.append(start, len(order)))
        for kind, which in ((SINGLE, order[np.repeat(~several, times)]), (SEVERAL, order[start[several & lead]])):
            part = {k: v[which] for k, v in e.items()}
            yield X.blobs(NAME, X.bucket_of(part["key"], buckets), kind, **part)
        part = {k: v[order[np.repeat(several, times)]] for k, v in e.items()} | {"key": np.zeros(int(times[several].sum()), np.uint64)}
        yield X.blobs(NAME, X.bucket_of_ids(part["rid"], buckets), MARK, **part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = X.Gather(NAME)
        for batch in batches:
            for block in B.blocks(batch, key="rid"):
                found = B.words(block)
                key, where, many, _ = representatives(block, found, size)
                doc = np.searchsorted(found.at, where, side="right") - 1
                if got.add(key=key, rid=block.ids.to_numpy(zero_copy_only=False)[doc], at=(where - found.at[doc]) << 4 | many):
                    yield from flush(got)
        yield from flush(got)

    return run


def _shared(buckets: int):
    """Of the names in one bucket those of two documents or more, and the hits found in tasks."""

    def run(table: pa.Table) -> pa.Table:
        single, several, marks = (X.arrays(table, NAME, k) for k in (SINGLE, SEVERAL, MARK))
        e = {k: np.concatenate([single[k], several[k]]) for k in NAME}
        known = np.arange(len(e["key"])) >= len(single["key"])
        order, start = X.groups(e["key"], e["rid"])
        keys = e["key"][order[start]]
        shared = np.zeros(len(start), bool)
        shared[1:] = keys[1:] == keys[:-1]
        shared[:-1] |= shared[1:].copy()
        hit = order[np.repeat(shared, np.diff(np.append(start, len(order))))]
        hit = hit[~known[hit]]  # the others are among the marks
        part = {k: np.concatenate([marks[k], e[k][hit]]) for k in ("rid", "at")}
        part["key"] = np.zeros(len(part["rid"]), np.uint64)
        return pa.Table.from_batches([X.blobs(NAME, X.bucket_of_ids(part["rid"], buckets), MARK, **part)])

    return run


def _hits(table: pa.Table) -> pa.Table:
    """For each text the first window and the number of windows of each run of them that a shared name represents."""
    e = X.arrays(table, NAME)
    order, start = X.groups(e["rid"], e["at"])
    order = order[start]  # of rows that repeat one is enough
    at, rid = e["at"][order], e["rid"][order]
    _, start = X.groups(rid)
    rows = [(int(rid[s]), at[s:c].tobytes()) for s, c in X.spans(start, len(rid))]
    return pa.table({"rid": pa.array([r[0] for r in rows], pa.int64()), "hits": pa.array([r[1] for r in rows], pa.binary())})


def as_ranges(rid: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Windows as ranges of words, neighbours of one row joined."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order].astype(np.int64)
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return {"rid": rid[first], "start": at[first], "end": at[last] + size} if len(rid) else {"rid": rid, "start": at, "end": at}


def _later(e: dict[str, np.ndarray]) -> np.ndarray:
    """Entries whose window a smaller document has."""
    order, start = X.groups(e["window"], e["check"])
    if not len(order):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(e["doc"][order], start)
    out = np.zeros(len(order), bool)
    out[order] = e["doc"][order] > np.repeat(least, np.diff(np.append(start, len(order))))
    return out


def _windows(buckets: int, size: int):
    fields = WINDOW | {"end": "<u4"}

    def flush(got: X.Gather) -> Iterator[pa.RecordBatch]:
        e = got.take()
        later = _later(e)
        part = {k: v[~later] for k, v in e.items()}
        yield X.blobs(fields, X.bucket_of(part["window"], buckets), SINGLE, **part, end=part["at"])
        r = as_ranges(e["rid"][later], e["at"][later], size)
        zero = np.zeros(len(r["rid"]), np.uint64)
        yield X.blobs(fields, X.bucket_of_ids(r["rid"], buckets), MARK, window=zero, check=zero, doc=zero, rid=r["rid"], at=r["start"], end=r["end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = X.Gather(WINDOW)
        for batch in batches:
            for block in B.blocks(batch, key="rid"):
                found = B.words(block)
                where = B.windows(found, size)
                prints = np.zeros((2, len(found)), np.uint64)
                for k in (0, 1):
                    prints[k, where] = B.fingerprint(B.prefix(B.word_hashes(block, found, second=bool(k))), where, where + size)
                docs, rids = block.column("doc_id").to_numpy(zero_copy_only=False), block.ids.to_numpy(zero_copy_only=False)
                hits = [np.frombuffer(x.as_py(), "<u4") for x in block.column("hits")]
                row = np.repeat(np.arange(len(block)), [len(h) for h in hits])
                hits = np.concatenate(hits)
                many = (hits & 15).astype(np.int64)
                at = B.ragged((hits >> 4).astype(np.int64), many)
                row = np.repeat(row, many)
                if got.add(window=prints[0, found.at[row] + at], check=prints[1, found.at[row] + at], doc=docs[row], rid=rids[row], at=at):
                    yield from flush(got)
        yield from flush(got)

    return run, fields


def _verify(buckets: int, size: int, fields: dict[str, str]):
    def run(table: pa.Table) -> pa.Table:
        e, marks = X.arrays(table, fields, SINGLE), X.arrays(table, fields, MARK)
        later = _later(e)
        r = as_ranges(e["rid"][later], e["at"][later], size)
        r = {"rid": np.concatenate([marks["rid"], r["rid"]]), "start": np.concatenate([marks["at"], r["start"]]), "end": np.concatenate([marks["end"], r["end"]])}
        return pa.Table.from_batches([X.blobs(RANGE, X.bucket_of_ids(r["rid"], buckets), MARK, **r)])

    return run


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges with overlaps joined, a row each."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.column_stack([start[first], end[np.append(first[1:], len(start)) - 1]])


def _ranges(table: pa.Table) -> pa.Table:
    e = X.arrays(table, RANGE)
    order, start = X.groups(e["rid"])
    rows = [(int(e["rid"][order[s]]), merged(e["start"][order[s:c]], e["end"][order[s:c]]).astype("<u4").tobytes()) for s, c in X.spans(start, len(order))]
    return pa.table({"rid": pa.array([r[0] for r in rows], pa.int64()), "ranges": pa.array([r[1] for r in rows], pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            words = (text.as_py() or "").encode().split()
            kept = words
            if ranges.as_py():
                pairs = np.frombuffer(ranges.as_py(), "<u4").reshape(-1, 2).tolist()
                kept = [w for s, e in zip([0, *(e for _, e in pairs)], [*(s for s, _ in pairs), len(words)], strict=True) for w in words[s:e]]
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _find_hits(texts: DataFrame, buckets: int, size: int) -> WorkTable:
    """The first step's result. Its frames end with this call, so release() can drop their shuffle files."""
    names = texts.select("rid", "text").mapInArrow(_names(buckets, size), X.schema(NAME))
    shared = X.reduce_buckets(names, _shared(buckets), X.schema(NAME), buckets)
    return WorkTable(X.reduce_buckets(shared, _hits, "rid long, hits binary", buckets), "recompression-hits")


def _find_ranges(texts: DataFrame, hits: WorkTable, buckets: int, size: int) -> WorkTable:
    """The second step's result; its frames end with this call."""
    known = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID))).join(hits.read(), "rid")
    send, fields = _windows(buckets, size)
    windows = known.mapInArrow(send, X.schema(fields))
    verified = X.reduce_buckets(windows, _verify(buckets, size, fields), X.schema(RANGE), buckets)
    return WorkTable(X.reduce_buckets(verified, _ranges, "rid long, ranges binary", buckets), "recompression-ranges")


def remove_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document; needs doc_id and text, ignores all other columns. size: 3 to 15 words."""
    if not 3 <= size <= 15:
        raise ValueError("a window has 3 to 15 words")
    spark = docs.sparkSession
    buckets = bucket_count(docs)
    key = F.col("doc_id").cast("long")
    texts = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(key, F.col("text"), F.octet_length("text")).alias("rid"))
    hits = _find_hits(texts, buckets, size)
    release(spark)
    ranges = _find_ranges(texts, hits, buckets, size)
    hits.drop()
    release(spark)
    return texts.join(ranges.read(), "rid", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
