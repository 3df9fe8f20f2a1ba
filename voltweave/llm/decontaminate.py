"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of token positions of which some are ignored, so a seed survives substitutions at
those positions. The seeds of every benchmark item are joined with the seeds of all documents; around each
hit the item and the document are compared token by token on the hit's diagonal, and any stretch counts that
begins and ends with an agreeing token, has at most DROP others in a row, is long enough, and has at least
the stated share of its tokens agreeing; agreeing tokens beside it never take it away.

Benchmark items travel to the tasks in blocks of a checked size, one pass over the documents for each
block, so what is broadcast never grows with either table. A document's evidence stays in the task that
reads the document: nothing is shuffled.

Tokens are runs of ASCII letters and digits and of bytes above 127, with A-Z lower-cased.

The masks leave no accepted pattern of substitutions without a seed: those for long items none of any length
from 13 tokens, those for shorter items none of the whole item, which has to agree at both ends.

Defined cases: null or empty texts and items have no tokens and match nothing; items of fewer than 13 tokens,
one token included, match as a whole; repeated documents repeat, a repeated
item counts once; of stretches of one item in one document the one
with most agreeing tokens is returned, ties by the smallest start. Documents that overlap an item whose item_id
is null are dropped like any other; find_overlaps() reports pairs of ids and leaves out items without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

# The masks; 1 is a position that must agree.
MASKS = ("111111", "1101011001", "11001010011", "1011000010111", "110010111")
#: Masks of items of so many tokens; all below LEAST_TOKENS.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("11",), 6: ("111",), 7: ("111",)} | {n: ("1111", "1100101") for n in range(8, 13)}
#: Least tokens of a stretch (or the whole item where that is shorter), and the percent that must agree.
LEAST_TOKENS = 13
AGREE_PERCENT = 80
#: Bytes of benchmark text that one pass may broadcast.
BLOCK_BYTES = 8 << 20
#: Tokens that may disagree in a row before a stretch ends.
DROP = 4
#: Candidate tokens held at once while hits are gathered and verified.
PAIRS = 1 << 21

MATCH = "doc_id long, item_id long, start_token long, n_aligned long, n_agree long"


def offsets(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def seeds(tokens: np.ndarray, at: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a mask within one text each, and the fingerprint of the tokens it selects. at: offsets of the texts."""
    last = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(tokens)) + len(mask) <= last)
    total = np.full(len(start), salt, np.uint64)
    for k, o in enumerate(offsets(mask)):
        total += tokens[start + o] * B.U64(pow(B.BASE, 2 * k + 3, 1 << 64))
    return start, B.mix(total)


class Seeds:
    """The seeds of some items, sorted, behind a bit table that most document seeds do not pass."""

    def __init__(self, items: list[tuple[int, str]]):
        batch = pa.record_batch([pa.array([i for i, _ in items], pa.int64()), pa.array([t or "" for _, t in items], pa.string())], names=["item_id", "text"])
        self.ids, tokens, at = [], [], [0]
        for block in B.blocks(batch, key="item_id"):
            found = B.words(block, B.NOT_ALNUM)
            tokens.append(B.word_hashes(block, found, lower=True))
            at += (at[-1] + found.at[1:]).tolist()
            self.ids += block.ids.to_pylist()
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.at = np.array(at)
        self.size = np.diff(self.at)
        self.masks, found = [], []
        for k, mask in enumerate(dict.fromkeys((*MASKS, *(m for x in SHORT_MASKS.values() for m in x)))):
            start, key = seeds(self.tokens, self.at, mask, k)
            takes = np.array([mask in SHORT_MASKS.get(n, ()) for n in range(LEAST_TOKENS)] + [mask in MASKS])
            used = takes[np.minimum(self.size, LEAST_TOKENS)[self.item(start)]]
            if used.any():
                self.masks.append((k, mask))
                found.append((start[used], key[used]))
        keys, where = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, t) for i, t in ((1, np.uint64), (0, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = keys[order], where[order]
        self.bits = 1 << max(16, int(len(keys) * 16).bit_length())
        self.table = np.zeros(self.bits, bool)
        self.table[(self.keys & B.U64(self.bits - 1)).astype(np.int64)] = True

    def item(self, where: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, where, side="right") - 1

    def whole(self, tokens: np.ndarray, at: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int, int]]]:
        """The best stretch of each document and short item of these hits: the item as a whole, agreeing at both ends."""
        size = self.size[item]
        inside = (diagonal >= 0) & (diagonal + size <= np.diff(at)[doc])
        doc, item, diagonal, size = (x[inside] for x in (doc, item, diagonal, size))
        here, there = at[doc] + diagonal, self.at[item]
        n = sum(((size > k) & (tokens[np.minimum(here + k, here + size - 1)] == self.tokens[np.minimum(there + k, there + size - 1)])).astype(np.int64) for k in range(LEAST_TOKENS - 1))
        good = (100 * n >= AGREE_PERCENT * size) & (tokens[here] == self.tokens[there]) & (tokens[here + size - 1] == self.tokens[there + size - 1])
        doc, item, diagonal, size, n = (x[good] for x in (doc, item, diagonal, size, n))
        order = np.lexsort((diagonal, -n, item, doc))
        first = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)])] if len(order) else order
        for d, i, s, e, m in zip(*(x[first].tolist() for x in (doc, item, diagonal, size, n)), strict=True):
            yield (d, i), (s, e, m)

    def matches(self, block: B.Block) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document row, item row) -> (start token, aligned, agreeing) of the best stretch."""
        found = B.words(block, B.NOT_ALNUM)
        tokens = B.word_hashes(block, found, lower=True)
        long, short = [], []
        for k, mask in self.masks:
            start, keys = seeds(tokens, found.at, mask, k)
            near = np.flatnonzero(self.table[(keys & B.U64(self.bits - 1)).astype(np.int64)])
            if not len(near):
                continue
            low, high = np.searchsorted(self.keys, keys[near]), np.searchsorted(self.keys, keys[near], side="right")
            hit = np.flatnonzero(high > low)
            place, low, many = start[near[hit]], low[hit], (high - low)[hit]
            total = np.cumsum(many)
            for s, e in parts(total, PAIRS):
                where = self.where[B.ragged(low[s:e], many[s:e])]
                here = np.repeat(place[s:e], many[s:e])
                doc, item = np.searchsorted(found.at, here, side="right") - 1, self.item(where)
                diagonal = here - found.at[doc] - where + self.at[item]
                # Hits on one diagonal of one document and item are one.
                order = np.lexsort((diagonal, item, doc))
                doc, item, diagonal = (x[order] for x in (doc, item, diagonal))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
                (long if mask in MASKS else short).append((doc[new], item[new], diagonal[new]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if short:
            best.update(self.whole(tokens, found.at, *(np.concatenate(x) for x in zip(*short, strict=True))))
        if long:
            for d, i, start, length, n in self.along(tokens, found.at, *np.unique(np.column_stack([np.concatenate(x) for x in zip(*long, strict=True)]), axis=0).T):
                other = best.get((d, i))
                if other is None or (-n, start) < (-other[2], other[0]):
                    best[d, i] = (start, length, n)
        return best

    def along(self, tokens: np.ndarray, at: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Document, item, start, length and agreeing tokens of the best stretch of each chain on these diagonals, in their order."""
        low, high = np.maximum(0, diagonal), np.minimum(np.diff(at)[doc], diagonal + self.size[item])
        length = high - low
        least = np.minimum(LEAST_TOKENS, self.size[item])
        for s, e in parts(np.cumsum(length), PAIRS):
            n = length[s:e]
            here = B.ragged(at[doc[s:e]] + low[s:e], n)
            there = B.ragged(self.at[item[s:e]] + low[s:e] - diagonal[s:e], n)
            agree = np.flatnonzero(tokens[here] == self.tokens[there])
            first = np.cumsum(n) - n
            of = np.searchsorted(first, agree, side="right") - 1
            # Chains: agreeing tokens of one diagonal with at most DROP others between two; most are too short to look at.
            new = np.ones(len(agree), bool)
            new[1:] = (of[1:] != of[:-1]) | (np.diff(agree) > DROP + 1)
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(agree))
            lead = of[start]
            good = np.flatnonzero(100 * (end - start) >= AGREE_PERCENT * least[s:e][lead])
            for a, b, k in zip(start[good].tolist(), end[good].tolist(), lead[good].tolist(), strict=True):
                chain = agree[a:b] - first[k]
                for where, size, m in stretches_at(chain, int(least[s + k])):
                    yield int(doc[s + k]), int(item[s + k]), int(low[s + k]) + where, size, m


def parts(total: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sums are at most limit, or one entry; total: running sums."""
    start = 0
    while start < len(total):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield start, end
        start = end


def stretches(agree: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Start, length and agreeing tokens of the best stretch of each chain, a longest piece with at most DROP others in a row."""
    hits = np.flatnonzero(agree)
    return [x for h in np.split(hits, np.flatnonzero(np.diff(hits) > DROP + 1) + 1) for x in stretches_at(h, least)]


def stretches_at(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The best stretch of one chain of agreeing places, if any is good enough."""
    if not len(h) or 100 * len(h) < AGREE_PERCENT * least:
        return []
    # Hits i to j are a stretch if value[j] >= value[i] - spare; the last such j is the longest for i.
    value, spare = 100 * np.arange(len(h)) - AGREE_PERCENT * h, 100 - AGREE_PERCENT
    later = np.maximum.accumulate(value[::-1])[::-1]
    last = np.searchsorted(-later, spare - value, side="right") - 1
    n = np.where(h[last] - h + 1 >= least, last - np.arange(len(h)) + 1, 0)
    k = int(n.argmax())
    return [(int(h[k]), int(h[last[k]] - h[k] + 1), int(n[k]))] if n[k] else []


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, each once, in blocks of about so many bytes each, by a hash of the item, and never all at once."""
    benchmark = benchmark.select("item_id", "text").distinct()
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    passes = -(-size // block_bytes) or 1
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id and the best stretch of each pair that overlaps; uses doc_id, text, item_id, and no other column."""
    out = None
    for items in benchmark_blocks(benchmark.where("item_id IS NOT NULL"), block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Seeds(sent.value)
            for batch in batches:
                rows = []
                for block in B.blocks(batch):
                    ids = block.ids.to_pylist()
                    rows += [(ids[d], index.ids[i], *x) for (d, i), x in index.matches(block).items()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=[x.split()[0] for x in MATCH.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that overlap no item, with all their columns. Each block of items is a filter; nothing is joined or shuffled."""
    for items in benchmark_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Seeds(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in B.blocks(batch, key="text"):
                    clean[[block.first + d for d, _ in index.matches(block)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
