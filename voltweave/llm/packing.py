"""Packing of whole documents into fixed windows through a hierarchy of context sizes.

Tokenizing, cutting and packing all happen in the task that reads a document: no shuffle, nothing to
skew. Every task is deterministic, so a repeated task gives the same sequences and the same ids.

A document's whole windows become sequences of their own. What is left is routed to the smallest tier
that holds it (2048, 1024, 512 or 256 tokens). Each tier packs its own windows; a window's gap is filled
with the largest waiting piece of a shorter tier that fits, and the last of the gap by cutting one piece.
The rest at a task's end is cut into windows of a power of two, which need no padding. Sequences of one length
form step groups of as many tokens each, and of as even a number of pieces as they allow.

Defined cases: a null or empty text is one end token; a null doc_id stays null; repeated rows are packed
as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bytetext as B

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of one optimizer step; the sequences of a step all have one length.
STEP_TOKENS = 16384
#: Tokens of documents that are packed together: the more there are, the fewer are cut.
PACKED_TOKENS = 1 << 21
#: Distinct pieces whose ids a worker remembers before it starts anew (some 40 bytes each), and how many are encoded in one call.
CACHED_WORDS = 1 << 19
JOINED_PIECES = 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# What the tokenizer's splitter makes of bytes. Letters, single digits and runs of other signs are
# pieces of their own; a word with an apostrophe (a contraction), a bar (a special token), a control character or a
# character beyond the Latin-1 letters is left whole for the tokenizer.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[0x27, 0x7C]] = OTHER
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
#: The second byte of a Latin-1 letter after 0xC3, and its lower case; the signs for times and divided are no letters.
SECOND = np.full(256, OTHER, np.uint8)
SECOND[0x80:0xC0] = LETTER
SECOND[[0x97, 0xB7]] = OTHER
SECOND_LOWER = np.arange(256, dtype=np.uint8)
SECOND_LOWER[0x80:0x9F] += 0x20


def pieces(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what the tokenizer splits a text into, where each document's start, which are whole words left to it, and all bytes in the lower case of the rest."""
    buf, found = block.buf, B.words(block)
    kind, low = KIND[buf], B.LOWER[buf]
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    kind[second], low[second] = SECOND[buf[second]], SECOND_LOWER[buf[second]]
    odd = B.per_document(kind == OTHER, np.append(found.start, len(buf))) > 0 if len(found) else np.zeros(0, bool)
    new = np.zeros(len(buf), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new[kind == BLANK] = False
    new[found.start] = True
    start = np.flatnonzero(new)
    word = np.searchsorted(found.start, start, side="right") - 1
    keep = ~odd[word] | (start == found.start[word])
    start, word = start[keep], word[keep]
    end = found.end[word]
    inner = np.flatnonzero(word[1:] == word[:-1])
    end[inner] = start[inner + 1]
    whole = odd[word]
    raw = B.ragged(start[whole], (end - start)[whole])
    low[raw] = buf[raw]
    return start, end, np.searchsorted(start, block.at), whole, low


class WordTokenizer:
    """Ids of whole texts, one distinct piece at a time.

    The tokenizer's own splitter never joins across white space, and lower-cases; so a text's ids are its
    pieces' ids in order. Each distinct piece is encoded once and its ids are gathered for every occurrence.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.array([END_ID], np.uint32)

    def learn(self, hashes: np.ndarray, texts: list[str], whole: np.ndarray) -> None:
        """texts: distinct pieces in the order of their hashes, which are new and sorted."""
        length, parts = np.zeros(len(texts), np.int64), []
        order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
        plain = len(texts) - int(whole.sum())
        for k in range(0, plain, JOINED_PIECES):
            which = order[k : min(k + JOINED_PIECES, plain)]
            ids = np.array(self.encode([" ".join(texts[i] for i in which.tolist())], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(which):
                raise RuntimeError("the tokenizer splits a piece")
            length[which] = np.diff(ends, prepend=0)
            parts.append(ids)
        rows = [x.ids for x in self.encode([texts[i] for i in order[plain:].tolist()], add_special_tokens=False)] if plain < len(texts) else []
        length[order[plain:]] = [len(r) for r in rows]
        parts.append(np.fromiter((i for r in rows for i in r), np.uint32))
        at = np.empty(len(texts), np.int64)
        at[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        self.ids = np.concatenate([self.ids, *parts])
        spot = np.searchsorted(self.known, hashes)
        self.known, self.at, self.length = np.insert(self.known, spot, hashes), np.insert(self.at, spot, at), np.insert(self.length, spot, length)

    def __call__(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, an end id after each document, and where each document's ids start."""
        start, end, at, whole, low = pieces(block)
        hashes = B.fingerprint(B.bytes_prefix(low), start, end)
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        spot = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(spot, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            raw, one = low.tobytes(), first[new]
            self.learn(distinct[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)], whole[one])
            spot = np.searchsorted(self.known, distinct)
        start, length = self.at[spot][of], self.length[spot][of]
        start, length = np.insert(start, at[1:], 0), np.insert(length, at[1:], 1)
        ends = at[1:] + np.arange(len(block))
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return self.ids[B.ragged(start, length)], np.concatenate([[0], total[ends + 1]])


@lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    """A worker's tokenizer, which remembers pieces from one task to the next; ids do not depend on what it remembers."""
    return WordTokenizer(path)


class Steps:
    """Groups of sequences of one length for optimizer steps. All groups of a length have as many sequences, but for the last of a task; sequences of many pieces are dealt to the groups that have fewest."""

    def __init__(self, tokens: int = STEP_TOKENS):
        self.tokens, self.serial = tokens, 0
        self.open: dict[int, list[int]] = {}  # of each length the group that has room: its number, sequences, pieces

    def deal(self, made: list[tuple[int, list[tuple]]]) -> list[int]:
        """The group of each sequence (length, pieces)."""
        out, by_size = [0] * len(made), {}
        for k, (size, _) in enumerate(made):
            by_size.setdefault(size, []).append(k)
        for size, which in by_size.items():
            each, left = max(1, self.tokens // size), len(which)
            groups = []  # pieces, number, room, sequences before
            while left:
                number, n, pieces = self.open.pop(size, None) or [self.serial, 0, 0]
                self.serial += number == self.serial
                room = min(each - n, left)
                groups.append([pieces, number, room, n + room])
                left -= room
            if groups[-1][3] < each:
                self.open[size] = groups[-1]
            heap = list(groups)
            heapq.heapify(heap)
            for k in sorted(which, key=lambda k: -len(made[k][1])):
                group = heap[0]
                out[k] = group[1]
                group[0] += len(made[k][1])
                group[2] -= 1
                heapq.heapreplace(heap, group) if group[2] else heapq.heappop(heap)
            if size in self.open:
                pieces, number, _, n = self.open[size]
                self.open[size] = [number, n, pieces]
        return out


class Packer:
    """Sequences of one task. A piece is (document row, start, length); waiting[t] is sorted by length."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.made: list[tuple[int, list[tuple]]] = []
        self.total = dict.fromkeys(tiers, 0)  # tokens that wait in each tier

    def pack(self, lengths: np.ndarray, last: bool) -> None:
        """Packs the pieces of some documents. What fills no window waits for the next call, and is cut at the last."""
        window = self.tiers[-1]
        waiting = getattr(self, "waiting", None) or {t: [] for t in self.tiers}
        self.waiting = waiting
        base = getattr(self, "rows", 0)
        for k, n in enumerate(lengths.tolist(), base):
            for start in range(0, n - window + 1, window):
                self.made.append((window, [(k, start, window)]))
            if n % window:
                self.route((n % window, k, n - n % window))
        self.rows = base + len(lengths)
        for tier in reversed(self.tiers):
            while waiting[tier] and sum(self.total[t] for t in self.tiers if t <= tier) >= tier:
                self.fill(tier)
        if last:
            rest = [x for t in reversed(self.tiers) for x in waiting[t]]
            total = sum(x[0] for x in rest)
            for size in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
                if total & size:
                    pieces, room = [], size
                    while room:
                        n, k, start = rest.pop(0)
                        if n > room:
                            rest.insert(0, (n - room, k, start + room))
                            n = room
                        pieces.append((k, start, n))
                        room -= n
                    self.made.append((size, pieces))
            self.waiting = {t: [] for t in self.tiers}
            self.total = dict.fromkeys(self.tiers, 0)

    def route(self, piece: tuple[int, int, int]) -> None:
        tier = next(t for t in self.tiers if piece[0] <= t)
        bisect.insort(self.waiting[tier], piece)
        self.total[tier] += piece[0]

    def fill(self, tier: int) -> None:
        """One full window of a tier: its longest piece, then the longest that fits, at last part of one."""
        pieces, room = [], tier
        while room:
            best = None
            for t in reversed([t for t in self.tiers if t <= tier]):
                k = bisect.bisect_right(self.waiting[t], (room, 1 << 62)) - 1
                if k >= 0:
                    best = self.waiting[t].pop(k)
                    self.total[t] -= best[0]
                    break
            if best is None:
                t = next(t for t in self.tiers if t <= tier and self.waiting[t])
                n, k, start = self.waiting[t].pop(0)
                self.total[t] -= n
                self.route((n - room, k, start + room))
                best = (room, k, start)
            pieces.append((best[1], best[2], best[0]))
            room -= best[0]
        self.made.append((tier, pieces))


def pack_partition(path: str, tiers: tuple[int, ...] = TIERS):
    """For mapInArrow: pieces of every document of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        packer, task = Packer(tiers), TaskContext.get().partitionId()
        number, steps = 0, Steps()
        held: dict[int, tuple] = {}  # ids of documents that still have a waiting piece

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for step, (size, pieces) in zip(steps.deal(packer.made), packer.made, strict=True):
                offset = 0
                for k, start, n in pieces:
                    doc, ids = held[k]
                    rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), (task << 40) | number, offset, size, (task << 40) | step))
                    offset += n
                number += 1
            packer.made = []
            wait = {x[1] for tier in packer.waiting.values() for x in tier}
            for k in [k for k in held if k not in wait]:
                del held[k]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        lengths, size, rows = [], 0, 0
        for batch in batches:
            for block in B.blocks(batch):
                ids, at = tokenizer(block)
                for k, (doc, s, e) in enumerate(zip(block.ids.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True), rows):
                    held[k] = (doc, ids[s:e])
                lengths.append(np.diff(at))
                size, rows = size + len(ids), rows + len(block)
                if size >= PACKED_TOKENS:
                    packer.pack(np.concatenate(lengths), last=False)
                    yield flush()
                    lengths, size = [], 0
        packer.pack(np.concatenate(lengths) if lengths else np.zeros(0, np.int64), last=True)
        yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece; needs doc_id and text, ignores all other columns."""
    return docs.select("doc_id", "text").mapInArrow(pack_partition(tokenizer or default_tokenizer(), tiers), SCHEMA)
