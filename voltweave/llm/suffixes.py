"""Exact removal of repeated byte strings by sorted suffixes.

Every string of SIZE bytes holds an anchor: the gram of GRAM bytes with the smallest fingerprint among its
grams. Equal strings have their anchor at the same place, so only suffixes that start at an anchor need
comparing, and only with those whose gram is the same.

1. Each task finds its documents' anchors and the context of each: up to SIZE - GRAM bytes before it and
   SIZE from it on. Equal contexts are collapsed in the task and again in the gram's bucket: all their
   strings repeat. One context of each kind is left, and only where a gram has several kinds.
2. Those contexts are put in the order of their suffixes from the anchor, and of their reversed prefixes,
   by deep-shallow sorting: multikey quicksort, eight bytes a step and all groups of a depth at once, down
   to a shallow depth; then a blind trie for each group that still shares a long common prefix. Two
   contexts share the string that starts d bytes before the anchor if they lie in one interval of the
   suffix order with SIZE - d common bytes and in one interval of the prefix order with d. Intervals
   follow from neighbours' common prefixes, so no pairs are formed.
3. A gram with very many different contexts, as a common line has, is dealt out instead of sorted: its contexts'
   strings go each to its own bucket, as two independent prints of 64 bits, and are settled in a task first. A
   task that finds such a gram says so in the gram's bucket with one entry, so a hot gram fills no bucket.
4. The ranges found are joined back to the texts.

Contexts that are equal as a whole are told by a print of 64 bits among those of one gram only.

What a shuffle moves is anchors (one in some 70 bytes), then contexts that differ near a repeat, and the
texts once for each of the last two steps. Work tables of requests and ranges cut the lineage.

Defined cases: a null or empty text has no bytes and loses none; documents with equal texts, repeated rows
included, are documents of their own and lose all that is long enough; doc_id is only carried.
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

SIZE = 200
GRAM = 64
#: Bytes that multikey quicksort looks at before tries take over: beyond the common gram for suffixes.
SHALLOW = 96
SHALLOW_PREFIX = 32
#: A byte that no UTF-8 text has; it ends a context.
PAD = 0xFF

#: Different contexts of one gram that a task sends, and that a bucket sorts, at most.
HOT_TASK, HOT_BUCKET = 1024, 1 << 14
#: Contexts whose strings are dealt out at once.
DEALT = 1 << 12

ANCHOR = {"key": "<u8", "ctx": "<u8", "uid": "<i8", "at": "<u4", "right": "<u2"}
REPLY = {"uid": "<i8", "at": "<u4", "right": "<u2", "key": "<u8", "many": "<u1"}
REQUEST = np.dtype([("key", "<u8"), ("at", "<u4"), ("right", "<u2"), ("many", "<u1")])
SINGLE, SEVERAL, MARK, HOT, STRING, STRINGS = range(6)
#: Bits of many: other contexts are equal as a whole; the context is dealt out.
EQUAL, DEAL = 1, 2


def context(size: int, gram: int) -> dict[str, str]:
    return {"key": "<u8", "uid": "<i8", "at": "<u4", "left": "<u2", "right": "<u2", "many": "<u1", "data": f"V{2 * size - gram}"}


def slide(values: np.ndarray, size: int, op) -> np.ndarray:
    """op over each window of so many values, by doubling."""
    out, done = values, 1
    while 2 * done <= size:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[: len(out) - (size - done)], out[size - done :]) if done < size else out


def anchors(buf: np.ndarray, at: np.ndarray, sums: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that hold the smallest gram of some whole string of one document, and the grams' fingerprints."""
    if len(buf) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(len(buf) - gram + 1)
    grams = B.fingerprint(sums, start, start + gram) | B.U64(1)
    least = slide(grams, size - gram + 1, np.minimum)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        least[max(s, e - size + 1) : e] = 0  # strings that would leave their document
    padded = np.zeros(len(least) + 2 * (size - gram), np.uint64)
    padded[size - gram : size - gram + len(least)] = least
    where = np.flatnonzero(slide(padded, size - gram + 1, np.maximum) == grams)
    return where, grams[where]


def _find(buckets: int, size: int, gram: int, hot: int):
    def flush(got: X.Gather) -> Iterator[pa.RecordBatch]:
        e = got.take()
        order, start = X.groups(e["key"], e["ctx"])
        times = np.diff(np.append(start, len(order)))
        one = order[start]
        _, of, kinds = np.unique(e["key"][one], return_inverse=True, return_counts=True)
        dealt = kinds[of] > hot if len(one) else np.zeros(0, bool)
        for kind, which in ((SINGLE, one[(times == 1) & ~dealt]), (SEVERAL, one[(times > 1) & ~dealt])):
            part = {k: v[which] for k, v in e.items()}
            yield X.blobs(ANCHOR, X.bucket_of(part["key"], buckets), kind, **part)
        keys = np.unique(e["key"][one[dealt]])
        zero = np.zeros(len(keys), np.int64)
        yield X.blobs(ANCHOR, X.bucket_of(keys, buckets), HOT, key=keys, ctx=zero, uid=zero, at=zero, right=zero)
        again = order[np.repeat(times > 1, times)]
        for kind, which, key in ((MARK, again, 0), (HOT, one[dealt], 1)):
            part = {k: v[which] for k, v in e.items()} | {"key": np.zeros(len(which), np.uint64), "ctx": np.full(len(which), key, np.uint64)}
            yield X.blobs(ANCHOR, X.bucket_of_ids(part["uid"], buckets), MARK, **part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = X.Gather(ANCHOR)
        for batch in batches:
            for block in B.blocks(batch, key="uid"):
                sums = B.bytes_prefix(block.buf)
                where, key = anchors(block.buf, block.at, sums, size, gram)
                doc = block.documents(where)
                start, end = np.maximum(where - (size - gram), block.at[doc]), np.minimum(where + size, block.at[doc + 1])
                ctx = B.mix(B.fingerprint(sums, start, end) ^ B.mix((where - start).astype(np.uint64)))
                if got.add(key=key, ctx=ctx, uid=block.ids.to_numpy(zero_copy_only=False)[doc], at=where - block.at[doc], right=end - where):
                    yield from flush(got)
        yield from flush(got)

    return run


def _compare(buckets: int, hot: int):
    """Of the anchors in one bucket of grams: marks for equal contexts, requests where contexts differ."""

    def run(table: pa.Table) -> pa.Table:
        single, several, passed, flags = (X.arrays(table, ANCHOR, k) for k in (SINGLE, SEVERAL, MARK, HOT))
        e = {k: np.concatenate([single[k], several[k]]) for k in ANCHOR}
        many = np.arange(len(e["key"])) >= len(single["key"])
        order, start = X.groups(e["key"], e["ctx"])
        size = np.diff(np.append(start, len(order)))
        total = np.add.reduceat(1 + many[order].astype(np.int64), start) if len(start) else size
        again = order[np.repeat(total > 1, size)]
        keys = e["key"][order[start]]
        _, of, kinds = np.unique(keys, return_inverse=True, return_counts=True)
        dealt = (kinds[of] > hot) | np.isin(keys, flags["key"]) if len(keys) else np.zeros(0, bool)
        ask = np.flatnonzero((kinds[of] > 1) | dealt) if len(keys) else np.zeros(0, np.int64)
        names = ("uid", "at", "right", "key")
        own = passed["ctx"] == 0  # the others ask to be dealt out
        marks = {k: np.concatenate([passed[k][own], e[k][again]]) for k in names} | {"many": np.full(int(own.sum()) + len(again), EQUAL)}
        asked = {k: np.concatenate([passed[k][~own], e[k][order[start[ask]]]]) for k in names}
        asked["many"] = np.concatenate([np.full(int((~own).sum()), DEAL), np.where(total[ask] > 1, EQUAL, 0) | np.where(dealt[ask], DEAL, 0)])
        return pa.Table.from_batches([X.blobs(REPLY, X.bucket_of_ids(part["uid"], buckets), kind, **part) for kind, part in ((MARK, marks), (SINGLE, asked))])

    return run


def ranges_bytes(start: np.ndarray, end: np.ndarray) -> bytes:
    """Overlapping or touching ranges merged, as pairs of 32-bit numbers."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.append(True, start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return np.column_stack([start[first], end[np.append(first[1:], len(start)) - 1]]).astype("<u4").tobytes()


def _by_text(size: int, gram: int):
    """Of the replies in one bucket of texts: a row for each text with its marked ranges and requests."""

    def run(table: pa.Table) -> pa.Table:
        marks, asked = X.arrays(table, REPLY, MARK), X.arrays(table, REPLY, SINGLE)
        rows: dict[int, list] = {}
        order, start = X.groups(marks["uid"])
        for s, e in X.spans(start, len(order)):
            k = order[s:e]
            at = marks["at"][k].astype(np.int64)
            rows[int(marks["uid"][k[0]])] = [ranges_bytes(np.maximum(at - (size - gram), 0), at + marks["right"][k]), None]
        order, start = X.groups(asked["uid"])
        for s, e in X.spans(start, len(order)):
            k = order[s:e]
            got = np.zeros(len(k), REQUEST)
            for f in REQUEST.names:
                got[f] = asked[f][k]
            rows.setdefault(int(asked["uid"][k[0]]), [None, None])[1] = got.tobytes()
        return pa.table({"uid": pa.array(list(rows), pa.int64()), "ranges": pa.array([r[0] for r in rows.values()], pa.binary()), "requests": pa.array([r[1] for r in rows.values()], pa.binary())})

    return run


def _send(buckets: int, size: int, gram: int):
    """The contexts that were asked for: reversed bytes before the anchor, then those from it on; or all their strings' prints."""
    fields = context(size, gram)
    before = size - gram

    def contexts(e: dict[str, np.ndarray]) -> pa.RecordBatch:
        return X.blobs(fields, X.bucket_of(e["key"], buckets), SINGLE, **e)

    def strings(e: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Those that the task has in several places are marked here, and one of each is sent."""
        order, start = X.groups(e["key"], e["check"], e["uid"], e["at"])
        order = order[start]  # copies of a text, and two anchors of one string, send the same place
        e = {k: v[order] for k, v in e.items()}
        order, start = X.groups(e["key"], e["check"])
        times = np.diff(np.append(start, len(order)))
        one = order[start]
        for kind, which in ((STRING, one[times == 1]), (STRINGS, one[times > 1]), (MARK, order[np.repeat(times > 1, times)])):
            part = {k: v[which] for k, v in e.items()}
            yield string_blobs(fields, X.bucket_of_ids(part["uid"], buckets) if kind == MARK else X.bucket_of(part["key"], buckets), kind, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, dealt = X.Gather(fields, 1 << 14), X.Gather(PLACE)
        for batch in batches:
            for block in B.blocks(batch, key="uid"):
                sums = None
                for k, (uid, raw) in enumerate(zip(block.ids.to_pylist(), block.column("requests"), strict=True)):
                    ask = np.frombuffer(raw.as_py(), REQUEST)
                    deal = (ask["many"] & DEAL) > 0
                    for s in range(0, int(deal.sum()), DEALT):
                        sums = sums or (B.bytes_prefix(block.buf), B.bytes_prefix(block.buf, second=True))
                        part = ask[deal][s : s + DEALT]
                        at, right = part["at"].astype(np.int64), part["right"].astype(np.int64)
                        low, high = np.minimum(at, before), np.maximum(0, size - right)  # a string starts so many bytes before its anchor at most, at least
                        many = np.maximum(0, low - high + 1)
                        start = block.at[k] + B.ragged(at - low, many)
                        if dealt.add(key=B.fingerprint(sums[0], start, start + size), check=B.fingerprint(sums[1], start, start + size), uid=np.full(len(start), uid), at=start - block.at[k]):
                            yield from strings(dealt.take())
                    ask = ask[~deal]
                    if not len(ask):
                        continue
                    text = block.buf[block.at[k] : block.at[k + 1]]
                    data = np.full((len(ask), before + size), PAD, np.uint8)
                    left, right, at = np.minimum(ask["at"], before), ask["right"], ask["at"].astype(np.int64)
                    spot = np.arange(before)
                    inside = spot < left[:, None]
                    data[:, :before][inside] = text[(at[:, None] - 1 - spot)[inside]]
                    spot = np.arange(size)
                    inside = spot < right[:, None]
                    data[:, before:][inside] = text[(at[:, None] + spot)[inside]]
                    if got.add(key=ask["key"], uid=np.full(len(ask), uid), at=at, left=left, right=right, many=ask["many"], data=data.view(fields["data"]).ravel()):
                        yield contexts(got.take())
        yield contexts(got.take())
        yield from strings(dealt.take())

    return run


PLACE = {"key": "<u8", "check": "<u8", "uid": "<i8", "at": "<u4"}


def string_blobs(fields: dict[str, str], bucket: np.ndarray, kind: int, part: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Strings in the columns of contexts: the second print stands for the data."""
    zero = np.zeros(len(bucket), np.uint8)
    return X.blobs(fields | {"data": "<u8", "left": "u1", "right": "u1"}, bucket, kind, key=part["key"], uid=part["uid"], at=part["at"], left=zero, right=zero, many=zero, data=part["check"])


def string_arrays(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    e = X.arrays(table.select(["kind", "key", "uid", "at", "data"]), {"key": "<u8", "uid": "<i8", "at": "<u4", "data": "<u8"}, kind)
    return e | {"check": e["data"]}


class BlindTrie:
    """Orders strings that share a long prefix. Inner nodes hold only the place of a difference; one full comparison finds where a string belongs."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [place, {byte: child}] or [-1, [numbers of equal strings]]
        for k in range(len(strings)):
            self.insert(k)

    def insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [-1, [k]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(k)
            return
        n = len(s)
        place = n - 1 - ((int.from_bytes(s) ^ int.from_bytes(other)).bit_length() - 1) // 8
        above, node = None, self.root
        while 0 <= node[0] < place:
            above, node = node, node[1][s[node[0]]]
        if node[0] == place:
            node[1][s[place]] = [-1, [k]]
            return
        new = [place, {other[place]: node, s[place]: [-1, [k]]}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            place, kids = stack.pop()
            if place < 0:
                out += kids
            else:
                stack += [kids[b] for b in sorted(kids, reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of byte strings of one length, and what each has in common with the one before it in that order."""
    n, width = rows.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of each place in the order; groups are in order
    for depth in range(0, min(shallow, width), 8):
        size = np.bincount(group, minlength=1) if n else np.zeros(1, np.int64)
        open_ = np.flatnonzero(size[group] > 1) if n else np.zeros(0, np.int64)
        if not len(open_):
            break
        part = np.zeros((len(open_), 8), np.uint8)
        piece = rows[order[open_], depth : depth + 8]
        part[:, : piece.shape[1]] = piece
        word = part.view(">u8").ravel().astype(np.uint64)
        turn = np.lexsort((word, group[open_]))
        order[open_] = order[open_][turn]
        word = word[turn]
        new = np.zeros(n, bool)
        new[1:] = group[1:] != group[:-1]
        differs = (word[1:] != word[:-1]) & (np.diff(open_) == 1)
        new[open_[1:][differs]] = True
        group = np.cumsum(new)
    if n:
        size = np.bincount(group)
        start = np.cumsum(size) - size
        for g in np.flatnonzero(size > 1).tolist():
            where = order[start[g] : start[g] + size[g]]
            order[start[g] : start[g] + size[g]] = where[BlindTrie([r.tobytes() for r in rows[where]]).order()]
    common = np.zeros(n, np.int64)
    for s in range(1, n, 4096):
        differs = rows[order[s : s + 4096]] != rows[order[s - 1 : s - 1 + len(order[s : s + 4096])]]
        common[s : s + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, common


def shared_strings(data: np.ndarray, left: np.ndarray, right: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For each context and each d: whether another context has the string that starts d bytes before its anchor."""
    n, before = len(data), size - gram
    found = np.zeros((n, before + 1), bool)
    suffix_order, suffix_common = deep_shallow(data[:, before:], SHALLOW)
    prefix_order, prefix_common = deep_shallow(data[:, :before], SHALLOW_PREFIX)
    suffix_class, prefix_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(before + 1):
        able = np.flatnonzero((left >= d) & (right >= size - d))
        suffix_class[suffix_order] = np.cumsum(suffix_common < size - d)
        prefix_class[prefix_order] = np.cumsum(prefix_common < d)
        both = suffix_class[able] * (n + 1) + prefix_class[able]
        order = np.argsort(both, kind="stable")
        same = np.flatnonzero(both[order][1:] == both[order][:-1])
        found[able[order[same]], d] = True
        found[able[order[same + 1]], d] = True
    return found


def _sort(buckets: int, size: int, gram: int):
    fields = context(size, gram)

    def run(table: pa.Table) -> pa.Table:
        e = X.arrays(table, fields, SINGLE)
        first, start = X.groups(e["uid"], e["at"])  # copies of a text send the same context
        e = {k: v[first[start]] for k, v in e.items()}
        data = e["data"].view(np.uint8).reshape(len(e["data"]), 2 * size - gram)
        found = shared_strings(data, e["left"].astype(np.int64), e["right"].astype(np.int64), size, gram)
        found[e["many"] > 0] = False  # marked already
        edge = np.diff(np.pad(found.view(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        at = e["at"][row].astype(np.int64)
        got = {"uid": e["uid"][row], "start": at - (high - 1), "end": at - low + size}
        single, several, marks = (string_arrays(table, k) for k in (STRING, STRINGS, MARK))
        both = {k: np.concatenate([single[k], several[k]]) for k in PLACE}
        order, start = X.groups(both["key"], both["check"], both["uid"], both["at"])
        place = order[start]
        order, start = X.groups(both["key"][place], both["check"][place])
        times = np.diff(np.append(start, len(order)))
        known = np.add.reduceat((place[order] >= len(single["key"])).astype(np.int64), start) if len(start) else times
        again = place[order[np.repeat((times > 1) | (known > 0), times)]]
        uid, begin = (np.concatenate([marks[k], both[k][again]]) for k in ("uid", "at"))
        r = joined_strings(uid, begin.astype(np.int64), size)
        got = {k: np.concatenate([got[k], r[k]]) for k in got}
        return pa.Table.from_batches([X.blobs(RANGE, X.bucket_of_ids(got["uid"], buckets), MARK, **got)])

    return run


def joined_strings(uid: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Strings as ranges, neighbours of one text joined."""
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid)) - 1 if len(uid) else first
    return {"uid": uid[first], "start": at[first], "end": at[last] + size}


RANGE = {"uid": "<i8", "start": "<u4", "end": "<u4"}


def _ranges(table: pa.Table) -> pa.Table:
    e = X.arrays(table, RANGE)
    order, start = X.groups(e["uid"])
    rows = [(int(e["uid"][order[s]]), ranges_bytes(e["start"][order[s:c]], e["end"][order[s:c]])) for s, c in X.spans(start, len(order))]
    return pa.table({"uid": pa.array([r[0] for r in rows], pa.int64()), "more": pa.array([r[1] for r in rows], pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, *ranges in zip(batch.column("text"), batch.column("ranges"), batch.column("more"), strict=True):
            raw = (text.as_py() or "").encode()
            pairs = np.frombuffer(b"".join(r.as_py() or b"" for r in ranges), "<u4").reshape(-1, 2).astype(np.int64)
            if not len(pairs):
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            start, end = np.frombuffer(ranges_bytes(pairs[:, 0], pairs[:, 1]), "<u4").reshape(-1, 2).astype(np.int64).T
            kept = b"".join(raw[s:e] for s, e in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
            rows.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: tuple[int, int] = (HOT_TASK, HOT_BUCKET)) -> DataFrame:
    """One row per document; needs doc_id and text, ignores all other columns. hot: contexts of one gram that a task sends and that a bucket sorts; beyond, a gram is dealt out."""
    spark = docs.sparkSession
    buckets = bucket_count(docs)
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body, F.octet_length(body)).alias("uid"))
    found = texts.select("uid", "text").mapInArrow(_find(buckets, size, gram, hot[0]), X.schema(ANCHOR))
    replies = X.reduce_buckets(found, _compare(buckets, hot[1]), X.schema(REPLY), buckets)
    first = WorkTable(X.reduce_buckets(replies, _by_text(size, gram), "uid long, ranges binary, requests binary", buckets), "suffix-requests")
    release(spark)
    asked = texts.select("uid", "text").join(first.read().where("requests IS NOT NULL").select("uid", "requests"), "uid")
    sent = asked.mapInArrow(_send(buckets, size, gram), X.schema(context(size, gram)))
    sorted_ = X.reduce_buckets(sent, _sort(buckets, size, gram), X.schema(RANGE), buckets)
    second = WorkTable(X.reduce_buckets(sorted_, _ranges, "uid long, more binary", buckets), "suffix-ranges")
    release(spark)
    marked = texts.join(first.read().where("ranges IS NOT NULL").select("uid", "ranges"), "uid", "left").join(second.read(), "uid", "left")
    return marked.select("doc_id", "text", "ranges", "more").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
