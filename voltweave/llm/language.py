"""A gated recurrent language model over words, trained on all training documents.

1. All training tokens are counted. A bounded table of the most frequent words goes to every task; the
   counts of all other words stay in Spark and reach a document's rare words by an equi-join.
2. Every text is read once more and becomes a row of word numbers, two bytes a token: the model's words by
   frequency, the end of a document, and one number for all other words. Training and scoring read those rows.
3. The model's words are put in classes: by the frequent word that leads the documents they occur in, then by
   frequency, with equal shares of root counts. The output softmax is factored: the network gives a class's
   probability, and a softmax over the class's words, learned with it, the word's. All other words are one class,
   whose words have add-one shares and leave one share for unseen words.
4. The input is the last word's vector, the same one that its class's softmax uses. The gated network is trained
   by truncated backpropagation in numpy. A task deals its training documents to lanes; a lane is a stream, whose
   state lasts from window to window and is reset only where a document begins, and what a lane has left waits for
   more documents. Tasks start from the same weights and theirs are averaged in a tree, by tokens. This happens
   once for each half of the documents, the second from the first's average.
5. Scoring carries the state from the first to the last token of a document, however long; documents are
   lanes of one batch, longest first, so a step works on all documents that still have tokens.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as an empty text for the
split, so it is in training; repeated rows count and are scored as often as they occur; without training
documents every token is unseen and the network is as it starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .tables import WorkTable, release

#: Words whose counts every task gets, and those that have classes of their own; both bound what is broadcast.
TABLE_WORDS = 1 << 18
MODEL_WORDS = 1 << 14
LEADERS = 16
CLASSES = 64
HIDDEN = 12
#: Truncation of backpropagation in tokens, lanes of a training batch, tokens gathered before training on them.
STEPS = 16
LANES = 512
GATHER = 1 << 20
#: Tokens of a document that one lane trains on in a row; a longer one is several stretches. Scoring has no such bound.
STRETCH = 1024
#: Steps of the network's weights, and of a word's vector and bias.
RATE = 0.01
WORD_RATE = 0.1
#: Bound of an output weight: a state's entries are below one, so no logit comes near the end of the exponential's range.
MOST = 60 / HIDDEN
#: The log of the probability that a class without words starts with, and keeps.
NEVER = -40.0
ONES = np.ones(max(MODEL_WORDS + 2, LANES * STEPS), np.float32)
#: States that wait for their words' probabilities while documents are scored.
HELD_STATES = 1 << 16
#: Averages are formed of so many tasks at a time.
FAN = 16
FOLDS, HELD_OUT = 7, 2

END = np.uint64(0x5DEECE66D1234567)
END_CLASS, REST_CLASS = CLASSES - 2, CLASSES - 1
#: Numbers above the model's words: the end, all other words, and the start of a document, which is input only.
END_WORD, REST_WORD, START_WORD = MODEL_WORDS, MODEL_WORDS + 1, MODEL_WORDS + 2


def tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens, an end after each, and where each document's start."""
    found = B.words(block)
    return np.insert(B.word_hashes(block, found, lower=True), found.at[1:], END), found.at + np.arange(len(found.at))


def _fold(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for block in B.blocks(batch):
            held.append(tokens(block)[0])
            size += len(held[-1])
            if size >= 2 * GATHER:
                yield flush()
                held, size = [], 0
    yield flush()


@dataclass
class Table:
    """Sorted word hashes with their counts and their numbers in the model."""

    words: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    total: int
    distinct: int
    rest: float  # log10 of the denominator of the words that the model has no number for

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and whether there is one."""
        distinct, of = np.unique(hashes, return_inverse=True)
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        spot = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return spot[of], (self.words[spot] == distinct)[of]


@dataclass
class Classes:
    """place: where each number stands among the words in order of their classes, the end and all others last; at: where each class starts there; shares: the log of each place's share of its class's count; sizes: the log of each class's share of all."""

    place: np.ndarray
    at: np.ndarray
    shares: np.ndarray
    sizes: np.ndarray


def least_count(counts: DataFrame, most: int = TABLE_WORDS) -> int:
    """The smallest count such that at most so many words reach it, by halving on one aggregate after another: one row each."""
    low, high = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1
    while low < high:
        points = sorted({low + (high - low) * k // 16 for k in range(16)})
        row = counts.agg(*(F.count_if(F.col("n") >= p) for p in points)).first()
        fits = [p for p, n in zip(points, row, strict=True) if n <= most]
        short = [p for p, n in zip(points, row, strict=True) if n > most]
        high = min([high, *fits])
        low = max([low, *(p + 1 for p in short)])
    return high


def make_table(counts: DataFrame) -> Table:
    sums = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = sums["total"] or 0, sums["distinct"]
    # The least count of which the table holds all words: no task sends more than the table's own rows.
    least = least_count(counts)
    top = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, count = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    numbers = np.full(len(words), REST_WORD)
    model = np.flatnonzero(words != END)[:MODEL_WORDS]
    numbers[model] = np.arange(len(model))
    numbers[words == END] = END_WORD
    own = numbers != REST_WORD
    rest = np.log10(total - int(count[own].sum()) + distinct - int(own.sum()) + 1)
    order = np.argsort(words)
    return Table(words[order], count[order], numbers[order].astype(np.uint16), total, distinct, float(rest))


def _leaders(encoded: DataFrame) -> np.ndarray:
    """For each of the model's words the most frequent word that most often leads the documents it occurs in; ties go to the more frequent leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MODEL_WORDS * LEADERS, np.int64)
        for batch in batches:
            ids, at = word_numbers(batch)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            lead = np.flatnonzero(ids < LEADERS)
            led = np.bincount(doc[lead] * LEADERS + ids[lead], minlength=(len(at) - 1) * LEADERS).reshape(-1, LEADERS).argmax(axis=1)
            own = ids < MODEL_WORDS
            total += np.bincount(ids[own].astype(np.int64) * LEADERS + led[doc[own]], minlength=len(total))
        where = np.flatnonzero(total)
        yield pa.record_batch([pa.array(where // LEADERS), pa.array(where % LEADERS), pa.array(total[where])], names=["number", "lead", "n"])

    counted = encoded.select("ids").mapInArrow(run, "number long, lead long, n long").groupBy("number", "lead").agg(F.sum("n").alias("n"))
    best = counted.groupBy("number").agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("top")).select("number", (-F.col("top.lead")).alias("lead")).toPandas()
    out = np.zeros(MODEL_WORDS, np.int64)
    out[best["number"]] = best["lead"]
    return out


def make_classes(table: Table, leaders: np.ndarray) -> Classes:
    """Words without a count, if there are fewer than the model has room for, are in no class."""
    count = np.zeros(REST_WORD + 1)
    count[table.numbers] = np.where(table.numbers == REST_WORD, 0, table.counts)
    model = np.flatnonzero(count[:MODEL_WORDS] > 0)
    order = model[np.lexsort((model, leaders[model]))]
    mass = np.cumsum(np.sqrt(count[order]))
    of = np.minimum((mass - 1e-9) / mass[-1] * END_CLASS, END_CLASS - 1).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    place = np.full(START_WORD + 1, len(order) + 1)
    place[order] = np.arange(len(order))
    place[END_WORD], place[REST_WORD], place[START_WORD] = len(order), len(order) + 1, len(order) + 2
    at = np.searchsorted(np.concatenate([of, [END_CLASS, REST_CLASS]]), np.arange(CLASSES + 1))
    shares = np.concatenate([np.log(count[order] / np.bincount(of, weights=count[order], minlength=CLASSES)[of]), [0.0, 0.0]])
    rest = table.total - count.sum()
    sizes = np.bincount(of, weights=count[order], minlength=CLASSES) + np.bincount([END_CLASS, REST_CLASS], weights=[count[END_WORD], rest], minlength=CLASSES) + 1
    logs = np.where(np.diff(at) > 0, np.log(sizes / sizes.sum()), NEVER)
    return Classes(place, at, shares.astype(np.float32), logs.astype(np.float32))


def word_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All documents' word numbers, and where each document's start."""
    raw, at = B.text_bytes(batch.column("ids"))
    return np.frombuffer(raw.tobytes(), np.uint16), at // 2


class Network:
    """A gated recurrent layer from the last word's vector to the next word's class, and a softmax over each class's words; float32.

    flat holds the layer's weights, vectors and bias those of the words in order of their classes; the vectors have
    one more row for the start of a document.
    """

    SHAPES = {"wx": (HIDDEN, 3 * HIDDEN), "bx": (1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wo": (HIDDEN, CLASSES), "bo": (1, CLASSES)}

    def __init__(self, classes: Classes, weights: bytes | None = None):
        sizes = [a * b for a, b in self.SHAPES.values()]
        self.classes, self.words = classes, len(classes.shares)
        self.class_of = np.repeat(np.arange(CLASSES, dtype=np.uint8), np.diff(classes.at))
        if weights is None:
            rng = np.random.Generator(np.random.PCG64(7))
            flat = [classes.sizes if k == "bo" else np.zeros(n) if k == "bx" else rng.normal(0, 0.2, n) for k, n in zip(self.SHAPES, sizes, strict=True)]
            held = np.concatenate([*flat, rng.normal(0, 0.1, (self.words + 1) * HIDDEN), classes.shares]).astype(np.float32)
        else:
            held = np.frombuffer(weights, np.float32).copy()
        self.held = held
        self.flat, vectors, self.bias = np.split(held, [sum(sizes), sum(sizes) + (self.words + 1) * HIDDEN])
        self.vectors = vectors.reshape(-1, HIDDEN)
        self.part = dict(zip(self.SHAPES, (x.reshape(s) for x, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), self.SHAPES.values(), strict=True)), strict=True))
        self.grad = np.zeros_like(self.flat)
        self.gpart = dict(zip(self.SHAPES, (x.reshape(s) for x, s in zip(np.split(self.grad, np.cumsum(sizes)[:-1]), self.SHAPES.values(), strict=True)), strict=True))
        self.m, self.v, self.updates, self.seen = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0.0

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the layer's input, already times its weights."""
        n = HIDDEN
        u = h @ self.part["u"]
        zr = x[:, : 2 * n] + u[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, un = zr[:, :n], zr[:, n:], u[:, 2 * n :]
        c = r * un
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, un, c

    def given(self, places: np.ndarray) -> np.ndarray:
        return self.vectors[places] @ self.part["wx"] + self.part["bx"]

    def log_classes(self, h: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The logs of all classes' probabilities, or of those wanted, one for each state."""
        logits = h @ self.part["wo"]
        logits += self.part["bo"]
        own = logits[:, :] if wanted is None else logits[np.arange(len(h)), wanted]
        total = np.log((np.exp(logits) if wanted is None else np.exp(logits, out=logits)) @ ONES[:CLASSES])
        return own - (total[:, None] if wanted is None else total)

    def by_class(self, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each class with several words that occurs among wanted: its range of places, and where it occurs."""
        of = self.class_of[wanted]
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            low, high = int(self.classes.at[c]), int(self.classes.at[c + 1])
            if cut[c] < cut[c + 1] and high - low > 1:
                yield low, high, order[cut[c] : cut[c + 1]]

    def log_words(self, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The log of the probability of each place wanted within its class."""
        out = np.zeros(len(wanted), np.float32)
        for low, high, where in self.by_class(wanted):
            for s in range(0, len(where), 4096):
                k = where[s : s + 4096]
                logits = h[k] @ self.vectors[low:high].T
                logits += self.bias[low:high]
                own = logits[np.arange(len(k)), wanted[k] - low]
                out[k] = own - np.log(np.exp(logits, out=logits) @ ONES[: high - low])
        return out

    def learn(self, given: np.ndarray, wanted: np.ndarray, keep: np.ndarray, weight: np.ndarray, h: np.ndarray, least: int = 1) -> np.ndarray:
        """One window of truncated backpropagation; arrays are steps x lanes, of places. Returns the state at its end.

        The network's weights are stepped once least tokens were seen, so that a few lanes do not move them alone.
        """
        (steps, lanes), n = given.shape, HIDDEN
        inputs = self.vectors[given.ravel()]
        x = (inputs @ self.part["wx"] + self.part["bx"]).reshape(steps, lanes, 3 * n)
        before, states = np.empty((2, steps, lanes, n), np.float32)
        gates = []
        for t in range(steps):
            before[t] = h * keep[t][:, None]
            h, *more = self.step(x[t], before[t])
            states[t] = h
            gates.append(more)
        flat, w = wanted.ravel(), weight.ravel().astype(np.float32)
        all_ = states.reshape(-1, n)
        d = np.exp(all_ @ self.part["wo"] + self.part["bo"])
        d *= (w / (d @ ONES[:CLASSES]))[:, None]
        d[np.arange(len(d)), self.class_of[flat]] -= w
        g = self.gpart
        g["wo"] += all_.T @ d
        g["bo"][0] += ONES[: len(d)] @ d
        back = d @ self.part["wo"].T
        back += self.learn_words(all_, flat, w)
        back = back.reshape(steps, lanes, n)
        da, du = x, np.empty((steps, lanes, 3 * n), np.float32)  # the layer's input is not needed any more
        later, turned = np.zeros((lanes, n), np.float32), np.ascontiguousarray(self.part["u"].T)
        for t in range(steps - 1, -1, -1):
            z, r, un, c = gates[t]
            dh = later
            dh += back[t]
            dc = dh * (1 - z)
            dc *= 1 - c * c
            hz = dh * z
            dz = (before[t] - c) * hz
            dz *= 1 - z
            dr = dc * un
            dr *= r
            dr *= 1 - r
            da[t, :, :n] = du[t, :, :n] = dz
            da[t, :, n : 2 * n] = du[t, :, n : 2 * n] = dr
            da[t, :, 2 * n :] = dc
            np.multiply(dc, r, out=du[t, :, 2 * n :])
            later = du[t] @ turned
            later += hz
            later *= keep[t][:, None]
        da = da.reshape(-1, 3 * n)
        g["u"] += before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
        g["wx"] += inputs.T @ da
        g["bx"][0] += ONES[: len(da)] @ da
        self.learn_given(given.ravel(), da @ self.part["wx"].T)
        self.seen += float(w.sum())
        if self.seen >= least:
            self.grad /= self.seen
            self.update()
            self.grad[:], self.seen = 0, 0.0
        return h

    def learn_words(self, states: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A step of the vectors and biases of all words of the classes that occur. Returns the loss's derivative by the states."""
        back = np.zeros_like(states)
        for low, high, k in self.by_class(wanted):
            h, vectors = states[k], self.vectors[low:high]
            p = h @ vectors.T
            p += self.bias[low:high]
            np.exp(p, out=p)
            p *= (weight[k] / (p @ ONES[: high - low]))[:, None]
            p[np.arange(len(k)), wanted[k] - low] -= weight[k]
            back[k] = p @ vectors
            # Words are stepped by their expected number in the window, so frequent ones don't overshoot.
            rate = (WORD_RATE / np.sqrt(1 + len(k) * np.exp(self.classes.shares[low:high]))).astype(np.float32)
            vectors -= rate[:, None] * (p.T @ h)
            np.clip(vectors, -MOST, MOST, out=vectors)
            self.bias[low:high] -= rate * (ONES[: len(k)] @ p)
        return back

    def learn_given(self, given: np.ndarray, grad: np.ndarray) -> None:
        """A step of the vectors by what they are as input."""
        order = np.argsort(given, kind="stable")
        where = given[order]
        start = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        times = np.diff(np.append(start, len(where)))
        sums = np.add.reduceat(grad[order], start, axis=0)
        self.vectors[where[start]] = np.clip(self.vectors[where[start]] - (WORD_RATE / np.sqrt(times)).astype(np.float32)[:, None] * sums, -MOST, MOST)

    def update(self) -> None:
        """Adam, with the gradient's norm bounded."""
        norm = float(np.sqrt((self.grad * self.grad).sum()))
        grad = self.grad / max(1.0, norm)
        self.updates += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.flat -= RATE * (self.m / (1 - 0.9**self.updates)) / (np.sqrt(self.v / (1 - 0.99**self.updates)) + 1e-7)
        np.clip(self.part["wo"], -MOST, MOST, out=self.part["wo"])

    def score(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each document's places, in order."""
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        start, length = at[:-1][order], length[order]
        total = np.zeros(len(order))
        h = np.zeros((len(order), HIDDEN), np.float32)
        x = np.full(len(order), self.words)
        active, states, wanted, lanes, size = len(order), [], [], [], 0
        inputs = self.given(np.arange(self.words + 1))

        def settle() -> None:
            hs, ws, of = np.concatenate(states), np.concatenate(wanted), np.concatenate(lanes)
            logs = self.log_classes(hs, self.class_of[ws]) + self.log_words(hs, ws)
            total[: int(of.max()) + 1] += np.bincount(of, weights=logs)
            states.clear(), wanted.clear(), lanes.clear()

        for t in range(int(length[0]) if len(order) else 0):
            active = int(np.searchsorted(-length[:active], -t, side="left"))
            h, x = h[:active], x[:active]
            h = self.step(inputs[x], h)[0]
            x = places[start[:active] + t]
            states.append(h)
            wanted.append(x)
            lanes.append(np.arange(active))
            size += active
            if size >= HELD_STATES:
                settle()
                size = 0
        if size:
            settle()
        out = np.empty(len(order))
        out[order] = total / np.log(10)
        return out


class Streams:
    """Documents dealt to lanes. A lane's documents follow each other; windows are cut where all lanes have tokens, and what is left waits with its lane's state."""

    def __init__(self, net: Network, lanes: int):
        self.net, self.lanes = net, lanes
        self.rest = [np.zeros(0, np.int64) for _ in range(lanes)]  # places from 1, a stretch's first marked by its sign
        self.state = np.zeros((lanes, HIDDEN), np.float32)
        self.last = np.full(lanes, net.words)

    def add(self, places: np.ndarray, at: np.ndarray, all_: bool) -> None:
        """Trains on some more documents; all_: on all that waits, with fewer and fewer lanes."""
        length = np.diff(at)
        many = -(-length // STRETCH)
        start = np.repeat(at[:-1], many) + STRETCH * B.ragged(np.zeros(len(many), np.int64), many)
        end = np.minimum(start + STRETCH, np.repeat(at[1:], many))
        signed = places + 1
        signed[start] *= -1
        more = [[x] for x in self.rest]
        heap = [(len(x), k) for k, x in enumerate(self.rest)]
        heapq.heapify(heap)
        for d in np.argsort(start - end, kind="stable").tolist():
            n, k = heap[0]
            more[k].append(signed[start[d] : end[d]])
            heapq.heapreplace(heap, (n + int(end[d] - start[d]), k))
        held = [np.concatenate(x) for x in more]
        size = np.array([len(x) for x in held])
        order = np.argsort(-size, kind="stable")
        held, size = [held[k] for k in order], size[order]
        self.state, self.last = self.state[order], self.last[order]
        steps = int(size[0]) if all_ else int(size[-1]) // STEPS * STEPS
        table = np.zeros((steps, self.lanes), np.int64)
        for k, x in enumerate(held):
            table[: min(len(x), steps), k] = x[:steps]
        first, wanted = table < 0, np.maximum(np.abs(table) - 1, 0)
        given = np.where(first, self.net.words, np.vstack([self.last, wanted[:-1]])) if steps else wanted
        for t in range(0, steps, STEPS):
            n = int(np.searchsorted(-size, -t, side="left"))
            part = (slice(t, t + STEPS), slice(0, n))
            self.state[:n] = self.net.learn(given[part], wanted[part], 1 - first[part].astype(np.float32), (table[part] != 0).astype(np.float32), self.state[:n], self.lanes * STEPS // 2)
        if steps:
            self.last = wanted[-1]
        self.rest = [x[steps:] for x in held]


TRAINED = "task long, n long, weights binary"


def _train(classes, weights):
    """classes and weights: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(classes.value, weights.value)
        streams, held, size, seen = None, [], 0, 0

        def learn(last: bool) -> None:
            nonlocal streams
            places = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]))]) if held else np.zeros(1, np.int64)
            streams = streams or Streams(net, max(1, min(LANES, len(places) // STRETCH)))
            streams.add(places, at, last)
            held.clear()

        for batch in batches:
            ids, at = word_numbers(batch)
            held.append((classes.value.place[ids], np.diff(at)))
            size, seen = size + len(ids), seen + len(ids)
            if size >= GATHER:
                learn(False)
                size = 0
        if seen:
            learn(True)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([net.held.tobytes()])], names=["task", "n", "weights"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    table = table.sort_by("task")
    n = table.column("n").to_numpy().astype(np.float64)
    share = n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))
    mean = 0.0
    for w, x in zip(share, table.column("weights"), strict=True):
        mean = mean + w * np.frombuffer(x.as_py(), np.float32)
    return pa.table({"task": pa.array([table.column("task")[0].as_py() // FAN], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(encoded: DataFrame, classes: Classes) -> bytes:
    """Weights after both halves of the training documents."""
    spark = encoded.sparkSession
    weights, known = Network(classes).held.tobytes(), spark.sparkContext.broadcast(classes)
    for half in (0, 1):
        part = encoded.where(F.col("half") == half).select("ids")
        made = WorkTable(part.mapInArrow(_train(known, spark.sparkContext.broadcast(weights)), TRAINED), "weights")
        while made.read().count() > 1:
            next_ = WorkTable(made.read().groupBy(F.expr(f"task div {FAN}")).applyInArrow(_mean, TRAINED), "weights")
            made.drop()
            made = next_
        rows = made.read().collect()  # one
        made.drop()
        if rows and rows[0]["n"]:
            weights = bytes(rows[0]["weights"])
    return weights


ENCODED = "row long, doc_id long, held_out boolean, half int, n_tokens long, n_known long, base double, rest double, ids binary, rare array<long>, times array<int>"


def _encode(sent):
    """Every text as word numbers, with what the counts alone say of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, row = sent.value, TaskContext.get().partitionId(), 0
        logs = np.log10(table.counts + 1.0)
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            for block in B.blocks(batch):
                hashes, at = tokens(block)
                spot, known = table.find(hashes)
                numbers = np.where(known, table.numbers[spot], np.uint16(REST_WORD)) if len(logs) else np.full(len(hashes), REST_WORD, np.uint16)
                log = np.where(known, logs[spot], 0.0) if len(logs) else np.zeros(len(hashes))
                doc = np.repeat(np.arange(len(block)), np.diff(at))
                rare = np.flatnonzero(~known)
                order = np.lexsort((hashes[rare], doc[rare]))
                word, of = hashes[rare][order], doc[rare][order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (of[1:] != of[:-1])
                begin = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(of[begin], np.arange(len(block) + 1)).astype(np.int32))
                sums = lambda x: pa.array(np.bincount(doc, weights=x, minlength=len(block)))  # noqa: B023, E731
                ids = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])
                yield pa.record_batch([
                    pa.array((task << 40) + row + np.arange(len(block))), block.ids, block.column("held_out"), block.column("half"), pa.array(np.diff(at)), pa.array(np.bincount(doc, weights=known, minlength=len(block)).astype(np.int64)), sums(log), sums(np.where(numbers == REST_WORD, log - table.rest, 0.0)), ids,
                    pa.ListArray.from_arrays(offsets, pa.array(word[begin].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(begin, len(word))).astype(np.int32))),
                ], names=names)
                row += len(block)

    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


def _score(classes, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(classes.value, weights.value)
        held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []  # numbers, document lengths, the other columns

        def flush() -> Iterator[pa.RecordBatch]:
            """Many batches make wide ones for the network; only their numbers are kept for it."""
            length = np.concatenate([x[1] for x in held])
            got = net.score(classes.value.place[np.concatenate([x[0] for x in held])], np.concatenate([[0], np.cumsum(length)]))
            at = 0
            for _, n, batch in held:
                model = batch.column("rest").to_numpy() + got[at : at + len(n)]
                yield pa.record_batch([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(model)], names=[x.split()[0] for x in SCORED.split(", ")])
                at += len(n)
            held.clear()

        size = 0
        for batch in batches:
            ids, at = word_numbers(batch)
            held.append((ids, np.diff(at), batch.drop_columns(["ids"])))
            size += len(ids)
            if size >= 2 * GATHER:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document; needs doc_id and text, ignores all other columns."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    crc = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    docs = docs.select(key.alias("doc_id"), "text", (_fold(key) == HELD_OUT).alias("held_out"), F.pmod(F.floor(crc / FOLDS), F.lit(2)).cast("int").alias("half"))
    counted = docs.where("NOT held_out").select("doc_id", "text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = WorkTable(counted, "words").read()
    release(spark)
    table = make_table(counts)
    encoded = WorkTable(docs.mapInArrow(_encode(spark.sparkContext.broadcast(table)), ENCODED), "encoded").read()
    training = encoded.where("NOT held_out").select("half", "ids")
    classes = make_classes(table, _leaders(training))
    weights = train(training, classes)
    send = spark.sparkContext.broadcast
    scored = encoded.drop("half", "rare", "times").mapInArrow(_score(send(classes), send(weights)), SCORED)
    release(spark)
    rare = encoded.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(table.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * F.lit(float(np.log10(table.total + table.distinct + 1)))).alias("base_score"), (F.col("model") + zero("more")).alias("score"),
    )
