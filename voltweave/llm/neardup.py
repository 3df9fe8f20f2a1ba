"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidates; links are exact.

1. Each document's distinct shingles are hashed once; the value range is split into bins and each bin keeps
   its smallest hash. An empty bin takes the value of another, found by a fixed sequence of its own
   (optimal densification), so a bin agrees with the probability of the sets' similarity. Documents with
   equal sets form a class, and only one of a class goes on.
2. Bands of bins give buckets. In each, every class is a candidate of one centre only: a star, so a bucket
   of m classes gives m - 1 candidates. The centre is the class whose buckets hold most classes in all, which
   is the least edited one of a family of near copies, and the same one in most of the family's buckets.
3. Candidates are confirmed on full sets, a centre's members in chunks of fixed size, so that a large star
   is many tasks.
4. Classes of one star that the confirmed links leave apart may still resemble each other. They are compared
   directly, chunk against chunk, in a star of up to DIRECT chunks, so a text is sent that many times at most.
   A larger star is dealt into buckets anew, by the shingles that tell a class from the centre: a class that
   is not linked with the centre shares about half of another's differences or more if the two are linked, so it
   looks under all its differences, and the other waits under enough of them to be met. Those buckets have
   stars again, with centres of their own. Only what LEVELS such rounds leave apart in one star is compared
   chunk against chunk whatever its size. A task returns at most one link fewer than it has classes.
5. Components follow from links by alternating large-star and small-star rounds on tables.

Two sets of similarity s share no band with probability (1 - s**rows)**bands: below 6e-11 at 0.85 with 32
bands of 4 rows, and 2e-11 at 0.8 with 48.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; with fewer words
than a shingle the whole text is one; rows that repeat are one class; a null doc_id is never a component's
name unless all of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .tables import WorkTable, release

ROWS = 4
#: Members of one task's part of a star.
CHUNK = 256
#: Chunks of a star whose classes are compared directly.
DIRECT = 32
#: Rounds of stars before what is left is compared chunk against chunk.
LEVELS = 4


def shingle_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles, sorted within each document, and where each document's start."""
    found = B.words(block)
    sums = B.prefix(B.word_hashes(block, found, lower=True))
    count = np.diff(found.at)
    start = B.windows(found, size)
    short = np.flatnonzero((count > 0) & (count < size))
    first = np.concatenate([start, found.at[short]])
    last = np.concatenate([start + size, found.at[short + 1]])
    doc = np.concatenate([np.searchsorted(found.at, start, side="right") - 1, short])
    value = B.fingerprint(sums, first, last)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(block) + 1))


def detours(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a bin that is not empty."""
    rng = np.random.Generator(np.random.PCG64(bins))
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signatures(values: np.ndarray, at: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """documents x bins; rows of documents without shingles are zero."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    bin_ = ((values >> B.U64(32)) * B.U64(bins) >> B.U64(32)).astype(np.int64)
    spot = doc * bins + bin_
    new = np.ones(len(spot), bool)
    new[1:] = spot[1:] != spot[:-1]
    out = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    out[spot[new]] = values[new] | B.U64(1)
    full[spot[new]] = True
    made = out.reshape(n, bins).copy()
    out, full = out.reshape(n, bins), full.reshape(n, bins)
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for k in range(bins):
        if not len(row):
            break
        other = order[col, k]
        hit = full[row, other]
        made[row[hit], col[hit]] = out[row[hit], other[hit]]
        row, col = row[~hit], col[~hit]
    return made


def band_keys(made: np.ndarray, rows: int) -> np.ndarray:
    n, bins = made.shape
    parts = made.reshape(n, bins // rows, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        total += parts[:, :, k] * B.U64(pow(B.BASE, 2 * k + 1, 1 << 64))
    return B.mix(total + np.arange(bins // rows, dtype=np.uint64) * B.U64(0xD1B54A32D192ED03))


def _sketch(size: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = detours(bins)
        for batch in batches:
            for block in B.blocks(batch):
                values, at = shingle_sets(block, size)
                count = np.diff(at)
                total = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(B.mix(values + B.U64(0x8CB92BA72F3D8DD7)), out=total[1:])
                sid = B.mix(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64))
                keys = band_keys(signatures(values, at, bins, order), rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([block.ids, block.column("rid"), pa.array(count.astype(np.int64)), pa.array(sid.view(np.int64)), bands], names=["doc_id", "rid", "n_shingles", "sid", "bands"])

    return run


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a task's texts; the table has few enough rows to be one block."""
    batch = pa.record_batch([table.column("node").combine_chunks(), table.column("text").combine_chunks()], names=["node", "text"])
    parts, at = [], [0]
    for block in B.blocks(batch, key="node"):
        values, offsets = shingle_sets(block, size)
        parts.append(values)
        at += (at[-1] + offsets[1:]).tolist()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(at)


def _distinct(table: pa.Table) -> pa.Table:
    """One row for each node: rows that repeat a document join it twice."""
    return table.take(pa.array(np.unique(table.column("node").to_numpy(), return_index=True)[1]))


def _confirm(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = _distinct(table)
        nodes, centre = table.column("node").to_numpy(), table.column("centre")[0].as_py()
        values, at = _sets(table, size)
        k = int(np.flatnonzero(nodes == centre)[0])
        own = values[at[k] : at[k + 1]]
        shared = B.per_document(np.isin(values, own), at)
        linked = 100 * shared >= percent * (np.diff(at) + len(own) - shared)
        linked[k] = False
        return pa.table({"a": pa.array(np.full(int(linked.sum()), centre)), "b": pa.array(nodes[linked])})

    return run


def _apart(size: int, percent: int):
    """Links that connect what can be connected among a star's chunk and a chunk of its classes apart: at most one for each component but one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("roam", "descending")])
        table = _distinct(table)
        nodes, comp, roam = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "roam"))
        values, at = _sets(table, size)
        owner = np.repeat(np.arange(len(nodes)), np.diff(at))
        order = np.argsort(values, kind="stable")
        ordered, owner = values[order], owner[order]
        count = np.diff(at)
        root = np.unique(comp, return_inverse=True)[1]
        links = []
        for k in np.flatnonzero(roam).tolist():
            own = values[at[k] : at[k + 1]]
            low, high = np.searchsorted(ordered, own), np.searchsorted(ordered, own, side="right")
            shared = np.bincount(owner[B.ragged(low, high - low)], minlength=len(nodes))
            for j in np.flatnonzero((100 * shared >= percent * (count + count[k] - shared)) & (root != root[k])).tolist():
                if root[j] != root[k]:
                    links.append((nodes[k], nodes[j]))
                    root[root == root[j]] = root[k]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _differences(size: int, percent: int):
    """The shingles that tell each class of a star's chunk from the centre: all for a class apart, for the others as many as a linked one cannot miss.

    With d and e the numbers of differences from the centre c of x, which is apart, and y: x and y differ in
    d + e - 2 i shingles, i being the differences they share. Linked, they differ in at most k (|x| + |y|), and
    d > k (|x| + |c|), where k = (100 - percent) / (100 + percent). So i > (e + k (|c| - |y|)) / 2, and of
    any e - i + 1 differences of y one is a difference of x. Shingles that y adds come first: they are rarer
    than those it lacks.
    """

    def run(table: pa.Table) -> pa.Table:
        table = _distinct(table.sort_by([("roam", "descending")]))
        nodes, roam, centre = table.column("node").to_numpy(), table.column("roam").to_numpy(zero_copy_only=False), table.column("band")[0].as_py()
        values, at = _sets(table, size)
        k = int(np.flatnonzero(nodes == centre)[0])
        own = values[at[k] : at[k + 1]]
        added = ~np.isin(values, own)
        salt = B.mix(np.array([centre], np.int64).view(np.uint64))
        keys, of, wait = [], [], []
        for j in range(len(nodes)):
            part = slice(at[j], at[j + 1])
            other = np.concatenate([values[part][added[part]], np.setdiff1d(own, values[part], assume_unique=True)])
            shared = ((100 + percent) * len(other) + (100 - percent) * (len(own) - (at[j + 1] - at[j]))) // (2 * (100 + percent)) + 1
            waits = max(0, len(other) - int(shared) + 1)
            if j != k:
                other = other if roam[j] else other[:waits]
                keys.append(B.mix(other ^ salt))
                of.append(np.full(len(other), j))
                wait.append(np.arange(len(other)) < waits)
        of, wait = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((of, np.int64), (wait, bool)))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.table({"band": pa.array(keys.view(np.int64)), "node": pa.array(nodes[of]), "looks": pa.array(roam[of]), "waits": pa.array(wait)})

    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every node in links (a, b)."""
    edges = WorkTable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:  # every round lowers a finite sum or changes nothing
        e = edges.read()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        made = WorkTable(small, "links")
        edges.drop()
        edges = made
        sums = made.read().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    out = edges.read()
    return out.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(out.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def candidates(banded: DataFrame) -> WorkTable:
    """centre and node of every class that shares a bucket (node, band) with the bucket's centre."""
    full = WorkTable(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    # Joins are with tables, not with aggregates: Spark can then split the classes of a hot band among tasks.
    shared = WorkTable(banded.join(full.read(), "band").select("band", "node", "m"), "buckets")
    weight = WorkTable(shared.read().groupBy("node").agg(F.sum("m").alias("weight")), "weights")
    centre = shared.read().join(weight.read(), "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"))
    centre = WorkTable(centre.select("band", F.col("top.node").alias("centre")), "centres")
    pairs = WorkTable(shared.read().join(centre.read(), "band").where("node <> centre").select("centre", "node").distinct(), "candidates")
    for table in (full, shared, weight, centre):
        table.drop()
    return pairs


def candidate_texts(texts: DataFrame, pairs: WorkTable) -> WorkTable:
    """node and text of the classes in stars. All texts are shuffled here, once, and by the same plan at every size."""
    wanted = pairs.read().select("node").union(pairs.read().select("centre")).distinct()
    return WorkTable(texts.select(F.col("rid").alias("node"), "text").join(wanted.hint("merge"), "node"), "candidate-texts")


def in_parts(pairs: DataFrame, *columns: str) -> DataFrame:
    """centre, part, node and more columns: a star's classes in parts of about CHUNK, the centre in each; more columns are null for it."""
    # A table, not an aggregate: Spark can then split a large star's classes in the join.
    sized = WorkTable(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")), "parts").read()
    members = pairs.join(sized, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", *columns)
    each = sized.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
    return members.unionByName(each, allowMissingColumns=True)


def star_links(pairs: WorkTable, texts: WorkTable, size: int, percent: int) -> WorkTable:
    """Confirmed links between each star's centre and its other classes."""
    asked = in_parts(pairs.read())
    return WorkTable(asked.join(texts.read(), "node").groupBy("centre", "part").applyInArrow(_confirm(size, percent), "a long, b long"), "links")


def stars_apart(pairs: WorkTable, comps: WorkTable) -> WorkTable:
    """band (the centre), node, comp, m (classes beside the centre) and home (the centre's component) of stars that hold several components beside the centre."""
    of = comps.read()
    named = pairs.read().join(of, "node", "left").select(F.col("centre").alias("band"), "node", F.coalesce("comp", "node").alias("comp"))
    named = WorkTable(named.join(of.select(F.col("node").alias("band"), F.col("comp").alias("home")), "band", "left").withColumn("home", F.coalesce("home", "band")), "named")
    split = named.read().groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    split = WorkTable(split.select("band", "m"), "split")
    out = WorkTable(named.read().join(split.read(), "band"), "apart")
    named.drop()
    split.drop()
    return out


def links_apart(wide: WorkTable | DataFrame, texts: WorkTable, size: int, percent: int) -> WorkTable:
    """Links between the components of a band's classes: all of them in chunks, each with each chunk of the band's smaller components."""
    wide = wide.read() if isinstance(wide, WorkTable) else wide
    counted = wide.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"))
    largest = WorkTable(largest.select("band", F.col("top.comp").alias("top"), "total", (F.col("total") - F.col("top.n")).alias("away")), "largest").read()
    chunks = lambda n: F.ceil(n / (2 * CHUNK)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = wide.select("band", "node", "comp").join(largest, "band").select("band", "node", "comp", (F.col("comp") != F.col("top")).alias("roam"), chunks(F.col("total")).alias("parts"), chunks(F.col("away")).alias("turns"))
    # In a single chunk the classes of smaller components are there once, as those.
    home = asked.where("NOT roam OR parts > 1").select("band", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), each("turns").alias("turn"), "node", "comp", F.lit(False).alias("roam"))
    away = asked.where("roam").select("band", each("parts").alias("part"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int").alias("turn"), "node", "comp", "roam")
    return WorkTable(home.union(away).join(texts.read(), "node").groupBy("band", "part", "turn").applyInArrow(_apart(size, percent), "a long, b long"), "links")


def buckets_of_differences(large: DataFrame, texts: WorkTable, size: int, percent: int) -> WorkTable:
    """band and node of new buckets for the classes of large stars; in each a class apart looks for one that waits."""
    members = large.select(F.col("band").alias("centre"), "node", (F.col("comp") != F.col("home")).alias("roam"))
    asked = in_parts(members, "roam").select(F.col("centre").alias("band"), "part", "node", F.coalesce("roam", F.lit(False)).alias("roam"))
    told = WorkTable(asked.join(texts.read(), "node").groupBy("band", "part").applyInArrow(_differences(size, percent), "band long, node long, looks boolean, waits boolean"), "differences")
    met = WorkTable(told.read().groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.max("looks").alias("looked"), F.max("waits").alias("met")).where("m > 1 AND looked AND met").select("band"), "met")
    out = WorkTable(told.read().join(met.read(), "band").select("band", "node"), "banded")
    told.drop()
    met.drop()
    return out


def link_classes(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect every component. Each step's frames end with its call, so release() can drop their shuffle files."""
    spark = texts.sparkSession
    banded, held, known = classes.select("node", F.explode("bands").alias("band")), None, None
    for level in range(LEVELS):
        pairs = candidates(banded)
        release(spark)
        if held is None:
            held = candidate_texts(texts, pairs)
            release(spark)
        stars = star_links(pairs, held, size, percent).read()
        release(spark)
        comps = WorkTable(components(stars if known is None else known.union(stars)), "components")
        known = comps.read().select(F.col("node").alias("a"), F.col("comp").alias("b"))
        wide = stars_apart(pairs, comps)
        last = level == LEVELS - 1
        known = known.union(links_apart(wide.read() if last else wide.read().where(F.col("m") <= DIRECT * CHUNK), held, size, percent).read())
        large = wide.read().where(F.col("m") > DIRECT * CHUNK)
        if last or large.isEmpty():
            break
        banded = buckets_of_differences(large, held, size, percent).read()
        release(spark)
    held.drop()
    return known


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bins: int = 192, rows: int = ROWS) -> DataFrame:
    """doc_id, rid (a fingerprint of the row), n_shingles, component_id and kept for each row; needs doc_id and text."""
    key = F.col("doc_id").cast("long")
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(key.alias("doc_id"), body.alias("text"), row_print(key, F.col("text")).alias("rid"))
    sketch = WorkTable(texts.mapInArrow(_sketch(size, bins, rows), "doc_id long, rid long, n_shingles long, sid long, bands array<long>"), "sketch").read()
    classes = sketch.where("n_shingles > 0").groupBy("sid", "n_shingles").agg(F.min("doc_id").alias("doc"), F.min("rid").alias("node"), F.first("bands").alias("bands"))
    classes = WorkTable(classes, "classes").read()
    comps = components(link_classes(texts, classes, size, percent))
    named = classes.select("sid", "n_shingles", "doc", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = WorkTable(named, "classes").read()
    lowest = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    by_class = named.join(lowest, "comp").select("sid", "n_shingles", "component_id")
    out = sketch.select("doc_id", "rid", "n_shingles", "sid").join(by_class, ["sid", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "rid", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def row_print(key, text):
    return F.xxhash64(key, text, F.octet_length(text))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the smallest, with all its columns, whatever their names; of rows that repeat it in full one stays."""
    of, again = (f"_voltweave_{x}" for x in ("of", "again"))
    while {of, again} & set(docs.columns):
        of, again = of + "_", again + "_"
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("rid").alias(of)).distinct()
    marked = docs.withColumn(of, row_print(F.col("doc_id").cast("long"), F.col("text"))).join(kept, of, "left_semi")
    return marked.withColumn(again, F.row_number().over(Window.partitionBy(of).orderBy(of))).where(F.col(again) == 1).drop(of, again)
