"""The timestep loop as DataFrames.

A step is one job: spikes of the last max_delay steps meet the edges whose delay brings them to now, are
summed by target and joined to the state; the new state is written and cuts the lineage. The join is by source
and delay, so an edge is met only at the step its spike arrives, and no table of pending arrivals is rewritten.
Edges are partitioned by source and delay and states bucketed by id once: a step shuffles its spikes and partial
sums, never the graph. A source with very many edges of one delay is dealt out by its targets, and its spikes go
to each part.

Whether a sum of weights can leave 32 bits is proven once from the graph; where it can, the buckets of the targets
at risk are checked at every step, edge by edge in emission order, and the run ends there with an error.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import INT16, INT32, UINT16_MAX, SimulationConfig
from ..errors import ConfigurationError, FixedPointOverflowError, translated
from ..functions.lif import advance, require_ansi
from ..operators.graph import Graph, delay_bounds
from ..work import bucketed, remove, work_dir, written

DIGEST_CHUNK = 1 << 20
#: Nodes whose flags one digest covers.
DIGEST_RANGE = 1 << 16
#: Edges of one source and delay that meet in one task; a source with more of them is dealt out by its targets.
HUB_EDGES = 1 << 20
#: Steps whose spikes are read from their states; where delays are longer, spikes are kept in a table of their own.
UNION_STEPS = 8
KEY = ["source", "delay", "part"]


def initial_state(graph: Graph, given: DataFrame | None = None) -> DataFrame:
    """id, v, refr of every node; given has id and v or refr for all nodes, or is None for zeros."""
    ids = graph.neurons.select("id")
    if given is None:
        return ids.select("id", F.lit(0).alias("v"), F.lit(0).alias("refr"))
    v = F.col("v") if "v" in given.columns else F.lit(0)
    refr = F.col("refr") if "refr" in given.columns else F.lit(0)
    given = given.select("id", v.cast("long").alias("v"), refr.cast("long").alias("refr"))
    low, high = INT32
    seen = given.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_if(~F.col("v").between(low, high)).alias("v"), F.count_if(~F.col("refr").between(0, UINT16_MAX)).alias("r")).first()
    if seen["n"] != graph.n or seen["d"] != graph.n:
        raise ConfigurationError("the initial state must have every node once")
    if seen["v"] or seen["r"]:
        raise ConfigurationError("an initial potential or refractory count is out of range")
    return ids.join(given, "id").select("id", F.col("v").cast("int").alias("v"), F.col("refr").cast("int").alias("refr"))


def hubs(edges: DataFrame) -> DataFrame | None:
    """source, delay and parts of sources with more edges of one delay than a task should take; None if there are none."""
    if edges.count() <= HUB_EDGES:
        return None
    many = edges.groupBy("source", "delay").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_EDGES)
    many = written(many.select("source", "delay", F.ceil(F.col("n") / HUB_EDGES).cast("int").alias("parts")), "hubs")
    return None if many.isEmpty() else many


def dealt(edges: DataFrame, many: DataFrame | None) -> DataFrame:
    """edges with their part of a source: 0 but for hubs."""
    if many is None:
        return edges.withColumn("part", F.lit(0))
    out = edges.join(many, ["source", "delay"], "left")
    return out.withColumn("part", F.pmod(F.xxhash64("target"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def arrivals(spikes: DataFrame, edges: DataFrame, t: int, many: DataFrame | None = None) -> DataFrame:
    """target and current at step t. spikes: emit_t, id; edges: with parts."""
    due = spikes.select(F.col("id").alias("source"), (F.lit(t) - F.col("emit_t")).cast("int").alias("delay"))
    if many is None:
        due = due.withColumn("part", F.lit(0))
    else:
        due = due.join(many, ["source", "delay"], "left").select("source", "delay", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = edges.select(*KEY, "target", "weight").join(due, KEY)
    return met.groupBy("target").agg(F.sum(F.col("weight").cast("long")).alias("current"))


def step(state: DataFrame, arrived: DataFrame | None, config: SimulationConfig) -> DataFrame:
    """id, v, refr, spike after one transition. Input is narrowed to 32 bits where a node takes it."""
    if arrived is None:
        both = state.withColumn("current", F.lit(0).cast("long"))
    else:
        both = state.join(arrived.withColumnRenamed("target", "id"), "id", "left").withColumn("current", F.coalesce("current", F.lit(0)))
    return advance(both, config).select("id", "v", "refr", "spike")


def at_risk(edges: DataFrame) -> DataFrame | None:
    """Edges of the targets whose incoming weights, all at once and by magnitude, leave 32 bits; None if there are none. An edge adds to a bucket at most once."""
    if edges.count() * -INT16[0] <= INT32[1]:
        return None
    sums = edges.groupBy("target").agg(F.sum(F.abs(F.col("weight").cast("long"))).alias("s")).where(F.col("s") > INT32[1]).select("target")
    sums = written(sums, "at-risk")
    return None if sums.isEmpty() else written(edges.join(sums, "target", "left_semi"), "at-risk-edges")


def overflowing(spikes: DataFrame, edges: DataFrame, strict: bool) -> DataFrame:
    """target, arrive_t and the sum where a bucket of arrivals is out of 32 bits, after a step or, if strict, after an edge in emission, source and edge order."""
    met = edges.join(spikes.withColumnRenamed("id", "source"), "source").select("target", (F.col("emit_t") + F.col("delay")).alias("arrive_t"), "emit_t", "source", "ord", F.col("weight").cast("long").alias("weight"))
    order = ["emit_t", "source", "ord"] if strict else ["emit_t"]
    if not strict:
        met = met.groupBy("target", "arrive_t", "emit_t").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("target", "arrive_t").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.select("target", "arrive_t", F.sum("weight").over(w).alias("s")).where(~F.col("s").between(*INT32))


def check_buckets(spikes: DataFrame, edges: DataFrame, strict: bool, after: int | None = None) -> None:
    """Raises if a bucket of arrivals leaves 32 bits; after: only buckets that are due later."""
    bad = overflowing(spikes, edges, strict)
    if not (bad if after is None else bad.where(F.col("arrive_t") > after)).isEmpty():
        raise FixedPointOverflowError("a sum of arriving weights leaves signed 32 bits")


@dataclass
class SimulationResult:
    """states: a table of id, v, refr, spike for each step; n: nodes."""

    states: list[DataFrame]
    start: DataFrame
    n: int

    @property
    def timesteps(self) -> int:
        return len(self.states)

    @property
    def spikes(self) -> DataFrame:
        """t, id of every spike."""
        empty = self.start.limit(0).select(F.lit(0).alias("t"), "id")
        for t, s in enumerate(self.states):
            empty = empty.union(s.where("spike").select(F.lit(t).alias("t"), "id"))
        return empty

    @property
    def spike_matrix(self) -> DataFrame:
        """t, id, spike for every node and step."""
        out = self.start.limit(0).select(F.lit(0).alias("t"), "id", F.lit(False).alias("spike"))
        for t, s in enumerate(self.states):
            out = out.union(s.select(F.lit(t).alias("t"), "id", "spike"))
        return out

    @property
    def final_state(self) -> DataFrame:
        return (self.states[-1] if self.states else self.start).select("id", "v", "refr")

    @property
    def final_nonzero(self) -> DataFrame:
        """How many nodes end with a potential, and with refractory steps left."""
        return self.final_state.agg(F.count_if(F.col("v") != 0).alias("potentials"), F.count_if(F.col("refr") != 0).alias("refractory"))

    @property
    def step_summary(self) -> DataFrame:
        """t, spikes, sum_v, sum_refr of every step, steps without spikes included."""
        out = self.start.limit(0).select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("spikes"), F.lit(0).cast("long").alias("sum_v"), F.lit(0).cast("long").alias("sum_refr"))
        for t, s in enumerate(self.states):
            out = out.union(s.agg(F.lit(t).cast("long").alias("t"), F.count_if("spike").alias("spikes"), F.sum(F.col("v").cast("long")).alias("sum_v"), F.sum(F.col("refr").cast("long")).alias("sum_refr")))
        return out

    @property
    def spike_count(self) -> int:
        return self.spikes.count()

    @property
    def spike_digest(self) -> str:
        """SHA-256 over a byte per step and node. Spikes stream through the driver in order; their number and the node count bound nothing but time."""
        digest, at = hashlib.sha256(), 0

        def zeros(n: int) -> None:
            for k in range(0, n, DIGEST_CHUNK):
                digest.update(bytes(min(DIGEST_CHUNK, n - k)))

        for row in self.spikes.orderBy("t", "id").toLocalIterator(prefetchPartitions=True):
            place = row["t"] * self.n + row["id"]
            zeros(place - at)
            digest.update(b"\x01")
            at = place + 1
        zeros(self.timesteps * self.n - at)
        return digest.hexdigest()


    @property
    def range_digests(self) -> DataFrame:
        """t, part and the SHA-256 of a byte per node of each step and range of nodes, made where the rows are."""
        flag = F.struct("id", F.when(F.col("spike"), "01").otherwise("00").alias("x"))
        part = F.call_function("div", F.col("id"), F.lit(DIGEST_RANGE)).cast("int")
        held = self.spike_matrix.groupBy("t", part.alias("part")).agg(F.array_sort(F.collect_list(flag)).alias("all"))
        return held.select(F.col("t").cast("long").alias("t"), F.col("part").cast("long").alias("part"), F.sha2(F.unhex(F.array_join(F.transform("all", lambda f: f["x"]), "")), 256).alias("sha256"))

    @property
    def range_digest(self) -> str:
        """SHA-256 over the digests of all ranges in order: the driver takes one row for each."""
        digest = hashlib.sha256()
        for row in self.range_digests.orderBy("t", "part").toLocalIterator():
            digest.update(bytes.fromhex(row["sha256"]))
        return digest.hexdigest()


class Stepper:
    """One step at a time: begin, schedule the graph's blocks in order, finish. close() takes the last state's name from the catalog."""

    def __init__(self, graph: Graph, config: SimulationConfig, initial: DataFrame | None = None, max_delay: int | None = None, strict: bool = True, many: DataFrame | None = None):
        """graph: its edges may have parts already, those of many."""
        require_ansi(graph.spark)
        self.graph, self.config, self.strict, self.many = graph, config, strict, many
        if "part" not in graph.edges.columns:
            self.many = hubs(graph.edges)
            self.graph = Graph(graph.neurons, dealt(graph.edges, self.many), graph.n, graph.block_size)
        self.max_delay = delay_bounds(graph.edges).first()["max_delay"] if max_delay is None else max_delay
        self.risky = at_risk(graph.edges)
        self.table = bucketed(initial_state(graph, initial), ["id"], "state")
        self.start = self.state = self.table.df
        self.states: list[DataFrame] = []
        self.sent = f"{work_dir(graph.spark)}/spikes-{uuid.uuid4().hex}"
        self.open = False
        self.next_source = 0

    def recent(self, t: int) -> DataFrame | None:
        """emit_t and id of the spikes that may arrive at step t or later; None before the first step."""
        first = max(0, t - self.max_delay)
        if not self.states:
            return None
        if self.max_delay > UNION_STEPS:
            return self.graph.spark.read.schema("id long, emit_t int").parquet(self.sent).where(F.col("emit_t") >= first)
        out = None
        for k, s in enumerate(self.states[first:], first):
            part = s.where("spike").select(F.lit(k).alias("emit_t"), "id")
            out = part if out is None else out.union(part)
        return out

    def begin_step(self) -> DataFrame:
        """The new state, spikes flagged."""
        if self.open:
            raise ConfigurationError("the step before is not finished")
        t = len(self.states)
        spikes = self.recent(t)
        arrived = None if spikes is None else arrivals(spikes, self.graph.edges, t, self.many)
        before = self.table
        try:
            self.table = bucketed(step(self.state.select("id", "v", "refr"), arrived, self.config), ["id"], "state", arranged=True)
        except PySparkException as error:
            raise translated(error) from error
        self.state = self.table.df
        plain = before.unnamed()
        if self.states:
            self.states[-1] = plain
        else:
            self.start = plain
        self.states.append(self.state)
        if self.max_delay > UNION_STEPS:
            self.state.where("spike").select("id").write.parquet(f"{self.sent}/emit_t={t}")
        if self.risky is not None:
            check_buckets(self.recent(t + 1), self.risky, self.strict, after=t)
        self.open, self.next_source = True, 0
        return self.state

    def close(self) -> None:
        plain = self.table.unnamed()
        if self.states:
            self.states[-1] = plain
        else:
            self.start = plain
        self.state = plain
        if self.max_delay > UNION_STEPS:
            remove(self.graph.spark, self.sent)

    def schedule_block(self, source_start: int, source_count: int) -> None:
        """Declares a block's edges scheduled. Blocks must follow each other; the join itself happens at arrival."""
        if not self.open:
            raise ConfigurationError("no step is open")
        if source_start != self.next_source or source_count < 0 or source_start + source_count > self.graph.n:
            raise ConfigurationError("a block does not start where the one before ends")
        self.next_source += source_count

    def finish_step(self) -> None:
        if not self.open:
            raise ConfigurationError("no step is open")
        if self.next_source != self.graph.n:
            raise ConfigurationError("blocks do not cover every source")
        self.open = False

    @property
    def result(self) -> SimulationResult:
        return SimulationResult(list(self.states), self.start, self.graph.n)


def simulate(graph: Graph, config: SimulationConfig, *, timesteps: int, initial: DataFrame | None = None, residency: str = "resident", strict: bool = True) -> SimulationResult:
    """residency: resident keeps the edges in memory between steps, streamed scans a table of them at each; both partitioned by source and delay.

    strict: sums of arriving weights are checked after every edge rather than after every step.
    """
    if timesteps < 0:
        raise ConfigurationError("timesteps must not be negative")
    if residency not in ("resident", "streamed"):
        raise ConfigurationError(f"unknown residency: {residency}")
    many = hubs(graph.edges)
    edges = dealt(graph.edges.select("source", "ord", "target", "weight", "delay"), many)
    table = None
    if residency == "resident":
        edges = edges.repartition(*KEY).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        table = bucketed(edges, KEY, "edges")
        edges = table.df
    stepper = None
    try:
        stepper = Stepper(Graph(graph.neurons, edges, graph.n, graph.block_size), config, initial, strict=strict, many=many)
        for _ in range(timesteps):
            stepper.begin_step()
            stepper.schedule_block(0, graph.n)
            stepper.finish_step()
        stepper.close()
        return stepper.result
    finally:
        edges.unpersist() if table is None else table.drop()
