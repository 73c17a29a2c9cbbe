"""Mixing overlapping sources to target weights by min-cost flow.

Copies of a text under several sources make one document that is a member of all of them. Documents are aggregated
by membership pattern (the set of their sources) to token capacities. A min-cost flow routes each pattern's tokens
to the quotas of its sources: the k-th repetition of a token costs k - 1 (convex), so nothing is repeated while an
unused token could serve, and repetitions spread evenly. Along each pattern's line of tokens, on which a seeded hash
orders its documents, the flow is cut into one stretch a source; a document is selected once for each stretch (and
repetition) in which it begins.

The driver gets one row a pattern: there are at most 2**sources of them however many documents there are.

Target weights are given, or follow the sources' tokens to the power TEMPERATURE. The token budget is given, or is
the smallest at which no quota is below what its source holds, so that each document is selected at least once.

Tokens are repeated as often as the quotas need, unless a number of repetitions is given as the most; a quota beyond
that stays partly unfilled.

Defined results: a null source counts as the source ""; null and empty texts have no tokens and are never selected;
rows without a doc_id take no part; of copies (and repeated rows) the smallest doc_id stands for all; rows that share
a doc_id but not their text are different documents; hash ties fall to the smaller doc_id, then the smaller digest of
the text; a source without a given weight gets no quota; an empty table gives an empty result; ``mixed`` returns the
columns of its input, whatever they are called, ``source`` being the source served; of rows equal in doc_id and text
it takes the one with the first source, then the smallest hash of the whole row.

``select`` runs jobs at once: the driver plans with the patterns' capacities.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.tables import fresh, written

TEMPERATURE = 0.8
SEED = 17
#: Hash ranges of a pattern, so that no task sorts a whole pattern.
BUCKETS = 1024
#: Most patterns whose table is broadcast; beyond, the join is shuffled.
BROADCAST_PATTERNS = 50_000


class MinCostFlow:
    """Successive shortest paths: distances by label correction, then blocking flows on the shortest arcs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        k = len(self.to)
        self.arcs[a].append(k)
        self.arcs[b].append(k + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return k

    def flow(self, k: int) -> int:
        return self.left[k ^ 1]

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Largest flow at least cost: (flow, cost)."""
        total = paid = 0
        while True:
            distance: list[float] = [float("inf")] * len(self.arcs)
            distance[source], waiting, queued = 0, deque([source]), {source}
            while waiting:
                a = waiting.popleft()
                queued.discard(a)
                for k in self.arcs[a]:
                    b = self.to[k]
                    if self.left[k] and distance[a] + self.cost[k] < distance[b]:
                        distance[b] = distance[a] + self.cost[k]
                        if b not in queued:
                            queued.add(b)
                            waiting.append(b)
            if distance[sink] == float("inf"):
                return total, paid
            while sent := self._blocking(source, sink, distance):
                total += sent
                paid += sent * int(distance[sink])

    def _blocking(self, source: int, sink: int, distance: list[float]) -> int:
        level = [-1] * len(self.arcs)
        level[source], waiting = 0, deque([source])
        while waiting:
            a = waiting.popleft()
            for k in self.arcs[a]:
                b = self.to[k]
                if self.left[k] and level[b] < 0 and distance[a] + self.cost[k] == distance[b]:
                    level[b] = level[a] + 1
                    waiting.append(b)
        if level[sink] < 0:
            return 0
        at, sent, path = [0] * len(self.arcs), 0, []
        a = source
        while True:
            if a == sink:
                least = min(self.left[k] for k in path)
                for k in path:
                    self.left[k] -= least
                    self.left[k ^ 1] += least
                sent += least
                cut = next(i for i, k in enumerate(path) if not self.left[k])
                a = self.to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(self.arcs[a]):
                k = self.arcs[a][at[a]]
                b = self.to[k]
                if self.left[k] and level[b] == level[a] + 1 and distance[a] + self.cost[k] == distance[b]:
                    break
                at[a] += 1
            if at[a] < len(self.arcs[a]):
                path.append(k)
                a = b
            elif a == source:
                return sent
            else:
                k = path.pop()
                a = self.to[k ^ 1]
                at[a] += 1


def _flow(capacity: Mapping[tuple[str, ...], int], quotas: Mapping[str, int], repeats: int) -> tuple[dict[tuple[str, ...], list[tuple[str, int]]], int]:
    """Tokens that each pattern sends to each of its sources, and their sum."""
    names, patterns = sorted(quotas), sorted(capacity)
    number = {s: 1 + len(patterns) + k for k, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    net, routes = MinCostFlow(sink + 1), {}
    for k, p in enumerate(patterns, 1):
        for n in range(repeats):
            net.add(0, k, capacity[p], n)
        routes[p] = [(s, net.add(k, number[s], capacity[p] * repeats)) for s in p if s in number]
    for s in names:
        net.add(number[s], sink, quotas[s])
    total, _ = net.run(0, sink)
    return {p: [(s, net.flow(a)) for s, a in arcs if net.flow(a)] for p, arcs in routes.items()}, total


def route(capacity: Mapping[tuple[str, ...], int], weights: Mapping[str, float] | None = None, budget: int | None = None, repeats: int | None = None, temperature: float = TEMPERATURE) -> dict[tuple[str, ...], list[tuple[str, int]]]:
    """Tokens that each pattern sends to each of its sources.

    Without a number of repetitions it is doubled until every quota is filled. No more would change the result: one
    more repetition costs more than any in use, so no exchange for it could pay.
    """
    held: dict[str, int] = {}
    for pattern, tokens in capacity.items():
        for s in pattern:
            held[s] = held.get(s, 0) + tokens
    if weights is None:
        weights = {s: t**temperature for s, t in held.items() if t}
    weights = {s: w for s, w in weights.items() if w > 0}
    whole = sum(weights.values())
    if not whole:
        return {}
    if budget is None:
        budget = max([0, *(-int(-held[s] * whole // w) for s, w in weights.items() if s in held)])
    quotas = {s: round(budget * w / whole) for s, w in weights.items()}
    if repeats is not None:
        return _flow(capacity, quotas, repeats)[0]
    wanted, repeats = sum(q for s, q in quotas.items() if held.get(s)), 2
    while True:
        flows, total = _flow(capacity, quotas, repeats)
        if total == wanted:
            return flows
        repeats *= 2


def _selected(docs: DataFrame, weights: Mapping[str, float] | None, budget: int | None, seed: int, repeats: int | None) -> DataFrame:
    """doc_id, copy (digest of the text), source (served), repetition (from 1), tokens: one row per selection."""
    spark = docs.sparkSession
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.md5(F.col("text").cast("string")).alias("copy"),
        F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")).cast("long").alias("tokens"),
    ).where("doc_id is not null and tokens > 0")
    merged = light.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"))
    members = written(merged.select("doc_id", "copy", "pattern", "tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(BUCKETS)).alias("bucket")), "mixing-members")
    capacity = {tuple(r.pattern): r.tokens for r in members.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    rows = []
    for pattern, flows in route(capacity, weights, budget, repeats).items():
        upto, cuts = 0, []
        for s, tokens in flows:
            upto += tokens
            cuts.append((upto, s))
        if cuts:
            rows.append((list(pattern), capacity[pattern], upto, cuts))
    plan = spark.createDataFrame(rows, "pattern array<string>, held long, sent long, cuts array<struct<upto: long, source: string>>")
    if len(rows) <= BROADCAST_PATTERNS:
        plan = F.broadcast(plan)
    sums = members.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select("pattern", "bucket", (F.sum("in_bucket").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    order = W.partitionBy("pattern", "bucket").orderBy("h", "doc_id", "copy").rowsBetween(W.unboundedPreceding, 0)
    placed = members.join(before, ["pattern", "bucket"]).select("pattern", "doc_id", "copy", "tokens", (F.col("before") + F.sum("tokens").over(order) - F.col("tokens")).alias("begins"))
    return (
        placed.join(plan, "pattern")
        .where("begins < sent")
        .select("doc_id", "copy", "tokens", "cuts", "held", "begins", F.explode(F.sequence(F.lit(1), F.ceil((F.col("sent") - F.col("begins")) / F.col("held")).cast("int"))).alias("repetition"))
        .withColumn("begins", F.col("begins") + (F.col("repetition") - 1) * F.col("held"))
        .select("doc_id", "copy", F.expr("filter(cuts, c -> begins < c.upto)[0].source").alias("source"), "repetition", "tokens")
    )


def select(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, seed: int = SEED, repeats: int | None = None) -> DataFrame:
    """doc_id, source (served), repetition (from 1), tokens: one row per selection."""
    return _selected(docs, weights, budget, seed, repeats).select("doc_id", "source", "repetition", "tokens")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, seed: int = SEED, repeats: int | None = None) -> DataFrame:
    """The selected documents, each as often as it was selected, with the columns of docs.

    Rows are brought together by doc_id and text once, for choosing one of equals and for the join alike.
    """
    i, copy, n, i2, copy2, served = fresh(docs.columns, "i", "copy", "n", "i2", "copy2", "served")
    chosen = _selected(docs, weights, budget, seed, repeats).select(F.col("doc_id").alias(i2), F.col("copy").alias(copy2), F.col("source").alias(served))
    whole = F.xxhash64(*(c if not t.startswith("map") and "map<" not in t else F.to_json(c) for c, t in docs.dtypes))
    first = F.row_number().over(W.partitionBy(i, copy).orderBy(F.col("source").asc_nulls_first(), whole))
    one = docs.withColumns({i: F.col("doc_id").cast("long"), copy: F.md5(F.col("text").cast("string"))}).withColumn(n, first).where(F.col(n) == 1)
    kind = docs.schema["source"].dataType
    return one.join(chosen, (F.col(i) == F.col(i2)) & (F.col(copy) == F.col(copy2))).select(*(F.col(served).cast(kind).alias(c) if c == "source" else F.col(f"`{c}`") for c in docs.columns))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"))
