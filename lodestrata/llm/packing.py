"""Filling fixed-capacity containers with items of varying length.

The lengths' histogram, which has no more rows than the capacity, goes to the driver; there the configuration
linear program is solved by multiplicative weights, with a knapsack dynamic program that prices configurations,
and rounded. The plan says which ranks of each length go to which containers; items find theirs by their rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import Workspace, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE of this vocabulary splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_BITS = 1 << 40


@dataclass(frozen=True)
class Plan:
    """Sorted by key = length * 2**40 + first rank: the first container of the range and how many of a length each takes."""

    key: np.ndarray
    first: np.ndarray
    per: np.ndarray
    containers: int
    lp_containers: int
    lower_bound: float


def price_best(lengths: np.ndarray, value: np.ndarray, demand: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration (index of length: number) of greatest value that fits and takes no length more often than demand has it."""
    best, spare = np.zeros(capacity + 1), np.empty(capacity + 1)
    items: list[tuple[int, int]] = []
    for j in np.flatnonzero((demand > 0) & (value > 0)):
        n, k = min(int(demand[j]), capacity // int(lengths[j])), 1
        while n > 0:  # 1, 2, 4, ... of a length and what is left make every number of it
            k = min(k, n)
            items.append((int(j), k))
            n, k = n - k, k * 2
    took = np.zeros((len(items), capacity + 1), dtype=bool)
    for t, (j, k) in enumerate(items):
        w = k * int(lengths[j])
        got = np.add(best[: capacity + 1 - w], k * value[j], out=spare[: capacity + 1 - w])
        np.greater(got, best[w:], out=took[t, w:])
        np.maximum(got, best[w:], out=best[w:])
    out: dict[int, int] = {}
    c = capacity
    for t in range(len(items) - 1, -1, -1):
        if took[t, c]:
            j, k = items[t]
            out[j] = out.get(j, 0) + k
            c -= k * int(lengths[j])
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = 256, rate: float = 4.0, part: float = 0.5) -> Plan:
    """The plan for a histogram {length: number}, lengths from 1 to capacity; empty for none.

    Each round prices lengths by exp(-rate * covered share) and takes the best configuration of what is left, in whole
    containers: part of what the scarcest of its lengths allows, all of it after that many rounds, at least one. It ends
    when every length is covered; each round covers a container at least, and after the first rounds it exhausts what
    allows its configuration. So the containers are a primal solution in whole numbers, at every size of the input alike;
    lower_bound is the best value of the dual met on the way, from prices tried on the whole demand, and the linear
    program's value lies between them.
    """
    if not histogram:
        return Plan(*(np.zeros(0, np.int64) for _ in range(3)), 0, 0, 0.0)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    left, rank, rows, base, r = demand.copy(), np.zeros(len(lengths), np.int64), [], 0, 0
    bound = float((lengths * demand).sum()) / capacity  # the dual with prices in proportion to the lengths
    while left.any():
        value = lengths / capacity * np.exp(-rate * (1 - left / demand))
        if r and r % rounds == 0:
            whole = price_best(lengths, value, demand, capacity)
            bound = max(bound, float((value * demand).sum()) / sum(float(value[j]) * n for j, n in whole.items()))
        c = price_best(lengths, value, left, capacity)
        most = min(int(left[j]) // k for j, k in c.items())
        n = max(1, int(part * most)) if r < rounds else most
        for j, k in sorted(c.items()):
            rows.append((int(lengths[j]) * RANK_BITS + int(rank[j]), base, k))
            rank[j] += k * n
            left[j] -= k * n
        base, r = base + n, r + 1
    rows.sort()
    k, f, p = (np.array(c, dtype=np.int64) for c in zip(*rows))
    return Plan(k, f, p, base, base, bound)


def token_counts(docs: DataFrame, id_col: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) by a public byte-level BPE; null texts have no tokens. The vocabulary, of a fixed size, goes to the workers."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))).mapInPandas(run, f"doc_id {kind}, n_tokens long")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens): an item longer than a container is cut into full ones and a rest; no other is cut."""
    full = F.floor(F.col("n_tokens") / capacity)
    last = F.when(F.col("n_tokens") % capacity == 0, F.greatest(full - 1, F.lit(0))).otherwise(full)
    d = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return d.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))


def audit(packed: DataFrame, counts: DataFrame, capacity: int = 2048, gap: float = 0.01) -> DataFrame:
    """(rule, holds) of what pack() gave for the tokens of token_counts(): one row a rule."""
    c = packed.where("container_id is not null")
    w = Window.partitionBy("container_id").orderBy("place")
    per = c.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    apart = c.select((F.coalesce(F.lag(F.col("place") + F.col("n_tokens")).over(w), F.lit(0)) == F.col("place")).alias("ok"))
    items = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("kinds"))
    want = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("longest"), F.count("*").alias("copies"))
    both = items.join(want, "doc_id", "full")
    rules = [
        per.agg(F.lit("no container over capacity").alias("rule"), F.coalesce(F.max("n") <= capacity, F.lit(True)).alias("holds")),
        per.agg(F.lit("containers near the bound").alias("rule"), (F.count("*") <= F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / capacity * (1 + gap)) + 1).alias("holds")),
        apart.agg(F.lit("places follow each other").alias("rule"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("holds")),
        both.agg(F.lit("every token once").alias("rule"), F.coalesce(F.bool_and(F.coalesce(F.col("n") == F.col("want"), F.lit(False))), F.lit(True)).alias("holds")),
        both.agg(F.lit("only longer items are cut").alias("rule"), F.coalesce(F.bool_and((F.col("longest") > capacity) | (F.col("pieces") == F.col("copies"))), F.lit(True)).alias("holds")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, salts: int = 64, rounds: int = 256, ws: Workspace | None = None) -> DataFrame:
    """(container_id, doc_id, piece, n_tokens, place): every item in one container, place its first token there.

    No container holds more than capacity tokens; only items longer than it are cut. A document without tokens has a
    null container and place. Repeated documents are items each. A length's items are ranked in two steps, over
    salts, so a length that a third of all items have is many tasks. What goes to the driver, and back, is bounded
    by the capacity and the number of rounds.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    items = ws.save(pieces(token_counts(docs, id_col, text, vocabulary), capacity), "items")
    histogram = {int(r[0]): int(r[1]) for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    plan = spark.sparkContext.broadcast(solve(histogram, capacity, rounds))

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        p, key = plan.value, n.to_numpy(np.int64) * RANK_BITS + rank.to_numpy(np.int64)
        at = np.searchsorted(p.key, key, "right") - 1
        return pd.Series(p.first[at] + (key - p.key[at]) // p.per[at])

    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    blocks = salted.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("size"))
    before = blocks.select("n_tokens", "salt", (F.sum("size").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("size")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    d = salted.where("n_tokens > 0").withColumn("inner", inner).join(before, ["n_tokens", "salt"])
    d = d.select("doc_id", "piece", "n_tokens", container("n_tokens", F.col("base") + F.col("inner")).alias("container_id"))
    w = Window.partitionBy("container_id").orderBy(F.desc("n_tokens"), "doc_id", "piece")
    d = d.select("container_id", "doc_id", "piece", "n_tokens", (F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("place"))
    none = items.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container_id"), "doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("place"))
    return d.unionByName(none)
