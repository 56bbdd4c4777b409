"""Joins beyond plain equality: blocked pairs, nearest dates, tiers, claims, chains."""

from __future__ import annotations

import math
from collections import deque
from decimal import ROUND_HALF_UP, Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.sizing import lookup
from vellum.session import materialize, release


def blocked_pairs(df: DataFrame, key: str, block: list[str], columns: list[str]) -> DataFrame:
    """Pairs key_1 < key_2 of rows that share a block (J23); null blocks meet nobody.

    Hot blocks are split by adaptive execution, as this is an equi-join.
    """
    left = df.select(*block, *[F.col(c).alias(f"{c}_1") for c in [key, *columns]])
    right = df.select(*block, *[F.col(c).alias(f"{c}_2") for c in [key, *columns]])
    return left.join(right, block).where(F.col(f"{key}_1") < F.col(f"{key}_2"))


def edit_score(a: Column, b: Column, most: int = 2) -> tuple[Column, Column]:
    """(distance or null above ``most``, 1 - distance / longer length)."""
    d = F.levenshtein(a, b, most)
    d = F.when(d >= 0, d)
    return d, F.round(1 - d / F.greatest(F.length(a), F.length(b)), 6)


def nearest_by_offset(left: DataFrame, right: DataFrame, keys: list[str], date: str, right_id: str, offsets: list[int], left_id: str) -> DataFrame:
    """For each left row the right row of the same key at the first offset that has
    one, offsets in order of preference, smallest id at a tie (J19)."""
    tried = left.withColumn("_try", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(o).alias("o")) for i, o in enumerate(offsets)])))
    tried = tried.withColumn("_at", F.date_add(F.col(date), F.col("_try.o")))
    r = right.select(*keys, F.col(date).alias("_at"), F.col(right_id).alias("_rid"))
    met = tried.join(r, [*keys, "_at"]).groupBy(left_id).agg(F.min(F.struct("_try.p", "_rid", "_try.o")).alias("_b"))
    return met.select(left_id, F.col("_b._rid").alias("match_id"), F.col("_b.o").alias("offset_days"))


def first_of_tiers(df: DataFrame, keys: list[str], tiers: list[tuple[str, Column]], prefer: list[Column]) -> DataFrame:
    """Candidate rows reduced to the best tier that holds, one per key."""
    rank, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (label, test) in reversed(list(enumerate(tiers))):
        hit = F.coalesce(test, F.lit(False))
        rank, name = F.when(hit, i).otherwise(rank), F.when(hit, label).otherwise(name)
    told = df.withColumn("_rank", rank).withColumn("tier", name).where("_rank is not null")
    w = Window.partitionBy(*keys).orderBy("_rank", *prefer)
    return told.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_rank")


def greedy_claim(candidates: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """Pairs claimed best first inside each group, every left and right row once.

    A group's candidates are sorted in one task: group by something bounded such as
    one day of one place.
    """
    schema = candidates.select(group, left, right, score).schema

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_l, taken_r, rows = set(), set(), []
        for row in pdf.sort_values([score, left, right], ascending=[False, True, True]).itertuples(index=False):
            a, b = getattr(row, left), getattr(row, right)
            if a not in taken_l and b not in taken_r:
                taken_l.add(a)
                taken_r.add(b)
                rows.append(tuple(row))
        return pd.DataFrame(rows, columns=list(pdf.columns))

    return candidates.select(group, left, right, score).groupBy(group).applyInPandas(claim, schema)


def closeness(a: Column, b: Column) -> Column:
    """1 - difference / larger value of two positive numbers, to 6 places."""
    return F.round(1 - F.abs(a - b) / F.greatest(a, b), 6)


def _level(low: float, high: float) -> int:
    """Millionths of ``closeness``, rounded as Spark does: half up on the shortest decimals."""
    x = 1 - (high - low) / high
    y = x * 1e6 + 0.5
    n = int(y)
    if 1e-6 < y - n < 1 - 1e-6:
        return n
    return int(Decimal(repr(x)).scaleb(6).to_integral_value(ROUND_HALF_UP))


def _closest_claims(value: np.ndarray, right: np.ndarray, code: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Positions (left, right) claimed among finite values by level, left code, right code.

    Rows of one value and side are a node; nodes stand in a list by value. Of the rows
    still free the best pair stands side by side, so a heap of neighbours gives the
    next level; no free pair has a better one, so what a node meets at it lies around it.
    """
    order = np.lexsort((code, right, value))
    v, r, c = value[order], right[order], code[order].tolist()
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(v) else np.zeros(0, int)
    n, head, stop = len(starts), starts.tolist(), [*starts[1:].tolist(), len(v)]
    val, side = v[starts].tolist(), r[starts].tolist()
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    taken: tuple[set, set] = (set(), set())
    heap = [(-_level(val[i], val[i + 1]), i) for i in range(n - 1) if side[i] != side[i + 1]]
    heap = [x for x in heap if -x[0] >= least]
    heapify(heap)

    def first(i: int) -> int:
        """Lowest free code of a node, or -1, where it leaves the list."""
        own = taken[side[i]]
        while head[i] < stop[i]:
            if c[head[i]] not in own:
                return c[head[i]]
            head[i] += 1
        if alive[i]:
            alive[i] = False
            p, q = before[i], after[i]
            if p >= 0:
                after[p] = q
            if q >= 0:
                before[q] = p
            if p >= 0 and q >= 0 and side[p] != side[q] and (at := _level(val[p], val[q])) >= least:
                heappush(heap, (-at, p))
        return -1

    claims = []
    while heap:
        at, live = -heap[0][0], {}
        while heap and heap[0][0] == -at:
            i = heappop(heap)[1]
            if not alive[i] or (j := after[i]) < 0 or side[i] == side[j] or _level(val[i], val[j]) != at:
                continue
            if first(i) < 0 or first(j) < 0:
                continue  # what became neighbours is in the heap
            # all left nodes up to the next right one meet this right one at this level
            x, way, y = (j, after, i) if side[i] else (i, before, j)
            while x >= 0:
                if not side[x]:
                    if _level(*sorted((val[x], val[y]))) != at:
                        break
                    live[x] = None
                elif first(x) >= 0:
                    break
                x = way[x]
        ready = [(f, x) for x in live if (f := first(x)) >= 0]
        heapify(ready)
        while ready:
            f, x = heappop(ready)
            if (now := first(x)) != f:  # the code was claimed from another node
                if now >= 0:
                    heappush(ready, (now, x))
                continue
            met = []  # (code of the lowest right row met, its node, left node), of all nodes that hold the code
            while True:
                low, of = -1, -1
                for way in (before, after):
                    y = way[x]
                    while y >= 0 and (_level(val[x], val[y]) if way is after else _level(val[y], val[x])) >= at:
                        if side[y] and (g := first(y)) >= 0 and (low < 0 or g < low):
                            low, of = g, y
                        y = way[y]
                if low >= 0:  # else nobody of this node meets anything at this level
                    met.append((low, of, x))
                if not ready or ready[0][0] != f:
                    break
                x = heappop(ready)[1]
            if met:
                low, of, x = min(met)
                claims.append((int(order[head[x]]), int(order[head[of]])))
                taken[0].add(f)
                taken[1].add(low)
                first(of)
                for _, _, x in met:
                    if (now := first(x)) >= 0:
                        heappush(ready, (now, x))
    return claims


def _nan_claims(value: np.ndarray, right: np.ndarray, code: np.ndarray, claims: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Claims after all others: a value that isn't finite has the score NaN with any
    value, which passes every floor and comes last, as null."""
    finite, found, used = np.isfinite(value), [], set()
    taken = [{code[i] for i, _ in claims}, {code[j] for _, j in claims}]
    free: list[dict] = [{}, {}]  # by side: code -> row, not finite where it has such a row
    for i in np.lexsort((finite, code)).tolist():
        side = int(right[i])
        if code[i] not in taken[side]:
            free[side].setdefault(code[i], i)
    every = deque(free[1].items())
    odd = deque(x for x in every if not finite[x[1]])
    for i in free[0].values():
        among = odd if finite[i] else every
        while among and among[0][0] in used:
            among.popleft()
        if among:
            used.add(among[0][0])
            found.append((i, among[0][1]))
    return found


def claim_closest(df: DataFrame, group: str, key: str, value: str, right: Column, least: float) -> DataFrame:
    """``greedy_claim`` by ``closeness`` of all pairs of a group that reach ``least``
    (0.5 or more), without making the pairs (J18, X2): (group, l, r, score).

    ``right`` tells right rows from left ones. Values must be positive doubles. A group's rows
    go to one task, which takes memory in proportion to them; its time grows with the square
    only of the different values within a millionth of each other.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).alias("v"), right.alias("s")).where("g IS NOT NULL AND v IS NOT NULL AND s IS NOT NULL")
    floor = math.ceil(round(least * 1e6, 3))

    def claim(part: pa.Table) -> pa.Table:
        part = part.sort_by("k").combine_chunks()  # nulls last
        k = part["k"]
        same = np.zeros(len(k), bool)
        same[1:] = pc.equal(k[1:], k[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        code = np.cumsum(~same)
        v, s = part["v"].to_numpy(), part["s"].to_numpy()
        finite = np.flatnonzero(np.isfinite(v))
        claims = [(int(finite[i]), int(finite[j])) for i, j in _closest_claims(v[finite], s[finite], code[finite], floor)]
        if len(finite) < len(v):
            claims += _nan_claims(v, s, code, claims)
        at = np.array(claims, int).reshape(-1, 2)
        a, b = part.take(pa.array(at[:, 0])), part.take(pa.array(at[:, 1]))
        return pa.table([a["g"], a["k"], b["k"], a["v"], b["v"]], names=["g", "l", "r", "a", "b"])

    types = dict(rows.dtypes)
    claimed = rows.groupBy("g").applyInArrow(claim, f"g {types['g']}, l {types['k']}, r {types['k']}, a double, b double")
    return claimed.select(F.col("g").alias(group), "l", "r", F.nanvl(closeness(F.col("a"), F.col("b")), F.lit(None)).alias("score"))


def range_lookup(df: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Equi-join with a ``between`` residual (J7); the ranges are broadcast if small."""
    inside = F.col(at).between(F.col(start), F.col(end))
    for k in keys:
        inside = inside & (df[k] == ranges[k])
    return df.join(lookup(ranges), inside, how)


def min_label_components(edges: DataFrame, a: str, b: str, max_rounds: int = 30) -> DataFrame:
    """(vertex, component): smallest vertex reachable, by large-star and small-star
    rounds on tables in the shared folder (E10, E11). Raises if not stable in time."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs)
    last = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_low.select("u", F.col("m").alias("v")))
        step = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(pairs)
        pairs = step
        if last == now:
            roots = pairs.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
            return pairs.unionByName(roots).select(F.col("u").alias("vertex"), F.col("v").alias("component")).distinct()
        last = now
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def final_of_chain(links: DataFrame, old: str, new: str, max_depth: int = 20) -> DataFrame:
    """(old, final, depth): where a chain of replacements ends (E12), by pointer
    doubling. Raises if a chain is longer than 2 ** max_depth, as a circle is."""
    hop = materialize(links.where(F.col(new).isNotNull()).select(F.col(old).alias("o"), F.col(new).alias("f"), F.lit(1).alias("d")))
    for _ in range(max_depth):
        nxt = hop.select(F.col("o").alias("f"), F.col("f").alias("_f"), F.col("d").alias("_d"))
        step = materialize(hop.join(nxt, "f", "left").select("o", F.coalesce("_f", "f").alias("f"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
        open_ = step.join(hop.select(F.col("o").alias("f")), "f", "left_semi").limit(1).count()
        release(hop)
        hop = step
        if not open_:
            return hop.select(F.col("o").alias(old), F.col("f").alias("final"), F.col("d").alias("depth"))
    raise RuntimeError("a chain of replacements doesn't end")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, n): 1, 2, 3 ... in key order, by ranks inside range partitions plus the
    sizes of those before; no task sorts all rows (W1)."""
    parts = df.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    parts = materialize(parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("c"))  # one row per partition
    before = sizes.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "_p").select(key, (F.col("_r") + F.col("b")).alias("n"))
