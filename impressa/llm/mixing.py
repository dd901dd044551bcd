"""Mixing overlapping sources to target weights by min-cost flow (operator 6).

Documents are aggregated by membership pattern (the set of sources that claim
them).  The flow network has one node per pattern and one per source: a pattern
can give each of its words once at cost 0, a second time at cost 1, and so on
(convex repetition costs, ``max_repeats`` levels), to any source of the
pattern; a source takes its quota.  Minimising cost means no word is repeated
while an unused one could serve.  The routed amount of each pattern says how
many whole passes over its documents are taken and how many words of a further
pass; documents of that pass are chosen in a seeded hash order.

Scale: sizes by pattern and by source, quotas and cuts are tables.  A source
that no other overlaps needs no flow (its pattern gives the quota, as far as
its passes reach), so any number of such sources is mixed by joins.  Only
patterns of overlapping sources come to the driver, as one sum each (at most
``MAX_PATTERNS``, an error beyond).  The cut in the hash order is found by refining
ranges: each level sums words over 1024 ranges per pattern with map-side
combination and then looks only inside the range that the cut falls into, so no
pattern is ever sorted in one task.

Defined results: null text has size 0; documents of no source (an empty or null
membership array) take nothing; null is a source like any other; documents of
size 0 are never taken; repeated rows are separate capacity, and rows alike in
id and text share their place in the order and are taken together; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.common import WORD
from impressa.operators.ordering import global_index
from impressa.sources.sinks import stage

MAX_PATTERNS = 50_000
RANGE_BITS = 10
HASH_BITS = 60


def targets_by_weight(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """``share`` of all words dealt by weight; a target stops at ``most`` times its source, the excess is reshared."""
    goal = [0.0] * len(sizes)
    left, free = share * sum(sizes), {i for i in range(len(sizes)) if sizes[i] > 0}
    while free and left > 0:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                goal[i] = left * weights[i] / total
            break
        for i in over:
            goal[i] = most * sizes[i]
            left -= goal[i]
        free -= over
    return goal


def min_cost_flow(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, int]:
    """Words that each pattern gives, by successive shortest paths over (pattern, source) arcs.

    Level r of a pattern (its r-th repetition) costs r.  All arcs from a
    pattern to its sources cost 0, so a shortest augmenting path is found by a
    breadth-first search from the cheapest level that still reaches a hungry
    source, through reassignments of flow already routed.
    """
    flow: dict[tuple, dict] = {p: {} for p in capacity}
    used = dict.fromkeys(capacity, 0)
    need = {s: max(0, int(round(q))) for s, q in quota.items()}
    givers: dict = {}
    for p in capacity:
        for s in p:
            givers.setdefault(s, []).append(p)
    for level in range(repeats):
        for p in sorted(capacity, key=lambda p: (len(p), str(p))):
            room = capacity[p] * (level + 1) - used[p]
            while room > 0:
                came, queue, goal = {s: (p, None) for s in p if s in need}, deque(s for s in p if s in need), None
                while queue:
                    s = queue.popleft()
                    if need[s] > 0:
                        goal = s
                        break
                    for q in givers[s]:
                        if flow[q].get(s, 0) > 0:
                            for t in q:
                                if t in need and t not in came:
                                    came[t] = (q, s)
                                    queue.append(t)
                if goal is None:
                    break
                path, s = [], goal
                while s is not None:
                    q, back = came[s]
                    path.append((q, s, back))
                    s = back
                step = min([room, need[goal], *(flow[q][b] for q, _, b in path if b is not None)])
                for q, s, b in path:
                    flow[q][s] = flow[q].get(s, 0) + step
                    if b is not None:
                        flow[q][b] -= step
                need[goal] -= step
                used[p] += step
                room -= step
    return used


PATTERN, CLAIMS, HASH = "__llm_pattern", "__llm_claims", "__llm_h"


def _cuts(rows: DataFrame, partial: DataFrame) -> DataFrame:
    """(pattern, cut): per pattern, the hash below which documents make up ``left`` words (nearest to it).

    ``rows``: (pattern, h, size); ``partial``: (pattern, left).  Documents at
    one hash are taken together or not at all.
    """
    state = partial.select(PATTERN, F.lit(0).cast("long").alias("low"), "left")
    done, shift = [], HASH_BITS
    while shift > 0:
        shift -= RANGE_BITS
        wide = 1 << (shift + RANGE_BITS)
        inside = rows.where("size > 0").join(state, PATTERN).where((F.col(HASH) >= F.col("low")) & (F.col(HASH) < F.col("low") + F.lit(wide)))
        sums = inside.groupBy(PATTERN, "low", "left", F.shiftright(F.col(HASH) - F.col("low"), shift).alias("r")).agg(
            F.sum("size").alias("w"), (F.min(HASH) == F.max(HASH)).alias("one"))
        upto = Window.partitionBy(PATTERN).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("w").over(upto)).where(F.col("upto") > F.col("left")).groupBy(PATTERN).agg(
            F.min(F.struct("r", "w", "one", "low", (F.col("left") - F.col("upto") + F.col("w")).alias("left"))).alias("x"))
        found = state.select(PATTERN, F.col("low").alias("_low")).join(sums, PATTERN, "left")
        start = F.col("x.low") + F.shiftleft(F.col("x.r").cast("long"), shift)
        ends = F.col("x").isNull() | F.col("x.one") | F.lit(shift == 0)
        cut = (F.when(F.col("x").isNull(), F.col("_low") + F.lit(wide)).when(2 * F.col("x.left") < F.col("x.w"), start)
               .otherwise(start + F.lit(1 << shift)))
        found = stage(found.select(PATTERN, F.when(ends, cut).alias("cut"), start.alias("low"), F.col("x.left").alias("left")), "mix-cuts")
        done.append(found.where("cut IS NOT NULL").select(PATTERN, "cut"))
        state = found.where("cut IS NULL").select(PATTERN, "low", "left")
        if state.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _claim(source) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _routed(patterns: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """(pattern, used): words that every pattern gives."""
    spark = patterns.sparkSession
    of = patterns.select(PATTERN, "w", F.size("claims").alias("k"), F.explode("claims").alias("claim")).join(sources, "claim")
    alone = of.where((F.col("k") == 1) & (F.col("widest") == 1)).select(
        PATTERN, F.least(F.greatest(F.bround("quota"), F.lit(0)).cast("long"), F.col("w") * max_repeats).alias("used"))
    shared = of.groupBy(PATTERN, "w").agg(F.max("widest").alias("widest"), F.collect_list(F.struct("claim", "quota")).alias("q")).where("widest > 1")
    rows = shared.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of overlapping sources")
    name = {tuple(sorted(c["claim"] for c in r["q"])): r[PATTERN] for r in rows}
    capacity = {tuple(sorted(c["claim"] for c in r["q"])): r["w"] for r in rows}
    used = min_cost_flow(capacity, {c["claim"]: c["quota"] for r in rows for c in r["q"]}, max_repeats)
    return alone.unionByName(spark.createDataFrame([(name[p], int(u)) for p, u in used.items()], f"{PATTERN} string, used long"))


def mix(docs: DataFrame, sources: Column, quotas, size: Column | None = None, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with size, target (summed over the document's sources) and taken (words).

    ``sources``: array of source names; null inside it is a source.  ``quotas``
    is a dict by source, or a function from the table (source, source_size) to
    a table (source, quota).
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long") if size is None else size
    spark = docs.sparkSession
    one = F.array_sort(F.array_distinct(F.transform(sources, _claim)))
    order = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), 64 - HASH_BITS)
    d = docs.withColumns({CLAIMS: F.coalesce(one, F.array().cast("array<string>")), "size": size, HASH: order})
    d = d.withColumn(PATTERN, F.to_json(CLAIMS))
    slim = stage(d.select(PATTERN, CLAIMS, "size", HASH), "mix-sizes")
    patterns = stage(slim.groupBy(PATTERN).agg(F.first(CLAIMS).alias("claims"), F.sum("size").alias("w")).where(F.size("claims") > 0), "mix-patterns")
    claimed = patterns.select(F.explode("claims").alias("claim"), "w", F.size("claims").alias("k"))
    total = stage(claimed.groupBy("claim").agg(F.sum("w").alias("source_size"), F.max("k").alias("widest")), "mix-sources")
    named = F.when(F.col("claim") != "", F.substring(F.col("claim"), F.lit(2), F.length("claim")))
    if callable(quotas):
        goal = quotas(total.select(named.alias("source"), "source_size"))
    else:
        goal = spark.createDataFrame([(s, float(q)) for s, q in quotas.items()], "source string, quota double")
    goal = goal.select(_claim(F.col("source")).alias("claim"), "quota")
    known = stage(total.join(goal, "claim", "left").withColumn("quota", F.coalesce("quota", F.lit(0.0))), "mix-quotas")
    used = _routed(patterns, known, max_repeats)
    of = patterns.select(PATTERN, F.explode("claims").alias("claim")).join(known, "claim").groupBy(PATTERN).agg(
        F.sum("quota").alias("target"), F.sum("source_size").alias("source_size"))
    plan = patterns.select(PATTERN, "w").join(used, PATTERN).join(of, PATTERN)
    plan = stage(plan.withColumn("whole", F.floor(F.col("used") / F.greatest("w", F.lit(1))).cast("long"))
                 .withColumn("left", F.col("used") - F.col("whole") * F.col("w")), "mix-plan")
    cuts = _cuts(slim.select(PATTERN, HASH, "size"), plan.where("left > 0").select(PATTERN, "left"))
    plan = stage(plan.join(cuts, PATTERN, "left").select(PATTERN, "target", F.col("source_size").alias("__llm_source_size"), F.col("whole").alias("__llm_whole"),
                                                         F.coalesce("cut", F.lit(0)).alias("__llm_cut")), "mix-plan")
    plan = plan.withColumnRenamed("target", "__llm_target")
    out = d.join(plan, PATTERN, "left")
    passes = F.col("__llm_whole") + (F.col(HASH) < F.col("__llm_cut")).cast("long")
    return out.select(*docs.columns, "size", F.coalesce("__llm_source_size", F.lit(0)).cast("long").alias("source_size"),
                      F.coalesce("__llm_target", F.lit(0.0)).alias("target"),
                      F.coalesce(passes * F.col("size"), F.lit(0)).cast("long").alias("taken"))


def reshared(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``targets_by_weight`` of a table (source, source_size, weight): (source, quota).

    A round tells by one aggregate which sources stop at ``most`` times their
    size, and so what is left for the others; only sums come to the driver.
    """
    own = stage(sources.where("source_size > 0").select("source", F.col("source_size").cast("double").alias("size"), F.col("weight").cast("double").alias("weight")), "mix-weights")
    stopped = F.lit(False)
    while True:
        sums = own.agg(F.sum("size").alias("all"), F.sum(F.when(stopped, F.col("size")).otherwise(0.0)).alias("size"),
                       F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        left = share * (sums["all"] or 0.0) - most * (sums["size"] or 0.0)
        if not sums["weight"] or left <= 0:
            dealt = F.lit(0.0)
            break
        dealt = F.lit(left) * F.col("weight") / F.lit(sums["weight"])
        over = ~stopped & (dealt > most * F.col("size"))
        if own.where(over).isEmpty():
            break
        own = stage(own.withColumn("stopped", stopped | over), "mix-weights")
        stopped = F.col("stopped")
    return own.select("source", F.when(stopped, most * F.col("size")).otherwise(dealt).alias("quota"))


# The weights of sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def weigh(total: DataFrame) -> DataFrame:
    """(source, quota) of sources in code-point order, null last."""
    placed = global_index(total.withColumn("none", F.col("source").isNull()), ["none", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    return reshared(placed.select("source", "source_size", weight.alias("weight")))


def mix_by_source(docs: DataFrame) -> DataFrame:
    """Each document claimed by its ``source``; null is a source."""
    return mix(docs, F.array(F.col("source")), weigh)


def query(docs: DataFrame) -> DataFrame:
    return mix_by_source(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
