"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources a document counts for). A pattern's words flow to its
sources' quotas; each further repetition of a pattern costs more than the one before (convex costs 0, 1, 2, ... a word), so
the flow repeats no pattern a further time while another route is open. The flow runs on the driver over patterns and sources
only. A pattern's flow then becomes whole documents: every document as often as the whole repetitions go, and documents in
order of a seeded hash once more until the rest is met; the last step tries the next documents in that order and takes
those that still fit.

Sizes are word counts. Null texts have size 0. A null source is a source of its own, ordered last. Ties of the seeded order are
rows equal in id and text, which are taken alike: a row that is repeated so often that its copies have more words than a target is
off by can miss the target by them. Extra columns are not read; `mixture` passes them through. An empty table gives an empty result.

The driver holds a row for each pattern, as a flow network is one problem: MOST_PATTERNS bounds it, and more patterns are an error
that asks for coarser sources, never a sample.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import carried, cut

WORDS = r"[^\x20\x09-\x0D]+"
#: A pattern's last partial repetition is rounded to whole documents among at least so many of them, in seeded order.
FITTED_DOCUMENTS, EXCHANGED = 512, 32
#: Sums that are told apart; beyond it sizes are rounded.
SUMS = 1 << 21
BUCKET_BITS = 16
#: Membership patterns that a flow is computed for.
MOST_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def source_weights(sources: list, cycle: tuple[int, ...] = (1, 2, 3)) -> dict:
    """Weights by code point order of the source names, null last, repeating the cycle."""
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def source_targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Each source's share of all sizes by weight; shares stop at most times the source's size and the excess is shared again."""
    total, targets, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        left, weight = total - sum(targets.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not over:
            targets |= {s: left * weights[s] / weight for s in open_}
            break
        targets |= {s: most * sizes[s] for s in over}
        open_ -= over
    return targets


def route(patterns: dict[tuple, int], quotas: dict, most: int = 3) -> dict[tuple, dict]:
    """Min-cost flow: words of each pattern to each of its sources, meeting quotas as far as most repetitions allow.

    patterns: sources of the pattern -> words of its documents. Successive shortest paths with Bellman-Ford; the r-th repetition
    of a pattern is an arc of cost r - 1 and the pattern's words as capacity.
    """
    arcs: list[list] = []  # [from, to, capacity left, cost]
    leaving = defaultdict(list)

    def arc(a, b, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            leaving[x].append(len(arcs))
            arcs.append([x, y, c, w])

    for p, words in patterns.items():
        for r in range(most):
            arc("all", ("pattern", p), words, r)
        for s in p:
            arc(("pattern", p), ("source", s), words * most, 0)
    for s, quota in quotas.items():
        arc(("source", s), "mix", round(quota), 0)
    while True:
        cost, via, queue = {"all": 0}, {}, ["all"]
        while queue:
            a = queue.pop(0)
            for i in leaving[a]:
                _, b, left, w = arcs[i]
                if left > 0 and cost[a] + w < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + w, i
                    queue.append(b)
        if "mix" not in cost:
            break
        path, at = [], "mix"
        while at != "all":
            path.append(via[at])
            at = arcs[via[at]][0]
        flow = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= flow
            arcs[i ^ 1][2] += flow
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for i in range(0, len(arcs), 2):
        a, b, _, _ = arcs[i]
        if a != "all" and a[0] == "pattern" and arcs[i + 1][2]:
            out[a[1]][b[1]] = arcs[i + 1][2]
    return out


def fitted(words: int, documents: list[tuple[int, int]]) -> set[int]:
    """Of (order, size) documents, some whose sizes sum up as near to words as can be.

    They are taken in order while they fit; then the last EXCHANGED taken and the first EXCHANGED left out are chosen anew by
    dynamic programming over the sums they can have.
    """
    taken, left = [], words
    for d in documents:
        if d[1] <= left:
            taken.append(d)
            left -= d[1]
    fixed, again = taken[:-EXCHANGED], taken[-EXCHANGED:]
    chosen = {order for order, _ in taken}
    again += [d for d in documents if d[0] not in chosen][:EXCHANGED]
    unit = sum(size for _, size in again) // SUMS + 1
    again = [(order, round(size / unit)) for order, size in again]
    target = round((words - sum(size for _, size in fixed)) / unit)
    sums = [1]  # bit s: some of the first documents sum up to s
    for _, size in again:
        sums.append(sums[-1] | sums[-1] << size)
    below, above = sums[-1] & ((1 << target + 1) - 1), sums[-1] >> target
    down = target - (below.bit_length() - 1)
    up = (above & -above).bit_length() - 1 if above else down + 1
    at = target - down if down <= up else target + up
    out = {order for order, _ in fixed}
    for (order, size), before in zip(reversed(again), reversed(sums[:-1]), strict=True):
        if not before >> at & 1:
            out.add(order)
            at -= size
    return out


def mixed(docs: DataFrame, sources_column: str | None = None, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """Rows (id, size, sources, source_size, target, copies, taken); with carry the whole row as well.

    sources_column: an array of the sources a document counts for; by default its one `source` is all.
    source_size and target are sums over the pattern's sources.
    """
    member = F.array(F.col("row.source").cast("string")) if sources_column is None else F.array_sort(F.array_distinct(F.col(f"row.`{sources_column}`")))
    rows = carried(docs)
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit(""))
    sized = rows.select(
        F.col(f"row.`{id_column}`").alias("id"), word_count(text).alias("size"), member.alias("sources"),
        F.xxhash64(F.lit(seed), F.col(f"row.`{id_column}`"), text).alias("order"), *([F.col("row")] if carry else []),
    ).withColumn("bucket", F.shiftrightunsigned("order", 64 - BUCKET_BITS).cast("int"))
    sized = cut(sized, "sizes")
    # At most 2^BUCKET_BITS rows for each pattern.
    buckets = cut(sized.groupBy("sources", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "buckets")
    by_pattern_words = buckets.groupBy("sources").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(by_pattern_words) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns; make the sources coarser")
    patterns = {tuple(r.sources or ()): r.words for r in by_pattern_words}
    sizes: dict = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            sizes[s] += words
    targets = source_targets(sizes, source_weights(list(sizes), cycle), most)
    flow = route(patterns, targets, most)
    plan = []  # pattern, whole repetitions, words of the partial one
    for p, words in patterns.items():
        words_out = sum(flow[p].values())
        whole = min(most, words_out // words) if words else 0
        plan.append((list(p), int(whole), int(words_out - whole * words), int(sum(sizes[s] for s in p)), float(sum(targets[s] for s in p))))
    spark = docs.sparkSession
    coarse = F.shiftright("bucket", BUCKET_BITS // 2)
    keyed = lambda df: df.withColumn("sources_key", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"}))
    planned = spark.createDataFrame(plan, "sources array<string>, whole int, rest long, source_size long, target double")
    planned = F.broadcast(keyed(planned).drop("sources"))  # one row for each pattern
    # Prefix sums in two levels, so that no task sorts more than 2^(BUCKET_BITS / 2) rows of a pattern.
    fine = cut(keyed(buckets).select("sources_key", "bucket", "words", "n", coarse.alias("coarse")), "fine")
    before = Window.partitionBy("sources_key").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = fine.groupBy("sources_key", "coarse").agg(F.sum("words").alias("w"), F.sum("n").alias("k"))
    sums = sums.select("sources_key", "coarse", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("n_before"))
    along = Window.partitionBy("sources_key", "coarse").orderBy("bucket")
    summed = fine.withColumn("words_here", F.sum("words").over(along)).withColumn("n_here", F.sum("n").over(along)).join(sums, ["sources_key", "coarse"])
    summed = summed.withColumn("words_here", F.col("words_here") + F.col("words_before")).withColumn("n_here", F.col("n_here") + F.col("n_before"))
    summed = cut(summed.join(planned, "sources_key").withColumn("inside", F.col("words_here") <= F.col("rest")), "sums")
    # The edge: where half of FITTED_DOCUMENTS remain before the first bucket that is not wholly inside, and on to all of them.
    n_inside = summed.groupBy("sources_key").agg(F.coalesce(F.max(F.when(F.col("inside"), F.col("n_here"))), F.lit(0)).alias("n_inside"))
    edge = summed.join(F.broadcast(n_inside), "sources_key").where(F.col("n_here") > F.greatest(F.col("n_inside") - FITTED_DOCUMENTS // 2, F.lit(0))).groupBy("sources_key").agg(F.min("bucket").alias("edge"))
    first = summed.join(F.broadcast(edge), "sources_key").where("bucket = edge").select("sources_key", "edge", "n", "n_here", (F.col("rest") - (F.col("words_here") - F.col("words"))).alias("left"))
    near = summed.join(F.broadcast(first.select("sources_key", "edge", F.col("n_here").alias("n_first"), F.col("n").alias("n_own"), "left")), "sources_key").where(f"bucket >= edge and n_here - n <= n_first - n_own + {FITTED_DOCUMENTS}")
    near = near.select("sources_key", "bucket", "left")
    tried = keyed(sized.select("sources", "bucket", "order", "size")).join(F.broadcast(near), ["sources_key", "bucket"]).groupBy("sources_key", "left", "order").agg(F.sum("size").alias("size"))
    by_pattern = defaultdict(list)
    # Bounded: some FITTED_DOCUMENTS plus one bucket, 2^-BUCKET_BITS of a pattern's documents, for each pattern.
    for r in tried.collect():
        by_pattern[r.sources_key, r.left].append((r.order, r.size))
    unsigned = lambda x: x[0] % 2**64
    chosen = [(k, o) for (k, left), found in by_pattern.items() for o in fitted(left, sorted(found, key=unsigned))]
    chosen_df = F.broadcast(spark.createDataFrame(chosen, "sources_key string, order long").withColumn("extra", F.lit(True)))
    edges = F.broadcast(edge.select("sources_key", "edge"))
    out = keyed(sized).join(planned, "sources_key", "left").join(edges, "sources_key", "left").join(chosen_df, ["sources_key", "order"], "left")
    before_edge = F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))
    copies = (F.col("whole") + F.when(((F.col("rest") > 0) & before_edge) | F.col("extra"), 1).otherwise(0)).cast("int")
    return out.withColumn("copies", F.least(copies, F.lit(most))).select(
        F.col("id").alias(id_column), "size", "sources", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *([F.col("row")] if carry else []),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: all columns, each document as many times as its copies."""
    found = mixed(docs, carry=True, **options).where("copies > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
