"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are first reduced to words per membership pattern (the set of
sources a document belongs to). A flow network routes pattern capacity to
source quotas: pattern -> source arcs carry words, and each further
repetition of a pattern's words costs more than the one before (a convex
cost), so no text is repeated while unused text can serve the same quota.
The optimal flow gives each pattern a number of words to take. Documents
are then selected by a seeded order: whole rounds for everybody, and one
more round for the first documents of the order up to the rest.

Only one row per pattern and one row per source reach the driver; documents
never do. The seeded order is walked through histograms of the order key,
so a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.llm.store import write_table

MAX_REPEATS = 3
WEIGHT_CYCLE = (1, 2, 3)
MAX_PATTERNS = 200_000
BINS = 4096


def text_size(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float],
                   most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Share the total of all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again by weight among the rest."""
    names = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if sizes[s] > 0]
    target: dict[str | None, float] = {s: 0.0 for s in sizes}
    left, open_names = float(sum(sizes.values())), names
    while open_names:
        total = sum(weights[s] for s in open_names)
        over = [s for s in open_names if left * weights[s] / total > most * sizes[s]]
        if not over:
            for s in open_names:
                target[s] = left * weights[s] / total
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_names = [s for s in open_names if s not in set(over)]
    return target


def route(capacity: dict[tuple, int], quota: dict, most: int = MAX_REPEATS) -> dict[tuple, int]:
    """Min-cost flow of words: (pattern, source) -> words.

    Each pattern offers ``most`` rounds of its words, round k at cost k - 1 per
    word. Successive shortest paths fill the quotas round by round: as every
    arc into a source is free and only the round costs, a cheapest augmenting
    path uses the lowest round with words left, possibly re-routing a pattern
    shared by several sources to make room.
    """
    flow: dict[tuple, int] = {}
    need = {s: int(round(q)) for s, q in quota.items()}
    feeds: dict = {}
    for p in sorted(capacity, key=repr):
        for s in p:
            feeds.setdefault(s, []).append(p)
    for _ in range(most):
        spare = dict(capacity)
        # sources with few patterns first: their words have no other use
        heap = [(len(feeds.get(s, ())), s is None, s or "", s) for s in need if need[s] > 0]
        heapq.heapify(heap)
        used: dict[tuple, int] = {}
        while heap:
            s = heapq.heappop(heap)[3]
            while need[s] > 0:
                path = _augment(s, feeds, spare, used)
                if path is None:
                    break
                room = min(need[s], spare[path[-1][1]],
                           *(used[(p, b)] for (_, p), (b, _) in zip(path, path[1:])))
                for i, (a, p) in enumerate(path):
                    used[(p, a)] = used.get((p, a), 0) + room
                    if i + 1 < len(path):
                        used[(p, path[i + 1][0])] -= room
                spare[path[-1][1]] -= room
                need[s] -= room
        for k, v in used.items():
            if v:
                flow[k] = flow.get(k, 0) + v
    return flow


def _augment(source, feeds, spare, used):
    """Shortest path from a source to a pattern with spare words in this round:
    [(source, pattern), (other source giving that pattern up, its new pattern), ...]."""
    for p in feeds.get(source, ()):
        if spare[p] > 0:
            return [(source, p)]
    seen, layer = {source}, [(source, [])]
    owners: dict = {}
    for (p, s), v in used.items():
        if v > 0:
            owners.setdefault(p, []).append(s)
    while layer:
        nxt = []
        for s, path in layer:
            for p in feeds.get(s, ()):
                if spare[p] > 0:
                    return path + [(s, p)]
            for p in feeds.get(s, ()):
                for other in owners.get(p, ()):
                    if other not in seen:
                        seen.add(other)
                        nxt.append((other, path + [(s, p)]))
        layer = nxt
    return None


def seeded_select(docs: DataFrame, plan: DataFrame, key: str = "pattern_key") -> DataFrame:
    """Add ``taken``: whole rounds of each document's size, and one more round for
    the first documents of the seeded order while it brings the pattern's total
    nearer to its planned words.

    ``plan`` has (key, rounds, rest): every document is taken ``rounds``
    times; ``rest`` words are left for the extra round. ``docs`` needs key,
    size and order_key (bigint); it must be materialised, as it is read
    three times.
    """
    spread = docs.withColumns({
        "bin_a": F.pmod(F.shiftrightunsigned("order_key", 52), F.lit(BINS)).cast("int"),
        "bin_b": F.pmod(F.shiftrightunsigned("order_key", 40), F.lit(BINS)).cast("int")})

    def reach(frame, bins, before):
        """The bin in which the running total passes ``rest``, and the total before it."""
        order = Window.partitionBy(key).orderBy(bins)
        sums = frame.groupBy(key, bins).agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.sum("words").over(order) + F.lit(0))
        run = run.join(before, key).withColumn("start", F.col("upto") - F.col("words") + F.col("offset"))
        return run.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest"))) \
            .groupBy(key).agg(F.min(F.struct(bins, "start")).alias("hit")) \
            .select(key, F.col(f"hit.{bins}").alias(f"edge_{bins}"), F.col("hit.start").alias(f"at_{bins}"))

    wanted = plan.where(F.col("rest") > 0).select(key, "rest", F.lit(0).cast("bigint").alias("offset"))
    first = F.broadcast(reach(spread, "bin_a", wanted))
    inner = spread.join(first, key).where(F.col("bin_a") == F.col("edge_bin_a"))
    second = F.broadcast(reach(inner, "bin_b", wanted.drop("offset").join(
        first.select(key, F.col("at_bin_a").alias("offset")), key)))
    marked = spread.join(F.broadcast(plan), key, "left").join(first, key, "left").join(second, key, "left")
    inside = (F.col("bin_a") == F.col("edge_bin_a")) & (F.col("bin_b") == F.col("edge_bin_b"))
    sure = (F.col("bin_a") < F.col("edge_bin_a")) | (
        (F.col("bin_a") == F.col("edge_bin_a")) & (F.col("bin_b") < F.col("edge_bin_b")))
    marked = marked.withColumns({"inside": F.coalesce(inside, F.lit(False)), "sure": F.coalesce(sure, F.lit(False))})
    # Only the documents of one bin in 16 million per pattern need a real order.
    order = Window.partitionBy(key).orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("inside").withColumn("start", F.col("at_bin_b") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    nearer = F.col("start") + F.col("size") / 2 <= F.col("rest")
    rest = marked.where(~F.col("inside"))
    extra = edge.withColumn("extra", nearer.cast("bigint")).drop("start").unionByName(
        rest.withColumn("extra", F.col("sure").cast("bigint")))
    return extra.withColumn("taken", F.col("size") * (F.coalesce("rounds", F.lit(0)) + F.col("extra"))).drop(
        "bin_a", "bin_b", "edge_bin_a", "edge_bin_b", "at_bin_a", "at_bin_b", "inside", "sure", "extra", "rounds", "rest")


def mix_sources(documents: DataFrame, sources: Column | None = None, weights: dict | None = None,
                most: int = MAX_REPEATS, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix to target weights takes.

    ``sources`` is an array column with every source a document belongs to
    (default: its ``source`` column alone). Sources by code point, null
    last, weigh 1, 2, 3, repeating, unless ``weights`` names them. Together
    they share 100 % of all words; a target stops at ``most`` times the words
    of its source and the excess is shared again by weight.

    Returns doc_id, the columns of ``keep``, size, source_size and target (sums
    over the document's sources), taken (words the mix takes, repeats
    counted: at most ``most`` times the size). Defined cases: a null or empty
    text has size 0 and is taken 0 times; null is a source of its own;
    repeated rows and rows that share a doc_id count one by one and may differ
    in ``taken``; a source whose words are all 0 has target 0; no rows give
    no rows. Other columns are ignored, whatever their names. The driver
    holds one row per membership pattern, at most MAX_PATTERNS.
    """
    spark = documents.sparkSession
    member = F.array(F.col("source").cast("string")) if sources is None else sources
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    table = documents.select(
        *names, F.array_sort(F.array_distinct(member)).alias("pattern"), text_size().alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("order_key"))
    table = write_table(table.withColumn("pattern_key", F.xxhash64("pattern", F.size("pattern"))), "mix-sizes")
    totals = table.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; give coarser sources")
    capacity = {tuple(r.pattern): int(r.words) for r in totals}
    sizes: dict = {}
    for p, words in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: (weights or {}).get(s, WEIGHT_CYCLE[i % len(WEIGHT_CYCLE)]) for i, s in enumerate(ordered)}
    target = capped_targets(sizes, share, most)
    flow = route(capacity, target, most)
    rows, taken = [], {}
    for (p, _), v in flow.items():
        taken[p] = taken.get(p, 0) + v
    for p, words in capacity.items():
        take = taken.get(p, 0)
        rounds = min(most, take // words) if words else 0
        rows.append((list(p), int(rounds), int(take - rounds * words),
                     int(sum(sizes[s] for s in p)), float(sum(target[s] for s in p))))
    plan = spark.createDataFrame(rows, "pattern array<string>, rounds bigint, rest bigint, source_size bigint, target double")
    plan = plan.withColumn("pattern_key", F.xxhash64("pattern", F.size("pattern")))
    chosen = seeded_select(table, plan.select("pattern_key", "rounds", "rest"))
    facts = plan.select("pattern_key", "source_size", "target")
    return chosen.join(F.broadcast(facts), "pattern_key", "left").select(
        *names, "size", "source_size", "target", "taken")


def mixing_query(spark, sf_dir: str) -> DataFrame:
    """op10: words taken of every document."""
    from ledgerscope.sources.tables import read_table
    return mix_sources(read_table(spark, sf_dir, "documents"))
