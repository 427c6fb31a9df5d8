"""Connected components, and folds that keep them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import written
from .sampling import hashed, ranked


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(item, root) of a bipartite table (item, doc): items that share a doc, directly or through others, get their smallest item as root.

    Labels spread by alternating aggregations, first to docs, then to items, and then jump to the label of their
    label, so the number of rounds grows with the logarithm of the longest path. Both aggregations combine before the
    shuffle, so a doc that a third of all items share costs one row a task. Items without docs aren't in the result.
    Labels that still change after ``rounds`` raise.
    """
    links = written(links.where("item is not null and doc is not null").distinct(), "links")
    labels = links.select("item", F.col("item").alias("root")).distinct()
    for _ in range(rounds):
        best = links.join(labels, "item").groupBy("doc").agg(F.min("root").alias("root"))
        spread = links.join(best, "doc").groupBy("item").agg(F.min("root").alias("root"))
        jumped = spread.join(spread.select(F.col("item").alias("root"), F.col("root").alias("next")), "root", "left").select("item", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = written(jumped, "labels")
        moved = new.join(labels.withColumnRenamed("root", "old"), "item").where("root <> old").isEmpty()
        labels = new
        if moved:
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")


def groups(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, item_ids, doc_ids, n_clean, n_false) of links (item, doc) and labels (item, root, bad): the sorted items and documents of each group, joined by commas, and its items of each class."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    items = labels.groupBy("root").agg(listed("item").alias("item_ids"), F.count_if(~F.col("bad")).alias("n_clean"), F.count_if("bad").alias("n_false"))
    docs = links.where("item is not null and doc is not null").join(labels.select("item", "root"), "item").groupBy("root").agg(listed("doc").alias("doc_ids"))
    return items.join(docs, "root").select("root", "item_ids", "doc_ids", "n_clean", "n_false")


def _dealt(kinds: list[tuple[int, int, int]], k: int, clean: int, false: int) -> list[tuple[int, int, list[int], list[int]]]:
    """For each kind of group (n_clean, n_false, number) the folds of its first groups, and the cycle of folds that all later ones go through.

    Each group goes to the fold where the squared error of both classes' counts grows least, then where the largest
    fold stays smallest, then to the first. A group of a kind adds the same to a fold's error each time, so once all
    folds are less than one such step apart they take turns for good; the rest of a kind is counted at once.
    """
    counts, out = [[0, 0] for _ in range(k)], []
    for a, b, number in kinds:
        step, first = k * (a * a + b * b), []
        error = lambda i: a * (k * counts[i][0] - clean) + b * (k * counts[i][1] - false)  # noqa: B023, E731

        def put() -> int:
            largest = max(map(sum, counts))
            i = min(range(k), key=lambda i: (error(i), max(largest, sum(counts[i]) + a + b), i))  # noqa: B023
            counts[i][0] += a  # noqa: B023
            counts[i][1] += b  # noqa: B023
            return i

        while len(first) < number and max(map(error, range(k))) - min(map(error, range(k))) >= step:
            first.append(put())
        cycle = [put() for _ in range(min(k, number - len(first)))]
        left = number - len(first) - len(cycle)
        for i in range(k):
            turns = left // k + (cycle.index(i) < left % k) if left else 0
            counts[i][0] += a * turns
            counts[i][1] += b * turns
        out.append((a, b, first, cycle))
    return out


def folds(groups: DataFrame, k: int, seed: str = "fold", exact: bool = False) -> DataFrame:
    """(root, n_clean, n_false, fold): groups dealt over k folds greedily, the largest first, ties by hash (see :func:`_dealt`).

    Groups of one make-up are interchangeable, so the greedy run is made over the kinds of groups, of which there are
    far fewer than groups (n items make some n to the two thirds at most), and a group finds its fold by its rank
    within its kind; ranks are taken within slices, so no task sees all groups of a kind. With ``exact`` folds whose
    counts differ raise.
    """
    kinds = groups.groupBy("n_clean", "n_false").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc(F.greatest("n_clean", "n_false")), F.desc(F.col("n_clean") + F.col("n_false")), F.desc("n_clean")).collect()
    plan = _dealt([tuple(r) for r in kinds], k, sum(r["n_clean"] * r["m"] for r in kinds), sum(r["n_false"] * r["m"] for r in kinds))
    table = groups.sparkSession.createDataFrame(plan, "n_clean bigint, n_false bigint, first array<int>, cycle array<int>")
    placed = ranked(groups.withColumn("__h", hashed(seed, F.col("root"))), ["n_clean", "n_false"], "__h", "__place").join(table, ["n_clean", "n_false"])
    at, early = F.col("__place") - 1, F.size("first")
    fold = F.when(at < early, F.get("first", at.cast("int"))).otherwise(F.get("cycle", ((at - early) % F.greatest(F.size("cycle"), F.lit(1))).cast("int")))
    out = placed.select("root", "n_clean", "n_false", fold.cast("bigint").alias("fold"))
    if exact:
        sums = out.groupBy("fold").agg(F.sum("n_clean"), F.sum("n_false")).collect()
        if len({tuple(r)[1:] for r in sums}) > 1 or len(sums) < k:
            raise ValueError(f"folds aren't balanced: {sorted(map(tuple, sums))}")
    return out
