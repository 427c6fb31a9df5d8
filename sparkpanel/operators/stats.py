"""Statistics of panels: error correlation, overlap laws, intervals and the conventions for means."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hashed

#: Thresholds of the risk rule, all strict, and the normal quantile of a 95 % interval. Fixed values.
MAX_CORRELATION, MAX_LIFT, MAX_P = 0.15, 1.5, 0.05
Z95 = 1.959963984540054


def d(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def pearson(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Correlation of two 0/1 vectors from their counts; 0 if either has no variance or there are no rows."""
    spread = (d(n) * d(sx) - d(sx) * d(sx)) * (d(n) * d(sy) - d(sy) * d(sy))
    return F.when(spread > 0, (d(n) * d(sxy) - d(sx) * d(sy)) / F.sqrt(spread)).otherwise(0.0)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.when(whole > 0, d(part) / d(whole))


def std(column: str) -> Column:
    """Sample deviation; 0 for one value, null for none."""
    return F.when(F.count(column) == 1, F.lit(0.0)).otherwise(F.stddev_samp(column))


def finite_mean(column: str) -> Column:
    """Mean of the values that are neither null nor infinite."""
    return F.avg(F.when(F.abs(F.col(column)) < float("inf"), F.col(column)))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a proportion, clipped; [0, 1] for no trials."""
    p, m = d(hits) / d(n), d(n)
    mid = (p + Z95 * Z95 / (2 * m)) / (1 + Z95 * Z95 / m)
    half = Z95 * F.sqrt(p * (1 - p) / m + Z95 * Z95 / (4 * m * m)) / (1 + Z95 * Z95 / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def ln_factorial(n: Column) -> Column:
    """ln n! of a whole number: exact below 10, Stirling's series from there (error below 1e-13)."""
    x = d(n)
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 10, F.get(F.lit([math.lgamma(k + 1) for k in range(10)]), n.cast("int"))).otherwise(series)


def hypergeometric(n: Column, marked: Column, drawn: Column, x: Column) -> Column:
    """The chance of x marked among drawn of n."""
    f = ln_factorial
    return F.exp(f(marked) - f(x) - f(marked - x) + f(n - marked) - f(drawn - x) - f(n - marked - drawn + x) - f(n) + f(drawn) + f(n - drawn))


def miss_counts(misses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of rows, of misses of three judges (m1, m2, m3), of pairs and of all three, by group."""
    m = [F.col(f"m{i}") for i in (1, 2, 3)]
    both = {"s12": m[0] * m[1], "s13": m[0] * m[2], "s23": m[1] * m[2], "s123": m[0] * m[1] * m[2]}
    sums = [F.sum(c).cast("bigint").alias(k) for k, c in (dict(zip(("s1", "s2", "s3"), m)) | both).items()]
    return misses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def overlap_p(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The exact chance, by group, that three independently shuffled miss vectors overlap at least as often as seen.

    The overlap of the first two is hypergeometric, so is that with the third given the first. Groups are samples of
    bounded size n; the law costs n squared small rows a group.
    """
    x = counts.select(*by, "n", "s1", "s2", "s3", "s123", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("x")).where("x <= least(s1, s2) and x >= s1 + s2 - n")
    t = x.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("t")).where("t >= s123 and t <= least(x, s3) and t >= x + s3 - n")
    chance = hypergeometric(F.col("n"), F.col("s1"), F.col("s2"), F.col("x")) * hypergeometric(F.col("n"), F.col("x"), F.col("s3"), F.col("t"))
    return t.groupBy(*by).agg(F.least(F.lit(1.0), F.sum(chance)).alias("p"))


def risk(counts: DataFrame) -> DataFrame:
    """fn_corr, all3, null3 and lift from counts; an infinite lift (misses without any expected) is null with lift_infinite."""
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s12", "s13", "s23", "s123")}
    corr = (pearson(c["n"], c["s1"], c["s2"], c["s12"]) + pearson(c["n"], c["s1"], c["s3"], c["s13"]) + pearson(c["n"], c["s2"], c["s3"], c["s23"])) / 3
    null3 = d("s1") * d("s2") * d("s3") / (d("n") * d("n") * d("n"))
    return counts.select("*", F.round(corr, 9).alias("fn_corr"), F.round(d("s123") / d("n"), 9).alias("all3"), F.round(null3, 9).alias("null3")).withColumns(
        {"lift": F.when(null3 > 0, F.round(d("s123") / d("n") / null3, 9)).when(F.col("s123") == 0, 0.0), "lift_infinite": (null3 == 0) & (F.col("s123") > 0)}
    )


def legacy_lift(all3: Column, null3: Column) -> Column:
    """The older convention: no expected triple misses make the lift infinite even if none was seen."""
    return F.when(null3 > 0, all3 / null3).otherwise(float("inf"))


def count_null(counts: DataFrame, by: Sequence[str], permutations: int = 3000) -> DataFrame:
    """Smoothed p by group (columns of ``by``, p) over permutations drawn from the counts of :func:`miss_counts`.

    The overlap of shuffled miss vectors follows hypergeometric laws of the counts alone, so a group of any number of
    rows is one row here. Draws are seeded by the group's key. A group without rows has p 1.
    """
    by = list(by)

    def draw(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for key, n, s1, s2, s3, seen in zip(pdf[by].itertuples(index=False, name=None), *(pdf[c].astype("int64") for c in ("n", "s1", "s2", "s3", "s123"))):
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, ["null", *key])).encode()).digest()[:8], "big"))
                x = rng.hypergeometric(s1, n - s1, s2, permutations) if n else np.zeros(permutations, int)
                t = rng.hypergeometric(x, n - x, s3) if n else x
                out.append([*key, (int((t >= seen).sum()) + 1) / (permutations + 1)])
            yield pd.DataFrame(out, columns=[*by, "p"])

    types = dict(counts.dtypes)
    return counts.select(*by, "n", "s1", "s2", "s3", "s123").mapInPandas(draw, ", ".join(f"{k} {types[k]}" for k in by) + ", p double")


def flagged(fn_corr: Column, lift: Column, infinite: Column, p: Column) -> Column:
    """The strict conjunction of the three thresholds."""
    return (fn_corr > MAX_CORRELATION) & (infinite | F.coalesce(lift > MAX_LIFT, F.lit(False))) & (p < MAX_P)


def hash_null(misses: DataFrame, by: Sequence[str], permutations: int, salt: Sequence[str] = ()) -> DataFrame:
    """Observed overlap, mean of permuted overlaps and smoothed p by group; a permutation ranks each judge's misses by a hash.

    For samples of bounded size: a group is one row, permutations are spread over tasks. ``salt`` names columns of
    ``by`` that enter the hash.
    """
    m = ("m1", "m2", "m3")
    groups = misses.groupBy(*by).agg(F.collect_list(F.struct("id", *m)).alias("rows"), F.sum(F.col("m1") * F.col("m2") * F.col("m3")).cast("bigint").alias("obs"))
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(permutations), F.lit(50)))).repartition(4 * misses.sparkSession.sparkContext.defaultParallelism, *by, "run")
    each = runs.withColumn("b", F.explode(F.sequence("run", F.least(F.col("run") + 49, F.lit(permutations)))))

    def placed(judge: int, miss: str) -> Column:
        pairs = F.transform("rows", lambda r: F.struct(hashed("perm", *map(F.col, salt), F.col("b"), F.lit(judge), r["id"]).alias("h"), r[miss].alias("miss")))
        return F.transform(F.sort_array(pairs), lambda x: x["miss"])

    all3 = F.zip_with(F.zip_with(placed(1, m[0]), placed(2, m[1]), lambda a, b: a * b), placed(3, m[2]), lambda a, b: a * b)
    hits = each.select(*by, "obs", F.aggregate(all3, F.lit(0), lambda a, x: a + x).cast("bigint").alias("t"), F.size("rows").alias("n"))
    p = (d(F.count_if(F.col("t") >= F.col("obs"))) + 1) / (permutations + 1.0)
    return hits.groupBy(*by).agg(F.max("n").cast("bigint").alias("n"), F.round(F.max(d("obs") / d("n")), 9).alias("all3"), F.round(F.avg(d("t") / d("n")), 9).alias("null3"), F.round(p, 9).alias("p"))


def replay_null(misses: DataFrame, by: str | Sequence[str], order: str, permutations: int = 3000, seed: int | str = 1) -> DataFrame:
    """Observed overlap, mean of shuffled overlaps and smoothed p by group, with one seeded generator for each group.

    For samples of bounded size: a group is shuffled in one task, in the order of ``order``. ``seed`` is a number or
    the column of ``by`` that holds it.
    """
    by = [by] if isinstance(by, str) else list(by)

    def shuffle(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        columns = [pdf[c].tolist() for c in ("m1", "m2", "m3")]
        rng = random.Random(int(pdf[seed].iloc[0]) if isinstance(seed, str) else seed)
        seen = sum(a & b & c for a, b, c in zip(*columns))
        null = []
        for _ in range(permutations):
            for c in columns:
                rng.shuffle(c)
            null.append(sum(a & b & c for a, b, c in zip(*columns)))
        n = max(1, len(pdf))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), seen / n, sum(null) / permutations / n, (sum(x >= seen for x in null) + 1) / (permutations + 1)]], columns=[*by, "all3", "null3", "p"])

    types = dict(misses.dtypes)
    return misses.select(*by, order, "m1", "m2", "m3").groupBy(*by).applyInPandas(shuffle, ", ".join(f"{k} {types[k]}" for k in by) + ", all3 double, null3 double, p double")


def bootstrap_reductions(rows: DataFrame, by: Sequence[str], order: str, replicates: int = 5000) -> DataFrame:
    """Reduction of the mean pairwise correlation and of the rate of triple errors from one set of errors (m1..) to another of the same items (e1..).

    By group and metric: the reduction seen, the 95 % interval over paired resamples of the items and the one-sided p.
    For samples of bounded size: a group is resampled in one task, seeded by its key.
    """
    by = list(by)

    def resample(pdf):
        import hashlib

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order)
        x = pdf[["m1", "m2", "m3", "e1", "e2", "e3"]].to_numpy(dtype=float)
        key = [pdf[k].iloc[0] for k in by]
        n = len(x)

        def metrics(mean, pairs, triple):
            def corr(a, b, ab):
                spread = (mean[:, a] - mean[:, a] ** 2) * (mean[:, b] - mean[:, b] ** 2)
                ok = spread > 1e-15
                return np.where(ok, (ab - mean[:, a] * mean[:, b]) / np.sqrt(np.where(ok, spread, 1)), 0)

            side = [sum(corr(a + k, b + k, pairs[:, i + k]) for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))) / 3 for k in (0, 3)]
            return {"mean_pair": side[0] - side[1], "all3": triple[:, 0] - triple[:, 1]}

        p = np.stack([x[:, a] * x[:, b] for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5))], 1)
        t = np.stack([x[:, :3].prod(1), x[:, 3:].prod(1)], 1)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, ["boot", *key])).encode()).digest()[:8], "big"))
        # How often each item is drawn; items are few, so all replicates fit in one matrix.
        times = rng.multinomial(n, np.full(n, 1 / n), size=replicates) / n
        one = np.full((1, n), 1 / n)
        seen, drawn = (metrics(w @ x, w @ p, w @ t) for w in (one, times))
        out = []
        for name in ("mean_pair", "all3"):
            v = np.sort(drawn[name])
            low, high = v[int(0.025 * replicates)], v[min(replicates - 1, int(0.975 * replicates))]
            out.append([*key, name, n, *(round(float(k), 9) for k in (seen[name][0], low, high)), (int((v <= 1e-12).sum()) + 1) / (replicates + 1)])
        return pd.DataFrame(out, columns=[*by, "metric", "n", "reduction", "low", "high", "p_lower"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", metric string, n bigint, reduction double, low double, high double, p_lower double"
    return rows.select(*by, order, *(f"{c}{i}" for c in "me" for i in (1, 2, 3))).groupBy(*by).applyInPandas(resample, schema)


def random_routing(counts: DataFrame, by: Sequence[str], trials: int = 100) -> DataFrame:
    """Mean and deviation over trials of the rates when ``budget`` random items of a group are grounded and the rest keep their majority.

    ``counts`` has a row for each group, class, majority, unanimity and grounded answer (n items) and the group's
    budget. How many of each class a sample without replacement takes follows the multivariate hypergeometric law, so
    trials are drawn from the counts and no task sees the items. Rates of a trial that misses a grounded answer are
    unknown, as in the other policies; the ``low`` ones count it as no acceptance.
    """
    by = list(by)

    def route(pdf):
        import hashlib

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["is_corrupted", "rf", "una", "gm"])
        key = [pdf[k].iloc[0] for k in by]
        n, bad, rf, una, gm = pdf["n"].to_numpy("int64"), *(pdf[c].to_numpy("int64") for c in ("is_corrupted", "rf", "una", "gm"))
        budget = int(min(pdf["budget"].iloc[0], n.sum()))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, ["route", *key])).encode()).digest()[:8], "big"))
        taken = rng.multivariate_hypergeometric(n, budget, size=trials, method="marginals")
        accepted = taken * (gm == 1) + (n - taken) * rf
        gone = (taken * (gm < 0)).sum(1)
        nan = np.full(trials, np.nan)
        low = {name: (accepted * w).sum(1) / whole if (whole := (n * c).sum()) else nan for name, c, w in (("false_accept", bad, bad), ("true_accept", 1 - bad, 1 - bad), ("false_consensus", bad, bad * una))}
        both = []
        for v in low.values():
            exact = np.where(gone == 0, v, np.nan)
            known = bool(np.isfinite(exact).all())
            both += [round(float(exact.mean()), 9) if known else None, round(float(exact.std(ddof=min(1, trials - 1))), 9) if known else None, round(float(v.mean()), 9) if np.isfinite(v).all() else None]
        return pd.DataFrame([[*key, budget, int(gone.sum()), *both]], columns=[*by, "budget", "missing_grounded", *(f"{k}{e}" for k in low for e in ("", "_std", "_low"))])

    types = dict(counts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", budget bigint, missing_grounded bigint, " + ", ".join(f"{k}{e} double" for k in ("false_accept", "true_accept", "false_consensus") for e in ("", "_std", "_low"))
    return counts.groupBy(*by).applyInPandas(route, schema)
