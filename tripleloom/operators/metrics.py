"""Evaluation marts: rates, distributions, agreement, correlation, token accounting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def faithfulness_per_doc(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_total, n_malformed, n_judge_error, n_evaluated, n_supported, rate) of verdict rows."""
    v = F.col("verdict")
    df = verdicts.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if(v == "MALFORMED").alias("n_malformed"), F.count_if(v == "JUDGE_ERROR").alias("n_judge_error"), F.count_if(v == "SUPPORTED").alias("n_supported")
    )
    df = df.withColumn("n_evaluated", F.col("n_total") - F.col("n_malformed") - F.col("n_judge_error"))
    return df.withColumn("rate", rate(F.col("n_supported"), F.col("n_evaluated")))


def faithfulness_dataset(per_doc: DataFrame, keys: list[str]) -> DataFrame:
    """Micro rate over all rows; macro mean and population deviation over documents with an evaluated row."""
    some = F.when(F.col("n_evaluated") > 0, F.col("rate"))
    df = per_doc.groupBy(*keys).agg(
        F.count("*").alias("n_docs"), F.sum("n_total").alias("n_total"), F.sum("n_evaluated").alias("n_evaluated"), F.sum("n_supported").alias("n_supported"),
        F.avg(some).alias("macro"), F.coalesce(F.stddev_pop(some), F.lit(0.0)).alias("macro_std"),
    )
    return df.withColumn("micro", rate(F.col("n_supported"), F.col("n_evaluated")))


def resolution_counters(history: DataFrame, keys: list[str]) -> DataFrame:
    """Nine counters of a resolution history (keys..., status, method, n_after), and the ratios derived from them, 0 where empty."""
    c = F.col
    multi = c("method") == "multiple_entities"
    out = history.groupBy(*keys).agg(
        F.count("*").alias("n_in"), F.coalesce(F.sum("n_after"), F.lit(0)).alias("n_out"),
        *(F.count_if(c("status") == s).alias(f"n_{s}") for s in ("clean", "repaired", "failed")),
        F.count_if(c("method") == "single_entity").alias("n_single"), F.count_if(multi).alias("n_multi"),
        F.coalesce(F.sum(F.when(multi, c("n_after"))), F.lit(0)).alias("n_multi_out"), F.count_if(multi).alias("n_multi_entries"),
    )
    shares = {f"{x}_percent": rate(100 * c(f"n_{x}"), c("n_in")) for x in ("clean", "repaired", "failed", "single", "multi")}
    return out.withColumns({**shares, "yield_percent": rate(100 * (c("n_out") - c("n_in")), c("n_in")), "mean_split": rate(c("n_multi_out"), c("n_multi_entries"))})


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, both deviations, min and max of a value; one row alone has sample deviation 0."""
    c = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_sample"),
        F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("std_population"), F.min(c).alias("min"), F.max(c).alias("max"),
    )


def band(percent: Column) -> Column:
    """Quarter of the percentage scale: 0 to 3, the last closed."""
    return F.when(percent < 25, 0).when(percent < 50, 1).when(percent < 75, 2).otherwise(3)


def consistency(std: Column) -> Column:
    return F.when(std < 15, "consistent").when(std < 20, "moderate").otherwise("variable")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, accuracy and Cohen's kappa of two label columns; 1 where chance agreement is complete."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "a").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    total = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    acc = F.col("same") / F.col("n")
    # two tables of one row each, joined on a constant
    both = total.withColumn("_one", F.lit(1)).join(chance.withColumn("_one", F.lit(1)), "_one")
    return both.select("n", acc.alias("accuracy"), F.when(pe < 1, (acc - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., entropy) in bits of the values of a column."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    return c.groupBy(*keys).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of a value within its keys, ties sharing their mean rank. Equal values meet in one frame."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def _tail(t: float, df: int) -> float:
    """Two-sided p-value of Student's t through the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def p_value(r: Column, n: Column) -> Column:
    """p-value of a correlation of n pairs; null below three pairs."""

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if not m >= 3 or x != x else 0.0 if abs(x) >= 1 else _tail(x * math.sqrt((m - 2) / (1 - x * x)), int(m) - 2) for x, m in zip(r, n)])

    return run(r, n)


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., n, pearson, spearman, p_pearson, p_spearman) of two columns."""
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    return out.withColumns({"p_pearson": p_value(F.col("pearson"), F.col("n")), "p_spearman": p_value(F.col("spearman"), F.col("n"))})


def kde(df: DataFrame, keys: list[str], value: str, grid: list[float], width: float) -> DataFrame:
    """(keys..., x, density) of a Gaussian kernel estimate; values are binned to a tenth of the width first."""
    binned = df.groupBy(*keys, F.round(F.col(value) / (width / 10)).alias("_b")).agg(F.count("*").alias("_n"))
    points = binned.withColumn("x", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    z = (F.col("x") - F.col("_b") * (width / 10)) / width
    total = F.sum("_n")
    return points.groupBy(*keys, "x").agg((F.sum(F.col("_n") * F.exp(-z * z / 2)) / (total * width * math.sqrt(2 * math.pi))).alias("density"))


def smoothed(values: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, n, mode="symmetric"), k / k.sum(), mode="valid")


#: A token line of a run log.
TOKENS = r"\[(\w+)\] Tokens - Input: (\d+), Output: (\d+)"


def token_lines(logs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., provider, n_in, n_out) of every token line of a log."""
    hits = logs.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0))).alias("_l"))
    part = lambda i: F.regexp_extract("_l", TOKENS, i)
    return hits.select(*keys, part(1).alias("provider"), part(2).cast("bigint").alias("n_in"), part(3).cast("bigint").alias("n_out"))


def combined_score(fuzzy: Column, semantic: Column) -> Column:
    """Harmonic mean whose semantic weight rises from 0.4 to 0.7 around a semantic score of 0.8."""
    w = 0.4 + 0.3 / (1 + F.exp(-20 * (semantic - 0.8)))
    return F.when((fuzzy > 0) & (semantic > 0), 1 / (w / semantic + (1 - w) / fuzzy)).otherwise(0.0)


def indel_ratio(a: str, b: str) -> float:
    """Similarity in percent, rounded: matched letters of the longest common subsequence over all letters."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return float(round(200 * row[-1] / (len(a) + len(b))))


def fuzzy_score(a: Column, b: Column) -> Column:
    """Root of the product of the plain ratio and the ratio of the sorted words, from 0 to 1."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            x, y = x.lower(), y.lower()
            s, t = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
            out.append(math.sqrt(indel_ratio(x, y) * indel_ratio(s, t)) / 100)
        return pd.Series(out, dtype="float64")

    return run(a, b)
