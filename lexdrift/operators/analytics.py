"""Tables that analysts read: quantiles, coverage, monosemy, classifiers, summaries, histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions import ranks
from lexdrift.functions.special import correlation_p
from lexdrift.functions.vectors import vector_sums
from lexdrift.operators import kernels, pairs

QUANTILES = [("q00", 0.0), ("q10", 0.1), ("q20", 0.2), ("q30", 0.3), ("q70", 0.7), ("q80", 0.8), ("q90", 0.9), ("q100", 1.0)]
THRESHOLDS = [10, 25, 50, 100, 200, 300]


def shift_quantiles(steps: DataFrame, min_steps: int = 10, value: str = "step_distance") -> DataFrame:
    """word, n_steps, q00 .. q100, spread_ratio (q90 over q10) of words with enough steps."""
    x = steps.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = x.groupBy("word").agg(F.count(F.lit(1)).alias("n_steps"), F.percentile(value, F.array(*[F.lit(q) for _, q in QUANTILES])).alias("q")).where(F.col("n_steps") >= min_steps)
    out = rows.select("word", "n_steps", *[F.get("q", F.lit(k)).alias(n) for k, (n, _) in enumerate(QUANTILES)])
    return out.withColumn("spread_ratio", ranks.guarded_ratio(F.col("q90"), F.col("q10")))


def top_two_ratio(steps: DataFrame, value: str = "step_distance") -> DataFrame:
    """word, top2_ratio: second largest step over the largest; null with fewer than two."""
    order = Window.partitionBy("word").orderBy(F.desc(value))
    top = steps.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 2)
    two = top.groupBy("word").agg(F.max(value).alias("a"), F.min(value).alias("b"), F.count(F.lit(1)).alias("n"))
    return two.select("word", F.when(F.col("n") == 2, ranks.guarded_ratio(F.col("b"), F.col("a"))).alias("top2_ratio"))


def path_table(quantiles: DataFrame, ranking: DataFrame, steps: DataFrame) -> DataFrame:
    """Quantiles with r_100_90, r_100_80, top2_ratio and path_efficiency (end_vs_start over total_drift)."""
    ends = ranking.select("word", ranks.guarded_ratio(F.col("end_vs_start"), F.col("total_drift")).alias("path_efficiency"))
    rows = quantiles.join(top_two_ratio(steps), "word", "left").join(ends, "word", "left")
    return rows.withColumns({"r_100_90": ranks.guarded_ratio(F.col("q100"), F.col("q90")), "r_100_80": ranks.guarded_ratio(F.col("q100"), F.col("q80"))})


def both_above(df: DataFrame, x: str, y: str, qx: float = 0.9, qy: float = 0.9) -> DataFrame:
    """Rows at or above their own quantile on both axes; the two thresholds are one row."""
    cut = df.agg(F.percentile(x, F.lit(qx)).alias("__x"), F.percentile(y, F.lit(qy)).alias("__y"))
    return df.crossJoin(F.broadcast(cut)).where((F.col(x) >= F.col("__x")) & (F.col(y) >= F.col("__y"))).drop("__x", "__y")


def product_score(df: DataFrame, x: str, y: str, name: str = "score") -> DataFrame:
    """Product of the fractional ranks on two axes."""
    rows = ranks.fraction_rank(ranks.fraction_rank(df, x, "__a"), y, "__b")
    return rows.withColumn(name, F.col("__a") * F.col("__b")).drop("__a", "__b")


def usage_floor(cells: DataFrame) -> DataFrame:
    """word, floor_count, n_years of a (word, year, n_usages) table."""
    return cells.groupBy("word").agg(F.min("n_usages").alias("floor_count"), F.countDistinct("year").alias("n_years"))


def coverage(cells: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """threshold, frac_word_years_ge, frac_words_all_years_ge, frac_full_cohort_all_years_ge.

    The full cohort is the words present in the most years. One pass over the
    cells and one over the words makes all thresholds.
    """
    words = usage_floor(cells)
    most = words.agg(F.max("n_years").alias("__most"))
    flags = words.crossJoin(F.broadcast(most)).withColumn("full", F.col("n_years") == F.col("__most"))

    def share(value: str, t: int) -> Column:
        return F.avg((F.col(value) >= t).cast("double"))

    a = cells.agg(*[share("n_usages", t).alias(f"a{t}") for t in thresholds])
    b = flags.agg(*[share("floor_count", t).alias(f"b{t}") for t in thresholds], *[F.avg(F.when(F.col("full"), (F.col("floor_count") >= t).cast("double"))).alias(f"c{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{t}").alias("frac_word_years_ge"), F.col(f"b{t}").alias("frac_words_all_years_ge"), F.col(f"c{t}").alias("frac_full_cohort_all_years_ge")) for t in thresholds])
    return a.crossJoin(b).select(F.inline(rows))


def coverage_curve(cells: DataFrame, upto: int = 100) -> DataFrame:
    """k, frac: share of cells with at least k usages, for k from 1."""
    total = cells.agg(F.count(F.lit(1)).alias("n"))
    counts = cells.select(F.least("n_usages", F.lit(upto)).cast("int").alias("c")).where("c >= 1").groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    ks = cells.sparkSession.range(1, upto + 1).select(F.col("id").cast("int").alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = ks.join(counts, ks.k == counts.c, "left").withColumn("s", F.sum(F.coalesce("m", F.lit(0))).over(above))
    return rows.crossJoin(F.broadcast(total)).select("k", (F.col("s") / F.col("n")).alias("frac"))


def survival(cells: DataFrame, thresholds: tuple[int, ...] = (100, 200, 300)) -> DataFrame:
    """year and the share of its words with at least so many usages."""
    return cells.groupBy("year").agg(*[F.avg((F.col("n_usages") >= t).cast("double")).alias(f"frac_ge_{t}") for t in thresholds])


def dip_by_word_year(usages: DataFrame, min_usages: int = 150, draws: int = 1000, ident: str = "usage_id", null_path: str | None = None) -> DataFrame:
    """word, year, n_usages, dip, p_value, tested: unimodality of pairwise distances; cells under ``min_usages`` are kept untested.

    Distances come from pairs of blocks, so a cell of any size is many tasks.
    """
    rows = usages.where(F.col("emb").isNotNull()).withColumn("year", F.col("year").cast("int"))
    cells = rows.groupBy("word", "year").agg(F.count(F.lit(1)).cast("int").alias("n_usages"))
    enough = cells.where(F.col("n_usages") >= max(min_usages, 2)).select("word", "year")
    found = pairs.distance_summaries(rows.join(enough, ["word", "year"], "left_semi"), ["word", "year"], ident, draws, null_path=null_path)
    told = cells.join(found.select("word", "year", "dip", F.col("dip_pvalue").alias("p_value")), ["word", "year"], "left")
    return told.select("word", "year", "n_usages", "dip", "p_value", F.col("dip").isNotNull().alias("tested"))


def monosemy_summary(dips: DataFrame, p: float = 0.10, k_pass: int = 5, max_fails: int = 0, dip_ceiling: float | None = None) -> DataFrame:
    """word, n_years_present, n_years_tested, n_pass, n_fail, min_p_tested, max_dip_tested, mean_p_passing, is_monosemous."""
    tested = F.col("tested")
    passing = tested & (F.col("p_value") >= p)
    if dip_ceiling is not None:
        passing = passing & (F.col("dip") < dip_ceiling)
    out = dips.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_years_present"), F.count_if(tested).alias("n_years_tested"), F.count_if(passing).alias("n_pass"), F.count_if(tested & ~passing).alias("n_fail"),
        F.min(F.when(tested, F.col("p_value"))).alias("min_p_tested"), F.max(F.when(tested, F.col("dip"))).alias("max_dip_tested"), ranks.mean_in_order(F.when(passing, F.col("p_value")), "year").alias("mean_p_passing"),
    )
    return out.withColumn("is_monosemous", (F.col("n_pass") >= k_pass) & (F.col("n_fail") <= max_fails))


def classifier_sweep(dips: DataFrame, settings: DataFrame) -> DataFrame:
    """``settings`` (setting, n_floor, p, dip_ceiling, k_pass, max_fails) with n_monosemous: how many words each classifies. Settings are a few rows."""
    s = F.broadcast(settings)
    tested = F.col("n_usages") >= F.col("n_floor")
    passing = tested & (F.col("p_value") >= F.col("p")) & (F.col("dip") < F.col("dip_ceiling"))
    cells = dips.where(F.col("p_value").isNotNull()).crossJoin(s).groupBy("setting", "word", "k_pass", "max_fails").agg(F.count_if(passing).alias("a"), F.count_if(tested & ~passing).alias("b"))
    found = cells.groupBy("setting").agg(F.count_if((F.col("a") >= F.col("k_pass")) & (F.col("b") <= F.col("max_fails"))).alias("n_monosemous"))
    return settings.join(found, "setting", "left").withColumn("n_monosemous", F.coalesce("n_monosemous", F.lit(0)))


def dip_archetypes(dips: DataFrame) -> DataFrame:
    """word, log_p_range, log_p_std of log10 p, clipped at 1e-4."""
    x = F.log10(F.greatest(F.col("p_value"), F.lit(1e-4)))
    return dips.where(F.col("p_value").isNotNull()).groupBy("word").agg((F.max(x) - F.min(x)).alias("log_p_range"), F.stddev_samp(x).alias("log_p_std"))


def histogram(df: DataFrame, value: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """bin (from 0), low, high, n over equal widths between the least and the largest value; the last bin is closed."""
    by = by or []
    rows = df.where(F.col(value).isNotNull())
    ends = rows.agg(F.min(value).cast("double").alias("__a"), F.max(value).cast("double").alias("__b"))
    at = F.when(F.col("__b") > F.col("__a"), F.least(F.floor((F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(*by, at.cast("int").alias("bin"), "__a", "__b").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("__b") - F.col("__a")) / bins
    return counts.select(*by, "bin", (F.col("__a") + F.col("bin") * width).alias("low"), (F.col("__a") + (F.col("bin") + 1) * width).alias("high"), "n")


def tempo(shift_rows: DataFrame, value: str = "combined_shift", time: str = "t2") -> DataFrame:
    """time, mean, median, p95, n of the valid shifts of a step."""
    x = shift_rows.where(F.col(value).isNotNull())
    return x.groupBy(time).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))


def year_strip(steps: DataFrame, value: str = "step_distance") -> DataFrame:
    """year, mean_step, p90_step."""
    return steps.where(F.col(value).isNotNull()).groupBy("year").agg(F.avg(value).alias("mean_step"), F.percentile(value, F.lit(0.9)).alias("p90_step"))


def slope(df: DataFrame, by: list[str], y: str, x: str, least: int = 5) -> DataFrame:
    """by, slope, n: least-squares slope of groups with enough points."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, F.regr_slope(y, x)).alias("slope"), F.count(F.lit(1)).alias("n"))


def heat_map(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Means pivoted by column, rows ordered by their own mean, highest first."""
    wide = df.groupBy(row).pivot(column).agg(F.avg(value))
    means = df.groupBy(row).agg(F.avg(value).alias("__m"))
    return wide.join(means, row).orderBy(F.desc("__m"), row).drop("__m")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n, p_value: Pearson's r of average ranks; two-sided p by Student's t."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = ranks.average_rank(ranks.average_rank(rows, x, "__a"), y, "__b")
    # Two steps, so that the correlation is one value within the long expression of p.
    out = both.agg(F.corr("__a", "__b").alias("rho"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("p_value", correlation_p(F.col("rho"), F.col("n")))


def summary_table(shift_rows: DataFrame, dispersion: DataFrame, terms: DataFrame, mids: Column) -> DataFrame:
    """word, total, place, percentile, trend of the given terms among all words; trend is the slope of dispersion over time."""
    totals = shift_rows.groupBy("word").agg(ranks.sum_in_order(F.col("combined_shift"), "t2").alias("total")).where(F.col("total").isNotNull())
    placed = ranks.competition_place(totals, "total", "place", "percentile")
    trend = slope(dispersion.withColumn("__mid", mids), ["word"], "dispersion", "__mid").select("word", F.col("slope").alias("trend"))
    return placed.join(terms.select("word").distinct(), "word", "left_semi").join(trend, "word", "left").select("word", "total", "place", "percentile", "trend")


def colour_limits(df: DataFrame, value: str) -> DataFrame:
    """low, high: 2nd and 98th percentile."""
    return df.agg(F.percentile(value, F.lit(0.02)).alias("low"), F.percentile(value, F.lit(0.98)).alias("high"))


def interval(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, mean, std (population), ci_lower, ci_upper, n_valid, values of bootstrap replicates; nulls and NaN are not valid."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.025)).alias("ci_lower"), F.percentile(value, F.lit(0.975)).alias("ci_upper"), F.count(F.lit(1)).alias("n_valid"), F.array_sort(F.collect_list(value)).alias("values"))


def block_moments(usages: DataFrame, max_per_year: int | None = 300, min_usages: int = 2, seed: int = 42) -> DataFrame:
    """word, year_a, year_b, mean_dist, var_dist, n_pairs over all pairs of two years' usages (within a year: its pairs); variance is null below two pairs.

    At most ``max_per_year`` usages a cell are sampled, which is then part of
    the metric; None takes all. No pair is formed: cosines add up to the product
    of two cells' sums of unit vectors, their squares to that of the cells' sums
    of outer products.
    """
    from lexdrift.operators.usages import sample_per_key

    rows = usages.where(F.col("emb").isNotNull())
    if max_per_year is not None:
        rows = sample_per_key(rows, ["word", "year"], ["usage_id"], max_per_year, seed)
    rows = rows.select("word", F.col("year").cast("int").alias("year"), "emb")

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sums over a batch; rows of one cell from other batches and tasks are added by Spark.
        for frame in frames:
            found = []
            for (word, year), g in frame.groupby(["word", "year"], dropna=False):
                if len(found) == 256:
                    yield pd.DataFrame(found, columns=["word", "year", "sums"])
                    found = []
                u = kernels.unit_matrix(np.stack(g["emb"].to_numpy()))
                own = (u * u).sum(1)
                found.append([word, year, np.concatenate([[len(u), own.sum(), (own * own).sum()], u.sum(0), (u.T @ u).ravel()])])
            yield pd.DataFrame(found, columns=["word", "year", "sums"])

    parts = rows.mapInPandas(added, "word string, year int, sums array<double>")
    cells = vector_sums(parts, ["word", "year"], "sums", "sums").drop("n").where(F.round(F.get("sums", F.lit(0))) >= min_usages)
    # The sums of a word's years: as many rows as it has years, whatever its usages.
    schema = "word string, year_a int, year_b int, mean_dist double, var_dist double, n_pairs long"

    def moments(key, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("year")
        years, sums, out = own["year"].to_numpy(), np.stack(own["sums"].to_numpy()), []
        dim = round((np.sqrt(4 * (sums.shape[1] - 3) + 1) - 1) / 2)
        n, s, g = np.rint(sums[:, 0]), sums[:, 3 : 3 + dim], sums[:, 3 + dim :]
        for a in range(len(years)):
            for b in range(a, len(years)):
                pairs, first, second = n[a] * n[b], s[a] @ s[b], g[a] @ g[b]
                if a == b:
                    pairs, first, second = n[a] * (n[a] - 1) / 2, (first - sums[a, 1]) / 2, (second - sums[a, 2]) / 2
                if pairs:
                    mean = first / pairs
                    out.append([key[0], years[a], years[b], 1 - mean, max(0.0, second / pairs - mean * mean) if pairs > 1 else None, int(pairs)])
        return pd.DataFrame(out, columns=["word", "year_a", "year_b", "mean_dist", "var_dist", "n_pairs"])

    return cells.groupBy("word").applyInPandas(moments, schema)


def density_curves(usages: DataFrame, max_per_year: int = 300, min_usages: int = 2, points: int = 200, upto: float = 1.5, seed: int = 42) -> DataFrame:
    """word, kind (within or consecutive), year, density on ``points`` places from 0 to ``upto``; null below ten distances. Consecutive: a year and the next calendar year."""
    from lexdrift.operators.usages import sample_per_key

    sampled = sample_per_key(usages.where(F.col("emb").isNotNull()), ["word", "year"], ["usage_id"], max_per_year, seed).select("word", F.col("year").cast("int").alias("year"), "emb")

    def curves(key, rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.linspace(0, upto, points)
        units = {y: kernels.unit_matrix(np.stack(g["emb"].to_numpy())) for y, g in rows.groupby("year") if len(g) >= min_usages}
        out = []
        for y, u in sorted(units.items()):
            out.append([key[0], "within", y, kernels.kde((1 - u @ u.T)[np.triu_indices(len(u), 1)], grid)])
            if y + 1 in units:
                out.append([key[0], "consecutive", y, kernels.kde((1 - u @ units[y + 1].T).ravel(), grid)])
        return pd.DataFrame(out, columns=["word", "kind", "year", "density"])

    return sampled.groupBy("word").applyInPandas(curves, "word string, kind string, year int, density array<double>")


def word_statistics(usages: DataFrame, k_max: int = 6, draws: int = 100, weight: float = 0.05, least: int = 10, seed: int = 42, most: int = 1000, null_draws: int = 1000, ident: str = "usage_id") -> DataFrame:
    """One row a word: moments of pairwise and of centroid distances, dips, two-means silhouette, and the bootstrapped number of components.

    Distances are those of all usages. Clusters and components are fitted on at
    most ``most`` usages a word, a seeded sample, as pilot studies draw them.
    """
    from lexdrift.operators.drift import centroid_distances
    from lexdrift.operators.usages import sample_per_key

    rows = usages.where(F.col("emb").isNotNull())
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("n_usages"))
    nulls = pairs.null_dips(usages.sparkSession, (counts.agg(F.max("n_usages")).first()[0] or 0) ** 2 // 2, null_draws, seed)
    four = lambda c: F.when(F.col("n_values") > 3, F.col(c))
    name = lambda p, d: [*(F.col(c).alias(f"{c}_{p}") for c in ("mean", "median", "std")), four("dip").alias(d), four("dip_pvalue").alias(f"{d}_pvalue")]
    between = pairs.summaries(pairs.pair_bins(rows, ["word"], ident), ["word"], nulls).select("word", *name("dist", "dip"))
    from_centre = pairs.summaries(pairs.value_bins(centroid_distances(rows, ["word"]), ["word"], "centroid_dist"), ["word"], nulls).select("word", *name("centroid_dist", "centroid_dip"))
    schema = "word string, silhouette_k2 double, k_mode int, k_mode_freq double, k_n_valid_bootstraps int"

    def parts(key, own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["emb"].to_numpy()).astype("f8")
        enough = len(x) >= least
        silhouette = kernels.cosine_silhouette(x, kernels.kmeans(x, 2, seed)) if enough else None
        found = kernels.bootstrap_components(x, k_max, draws, weight, seed) if enough else (None, None, 0)
        return pd.DataFrame([[key[0], silhouette, *found]], columns=["word", "silhouette_k2", "k_mode", "k_mode_freq", "k_n_valid_bootstraps"])

    fitted = sample_per_key(rows, ["word"], [ident], most, seed).select("word", "emb").groupBy("word").applyInPandas(parts, schema)
    return counts.join(between, "word", "left").join(from_centre, "word", "left").join(fitted, "word", "left")


def cumulative_limits(shift_rows: DataFrame, value: str = "combined_shift") -> DataFrame:
    """median, p95, n of the words' cumulative shifts; nulls add nothing, a word without a valid one counts 0."""
    totals = shift_rows.groupBy("word").agg(F.coalesce(ranks.sum_in_order(F.col(value), "t2"), F.lit(0.0)).alias("t"))
    return totals.agg(F.percentile("t", F.lit(0.5)).alias("median"), F.percentile("t", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))


def dip_order(summary: DataFrame) -> list[Column]:
    """The order in which monosemous words are shown: more passing years first, then the smaller largest dip, then the larger mean p, then the word."""
    return [F.desc("n_pass"), F.asc_nulls_last("max_dip_tested"), F.desc_nulls_last("mean_p_passing"), F.asc("word")]


def word_arrays(usages: DataFrame, years: list[int], max_per_year: int = 300, min_usages: int = 2, points: int = 200, upto: float = 1.5, seed: int = 42) -> DataFrame:
    """word, mean, var (years x years), within (years x points), consecutive (years - 1 x points): the four arrays of a word on one grid of years.

    Entries without enough usages are null; a word needs two years with enough.
    """
    moments = block_moments(usages, max_per_year, min_usages, seed)
    curves = density_curves(usages, max_per_year, min_usages, points, upto, seed)
    several = moments.where("year_a < year_b").select("word").distinct()
    cells = moments.unionByName(moments.where("year_a < year_b").select("word", F.col("year_b").alias("year_a"), F.col("year_a").alias("year_b"), "mean_dist", "var_dist", "n_pairs"))
    grid = F.array(*[F.lit(y) for y in years])
    wide = cells.groupBy("word").agg(*[F.map_from_entries(F.collect_list(F.struct(F.struct("year_a", "year_b"), c))).alias(c) for c in ("mean_dist", "var_dist")])
    square = lambda c: F.transform(grid, lambda a: F.transform(grid, lambda b: F.try_element_at(c, F.struct(a.alias("year_a"), b.alias("year_b")))))
    lines = curves.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "year"), "density"))).alias("d"))
    row = lambda kind, ys: F.transform(ys, lambda y: F.try_element_at(F.col("d"), F.struct(F.lit(kind).alias("kind"), y.alias("year"))))
    out = wide.join(several, "word", "left_semi").join(lines, "word", "left")
    return out.select("word", square(F.col("mean_dist")).alias("mean"), square(F.col("var_dist")).alias("var"), row("within", grid).alias("within"), row("consecutive", F.slice(grid, 1, max(0, len(years) - 1))).alias("consecutive"))


def pages_of(df: DataFrame, order: list[Column], size: int = 25) -> DataFrame:
    """``df`` with page (from 0) of a fixed number of rows in the given order."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))
