"""Drift of words between slices and years: shifts, dispersion, frequency adjustment, polysemy, centroids, cross-period distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.functions import ranks, vectors
from lexdrift.functions.vectors import cosine, cosine_distance, dot, mean_cosine_between, mean_pairwise_cosine, scaled, total, unit, vector_means, vector_sums
from lexdrift.lineage import cut
from lexdrift.operators.knn import close_counts, counted, neighbours, ranked, scan


def slice_pairs(slices: DataFrame) -> DataFrame:
    """t1, t2 of slices that follow each other; ``slices``: label, ord."""
    a = slices.select(F.col("label").alias("t1"), (F.col("ord") + 1).alias("ord"))
    return a.join(slices.select(F.col("label").alias("t2"), "ord"), "ord").drop("ord")


def ordered_slices(vecs: DataFrame) -> DataFrame:
    """label, ord of the slices in lexical order; one small row a slice."""
    return vecs.select(F.col("slice").alias("label")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("label")))


def neighbour_sets(knn: DataFrame, k: int) -> DataFrame:
    return knn.where(F.col("rank") <= k).groupBy("slice", "word").agg(F.collect_set("neighbour").alias("near"))


def shifts(vecs: DataFrame, words: DataFrame, k: int = 25, knn: DataFrame | None = None) -> DataFrame:
    """word, t1, t2, cosine_shift, jaccard_shift, combined_shift of every word for every two slices that follow each other.

    A word that either slice lacks has null shifts, but its row is there. ``vecs``: slice, word, vec.
    """
    knn = neighbours(vecs, k) if knn is None else knn
    near = neighbour_sets(knn, k)
    full = vecs.groupBy("slice", "word").agg(F.collect_list(F.struct("vec")).alias("vec")).join(near, ["slice", "word"], "left")
    # Each word's slices stand in order, so one join gives both sides and the neighbours are made once.
    grid = words.select("word").distinct().crossJoin(F.broadcast(ordered_slices(vecs)))
    every = grid.join(full.withColumnRenamed("slice", "label"), ["label", "word"], "left")
    later = Window.partitionBy("word").orderBy("ord")
    rows = every.select("word", F.col("label").alias("t1"), F.col("vec").alias("v1"), F.col("near").alias("n1"), *(F.lead(c).over(later).alias(d) for c, d in (("label", "t2"), ("vec", "v2"), ("near", "n2")))).where("t2 is not null")
    # Several vectors of a word in a slice meet each one of the other slice.
    for c in ("v1", "v2"):
        rows = rows.withColumn(c, F.explode_outer(c)).withColumn(c, F.col(f"{c}.vec"))
    empty = F.array().cast("array<string>")
    n1, n2 = F.coalesce("n1", empty), F.coalesce("n2", empty)
    union = F.size(F.array_union(n1, n2))
    present = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    jaccard = F.when(present, F.when(union > 0, 1 - F.size(F.array_intersect(n1, n2)) / union).otherwise(F.lit(0.0)))
    rows = rows.select("word", "t1", "t2", (1 - cosine(F.col("v1"), F.col("v2"))).alias("cosine_shift"), jaccard.alias("jaccard_shift"))
    return rows.withColumn("combined_shift", 0.5 * F.col("cosine_shift") + 0.5 * F.col("jaccard_shift"))


def directional_shift(vecs: DataFrame, word: str, t1: str, t2: str, k: int = 10, knn: DataFrame | None = None, near: int = 5) -> DataFrame:
    """word, direction, magnitude, nearest, gained, lost: from the old neighbours' centroid to the new ones', both in the later space.

    ``nearest``: the ``near`` words of the later space closest to the
    direction, the word itself not left out; none where there is no direction.
    Neighbours that the later space lacks do not count; a centroid of none is
    nought. A word that either slice lacks has a row without a direction.
    """
    knn = neighbours(vecs, k) if knn is None else knn
    top = knn.where((F.col("rank") <= k) & (F.col("word") == word))
    one = vecs.sparkSession.createDataFrame([(word,)], "word string")
    empty = F.array().cast("array<string>")

    def side(t: str, name: str) -> DataFrame:
        return top.where(F.col("slice") == t).groupBy("word").agg(F.collect_list("neighbour").alias(name))

    both = one.join(side(t1, "old"), "word", "left").join(side(t2, "new"), "word", "left").select("word", F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"))
    later = vecs.where(F.col("slice") == t2).select(F.col("word").alias("neighbour"), "vec")
    # Where the word is in both slices: noughts in place of a centroid of no neighbours.
    own = vecs.where((F.col("word") == word) & F.col("slice").isin(t1, t2)).groupBy("word").agg(F.countDistinct("slice").alias("__n"), F.first(F.transform("vec", lambda x: F.lit(0.0))).alias("__noughts")).where(F.col("__n") == len({t1, t2})).drop("__n")

    def centre(name: str) -> DataFrame:
        return vector_means(both.select("word", F.explode(name).alias("neighbour")).join(later, "neighbour"), ["word"], "vec", f"c_{name}").drop("n")

    rows = both.join(own, "word", "left").join(centre("old"), "word", "left").join(centre("new"), "word", "left")
    at = lambda name: F.when(F.col("__noughts").isNotNull(), F.coalesce(f"c_{name}", "__noughts"))
    only = lambda a, b: F.array_sort(F.filter(a, lambda x: ~F.array_contains(b, x)))
    rows = rows.select("word", F.zip_with(at("new"), at("old"), lambda x, y: x - y).alias("direction"), only("new", "old").alias("gained"), only("old", "new").alias("lost"))
    rows = rows.withColumn("magnitude", vectors.norm(F.col("direction")))
    along = along_direction(vecs, rows.where(F.col("magnitude") > 1e-6), t2, near).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("__s"), "neighbour"))).alias("__near"))
    return rows.crossJoin(F.broadcast(along)).select("word", "direction", "magnitude", F.col("__near.neighbour").alias("nearest"), "gained", "lost")


def along_direction(vecs: DataFrame, shift: DataFrame, t2: str, n: int = 5) -> DataFrame:
    """neighbour, sim: the words of ``t2`` nearest to a shift's direction."""
    rows = vecs.where((F.col("slice") == t2) & F.col("vec").isNotNull()).select(F.col("word").alias("neighbour"), "vec").crossJoin(F.broadcast(shift.select("direction")))
    return rows.select("neighbour", cosine(F.col("vec"), F.col("direction")).alias("sim")).orderBy(F.desc("sim"), "neighbour").limit(n)


def dispersion(vecs: DataFrame, k: int = 25, knn: DataFrame | None = None, near: float = 0.5) -> DataFrame:
    """word, time_slice, dispersion, density, neighborhood_size of each word in each slice.

    Mean distance to the ``k`` nearest, mean pairwise cosine among them (from
    the sum of their unit vectors), and how many words lie closer than ``near``.
    """
    if knn is None:
        # One product of blocks gives neighbours and counts; both are read from what it wrote.
        found = cut(scan(vecs, k, near), "neighbours")
        knn, close = ranked(found, k), counted(found)
    else:
        close = close_counts(vecs, near)
    top = knn.where(F.col("rank") <= k)
    units = vecs.select("slice", F.col("word").alias("neighbour"), unit(F.col("vec")).alias("u"))
    density = mean_cosine_between(top.join(units, ["slice", "neighbour"]), ["slice", "word"], "neighbour", "u", "density")
    spread = top.groupBy("slice", "word").agg(F.avg(1 - F.col("sim")).alias("dispersion"))
    rows = spread.join(density, ["slice", "word"], "left").join(close, ["slice", "word"], "left")
    return rows.select("word", F.col("slice").alias("time_slice"), "dispersion", "density", F.coalesce("close", F.lit(0)).alias("neighborhood_size"))


def neighbourhood_sizes(vecs: DataFrame, words: DataFrame, near: float = 0.5) -> DataFrame:
    """word, time_slice, neighborhood_size of each given word in each slice; a word that a slice lacks counts 0."""
    grid = words.select("word").distinct().crossJoin(F.broadcast(vecs.select("slice").distinct()))
    return grid.join(close_counts(vecs, near), ["slice", "word"], "left").select("word", F.col("slice").alias("time_slice"), F.coalesce("close", F.lit(0)).alias("neighborhood_size"))


def coherence(vecs: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, time_slice, coherence: mean pairwise cosine of a domain's words in a slice; null below two. ``domains``: domain, word."""
    rows = vecs.join(F.broadcast(domains), "word").select("domain", "slice", "word", unit(F.col("vec")).alias("u"))
    return mean_cosine_between(rows, ["domain", "slice"], "word", "u", "coherence").select("domain", F.col("slice").alias("time_slice"), "coherence")


def total_drift(shift_rows: DataFrame, value: str = "combined_shift") -> DataFrame:
    """word, total_drift (nulls skipped, all null: 0), n_pairs of valid steps."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return shift_rows.groupBy("word").agg(F.coalesce(ranks.sum_in_order(x, *(c for c in ["t2"] if c in shift_rows.columns)), F.lit(0.0)).alias("total_drift"), F.count(x).alias("n_pairs"))


def cumulative_shift(shift_rows: DataFrame, value: str = "cosine_shift", name: str = "cumulative") -> DataFrame:
    """Running sum over a word's pairs by t2; a null step keeps its row null and adds nothing."""
    run = Window.partitionBy("word").orderBy("t2").rowsBetween(Window.unboundedPreceding, 0)
    return shift_rows.withColumn(name, F.when(F.col(value).isNotNull(), F.sum(value).over(run)))


def top_drifters(shift_rows: DataFrame, n: int = 12, most_stable: bool = False) -> DataFrame:
    """The ``n`` words that moved most, or least; ties by word."""
    by = F.asc("total_drift") if most_stable else F.desc("total_drift")
    return total_drift(shift_rows).orderBy(by, "word").limit(n)


def frequency_percentiles(means: DataFrame, bins: int = 100) -> DataFrame:
    """``means`` (word, mean_count) with freq_percentile: bins of the average rank."""
    ranked = ranks.average_rank(means, "mean_count", "__rank")
    return ranks.quantile_bins(ranked, "__rank", "freq_percentile", bins).drop("__rank")


def frequency_adjusted(drift: DataFrame, means: DataFrame, min_percentile: int | None = 6, bins: int = 100) -> DataFrame:
    """word, total_drift, mean_count, freq_percentile, group_mean_drift, adjusted_drift: drift less the mean of the word's frequency bin."""
    rows = drift.select("word", "total_drift").join(frequency_percentiles(means, bins), "word")
    if min_percentile is not None:
        rows = rows.where(F.col("freq_percentile") >= min_percentile)
    group = F.avg("total_drift").over(Window.partitionBy("freq_percentile"))
    return rows.withColumn("group_mean_drift", group).withColumn("adjusted_drift", F.col("total_drift") - F.col("group_mean_drift")).select("word", "total_drift", "mean_count", "freq_percentile", "group_mean_drift", "adjusted_drift")


def polysemy(usages: DataFrame, min_usages: int = 10) -> DataFrame:
    """word, year, apd, self_similarity, n_usages of cells with enough usages (word, year, emb)."""
    keys = ["word", "year"]
    rows = usages.where(F.col("emb").isNotNull()).select(*keys, "emb", unit(F.col("emb")).alias("u"))
    units = vector_sums(rows, keys, "u", "s").where(F.col("n") >= min_usages)
    apd = units.select(*keys, F.col("n").alias("n_usages"), (1 - mean_pairwise_cosine(F.col("s"), F.col("n"))).alias("apd"))
    means = vector_means(rows, keys, "emb", "m").select(*keys, "m")
    # Cosines to the mean add up to the unit vectors' sum times the mean's direction.
    own = units.join(means, keys).select(*keys, (dot(F.col("s"), F.col("m")) / (vectors.norm(F.col("m")) + vectors.EPS) / F.col("n")).alias("self_similarity"))
    return apd.join(own, keys).select("word", "year", "apd", "self_similarity", "n_usages")


def polysemy_ranking(table: DataFrame, min_years: int = 20) -> DataFrame:
    out = table.groupBy("word").agg(F.avg("apd").alias("mean_apd"), F.avg("self_similarity").alias("mean_self_similarity"), F.countDistinct("year").alias("n_years"), F.avg("n_usages").alias("mean_n_usages"))
    return out.where(F.col("n_years") >= min_years)


def centroids(usages: DataFrame, min_usages: int = 10) -> DataFrame:
    """word, year, centroid, n_usages of cells with enough usages."""
    return vector_means(usages, ["word", "year"], "emb", "centroid").where(F.col("n") >= min_usages).withColumnRenamed("n", "n_usages")


def centroid_drift(cells: DataFrame, min_years: int = 20, anchor: tuple[int, int] | None = None) -> DataFrame:
    """word, year, step_distance, cumulative_drift, anchor_distance, n_usages.

    Steps go to the word's previous year that is there, so gaps are bridged.
    The anchor is the mean of the centroids in the anchor years, unweighted, or
    the first year's where there are none.
    """
    years = Window.partitionBy("word")
    by_year = years.orderBy("year")
    rows = cells.withColumn("__n", F.count(F.lit(1)).over(years)).where(F.col("__n") >= min_years).drop("__n")
    rows = rows.withColumn("step_distance", cosine_distance(F.col("centroid"), F.lag("centroid").over(by_year)))
    rows = rows.withColumn("cumulative_drift", F.coalesce(F.sum("step_distance").over(by_year.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    first = cells.groupBy("word").agg(F.min_by("centroid", "year").alias("__first"))
    base = first
    if anchor:
        means = vector_means(cells.where(F.col("year").between(*anchor)), ["word"], "centroid", "__anchor").drop("n")
        base = first.join(means, "word", "left").select("word", F.coalesce("__anchor", "__first").alias("__first"))
    return rows.join(base, "word").select("word", "year", "step_distance", "cumulative_drift", cosine_distance(F.col("centroid"), F.col("__first")).alias("anchor_distance"), "n_usages")


def drift_ranking(series: DataFrame, cells: DataFrame) -> DataFrame:
    """word, n_years, total_drift, mean_step, max_step, max_step_year, end_vs_start, anchor_to_final."""
    x = F.col("step_distance")
    out = series.groupBy("word").agg(
        F.countDistinct("year").alias("n_years"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total_drift"), F.avg(x).alias("mean_step"), F.max(x).alias("max_step"),
        F.max_by("year", F.when(x.isNotNull(), F.struct(x, -F.col("year")))).alias("max_step_year"), F.max_by("anchor_distance", "year").alias("anchor_to_final"),
    )
    ends = cells.groupBy("word").agg(F.min_by("centroid", "year").alias("a"), F.max_by("centroid", "year").alias("b"))
    return out.join(ends, "word").withColumn("end_vs_start", cosine_distance(F.col("a"), F.col("b"))).select("word", "n_years", "total_drift", "mean_step", "max_step", "max_step_year", "end_vs_start", "anchor_to_final")


def unit_cells(usages: DataFrame, min_usages: int = 1) -> DataFrame:
    """word, year, s (sum of unit vectors), n."""
    rows = usages.where(F.col("emb").isNotNull()).select("word", "year", unit(F.col("emb")).alias("u"))
    return vector_sums(rows, ["word", "year"], "u", "s").where(F.col("n") >= min_usages)


def cross_period(usages: DataFrame, min_usages: int = 10, min_years: int = 20) -> DataFrame:
    """word, year_a, year_b (a <= b), mean_dist, n_pairs: mean cosine distance between two years' usages, within a year over its pairs.

    Needs one vector a word and year, whatever the number of usages. Sample
    the usages first where a cap is part of the metric.
    """
    cells = unit_cells(usages, min_usages)
    kept = cells.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("word"))).where(F.col("__n") >= min_years).drop("__n")
    a = kept.select("word", F.col("year").alias("year_a"), F.col("s").alias("sa"), F.col("n").alias("na"))
    b = kept.select("word", F.col("year").alias("year_b"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    rows = a.join(b, "word").where("year_a <= year_b")
    same = F.col("year_a") == F.col("year_b")
    mean = F.when(same, 1 - mean_pairwise_cosine(F.col("sa"), F.col("na"))).otherwise(1 - dot(F.col("sa"), F.col("sb")) / (F.col("na") * F.col("nb")))
    pairs = F.when(same, (F.col("na") * (F.col("na") - 1) / 2).cast("long")).otherwise((F.col("na") * F.col("nb")).cast("long"))
    return rows.select("word", "year_a", "year_b", mean.alias("mean_dist"), pairs.alias("n_pairs"))


def cross_period_ranking(matrix: DataFrame) -> DataFrame:
    """word, n_years, mean_diag, mean_off_diag, drift_excess, drift_ratio, max_off_diag, peak_year."""
    diag = matrix.where("year_a = year_b").groupBy("word").agg(F.count(F.lit(1)).alias("n_years"), F.avg("mean_dist").alias("mean_diag"))
    off = matrix.where("year_a < year_b")
    means = off.groupBy("word").agg(F.avg("mean_dist").alias("mean_off_diag"), F.max("mean_dist").alias("max_off_diag"))
    both = off.select("word", F.col("year_a").alias("year"), "mean_dist").unionByName(off.select("word", F.col("year_b").alias("year"), "mean_dist"))
    by_year = both.groupBy("word", "year").agg(F.avg("mean_dist").alias("m"))
    peak = by_year.groupBy("word").agg(F.max_by("year", F.when(F.col("m").isNotNull(), F.struct("m", -F.col("year")))).alias("peak_year"))
    rows = diag.join(means, "word", "left").join(peak, "word", "left")
    return rows.select("word", "n_years", "mean_diag", "mean_off_diag", (F.col("mean_off_diag") - F.col("mean_diag")).alias("drift_excess"), ranks.guarded_ratio(F.col("mean_off_diag"), F.col("mean_diag")).alias("drift_ratio"), "max_off_diag", "peak_year")


def centroid_distances(usages: DataFrame, keys: list[str]) -> DataFrame:
    """``usages`` with centroid_dist: cosine distance of each to the mean direction of its group's unit vectors."""
    rows = usages.withColumn("__u", unit(F.col("emb")))
    sums = vector_sums(rows, keys, "__u", "__s").drop("n")
    return rows.join(sums, keys).withColumn("centroid_dist", 1 - dot(F.col("__u"), unit(F.col("__s")))).drop("__u", "__s")


def residual_variance(before: DataFrame, after: DataFrame, vector: str = "emb") -> DataFrame:
    """word, per_word_residual_var: share of a word's variance that a projection keeps."""

    def spread(df: DataFrame, name: str) -> DataFrame:
        parts = df.select("word", F.posexplode(vector).alias("pos", "x")).groupBy("word", "pos").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
        return parts.groupBy("word").agg(F.sum("v").alias(name))

    return spread(before, "b").join(spread(after, "a"), "word").select("word", ranks.guarded_ratio(F.col("a"), F.col("b"), 0.0).alias("per_word_residual_var"))


def neighbour_snapshot(knn: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """word, rank, first_slice, first_neighbour, last_slice, last_neighbour: the nearest words where a term first and last occurs, side by side."""
    rows = knn.where(F.col("rank") <= n).join(terms.select("word").distinct(), "word", "left_semi")
    ends = rows.groupBy("word").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"))

    def side(name: str) -> DataFrame:
        return rows.join(ends.select("word", F.col(f"{name}_slice").alias("slice")), ["word", "slice"]).select("word", "rank", F.col("slice").alias(f"{name}_slice"), F.col("neighbour").alias(f"{name}_neighbour"))

    return side("first").join(side("last"), ["word", "rank"], "full")
