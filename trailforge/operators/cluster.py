"""Rules across groups: predicate correlation, clustering, assignment and pooled effects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf_column, phi
from ..sources.io import saved

BINS = 40


def fire_counts(fired: DataFrame) -> DataFrame:
    return fired.groupBy("rule_id").agg(F.count("*").alias("fires"))


def powered(counts: DataFrame, n_pool: int, min_fires: int) -> DataFrame:
    """Rules that fire, and fail to fire, on at least min_fires runs."""
    return counts.where(F.col("fires").between(min_fires, n_pool - min_fires))


def phi_pairs(fired: DataFrame, n_pool: int) -> DataFrame:
    """(a, b, phi) of every pair of rules, from sparse co-occurrence; rules that never meet have their counts only."""
    n = fire_counts(fired)
    both = fired.alias("x").join(fired.alias("y"), F.col("x.traj_id") == F.col("y.traj_id")).where("x.rule_id < y.rule_id")
    met = both.groupBy(F.col("x.rule_id").alias("a"), F.col("y.rule_id").alias("b")).agg(F.count("*").alias("n11"))
    rules = n.select(F.col("rule_id").alias("a"), F.col("fires").alias("n1"))
    every = rules.join(n.select(F.col("rule_id").alias("b"), F.col("fires").alias("n2")), F.col("a") < F.col("b"))
    every = every.join(met, ["a", "b"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
    return every.select("a", "b", phi(F.lit(n_pool), F.col("n11"), F.col("n1"), F.col("n2")).alias("phi"))


def phi_histogram(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n) over [-1, 1]; the last bin holds 1."""
    at = F.least(F.floor((F.col("phi") + 1) / (2.0 / bins)), F.lit(bins - 1)).cast("int")
    return pairs.where("phi IS NOT NULL").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def phi_valley(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """(cutoff): centre of the lowest bin from the last mode but one to the last, of a histogram (bin, n); no row with fewer modes.

    Bins are smoothed over three neighbours; the first of equally low ones counts. One row a bin, so windows are small.
    """
    every = hist.sparkSession.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin")).join(hist, "bin", "left")
    by = W.orderBy("bin")
    near = lambda c, k, none: F.coalesce(F.lag(c, k).over(by), none)
    n = F.coalesce("n", F.lit(0))
    x = every.select("bin", n.alias("n"))
    x = x.select("bin", (F.col("n") + near("n", 1, F.lit(0)) + near("n", -1, F.lit(0))).alias("h"))
    mode = (F.col("h") >= F.lag("h").over(by)) & (F.col("h") > F.lead("h").over(by))  # null, and so false, at both ends
    x = x.withColumn("modes", F.sum(F.coalesce(mode, F.lit(False)).cast("int")).over(by)).withColumn("mode", F.coalesce(mode, F.lit(False)))
    last = F.max("modes").over(W.partitionBy())
    x = x.withColumn("left", last - F.col("modes"))
    # between the two last modes: one mode is still to come, or the last one itself
    between = x.withColumn("last", last).where((F.col("last") >= 2) & ((F.col("left") == 1) | (F.col("mode") & (F.col("left") == 0))))
    low = between.groupBy().agg(F.min_by("bin", F.struct("h", "bin")).alias("low")).where("low IS NOT NULL")
    return low.select((F.lit(-1.0) + (2 * F.col("low") + 1) / bins).alias("cutoff"))


def valley_of(pairs: DataFrame, bins: int = BINS) -> float | None:
    row = phi_valley(phi_histogram(pairs, bins), bins).first()
    return row.cutoff if row else None


def complete_linkage(names: list, distance: dict[tuple, float], cut: float) -> dict:
    """Cluster number of each name; clusters merge while their farthest members are nearer than cut.

    Numbers follow the first name of a cluster; pairs without a distance are at 2, the farthest.
    """
    n = len(names)
    d = np.full((n, n), 2.0)
    at = {x: i for i, x in enumerate(names)}
    for (a, b), v in distance.items():
        d[at[a], at[b]] = d[at[b], at[a]] = v
    np.fill_diagonal(d, np.inf)
    member = [[i] for i in range(n)]
    live = np.ones(n, bool)
    while live.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] >= cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        live[j] = False
        member[i] += member[j]
    groups = sorted(sorted(member[i]) for i in range(n) if live[i])
    return {names[i]: k for k, g in enumerate(groups) for i in g}


def cluster_rules(pairs: DataFrame, rule_ids: list, cutoff: float) -> dict:
    """Clusters of the powered rules, a set that is small by nature; pairs without a correlation count as -1."""
    dist = {(r.a, r.b): 1 - (r.phi if r.phi is not None else -1.0) for r in pairs.toLocalIterator()}
    return complete_linkage(sorted(rule_ids), dist, 1 - cutoff)


#: Vectors of a block, and how much farther than the k-th a vector may seem before its exact distance decides.
KNN_BLOCK, SLACK = 2048, 1e-9


def knn(vectors: DataFrame, k: int) -> DataFrame:
    """(a, b, distance): each vector's k nearest by cosine, made symmetric with the smaller distance, at most 1.

    Exact. Vectors are packed into blocks, and a task multiplies two of them as matrices; of each product every vector
    keeps its k nearest and ties, so a block sends on k rows a vector, not all pairs. Vectors without a direction have no neighbours.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id") if dict(vectors.dtypes)["id"] != "string" else "id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = rows.count()
    blocks = max(1, -(-n // KNN_BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("m"))  # KNN_BLOCK vectors or so
    pairs = spark.range(0, blocks).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"))
    x = pairs.join(packed.select(F.col("block").alias("i"), F.col("m").alias("x")), "i").join(packed.select(F.col("block").alias("j"), F.col("m").alias("y")), "j").repartition("i", "j")
    kind = dict(rows.dtypes)["id"]

    def unit(m: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack(m.values.field("v").to_numpy(zero_copy_only=False))
        norm = np.sqrt((v * v).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.array(m.values.field("id").to_pylist()), v / norm[:, None]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (p, u), (q, w) = unit(b.column("x")[r]), unit(b.column("y")[r])
                same = b.column("i")[r].as_py() == b.column("j")[r].as_py()
                d = 1 - u @ w.T
                if same:
                    np.fill_diagonal(d, np.inf)
                d = np.where(np.isnan(d), np.inf, d)
                for ids, others, s, t, dist in ((p, q, u, w, d),) if same else ((p, q, u, w, d), (q, p, w, u, d.T)):
                    kth = np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1]
                    a, c = np.nonzero((dist <= kth[:, None] + SLACK) & np.isfinite(dist))
                    exact = 1 - (s[a] * t[c]).sum(1)  # added up in one order for every pair
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(others[c]), pa.array(exact)], names=["a", "b", "distance"])

    d = x.select("i", "j", "x", "y").mapInArrow(near, f"a {kind}, b {kind}, distance double")
    near_ = d.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("rn") <= k)
    return near_.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.least(F.min("distance"), F.lit(1.0)).alias("distance"))


def assignment_choices(unresolved: DataFrame, neighbours: DataFrame, clusters: DataFrame, max_groups: int = 6, members: int = 3) -> DataFrame:
    """(rule, cluster, place, members): up to six nearest clusters of each unresolved rule, with three members each."""
    both = neighbours.select(F.col("a").alias("rule"), F.col("b").alias("other"), "distance").unionByName(neighbours.select(F.col("b").alias("rule"), F.col("a").alias("other"), "distance"))
    near = both.join(unresolved.select(F.col("rule_id").alias("rule")), "rule", "left_semi").join(clusters.select(F.col("rule_id").alias("other"), "cluster"), "other")
    w = W.partitionBy("rule", "cluster").orderBy("distance", "other")
    near = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= members)
    groups = near.groupBy("rule", "cluster").agg(F.min("distance").alias("distance"), F.transform(F.sort_array(F.collect_list(F.struct("rn", "other"))), lambda s: s["other"]).alias("members"))
    place = F.row_number().over(W.partitionBy("rule").orderBy("distance", "cluster"))
    return groups.withColumn("place", place).where(F.col("place") <= max_groups).select("rule", "cluster", "place", "members")


def pool_and_q(members: DataFrame, by: list[str], alpha: float = 0.10) -> DataFrame:
    """Inverse-variance pooled effect of members(lift, z) and Cochran's Q with its p-value."""
    se = F.abs(F.try_divide("lift", "z"))
    usable = F.coalesce((F.abs("z") > 1e-9) & (se > 1e-9), F.lit(False))
    w = F.when(usable, F.try_divide(F.lit(1.0), se * se))
    lift = F.when(usable, F.col("lift"))
    s = members.groupBy(*by).agg(F.count_if(usable).alias("n_scored"), F.sum(w).alias("w"), F.sum(w * lift).alias("wl"), F.sum(w * lift * lift).alias("wll"), F.max(lift).alias("one"), F.max(F.when(usable, F.col("lift") / se)).alias("one_z"))
    many = F.col("n_scored") >= 2
    mean = F.try_divide("wl", "w")
    q = F.greatest(F.col("wll") - mean * F.col("wl"), F.lit(0.0))
    s = s.withColumn("raw_q", F.when(many, q)).withColumn("raw_p", chi2_sf_column(F.col("raw_q"), F.col("n_scored") - 1))
    return s.select(
        *by, "n_scored", F.when(many, F.round(mean, 4)).otherwise(F.col("one")).alias("pooled_lift"), F.when(many, F.round(mean * F.sqrt("w"), 3)).otherwise(F.col("one_z")).alias("pooled_z"),
        F.round("raw_q", 3).alias("q"), F.when(many, F.round("raw_p", 4)).alias("q_p"), F.when(many, F.col("raw_p") >= alpha).alias("homogeneous"),
    )


def assemble(clusters: DataFrame, assigned: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, component): clusters, rules assigned to them, and a new number for every rule left over."""
    known = clusters.select("rule_id", F.col("cluster").alias("component")).unionByName(assigned.select("rule_id", F.col("cluster").alias("component")))
    top = known.agg(F.max("component").alias("top")).first().top
    alone = rules.select("rule_id").join(known.select("rule_id"), "rule_id", "left_anti")
    # numbers without one task: a sort deals the rules into ranges, whose sizes are a row each
    ranged = alone.repartitionByRange("rule_id").sortWithinPartitions("rule_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = saved(ranged, "ranged")  # the numbers have to be the same wherever they are read
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = sizes.select("part", "first", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = ranged.join(before, "part").select("rule_id", (F.lit(-1 if top is None else top) + 1 + F.col("before") + F.col("at") - F.col("first")).cast(known.schema["component"].dataType).alias("component"))
    return known.unionByName(numbered)


def component_table(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Size, repos, support and smallest correlation of each component; members(rule_id, component, repo, support)."""
    c = members.select("rule_id", "component")
    inside = pairs.join(c.select(F.col("rule_id").alias("a"), F.col("component").alias("ca")), "a").join(c.select(F.col("rule_id").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb")
    low = inside.groupBy(F.col("ca").alias("component")).agg(F.round(F.min("phi"), 3).alias("min_phi"))
    g = members.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_set("repo")).alias("repos"), F.sum("support").alias("support_total"))
    return g.join(low, "component", "left")


def strategies(components: DataFrame) -> DataFrame:
    """Components that span two repos or more."""
    return components.where(F.size("repos") >= 2)


def majority_predicate(members: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent predicate of a group, first seen on ties, and its share of all members as "n/m"."""
    n = members.groupBy(*by).agg(F.count("*").alias("m"))
    c = members.where("coalesce(predicate, '') <> ''").groupBy(*by, "predicate").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = c.groupBy(*by).agg(F.max_by(F.struct("predicate", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("t"))
    return n.join(top, by, "left").select(*by, F.col("t.predicate").alias("predicate"), F.when(F.col("t").isNotNull(), F.concat(F.col("t.n").cast("string"), F.lit("/"), F.col("m").cast("string"))).alias("agreement"))


def generalize_summary(parts: DataFrame) -> DataFrame:
    """Counts of strategies that are homogeneous, heterogeneous and undecided."""
    return parts.agg(F.count("*").alias("n"), F.count_if(F.col("homogeneous")).alias("homogeneous"), F.count_if(~F.col("homogeneous")).alias("heterogeneous"), F.count_if(F.col("homogeneous").isNull()).alias("undecided"))
