"""Candidate ranking: overlap, mid-ranks, balanced scores and guarded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.quantile import weighted_quantile
from rasterspark.operators.graph import group_closure
from rasterspark.params import SelectionParams

KEYS = ["field_id", "position"]
HIGHER = ("coverage", "precision")
LOWER = ("unsupported", "unanchored", "edge", "border_removed", "border_preserved")


def pairwise_iou(masks: DataFrame, candidates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """IoU of every candidate pair of a window.

    Pixels are reduced to the set of candidates that have them and equal sets are
    counted before any pair is formed, so pairs cost one row per distinct pattern
    rather than one per pixel. A set is at most as long as the window's catalog.
    Two empty masks have IoU 1.
    """
    own = F.array_sort(F.collect_set(F.col("candidate").cast("int")))
    members = masks.groupBy(*keys, "y", "x").agg(own.alias("m")).groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("n"))
    pairs = members.select(*keys, "n", F.explode("m").alias("a"), "m").select(*keys, "n", "a", F.explode("m").alias("b")).where(F.col("a") <= F.col("b"))
    both = pairs.groupBy(*keys, "a", "b").agg(F.sum("n").alias("inter"))
    area = both.where(F.col("a") == F.col("b")).select(*keys, F.col("a").alias("candidate"), F.col("inter").alias("area"))
    c = candidates.select(*keys, F.col("candidate").cast("int").alias("candidate")).join(area, [*keys, "candidate"], "left").fillna(0, ["area"])
    left = c.select(*keys, F.col("candidate").alias("a"), F.col("area").alias("_aa"))
    right = c.select(*keys, F.col("candidate").alias("b"), F.col("area").alias("_ab"))
    full = left.join(right, keys).where(F.col("a") < F.col("b")).join(both, [*keys, "a", "b"], "left").fillna(0, ["inter"])
    union = F.col("_aa") + F.col("_ab") - F.col("inter")
    return full.select(*keys, "a", "b", F.when(union > 0, F.col("inter") / union).otherwise(1.0).alias("iou"))


def symmetric(pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Both directions of every pair, in one pass over the pairs."""
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(*keys, F.explode(ends).alias("e"), "iou").select(*keys, "e.a", "e.b", "iou")


def rank01(value: Column, keys: list[str] = KEYS, higher: bool = True) -> Column:
    """Share of smaller values plus half the share of equal ones."""
    order = Window.partitionBy(*keys).orderBy(value)
    # The default RANGE frame counts values up to the current one, peers included.
    upto, below = F.count(value).over(order), F.rank().over(order) - 1
    r = (below + (upto - below) / 2.0) / F.count(value).over(Window.partitionBy(*keys))
    return r if higher else 1.0 - r


def weighted_rank01(value: Column, weight: Column, keys: list[str] = KEYS, higher: bool = True) -> Column:
    """Weight below plus half the weight of equal values, over the total weight."""
    order = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum(weight).over(order)
    # Peers are a frame of the same window: one of their own would be a group for every value.
    peers = F.sum(weight).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    r = (upto - peers / 2.0) / F.sum(weight).over(Window.partitionBy(*keys))
    return r if higher else 1.0 - r


def _score(df: DataFrame, rank) -> Column:
    w = SelectionParams().weights
    total = F.lit(w["mean_iou"]) * F.col("mean_iou")
    for name in HIGHER:
        total = total + w[name] * rank(F.col(name), True)
    total = total + w["soma"] * rank(F.least(F.col("soma_count").cast("double"), F.col("_cap")), True)
    for name in LOWER:
        total = total + w[name] * rank(F.col(name), False)
    return total


def _select(df: DataFrame, keys: list[str]) -> DataFrame:
    # Sums of a distributed job have no fixed order, so ties are judged at 12 digits.
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 12)), "candidate")
    return df.withColumn("selected", F.row_number().over(order) == 1)


def rank_candidates(metrics: DataFrame, pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean IoU, score and the selected candidate of every window."""
    mean = symmetric(pairs, keys).groupBy(*keys, F.col("a").alias("candidate")).agg(F.avg("iou").alias("mean_iou"))
    cap = metrics.groupBy(*keys).agg(F.percentile("soma_count", F.lit(0.75)).alias("_cap"), F.count(F.lit(1)).alias("_n"))
    j = metrics.join(mean, [*keys, "candidate"], "left").fillna(1.0, ["mean_iou"]).join(cap, keys)
    score = _score(j, lambda v, up: rank01(v, keys, up))
    return _select(j.withColumn("score", F.when(F.col("_n") == 1, 1.0).otherwise(score)), keys).drop("_cap", "_n")


def rank_eligible(metrics: DataFrame, pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rank error-free candidates only; failed ones score -1. Windows without any are ``all_failed``."""
    ok = metrics.where(F.col("error").isNull())
    good = ok.select(*keys, "candidate")
    live = pairs.join(good.withColumnRenamed("candidate", "a"), [*keys, "a"], "left_semi").join(good.withColumnRenamed("candidate", "b"), [*keys, "b"], "left_semi")
    ranked = rank_candidates(ok, live, keys).withColumn("eligible", F.lit(True))
    bad = metrics.where(F.col("error").isNotNull()).withColumns(
        {"mean_iou": F.lit(0.0), "score": F.lit(-1.0), "selected": F.lit(False), "eligible": F.lit(False)})
    out = ranked.unionByName(bad)
    any_ok = F.max("eligible").over(Window.partitionBy(*keys))
    return out.withColumn("window_status", F.when(any_ok, "ok").otherwise("all_failed"))


def near_duplicate_clusters(metrics: DataFrame, pairs: DataFrame, keys: list[str] = KEYS, iou: float = 0.995) -> DataFrame:
    """Representative (lowest number) of every near-duplicate cluster within a family; a window's near-duplicate pairs are closed in its task."""
    fam = metrics.select(*keys, "candidate", "family")
    e = pairs.where(F.col("iou") >= iou)
    e = e.join(fam.select(*keys, F.col("candidate").alias("a"), F.col("family").alias("_fa")), [*keys, "a"])
    e = e.join(fam.select(*keys, F.col("candidate").alias("b"), F.col("family").alias("_fb")), [*keys, "b"]).where(F.col("_fa") == F.col("_fb"))
    root = group_closure(e.select(*keys, "a", "b"), keys).select(*keys, F.col("node").alias("candidate"), F.col("root"))
    return fam.join(root, [*keys, "candidate"], "left").select(*keys, "candidate", "family", F.coalesce("root", "candidate").alias("representative"))


def family_balance_weights(clusters: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Equal weight per family, then per cluster, carried by representatives only."""
    per = clusters.groupBy(*keys, "family").agg(F.countDistinct("representative").alias("_k"))
    cells = per.withColumn("_cells", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    w = F.when(F.col("candidate") == F.col("representative"), 1.0 / F.col("_cells") / F.col("_k")).otherwise(0.0)
    return clusters.join(cells, [*keys, "family"]).withColumn("weight", w).drop("_k", "_cells")


def rank_family_balanced(metrics: DataFrame, pairs: DataFrame, expected: tuple[str, ...], keys: list[str] = KEYS) -> DataFrame:
    """Family-balanced scores; windows lacking an expected family get status ``missing_family``."""
    from rasterspark.session import cut_lineage

    weights = cut_lineage(family_balance_weights(near_duplicate_clusters(metrics, pairs, keys), keys))
    # A window's catalog travels as one map, so its pairs are sent once and not by each of their ends.
    catalog = F.map_from_entries(F.collect_list(F.struct("candidate", F.struct("family", "representative"))))
    of = lambda c: F.try_element_at("_of", F.col(c)).alias(f"_{c}")
    ends = pairs.join(weights.groupBy(*keys).agg(catalog.alias("_of")), keys).select(*keys, "a", "b", "iou", of("a"), of("b"))
    to = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"_{b}.family"), F.col(f"_{b}.representative").alias("rep"), F.col(f"_{a}.representative").alias("own"))
    to_rep = ends.select(*keys, F.explode(F.array(to("a", "b"), to("b", "a"))).alias("e"), "iou").where((F.col("e.b") == F.col("e.rep")) & (F.col("e.b") != F.col("e.own")))
    to_rep = to_rep.select(*keys, "e.a", "e.family", "iou")
    per_cell = to_rep.groupBy(*keys, "a", "family").agg(F.avg("iou").alias("_m"))
    mean = per_cell.groupBy(*keys, F.col("a").alias("candidate")).agg(F.avg("_m").alias("mean_iou"))
    j = metrics.join(weights.select(*keys, "candidate", "weight"), [*keys, "candidate"])
    soma = j.select(*keys, F.col("soma_count").cast("double").alias("soma_count"), "weight")
    cap = weighted_quantile(soma, keys, "soma_count", "weight", 0.75, "_cap")
    seen = metrics.groupBy(*keys).agg(F.array_sort(F.collect_set("family")).alias("_f"), F.count(F.lit(1)).alias("_n"))
    want = F.array_sort(F.array(*[F.lit(f) for f in expected]))
    j = j.join(mean, [*keys, "candidate"], "left").fillna(1.0, ["mean_iou"]).join(cap, keys).join(seen, keys)
    score = _score(j, lambda v, up: weighted_rank01(v, F.col("weight"), keys, up))
    scored = j.withColumn("score", F.when(F.col("_n") == 1, 1.0).otherwise(score))
    status = F.when(F.col("_f") == want, "ok").otherwise("missing_family")
    return _select(scored.withColumn("balance_status", status), keys).drop("_cap", "_f", "_n")


def dominates(rows: DataFrame, margin: float = 0.01) -> DataFrame:
    """Compare a challenger with an incumbent: columns ``c_*`` against ``i_*``, every test kept."""
    t = {f"{m}_not_lower": F.col(f"c_{m}") >= F.col(f"i_{m}") for m in HIGHER}
    t.update({f"{m}_not_higher": F.col(f"c_{m}") <= F.col(f"i_{m}") for m in LOWER})
    t["soma_equal"] = F.col("c_soma_count") == F.col("i_soma_count")
    t["incomplete_border_not_higher"] = F.col("c_incomplete_border") <= F.col("i_incomplete_border")
    t["score_margin"] = F.col("c_score") >= F.col("i_score") + margin
    out = rows.withColumns(t)
    every = None
    for name in t:
        every = F.col(name) if every is None else every & F.col(name)
    return out.withColumn("dominates", every)


_COMPARED = [*HIGHER, *LOWER, "soma_count", "incomplete_border", "score"]


def _stage(ranked: DataFrame, incumbent: DataFrame, number: int, keys: list[str]) -> DataFrame:
    """Challenger of one balanced ranking against the incumbent winner of each window."""
    side = lambda df, p: df.select(*keys, F.col("candidate").alias(f"{p}_candidate"), *[F.col(c).alias(f"{p}_{c}") for c in _COMPARED])
    ok = ranked.where(F.col("balance_status") == "ok")
    ch = side(ok.where("selected"), "c")
    inc = side(ok.join(incumbent.select(*keys, "candidate"), [*keys, "candidate"], "left_semi"), "i")
    d = dominates(ch.join(inc, keys))
    same = F.col("c_candidate") == F.col("i_candidate")
    reason = F.when(same, "challenger_is_incumbent").when(F.col("dominates"), "challenger_dominates").otherwise("challenger_rejected")
    return d.select(*keys, F.when(F.col("dominates"), F.col("c_candidate")).otherwise(F.col("i_candidate")).alias(f"_w{number}"),
                    F.col("c_candidate").alias(f"challenger{number}"), F.col("c_score").alias(f"challenger_score{number}"), reason.alias(f"guard{number}"))


def select_with_guard(metrics: DataFrame, pairs: DataFrame, keys: list[str] = KEYS, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Winner of each window of 18: incumbent of 6, challenger of 12, challenger of 18.

    A challenger must dominate the incumbent. A later stage runs only where all
    its candidates are free of errors, otherwise the earlier winner stands.
    """
    from rasterspark.session import cut_lineage

    metrics, pairs = cut_lineage(metrics), cut_lineage(pairs)
    upto = lambda n: (metrics.where(F.col("candidate") <= n), pairs.where((F.col("a") <= n) & (F.col("b") <= n)))
    m6, p6 = upto(6)
    first = cut_lineage(rank_eligible(m6, p6, keys).where("selected").select(*keys, "candidate", F.col("score").alias("score1")))
    result = metrics.select(*keys).distinct().join(first.withColumnRenamed("candidate", "stage1"), keys, "left").withColumn("winner", F.col("stage1"))
    incumbent = first
    families = {12: params.baseline_families, 18: (*params.baseline_families, params.last_family)}
    for stage, n in ((2, 12), (3, 18)):
        m, p = upto(n)
        clean = m.groupBy(*keys).agg(F.count_if(F.col("error").isNotNull()).alias("_e"), F.count(F.lit(1)).alias("_n")).where((F.col("_e") == 0) & (F.col("_n") == n)).select(*keys)
        ranked = rank_family_balanced(m.join(clean, keys, "left_semi"), p.join(clean, keys, "left_semi"), families[n], keys)
        out = _stage(cut_lineage(ranked), incumbent, stage, keys)
        result = cut_lineage(result.join(out, keys, "left").withColumn("winner", F.coalesce(f"_w{stage}", "winner")).drop(f"_w{stage}").withColumn(
            f"guard{stage}", F.coalesce(f"guard{stage}", F.lit("fail_closed"))))
        incumbent = result.where(F.col("winner").isNotNull()).select(*keys, F.col("winner").alias("candidate"))
    return result


def select_position(scores: DataFrame) -> DataFrame:
    """Unique best valid position per field; an exact tie is ambiguous."""
    top = F.max(F.when(F.col("valid"), F.col("total_score"))).over(Window.partitionBy("field_id"))
    hit = F.col("valid") & (F.col("total_score") == F.col("_top"))
    g = scores.withColumn("_top", top).groupBy("field_id").agg(
        F.count_if("valid").alias("_v"), F.count_if(hit).alias("_k"), F.min(F.when(hit, F.col("position"))).alias("_p"), F.max("_top").alias("best_score"))
    status = F.when(F.col("_v") == 0, "invalid").when(F.col("_k") > 1, "ambiguous").otherwise("selected")
    return g.select("field_id", status.alias("status"), F.when(status == "selected", F.col("_p")).alias("position"), "best_score")


def _without(rank: Column, n: Column, q: float) -> tuple[Column, Column, Column]:
    """Full-list ranks (from 0) of the two neighbours of quantile ``q`` once the item at ``rank`` is gone, and the weight of the upper one."""
    pos = (n - 2) * F.lit(q)
    lo, hi = F.floor(pos), F.ceil(pos)
    skip = lambda i: F.when(i < rank, i).otherwise(i + 1)
    return skip(lo), skip(hi), pos - lo


def _at_ranks(ranked: DataFrame, keys: list[str], value: str, rank: str, n: str, qs: dict[str, float]) -> DataFrame:
    """Per group the values around each quantile: columns <name>0, <name>1 and <name>2 from rank floor(pos) on."""
    cols = []
    for name, q in qs.items():
        lo = F.floor((F.col(n) - 2) * F.lit(q))
        cols += [F.max(F.when(F.col(rank) == lo + i, F.col(value))).alias(f"{name}{i}") for i in range(3)]
    return ranked.groupBy(*keys).agg(*cols)


def _pick(name: str, rank: Column, n: Column, q: float) -> Column:
    """The quantile without the item, from the columns of :func:`_at_ranks`."""
    lo, hi, weight = _without(rank, n, q)
    base = F.floor((n - 2) * F.lit(q))
    at = lambda i: F.when(i == base, F.col(f"{name}0")).when(i == base + 1, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))
    return at(lo) + (at(hi) - at(lo)) * weight


def leave_one_out(values: DataFrame, keys: list[str] = ["field_id"], item: str = "cell_id", value: str = "value") -> DataFrame:
    """Median and robust scale of all other items of the group.

    Dropping one item from a sorted list shifts later ranks by one, so every order
    statistic is one of three neighbours in the group's ranking. At most three
    medians occur in a group, so absolute deviations are ranked at most three times.
    Rows stay flat: no list of a group is gathered.
    """
    g = Window.partitionBy(*keys)
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.withColumns({"_r": F.row_number().over(g.orderBy(value, item)) - 1, "_n": F.count(F.lit(1)).over(g)})
    qs = {"_m": 0.5, "_a": 0.25, "_b": 0.75}
    j = rows.join(_at_ranks(rows, keys, value, "_r", "_n", qs), keys)
    r, n = F.col("_r"), F.col("_n")
    j = j.withColumns({"_med": _pick("_m", r, n, 0.5), "_iqr": _pick("_b", r, n, 0.75) - _pick("_a", r, n, 0.25)})
    j = j.select(*keys, item, value, "_n", "_med", "_iqr")
    medians = j.where(F.col("_n") > 1).select(*keys, "_med").distinct()
    dev = rows.select(*keys, item, value, "_n").join(medians, keys).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    dev = dev.withColumn("_dr", F.row_number().over(Window.partitionBy(*keys, "_med").orderBy("_d", item)) - 1)
    dev = dev.join(_at_ranks(dev, [*keys, "_med"], "_d", "_dr", "_n", {"_v": 0.5}), [*keys, "_med"])
    mad = dev.select(*keys, "_med", item, _pick("_v", F.col("_dr"), n, 0.5).alias("_mad"))
    j = j.join(mad, [*keys, "_med", item], "left")
    alone = n == 1
    scale = F.greatest(1.4826 * F.col("_mad"), F.col("_iqr") / 1.349, F.lit(1e-6))
    return j.select(*keys, item, value, F.when(alone, 0.0).otherwise(F.col("_med")).alias("median"), F.when(alone, 1.0).otherwise(scale).alias("scale"))
