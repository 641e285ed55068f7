"""Joins that are not equalities: bands, intervals, coverage, next in order, tiers of likeness. All run as equi joins on
buckets with the exact condition behind them, so no cross join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of the pieces by which texts that contain one another meet.
PIECES = (3, 5, 8, 16, 32)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: float, also: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of equal keys with |a - b| <= tolerance. left and right share no columns but keys.

    The left side's value falls in one bucket of width tolerance; the right side is copied to its own bucket and both next to it.
    """
    width = F.lit(float(tolerance))
    left = left.withColumn("_bucket", F.floor(F.col(a) / width))
    right = right.withColumn("_near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(b) / width) + k)))
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.col("_bucket") == F.col("_near")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    on = on & (F.abs(F.col(a) - F.col(b)) <= width)
    return left.join(right, on if also is None else on & also, how).drop("_bucket", "_near", *[f"_r_{k}" for k in keys])


def in_interval(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, also: Column | None = None, how: str = "inner", width: float = 64.0) -> DataFrame:
    """Points with start <= at < end on equal keys. Ranges are copied to each bucket of `width` that they touch."""
    points = points.withColumn("_bucket", F.floor(F.col(at) / width))
    ranges = ranges.filter(F.col(end) > F.col(start)).withColumn("_near", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    ranges = ranges.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in ranges.columns])
    on = (F.col("_bucket") == F.col("_near")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    out = points.join(ranges, on if also is None else on & also, how).drop("_bucket")
    return out.drop("_near", *[f"_r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def next_after(df: DataFrame, keys: list[str], value: str, out: str, gap: float = 0.0) -> DataFrame:
    """The least value of the group that is more than `gap` above a row's own: a forward as-of join of the table with itself, as one
    window over the values, without a join."""
    if gap:
        over = f"partition by {', '.join(keys)} order by {value} range between {gap + 1e-9!r} following and unbounded following"
        return df.withColumn(out, F.expr(f"min({value}) over ({over})"))
    # A range frame is inclusive; over dense ranks the next one is strictly above, at any size of the values.
    ranked = df.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy("_r").rangeBetween(1, Window.unboundedFollowing))).drop("_r")


def covered_share(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Share of box a that box b covers; a box without area counts as covered."""
    ax0, ay0, ax1, ay1 = map(F.col, a)
    bx0, by0, bx1, by1 = map(F.col, b)
    inter = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area <= 0, 1.0).otherwise(inter / area)


def match_tiers(products: DataFrame, assets: DataFrame, key: str, name: str, asset: str, order: str) -> DataFrame:
    """Best asset for each product name: key, asset, tier (null without one).

    Tiers: equal, equal without accents, asset starts with the name, contains it, the name contains the asset (4 letters), the same
    for letters and digits only (3, and 4), the same without leading zeros on either side. The lowest tier counts, then the
    asset's order. Equal names are matched by hash joins; only names without one are compared, by shared pieces: a text that
    contains another has its beginning among its own pieces of that length, for the largest of PIECES that the other reaches.
    Names of up to two letters are looked up among the pieces of assets, of which only the best asset is kept.
    """
    from pagewright.functions.text import match_key, strip_accents

    p = products.select(key, F.lower(name).alias("c")).withColumn("cs", strip_accents(F.col("c"))).withColumn("cn", match_key(F.col("c"))).withColumn("cz", F.regexp_replace("cn", "^0+", ""))
    a = assets.select(F.col(asset).alias("asset"), F.col(order).alias("ord"), F.lower(asset).alias("b")).withColumn("bn", match_key(F.col("b"))).withColumn("bz", F.regexp_replace("bn", "^0+", ""))
    best = F.min(F.struct("tier", "ord", "asset")).alias("best")
    exact = p.join(a, F.col("c") == F.col("b")).withColumn("tier", F.lit(1)).unionByName(p.join(a, F.col("cs") == F.col("b")).withColumn("tier", F.lit(2)))
    exact = exact.groupBy(key).agg(best)
    rest = p.join(exact.select(key), key, "left_anti")
    has = lambda x, y: F.contains(x, y)
    tier = (
        F.when(F.col("b").startswith(F.col("c")), 3)
        .when(has(F.col("b"), F.col("c")), 4)
        .when((F.length("b") >= 4) & has(F.col("c"), F.col("b")), 5)
        .when((F.length("cn") >= 3) & has(F.col("bn"), F.col("cn")), 6)
        .when((F.length("cn") >= 3) & (F.length("bn") >= 4) & has(F.col("cn"), F.col("bn")), 7)
        .when((F.length("cz") >= 3) & (F.col("cz") != F.col("cn")) & has(F.col("bn"), F.col("cz")), 8)
        .when((F.length("cn") >= 3) & (F.length("bz") >= 3) & has(F.col("bz"), F.col("cn")), 9)
    )
    cut = lambda x, n: F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array())
    pieces = lambda x: F.concat(*[cut(F.col(x), n) for n in PIECES])
    head = lambda x: F.coalesce(*[F.when(F.length(x) >= n, F.substring(x, 1, n)) for n in reversed(PIECES)])
    by_name = lambda ours, short, long: ours.withColumn("_p", short).join(a.withColumn("_p", F.explode(pieces(long))), "_p")
    by_asset = lambda ours, long, short: ours.withColumn("_p", F.explode(pieces(long))).join(a.withColumn("_p", head(short)), "_p")
    keyed = rest.filter("length(cn) >= 3")
    near = by_name(rest, head("c"), "b").unionByName(by_asset(rest, "c", "b"))
    near = near.unionByName(by_name(keyed, F.explode(F.array_distinct(F.array(head("cn"), head("cz")))), "bn")).unionByName(by_asset(keyed, "cn", "bn"))
    near = near.withColumn("tier", tier).filter("tier IS NOT NULL").select(key, "tier", "ord", "asset")
    few = a.withColumn("_p", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), cut(F.col("b"), 1), cut(F.col("b"), 2)))))
    few = few.withColumn("tier", F.when(F.col("b").startswith(F.col("_p")), 3).otherwise(4)).groupBy("_p").agg(best)
    short = rest.filter("length(c) < 3").join(few, F.col("c") == F.col("_p")).select(key, "best.tier", "best.ord", "best.asset")
    near = near.unionByName(short).groupBy(key).agg(best)
    return p.select(key).join(exact.unionByName(near).select(key, "best.asset", "best.tier"), key, "left")


def infer_section(products: DataFrame, labels: DataFrame, key: str, tokens: str, label: str, label_tokens: str, order: str, least: float = 0.25) -> DataFrame:
    """key, label, score: the label whose tokens overlap most, the first on ties; null under `least`.

    Overlap: distinct tokens of the name that equal, start or continue a token of the label, over the smaller number of distinct tokens of
    both. Distinct tokens of names meet those of labels once, by their first 3 letters (shorter tokens don't count); names then find
    labels through their own tokens and count, so no arrays of tokens are moved or compared.
    """
    p = products.select(key, F.array_distinct(tokens).alias("_a"))
    q = labels.select(F.col(label).alias("label"), F.array_distinct(label_tokens).alias("_b"), F.col(order).alias("_o"))
    words = q.select("_o", F.explode("_b").alias("_u"))
    named = p.select(key, F.size("_a").alias("_n"), F.explode("_a").alias("_t"))
    start = lambda c: F.substring(c, 1, 3).alias("_s")
    pairs = named.select("_t").distinct().select("_t", start("_t")).join(words.select("_u").distinct().select("_u", start("_u")), "_s")
    pairs = pairs.filter(F.col("_t").startswith(F.col("_u")) | F.col("_u").startswith(F.col("_t"))).select("_t", "_u")
    found = pairs.join(words, "_u").select("_t", "_o").distinct()
    met = named.join(found, "_t").groupBy(key, "_n", "_o").agg(F.count(F.lit(1)).alias("_c"))
    scored = met.join(q.select("_o", "label", F.size("_b").alias("_m")), "_o").withColumn("score", F.col("_c") / F.least("_n", "_m")).filter(F.col("score") >= least)
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "_o", "label")).alias("_best")).select(key, F.col("_best.label").alias("label"), (-F.col("_best.s")).alias("score"))
    return p.select(key).join(best, key, "left")
