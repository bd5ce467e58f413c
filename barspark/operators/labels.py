"""Labels, features, splits, correlations and model scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import prefix_totals
from ..functions.windows import ROW, in_blocks, mean, numbered, ordered
from . import indicators as ind

FEATURES = ("rsi_14", "macd_hist", "bb_pct", "ema_slope", "atr_pct", "ret_1", "ret_3", "ret_5", "ret_10", "vol_10", "vol_20")


def feature_frame(bars: DataFrame) -> DataFrame:
    """The model's columns per bar, null while a window fills and where a value isn't finite. Bars are numbered once; recursive means and windows run over the same blocks."""
    x = ind.ewm(numbered(bars), [("ema12", "close", ind.span(12)), ("ema26", "close", ind.span(26)), ("ema50", "close", ind.span(50))]).drop("n")
    x = ind.ewm(x.withColumn("macd", F.col("ema12") - F.col("ema26")), [("macd_signal", "macd", ind.span(9))]).drop("n")

    def windows(b: DataFrame) -> DataFrame:
        b = ind.with_returns(ind.with_atr(ind.with_rsi(b, name="rsi_14")))
        bb = ind.bollinger()
        return b.withColumns({"bb_pct": ind.percent_b(bb["bb_lower"], bb["bb_upper"]), "ema_slope": F.try_divide(F.col("ema50") - F.lag("ema50").over(ordered()), F.col("ema50")), **{f"ret_{k}": ind.roc(k) for k in (1, 3, 5, 10)}, **{f"vol_{k}": ind.volatility(k) for k in (10, 20)}})

    x = in_blocks(x, windows, 21).withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "atr_pct": F.try_divide("atr", "close")})
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return x.select("symbol", "ts", "close", *[finite(f).alias(f) for f in FEATURES])


def triple_barrier(bars: DataFrame, up: float = 1.0, down: float = 1.0, limit: int = 20) -> DataFrame:
    """1 if the close first reaches ``up`` ranges above, -1 if it first reaches ``down`` below or both at once, null if neither within
    ``limit`` bars; 0 for a close that isn't positive. A symbol's last bar has no label and is left out. Needs ``atr``."""
    w = ordered()
    x = bars.withColumns({"__next": F.collect_list("close").over(w.rowsBetween(1, limit)), "__end": F.lead("ts").over(w)}).where("__end is not null")
    hit = F.filter("__next", lambda c: (c >= F.col("close") + up * F.col("atr")) | (c <= F.col("close") - down * F.col("atr")))
    first = F.try_element_at(hit, F.lit(1))
    label = F.when(F.col("close") <= 0, 0.0).when(first <= F.col("close") - down * F.col("atr"), -1.0).when(first.isNotNull(), 1.0)
    return x.withColumn("label", label).drop("__next", "__end")


def next_direction(bars: DataFrame) -> DataFrame:
    w = ordered()
    return bars.withColumn("__next", F.lead("close").over(w)).where("__next is not null").withColumn("label", (F.col("__next") > F.col("close")).cast("int")).drop("__next")


def label_distribution(labels: DataFrame, *keys: str) -> DataFrame:
    y = F.col("label")
    x = labels.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(y == 1).alias("ups"), F.count_if(y == -1).alias("downs"), F.count_if(y.isNull()).alias("open"))
    return x.withColumns({"up_share": F.round(F.try_divide("ups", "rows"), 4), "asymmetry": F.round(F.try_divide(F.col("ups") - F.col("downs"), F.col("ups") + F.col("downs")), 4)})


def correlations(df: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    """Pearson's correlation of every pair of columns over the complete rows: one aggregate, then rows; ``collinear`` beyond the threshold."""
    pairs = list(combinations(columns, 2))
    one = df.dropna(subset=columns).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 4).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
    return rows.withColumn("collinear", F.coalesce(F.abs("corr") > threshold, F.lit(False)))


def lookahead(df: DataFrame, features: list[str], target: str, horizon: int = 5, threshold: float = 0.1) -> DataFrame:
    """Correlation of each feature with the target k bars later; flagged beyond ``threshold``."""
    x = in_blocks(df, lambda b: b.withColumns({f"__y{k}": F.lead(target, k).over(ordered()) for k in range(1, horizon + 1)}), 0, horizon)
    one = x.agg(*[F.when(F.count(F.when(F.col(f).isNotNull() & F.col(f"__y{k}").isNotNull(), 1)) >= 3, F.corr(f, f"__y{k}")).alias(f"{f}__{k}") for f in features for k in range(1, horizon + 1)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("k"), F.round(f"{f}__{k}", 4).alias("corr")) for f in features for k in range(1, horizon + 1)])).alias("r")).select("r.*")
    return rows.withColumn("flagged", F.coalesce(F.abs("corr") > threshold, F.lit(False)))


def _rows(df: DataFrame, **more: Column) -> DataFrame:
    """``row`` (from 0) and ``rows`` of each symbol, and further figures over its numbered rows."""
    x = numbered(df)
    n = x.groupBy(F.struct("symbol").alias("__s")).agg((F.max(ROW) + 1).alias("rows"), *[c.alias(k) for k, c in more.items()])
    return x.withColumn("__s", F.struct("symbol")).join(n, "__s").withColumnRenamed(ROW, "row").drop("__s")


def walk_forward(df: DataFrame, train: int, step: int) -> DataFrame:
    """Rows with every fold they belong to: fold f trains on rows ``[f step, f step + train)`` and tests on the ``step`` after."""
    x = _rows(df)
    last = F.floor((F.col("rows") - train - step) / step)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("row") - train - step + 1) / step)), F.least(last, F.floor(F.col("row") / step))
    x = x.withColumn("fold", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))
    return x.withColumn("role", F.when(F.col("row") - F.col("fold") * step < train, "train").otherwise("test")).drop("rows")


def purged_folds(df: DataFrame, k: int = 5, embargo: int = 5) -> DataFrame:
    """Rows by fold: test, or train but for ``embargo`` rows on each side of the test rows."""
    x = _rows(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("rows") / k)
    lo, hi = F.col("fold") * size, F.when(F.col("fold") == k - 1, F.col("rows")).otherwise((F.col("fold") + 1) * size)
    role = F.when((F.col("row") >= lo) & (F.col("row") < hi), "test").when((F.col("row") >= lo - embargo) & (F.col("row") < hi + embargo), "embargo").otherwise("train")
    return x.withColumn("role", role).drop("rows")


def purged_splits(df: DataFrame, k: int = 5, test_size: int | None = None, train_size: int | None = None, embargo_share: float = 0.05, gap: int = 0) -> DataFrame:
    """Rows by fold: ``k`` test blocks spread over a symbol's rows; of the rest the first ``train_size`` (all if null) train, but for those that follow the test rows
    within the embargo (``embargo_share`` of the test rows, 1 at least) and ``gap`` more. Rows that neither train nor test are ``embargo`` or ``unused``."""
    x = _rows(df)
    size = F.lit(test_size) if test_size else F.greatest(F.lit(1), F.floor(F.col("rows") / (k + 1)))
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = F.col("fold") * F.floor(F.col("rows") / k)
    hi = F.least(lo + size, F.col("rows"))
    x = x.withColumns({"__lo": lo, "__hi": hi, "__rest": F.greatest(F.lit(1), F.floor(size * embargo_share)) + gap})
    place = F.when(F.col("row") < F.col("__lo"), F.col("row")).otherwise(F.col("row") - (F.col("__hi") - F.col("__lo")))
    role = F.when((F.col("row") >= F.col("__lo")) & (F.col("row") < F.col("__hi")), "test")
    if train_size is not None:
        role = role.when(place >= train_size, "unused")
    role = role.when((F.col("row") >= F.col("__hi")) & (F.col("row") < F.col("__hi") + F.col("__rest")), "embargo").otherwise("train")
    return x.withColumn("role", role).drop("rows", "__lo", "__hi", "__rest")


def split_by_date(df: DataFrame, cutoff, embargo: int = 5) -> DataFrame:
    """Train before the cutoff, test from it on, with ``embargo`` bars dropped on each side."""
    x = _rows(df, cut=F.min(F.when(F.col("ts") >= cutoff, F.col(ROW))) + 1).withColumn("row", (F.col("row") + 1).cast("int")).drop("rows")
    d = F.col("row") - F.coalesce("cut", F.lit(1 << 40))
    return x.withColumn("role", F.when(d < -embargo, "train").when(d >= embargo, "test").otherwise("embargo")).drop("cut")


def classification(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the usual shares of them, from labels ``y`` and probabilities ``p``."""
    y, g = F.col("y") == 1, F.col("p") >= threshold
    c = df.agg(F.count_if(y & g).alias("tp"), F.count_if(~y & g).alias("fp"), F.count_if(~y & ~g).alias("tn"), F.count_if(y & ~g).alias("fn"), F.avg("p").alias("mean_p"), F.avg(y.cast("double")).alias("positive_rate"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"accuracy": div(tp + tn, tp + fp + tn + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn)})
    return c.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(df: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve, ties averaged, and average precision, of all rows or for each of ``keys`` (a model, a fold).

    Distinct scores are counted first, then totalled by ranges of scores: no task orders all of them. Null scores are left out; without both classes there is no area."""
    s = df.where("p is not null").groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    s = prefix_totals(s, ["p"], {"pos": F.col("pos"), "neg": F.col("neg")}, *keys)
    tp, fp = F.col("pos_all") - F.col("pos_before"), F.col("neg_all") - F.col("neg_before")  # at this score or above
    P, N = F.sum("pos"), F.sum("neg")
    area = F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), P * N)
    return s.groupBy(*keys).agg(area.alias("auc"), F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), P).alias("average_precision"))


def importance(df: DataFrame, features: list[str]) -> DataFrame:
    """Distance of each feature's means over the two labels."""
    one = df.agg(*[F.abs(F.avg(F.when(F.col("label") == 1, F.col(f))) - F.avg(F.when(F.col("label") == 0, F.col(f)))).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("gap")) for f in features])).alias("r")).select("r.*")


def regression_scores(df: DataFrame, y: str, guess: str) -> DataFrame:
    """Errors, r squared and the share of moves whose direction the guess has, per symbol."""
    a, b = F.col(y), F.col(guess)
    x = in_blocks(df, lambda x: x.withColumns({"__dy": a - F.lag(a).over(ordered()), "__dg": b - F.lag(b).over(ordered())}), 1)
    moved = F.col("__dy") != 0
    return x.groupBy("symbol").agg(F.avg(F.pow(a - b, 2)).alias("mse"), F.avg(F.abs(a - b)).alias("mae"), F.avg(F.when(moved, (F.signum("__dy") == F.signum("__dg")).cast("double"))).alias("direction"), (1 - F.try_divide(F.sum(F.pow(a - b, 2)), F.var_pop(a) * F.count(a))).alias("r2"))


def label_shift(df: DataFrame, least: float = 0.7) -> DataFrame:
    """Shares of label 1 in the labelled rows of ``role`` train and test, how alike they are (1 less their difference), and whether that is too little."""
    share = lambda r: F.round(F.coalesce(F.try_divide(F.count_if((F.col("role") == r) & (F.col("label") == 1)), F.count_if((F.col("role") == r) & F.col("label").isNotNull())), F.lit(0.0)), 4)
    x = df.agg(share("train").alias("train_share"), share("test").alias("test_share")).withColumn("stability", F.round(1 - F.abs(F.col("train_share") - F.col("test_share")), 4))
    return x.withColumn("shifted", F.col("stability") < least)


def with_ranks(df: DataFrame, column: str, name: str, parts: int = 200) -> DataFrame:
    """Average ranks of a column's values, nulls without one. Distinct values are counted, then ordered within ranges cut at percentiles, so no task sorts all."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = v.agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 10_000).alias("__cuts"))  # one row of bounded size
    v = v.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter(F.col("__cuts"), lambda c: c < F.col("__v")))).drop("__cuts")
    totals = v.groupBy("__part").agg(F.sum("__n").alias("__t"))
    base = totals.select("__part", F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # ``parts`` rows
    w = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    r = v.withColumn("__upto", F.sum("__n").over(w)).join(F.broadcast(base), "__part").select("__v", (F.col("__base") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(r, F.col(column) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, features: list[str]) -> DataFrame:
    """Rank correlations of all pairs of features, over rows that have both."""
    for f in features:
        df = with_ranks(df, f, f"__r_{f}")
    pairs = list(combinations(features, 2))
    one = df.agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 4).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def collinear_groups(pairs: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """Features in groups linked by correlations beyond the threshold; of a group the one with the lowest mean is kept (ties: the first listed).
    ``pairs`` (``a, b, corr``) has one row a pair of the given features, so groups are found among those few names."""
    both = pairs.select("a", "b", F.abs("corr").alias("c")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.abs("corr").alias("c")))
    place = {f: i for i, f in enumerate(features)}
    group = dict(place)
    links = [(r.a, r.b) for r in both.where(F.col("c") > threshold).select("a", "b").collect()]  # at most the square of the features' number
    while moved := [(a, group[b]) for a, b in links if group[b] < group[a]]:
        group.update((a, g) for a, g in moved if g < group[a])
    g = pairs.sparkSession.createDataFrame([(f, place[f], group[f]) for f in features], "feature string, place int, grp int")
    other = g.select(F.col("feature").alias("b"), F.col("grp").alias("grp_b"))
    mean = both.join(g, both.a == g.feature).join(other, "b").where("grp = grp_b").groupBy("feature", "place", "grp").agg(F.avg("c").alias("mean"))
    return mean.withColumn("kept", F.row_number().over(Window.partitionBy("grp").orderBy(F.round("mean", 9), "place")) == 1).select("feature", F.col("grp").alias("group"), "mean", "kept")
