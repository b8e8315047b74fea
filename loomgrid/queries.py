"""Registered queries of the modelling and data-preparation operators, with their SQL.

Doubles are rounded on both sides, since sums are taken in another order.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import metrics
from loomgrid.functions.decay import with_decay
from loomgrid.operators import density, feature_selection, features, grouped, linear, meta, outliers, projections, select
from loomgrid.plans.model_selection import ClusterFoldValidation, GroupTimeSeriesSplit, TimeGapSplit
from loomgrid.plans.pipeline import log_step, log_step_extra, make_debug_pipeline
from loomgrid.sources.datasets import make_simpleseries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


OJC = "orders JOIN customer ON o_custkey = c_custkey"

# ---------------------------------------------------------------- projections


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def column_selector(spark, sf_dir):
    return select.ColumnSelector(["o_orderkey", "o_orderstatus"]).fit_transform(read(spark, sf_dir, "orders"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def column_dropper(spark, sf_dir):
    return select.ColumnDropper("n_name").fit_transform(read(spark, sf_dir, "nation"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def type_selector(spark, sf_dir):
    return select.TypeSelector(include="number").fit_transform(read(spark, sf_dir, "supplier"))


@query("SELECT * FROM region")
def identity(spark, sf_dir):
    return select.IdentityTransformer(check_X=True).fit_transform(read(spark, sf_dir, "region"))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END AS BIGINT) AS o_orderpriority FROM orders")
def dict_mapper(spark, sf_dir):
    return select.DictMapper({"1-URGENT": 3, "2-HIGH": 2}, 0, ["o_orderpriority"]).fit_transform(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))


@query("""SELECT round(1.0::DOUBLE, 4) AS "Intercept", CAST(p_size AS DOUBLE) AS p_size, round(ln(p_retailprice), 4) AS "log(p_retailprice)", round(p_size * p_retailprice, 4) AS "p_size:p_retailprice" FROM part""")
def formula(spark, sf_dir):
    out = select.FormulaicTransformer("p_size + log(p_retailprice) + p_size:p_retailprice").fit_transform(read(spark, sf_dir, "part"))
    return out.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) for c in out.columns])


@query("""SELECT * FROM (SELECT event_id, user_id, value, lead(value, 1) OVER w AS value1, lag(value, 2) OVER w AS "value-2" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value1 IS NOT NULL AND "value-2" IS NOT NULL AND value IS NOT NULL""")
def add_lags(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return features.add_lags(events, "value", [1, -2], ["ts", "event_id"], "user_id").drop("ts")


@query("""SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo), 2) AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)""")
def column_capper(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(features.ColumnCapper("l_extendedprice").fit_transform(df), ["l_extendedprice"], 2)


@query("SELECT event_id, " + ", ".join(f"round(exp(-pow(least(abs(h - {k}/4.0::DOUBLE), 1 - abs(h - {k}/4.0::DOUBLE)) / 0.25, 2)), 6) AS hour_{k}" for k in range(4)) + " FROM (SELECT event_id, hour(ts) / 24.0::DOUBLE AS h FROM events)")
def repeating_basis(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("hour"))
    out = features.RepeatingBasisFunction("hour", "passthrough", 4, (0, 24)).fit_transform(df)
    return rounded(out, [f"hour_{k}" for k in range(4)], 6)


@query("""WITH k AS (SELECT min(p_size)::DOUBLE AS lo, (max(p_size) - min(p_size)) / 2.0::DOUBLE AS h FROM part), u AS (SELECT p_partkey, (p_size - lo) / h AS u FROM part, k)
SELECT p_partkey, """ + ", ".join(f"round((pow(greatest(u - {1 - k}, 0), 3) - 3 * pow(greatest(u - {2 - k}, 0), 3) + 3 * pow(greatest(u - {3 - k}, 0), 3) - pow(greatest(u - {4 - k}, 0), 3)) / 6, 6) AS p_size_{k}" for k in range(5)) + " FROM u")
def monotonic_spline(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return rounded(features.MonotonicSplineTransformer("p_size").fit_transform(df), [f"p_size_{k}" for k in range(5)], 6)


ENCODER_SQL = """WITH q AS (SELECT DISTINCT k FROM (SELECT unnest(quantile_cont(l_quantity, [i / 9.0 FOR i IN range(10)]))::DOUBLE AS k FROM lineitem)),
w AS (SELECT k, l_extendedprice AS y, {} AS w FROM q, lineitem), h AS (SELECT k, sum(w * y) / sum(w) AS h FROM w GROUP BY 1),
p AS (SELECT k AS a, h AS u, lead(k) OVER o AS b, lead(h) OVER o AS v FROM h WINDOW o AS (ORDER BY k)), e AS (SELECT min(a) AS lo, max(a) AS hi, arg_min(u, a) AS first, arg_max(u, a) AS last FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= lo THEN first WHEN l_quantity > hi THEN last ELSE u + (l_quantity - a) * (v - u) / (b - a) END, 3) AS l_quantity
FROM lineitem, e LEFT JOIN p ON l_quantity > a AND l_quantity <= b"""


def encoded(spark, sf_dir, method):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(features.IntervalEncoder("l_quantity", "l_extendedprice", 10, 1, method).fit_transform(df).drop("l_extendedprice"), ["l_quantity"], 3)


@query(ENCODER_SQL.format("exp(-pow(l_quantity - k, 2))"))
def interval_encoder(spark, sf_dir):
    return encoded(spark, sf_dir, "normal")


@query(ENCODER_SQL.format("CASE WHEN l_quantity < k + 1 THEN 1 / (abs(l_quantity - k) + 0.01) ELSE 0 END"))
def interval_encoder_average(spark, sf_dir):
    return encoded(spark, sf_dir, "average")


@query("SELECT l_orderkey, l_linenumber, l_quantity, true AS rises FROM lineitem")
def interval_encoder_increasing(spark, sf_dir):
    """Monotone levels: no row of a lower quantity has a higher level."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_quantity").alias("level"), "l_extendedprice")
    levels = features.IntervalEncoder("level", "l_extendedprice", 10, 1, "increasing").fit_transform(df).drop("l_extendedprice")
    by = levels.groupBy("l_quantity").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    before = F.max("high").over(Window.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, -1))  # one row a quantity
    marked = by.select("l_quantity", (F.coalesce(before, F.col("low")) <= F.col("low")).alias("rises"))
    return levels.drop("level").join(F.broadcast(marked), "l_quantity")


def capped_at(spark, sf_dir, mode):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(features.ColumnCapper("o_totalprice", (10, 90), mode).fit_transform(df), ["o_totalprice"], 2)


CAPPER_SQL = """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () - 1 AS n FROM orders),
c AS (SELECT {} AS lo, {} AS hi FROM r) SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 2) AS o_totalprice FROM orders, c"""
AT = "max(CASE WHEN i = {0}({1} * n) THEN v END)"


@query(CAPPER_SQL.format(AT.format("floor", 0.1), AT.format("floor", 0.9)))
def column_capper_lower(spark, sf_dir):
    return capped_at(spark, sf_dir, "lower")


@query(CAPPER_SQL.format(AT.format("ceil", 0.1), AT.format("ceil", 0.9)))
def column_capper_higher(spark, sf_dir):
    return capped_at(spark, sf_dir, "higher")


@query(CAPPER_SQL.format(AT.format("round_even", "0 + 0.1").replace("round_even(0 + 0.1 * n)", "round_even(0.1 * n, 0)"), AT.format("round_even", 0.9).replace("round_even(0.9 * n)", "round_even(0.9 * n, 0)")))
def column_capper_nearest(spark, sf_dir):
    return capped_at(spark, sf_dir, "nearest")


@query(CAPPER_SQL.format(f"({AT.format('floor', 0.1)} + {AT.format('ceil', 0.1)}) / 2", f"({AT.format('floor', 0.9)} + {AT.format('ceil', 0.9)}) / 2"))
def column_capper_midpoint(spark, sf_dir):
    return capped_at(spark, sf_dir, "midpoint")


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity * (SELECT sum(l_discount * l_quantity) / sum(l_quantity * l_quantity) FROM lineitem), 6) AS projection FROM lineitem")
def vector_projection(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(projections.vector_projection(df, "l_discount", "l_quantity").drop("l_discount"), ["projection"], 6)


@query("""WITH s AS (SELECT sqrt(sum(l_quantity * l_quantity)) AS r11, sum(l_quantity * l_discount) / sqrt(sum(l_quantity * l_quantity)) AS r12, sum(l_discount * l_discount) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity / r11 * 1000, 4) AS l_quantity, round((l_discount - l_quantity / r11 * r12) / sqrt(d - r12 * r12) * 1000, 4) AS l_discount FROM lineitem, s""")
def orthogonal(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = projections.OrthogonalTransformer(["l_quantity", "l_discount"]).fit_transform(df)
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col(c) * 1000, 4).alias(c) for c in ("l_quantity", "l_discount")])


@query("""SELECT l_orderkey, l_linenumber, round(l_discount - l_quantity * (SELECT sum(l_quantity * l_discount) / sum(l_quantity * l_quantity) FROM lineitem), 6) AS l_discount FROM lineitem""")
def information_filter(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(projections.InformationFilter(["l_quantity", "l_discount"], ["l_quantity"]).fit_transform(df), ["l_discount"], 6)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * (SELECT sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 1) FROM lineitem), 2) AS l_quantity FROM lineitem""")
def linear_embedder(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(projections.LinearEmbedder("l_quantity", "l_extendedprice").fit_transform(df).drop("l_extendedprice"), ["l_quantity"], 2)


@query("""WITH d AS (SELECT l_quantity::DOUBLE AS a, (l_quantity + 100 * l_discount)::DOUBLE AS b, l_linenumber::DOUBLE AS c, (l_quantity + 5 * l_linenumber)::DOUBLE AS y FROM lineitem),
f AS (SELECT 'a' AS feature, pow(corr(a, y), 2) AS r FROM d UNION ALL SELECT 'b', pow(corr(b, y), 2) FROM d UNION ALL SELECT 'c', pow(corr(c, y), 2) FROM d),
g AS (SELECT feature, r / (1 - r) AS gain FROM f), one AS (SELECT arg_max(feature, gain) AS first FROM g),
p AS (SELECT 'ab' AS pair, abs(corr(a, b)) AS r FROM d UNION ALL SELECT 'ac', abs(corr(a, c)) FROM d UNION ALL SELECT 'bc', abs(corr(b, c)) FROM d),
two AS (SELECT arg_max(feature, gain / r) AS second FROM g, one JOIN p ON contains(pair, feature) AND contains(pair, first) WHERE feature <> first)
SELECT 0 AS place, first AS feature FROM one UNION ALL SELECT 1, second FROM two""")
def mrmr(spark, sf_dir):
    """The second pick is decided by redundancy: ``b`` says more of the label than ``c``, but almost what ``a`` says."""
    q, d, n = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_linenumber"))
    df = read(spark, sf_dir, "lineitem").select(q.alias("a"), (q + 100 * d).alias("b"), n.alias("c"), (q + 5 * n).alias("y"))
    model = feature_selection.MaximumRelevanceMinimumRedundancy(["a", "b", "c"], "y", 2).fit(df)
    return spark.range(2).select(F.col("id").cast("int").alias("place"), F.element_at(F.array(*map(F.lit, model.selected_features_)), F.col("id").cast("int") + 1).alias("feature"))


@query()
def random_adder(spark, sf_dir):
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return select.RandomAdder(1.0, 7, ["s_acctbal"]).fit_transform(df)


@query("""WITH m AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer), r AS (SELECT c_custkey, c_acctbal, regr_slope(c_acctbal, c_nationkey) OVER () AS b, regr_intercept(c_acctbal, c_nationkey) OVER () AS a, c_nationkey FROM customer)
SELECT c_custkey FROM r, (SELECT stddev_pop(c_acctbal - (a + b * c_nationkey)) AS sd FROM r) WHERE abs(c_acctbal - (a + b * c_nationkey)) <= 1.5 * sd""")
def outlier_remover(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    detector = meta.RegressionOutlierDetector(["c_nationkey", "c_acctbal"], "c_acctbal", lower=1.5, upper=1.5)
    return select.OutlierRemover(detector).fit_transform(df).select("c_custkey")


# ---------------------------------------------------------------- groups

LEVELS_SQL = f"""WITH b AS (SELECT * FROM {OJC}),
g0 AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM b),
g1 AS (SELECT c_mktsegment, avg(o_totalprice) AS m, count(*) AS n FROM b GROUP BY 1),
g2 AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM b GROUP BY 1, 2)
SELECT b.o_orderkey, round({{}}, 4) AS prediction FROM b JOIN g2 USING (c_mktsegment, o_orderpriority) JOIN g1 USING (c_mktsegment), g0"""


def shrunk(spark, sf_dir, shrinkage, **options):
    df = joined(spark, sf_dir)
    model = grouped.GroupedPredictor(grouped.MeanEstimator("o_totalprice"), ["c_mktsegment", "o_orderpriority"], shrinkage, **options).fit(df)
    return rounded(model.predict(df).select("o_orderkey", "prediction"), ["prediction"])


@query(LEVELS_SQL.format("(g0.m * g0.n + g1.m * g1.n + g2.m * g2.n) / (g0.n + g1.n + g2.n)"))
def grouped_mean_shrinkage(spark, sf_dir):
    return shrunk(spark, sf_dir, "relative")


@query(LEVELS_SQL.format("0.25 * g0.m + 0.25 * g1.m + 0.5 * g2.m"))
def shrinkage_constant(spark, sf_dir):
    return shrunk(spark, sf_dir, "constant", alpha=0.5)


@query(LEVELS_SQL.format("(g0.m + g1.m + g2.m) / 3"))
def shrinkage_equal(spark, sf_dir):
    return shrunk(spark, sf_dir, "equal")


@query(LEVELS_SQL.format("CASE WHEN g2.n >= 600 THEN g2.m WHEN g1.n >= 600 THEN g1.m ELSE g0.m END"))
def shrinkage_min_n_obs(spark, sf_dir):
    return shrunk(spark, sf_dir, "min_n_obs", min_n_obs=600)


@query("""WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, 2) AS prediction FROM lineitem JOIN s USING (l_returnflag)""")
def grouped_ols(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    model = grouped.GroupedRegressor(grouped.LinearEstimator("l_quantity", "l_extendedprice"), "l_returnflag").fit(df)
    return rounded(model.predict(df).select("l_orderkey", "l_linenumber", "l_quantity", "prediction"), ["prediction"], 2)


@query("""WITH s AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderstatus) AS k FROM s)
SELECT o_orderkey, r.o_orderstatus AS prediction FROM orders JOIN customer ON o_custkey = c_custkey JOIN r USING (c_mktsegment) WHERE k = 1""")
def grouped_classifier(spark, sf_dir):
    df = joined(spark, sf_dir)
    model = grouped.GroupedClassifier(grouped.FrequencyClassifier("o_orderstatus"), "c_mktsegment").fit(df)
    return model.predict(df).select("o_orderkey", "prediction")


SEEN = "c_mktsegment <> 'BUILDING' AND NOT (c_mktsegment = 'MACHINERY' AND o_orderpriority IN ('1-URGENT', '5-LOW'))"


@query(f"""WITH b AS (SELECT * FROM {OJC}), t AS (SELECT * FROM b WHERE {SEEN}),
g0 AS (SELECT avg(o_totalprice) AS m FROM t), g1 AS (SELECT c_mktsegment, avg(o_totalprice) AS m FROM t GROUP BY 1), g2 AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS m FROM t GROUP BY 1, 2)
SELECT o_orderkey, round(coalesce(g2.m, g1.m, g0.m), 4) AS prediction FROM b LEFT JOIN g1 USING (c_mktsegment) LEFT JOIN g2 USING (c_mktsegment, o_orderpriority), g0""")
def hierarchical_fallback(spark, sf_dir):
    """Trained without one segment and without two priorities of another: those rows fall back by two levels and by one."""
    df = joined(spark, sf_dir)
    model = grouped.HierarchicalRegressor(grouped.MeanEstimator("o_totalprice"), ["c_mktsegment", "o_orderpriority"]).fit(df.where(SEEN))
    return rounded(model.predict(df).select("o_orderkey", "prediction"), ["prediction"])


@query(f"""WITH b AS (SELECT * FROM {OJC}), t AS (SELECT * FROM b WHERE {SEEN}), g0 AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM t), g1 AS (SELECT c_mktsegment, avg(o_totalprice) AS m, count(*) AS n FROM t GROUP BY 1),
g2 AS (SELECT c_mktsegment, o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM t GROUP BY 1, 2)
SELECT o_orderkey, round((g0.m * g0.n + coalesce(g1.m * g1.n, 0) + coalesce(g2.m * g2.n, 0)) / (g0.n + coalesce(g1.n, 0) + coalesce(g2.n, 0)), 4) AS prediction FROM b LEFT JOIN g1 USING (c_mktsegment) LEFT JOIN g2 USING (c_mktsegment, o_orderpriority), g0""")
def hierarchical_shrinkage(spark, sf_dir):
    df = joined(spark, sf_dir)
    model = grouped.HierarchicalRegressor(grouped.MeanEstimator("o_totalprice"), ["c_mktsegment", "o_orderpriority"], "relative").fit(df.where(SEEN))
    return rounded(model.predict(df).select("o_orderkey", "prediction"), ["prediction"])


@query(f"""WITH b AS (SELECT * FROM {OJC}), t AS (SELECT * FROM b WHERE {SEEN}), g0 AS (SELECT avg((o_orderstatus = 'F')::INT) AS p FROM t), g1 AS (SELECT c_mktsegment, avg((o_orderstatus = 'F')::INT) AS p FROM t GROUP BY 1), g2 AS (SELECT c_mktsegment, o_orderpriority, avg((o_orderstatus = 'F')::INT) AS p FROM t GROUP BY 1, 2)
SELECT o_orderkey, round(CASE WHEN g2.p IS NOT NULL THEN (g0.p + g1.p + g2.p) / 3 WHEN g1.p IS NOT NULL THEN (g0.p + g1.p) / 2 ELSE g0.p END, 6) AS p_f FROM b LEFT JOIN g1 USING (c_mktsegment) LEFT JOIN g2 USING (c_mktsegment, o_orderpriority), g0""")
def hierarchical_classifier(spark, sf_dir):
    df = joined(spark, sf_dir)
    model = grouped.HierarchicalClassifier(grouped.FrequencyClassifier("o_orderstatus"), ["c_mktsegment", "o_orderpriority"], "equal").fit(df.where(SEEN))
    return model.predict(df).select("o_orderkey", F.round(F.element_at("probability", model.classes_.index("F") + 1), 6).alias("p_f"))


def scaled(spark, sf_dir, method):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(grouped.GroupedTransformer(grouped.GroupScaler("l_quantity", method), "l_returnflag").fit_transform(df), ["l_quantity"])


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 4) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def grouped_standard(spark, sf_dir):
    return scaled(spark, sf_dir, "standard")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w), 4) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def grouped_minmax(spark, sf_dir):
    return scaled(spark, sf_dir, "minmax")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - quantile_cont(l_quantity, 0.5) OVER w) / (quantile_cont(l_quantity, 0.75) OVER w - quantile_cont(l_quantity, 0.25) OVER w), 4) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def grouped_robust(spark, sf_dir):
    return scaled(spark, sf_dir, "robust")


@query("SELECT l_orderkey, l_linenumber, round(greatest(least(l_quantity, quantile_cont(l_quantity, 0.8) OVER w), quantile_cont(l_quantity, 0.2) OVER w), 4) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def grouped_transformer(spark, sf_dir):
    """Any transformer within groups: here each group's own caps."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(grouped.GroupedTransformer(features.ColumnCapper("l_quantity", (20, 80)), "l_returnflag").fit_transform(df), ["l_quantity"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(quantile_cont(l_quantity, 0.5) OVER (PARTITION BY l_returnflag), 4) AS prediction FROM lineitem")
def grouped_median(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    model = grouped.GroupedRegressor(grouped.QuantileEstimator("l_quantity"), "l_returnflag").fit(df)
    return rounded(model.predict(df).select("l_orderkey", "l_linenumber", "l_quantity", "prediction"), ["prediction"])


@query("""WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_custkey, round(m, 4) AS prediction FROM customer JOIN s USING (c_mktsegment)""")
def grouped_pandas(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    inner = grouped.PandasEstimator("c_nationkey", "c_acctbal", lambda f: float(f["c_acctbal"].mean()), lambda m, f: [m] * len(f))
    return rounded(grouped.GroupedRegressor(inner, "c_mktsegment").fit(df).predict(df).select("c_custkey", "prediction"), ["prediction"])


@query("""WITH t AS (SELECT * FROM lineitem), s AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) + 1e-9 AS v FROM t GROUP BY 1), q AS (SELECT DISTINCT l_quantity FROM t),
l AS (SELECT l_quantity, f, n * exp(-0.5 * (ln(v) + pow(l_quantity - m, 2) / v)) AS e FROM q, s) SELECT l_quantity, round(max(CASE WHEN f = 'A' THEN e END) / sum(e), 6) AS p FROM l GROUP BY 1""")
def grouped_gaussian(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", F.lit("all").alias("g"))
    out = grouped.GroupedClassifier(grouped.GaussianClassifier("l_quantity", "l_returnflag"), "g").fit(df).predict(df.select("l_quantity", "g").distinct())
    return out.select("l_quantity", F.round(F.element_at("probability", 1), 6).alias("p"))


# ---------------------------------------------------------------- decay


def decayed(spark, sf_dir, decay, **options):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = with_decay(df, ["o_orderdate", "o_orderkey"], decay, "weight", "o_custkey", **options)
    return rounded(out.drop("o_orderdate"), ["weight"], 6)


DECAY_SQL = "SELECT o_orderkey, o_custkey, round({}, 6) AS weight FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(DECAY_SQL.format("(i + 1) / n::DOUBLE"))
def decay_linear(spark, sf_dir):
    return decayed(spark, sf_dir, "linear")


@query(DECAY_SQL.format("pow(0.9::DOUBLE, n - i)"))
def decay_exponential(spark, sf_dir):
    return decayed(spark, sf_dir, "exponential", decay_rate=0.9)


@query(DECAY_SQL.format("1 - floor((n - i) / greatest(floor(n / 2::DOUBLE), 1)) / 2"))
def decay_stepwise(spark, sf_dir):
    return decayed(spark, sf_dir, "stepwise", n_steps=2)


@query(DECAY_SQL.format("1 / (1 + exp(-(10.0::DOUBLE / n) * (i - floor(n / 2::DOUBLE))))"))
def decay_sigmoid(spark, sf_dir):
    return decayed(spark, sf_dir, "sigmoid")


@query("""WITH r AS (SELECT regr_slope(c_acctbal, c_nationkey) AS b, regr_intercept(c_acctbal, c_nationkey) AS a FROM customer) SELECT c_custkey, round(a + b * c_nationkey, 4) AS feature FROM customer, r""")
def estimator_transformer(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = meta.EstimatorTransformer(linear.LinearRegression("c_nationkey", "c_acctbal")).fit_transform(df)
    return rounded(out.select("c_custkey", "feature"), ["feature"])


@query("""WITH r AS (SELECT c_acctbal AS y, c_nationkey::DOUBLE AS x, pow(0.99::DOUBLE, count(*) OVER () - (row_number() OVER (ORDER BY c_custkey) - 1)) AS w FROM customer),
s AS (SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM r), k AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sx / n AS mx, sy / n AS my FROM s)
SELECT c_custkey, round(my + b * (c_nationkey - mx), 4) AS prediction FROM customer, k""")
def decay_estimator(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    model = meta.DecayEstimator(linear.LinearRegression(["c_nationkey"], "c_acctbal"), "c_custkey", decay_rate=0.99).fit(df)
    return rounded(model.predict(df).select("c_custkey", "prediction"), ["prediction"])


# ---------------------------------------------------------------- metrics


def flags(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("long"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.groupBy("doc_id").agg(F.max("long").alias("long")).join(labels, "doc_id")


FLAGS_SQL = "WITH f AS (SELECT * FROM (SELECT doc_id, max(CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END) AS long FROM documents GROUP BY 1) JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)) "


@query(FLAGS_SQL + "SELECT round(least(p1 / p0, p0 / p1), 6) AS score FROM (SELECT avg(CASE WHEN long = 0 THEN quality END) AS p0, avg(CASE WHEN long = 1 THEN quality END) AS p1 FROM f)")
def p_percent(spark, sf_dir):
    return rounded(metrics.p_percent_score(flags(spark, sf_dir), "long", 1, "quality"), ["score"], 6)


@query(FLAGS_SQL + "SELECT round(least(p1 / p0, p0 / p1), 6) AS score FROM (SELECT avg(CASE WHEN long = 0 THEN quality END) AS p0, avg(CASE WHEN long = 1 THEN quality END) AS p1 FROM f WHERE toxic = 0)")
def equal_opportunity(spark, sf_dir):
    return rounded(metrics.equal_opportunity_score(flags(spark, sf_dir).withColumn("toxic", 1 - F.col("toxic")), "long", "toxic", 1, "quality"), ["score"], 6)


@query(FLAGS_SQL + "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score FROM f WHERE long = 1")
def subset_score(spark, sf_dir):
    return rounded(metrics.subset_score(flags(spark, sf_dir), F.col("long") == 1, metrics.accuracy, label="toxic", prediction="quality"), ["score"], 6)


@query("SELECT round(-abs(corr(l_extendedprice, l_quantity)), 6) AS score FROM lineitem")
def correlation(spark, sf_dir):
    return rounded(metrics.correlation_score(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), ["score"], 6)


@query(FLAGS_SQL + "SELECT quality, toxic, count(*) AS n FROM f GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(flags(spark, sf_dir), "quality", "toxic")


# ---------------------------------------------------------------- models


class ByGroup(linear.Classifier):
    """Label shares by the value of one column, as a classifier for the meta operators."""

    def _fit(self, df):
        self.learn_classes(df)
        self.inner_ = grouped.GroupedClassifier(grouped.FrequencyClassifier(self.label), self.features, probability=self.probability).fit(df)

    def predict_proba(self, df):
        return self.inner_.predict_proba(df)


SHARES_SQL = FLAGS_SQL + ", p AS (SELECT long, avg(quality::DOUBLE) AS p1 FROM f GROUP BY 1), q AS (SELECT f.*, p1, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS pred FROM f JOIN p USING (long)) "


@query(SHARES_SQL + "SELECT doc_id, CASE WHEN p1 > 0.75 THEN 1 ELSE 0 END AS prediction FROM q")
def thresholder(spark, sf_dir):
    df = flags(spark, sf_dir)
    return meta.Thresholder(ByGroup(["long"], "quality"), 0.75).fit(df).predict(df).select("doc_id", "prediction")


@query(SHARES_SQL + ", c AS (SELECT pred, avg(quality::DOUBLE) AS t1 FROM q GROUP BY 1), k AS (SELECT coalesce(max(CASE WHEN pred = 0 THEN t1 END), 0) AS a, coalesce(max(CASE WHEN pred = 1 THEN t1 END), 1) AS b FROM c) SELECT doc_id, round(0.5 * p1 + 0.5 * ((1 - p1) * a + p1 * b), 6) AS p FROM q, k")
def confusion_balancer(spark, sf_dir):
    df = flags(spark, sf_dir)
    out = meta.ConfusionBalancer(ByGroup(["long"], "quality"), 0.5).fit(df).predict_proba(df)
    return out.select("doc_id", F.round(F.element_at("probability", 2), 6).alias("p"))


@query(SHARES_SQL + "SELECT doc_id, round(p1 * 0.2 / (p1 * 0.2 + (1 - p1) * 0.8), 6) AS p FROM q")
def subjective(spark, sf_dir):
    df = flags(spark, sf_dir)
    out = meta.SubjectiveClassifier(ByGroup(["long"], "quality"), {0: 0.8, 1: 0.2}, "predict_proba").fit(df).predict_proba(df)
    return out.select("doc_id", F.round(F.element_at("probability", 2), 6).alias("p"))


BAYES_SQL = SHARES_SQL + """, c AS (SELECT quality AS k, pred, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2), l AS (SELECT k, pred, n / sum(n) OVER (PARTITION BY k) AS l FROM c),
j AS (SELECT pred, coalesce(max(CASE WHEN k = 0 THEN l END), 0) * 0.8 AS a, coalesce(max(CASE WHEN k = 1 THEN l END), 0) * 0.2 AS b FROM l GROUP BY 1) SELECT doc_id, round({}, 6) AS p FROM q JOIN j USING (pred)"""


def with_evidence(spark, sf_dir, evidence):
    df = flags(spark, sf_dir)
    out = meta.SubjectiveClassifier(ByGroup(["long"], "quality"), {0: 0.8, 1: 0.2}, evidence).fit(df).predict_proba(df)
    return out.select("doc_id", F.round(F.element_at("probability", 2), 6).alias("p"))


@query(BAYES_SQL.format("p1 * b / (p1 * b + (1 - p1) * a)"))
def subjective_both(spark, sf_dir):
    return with_evidence(spark, sf_dir, "both")


@query(BAYES_SQL.format("b / (a + b)"))
def subjective_confusion(spark, sf_dir):
    return with_evidence(spark, sf_dir, "confusion_matrix")


@query()
def ordinal(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("band", F.least(F.floor(F.col("l_extendedprice") / 20000), F.lit(2)).cast("int"))
    model = meta.OrdinalClassifier(linear.LogisticClassifier(["l_quantity", "l_discount"], "band")).fit(df)
    return model.predict(df).groupBy("band", "prediction").count()


@query("""WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT *, l_extendedprice - (a + b * l_quantity) AS gap FROM lineitem, r), s AS (SELECT stddev_pop(gap) AS sd FROM e)
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN abs(gap) > 2 * sd THEN -1 ELSE 1 END AS prediction FROM e, s""")
def regression_outlier(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return meta.RegressionOutlierDetector(["l_quantity", "l_extendedprice"], "l_extendedprice").fit(df).predict(df).drop("l_quantity")


@query("""WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT *, l_extendedprice - (a + b * l_quantity) AS gap FROM lineitem, r), s AS (SELECT stddev_pop(gap) AS sd FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(gap) > 2 * sd THEN 1 ELSE 0 END AS prediction FROM e, s""")
def outlier_classifier(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.when(F.col("l_extendedprice") > 90000, 1).otherwise(0).alias("y"))
    detector = meta.RegressionOutlierDetector(["l_quantity", "l_extendedprice"], "l_extendedprice")
    return meta.OutlierClassifier(detector, "y").fit(df).predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("""WITH g AS (SELECT l_returnflag, avg(CASE WHEN l_tax <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE * avg(CASE WHEN l_tax <> 0 THEN l_tax END) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(p, 6) AS prediction FROM lineitem JOIN g USING (l_returnflag)""")
def zero_inflated_rate(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")

    class Means(linear.Regressor):
        def _fit(self, df):
            self.inner_ = grouped.GroupedRegressor(grouped.MeanEstimator(self.label), self.features, prediction=self.prediction).fit(df)

        def predict(self, df):
            return self.inner_.predict(df)

    class Shares(ByGroup):
        def _fit(self, df):
            self.learn_classes(df)
            self.inner_ = grouped.GroupedClassifier(grouped.FrequencyClassifier(self.label), self.features, probability=self.probability, prediction=self.prediction).fit(df)

    model = meta.ZeroInflatedRegressor(Shares(["l_returnflag"], "nonzero"), Means(["l_returnflag"], "l_tax")).fit(df)
    return rounded(model.score_samples(df).select("l_orderkey", "l_linenumber", "prediction"), ["prediction"], 6)


@query("""WITH q AS (SELECT DISTINCT n_nationkey AS x FROM nation) SELECT x::DOUBLE AS x, round(sum(exp(-pow(x - s_nationkey, 2) / 4.0::DOUBLE) * s_acctbal) / sum(exp(-pow(x - s_nationkey, 2) / 4.0::DOUBLE)), 4) AS prediction FROM q, supplier GROUP BY 1""")
def lowess(spark, sf_dir):
    train = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), "s_acctbal")
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("x"))
    return rounded(linear.LowessRegression("x", "s_acctbal", sigma=4.0).fit(train).predict(asked), ["prediction"])


@query("""WITH q AS (SELECT DISTINCT n_nationkey AS x FROM nation), k AS (SELECT x, sum(CASE WHEN s_acctbal > 5000 THEN exp(-0.5 * pow(x - s_nationkey, 2) / 4) ELSE 0 END) AS a, sum(exp(-0.5 * pow(x - s_nationkey, 2) / 4)) AS b FROM q, supplier GROUP BY 1)
SELECT x::DOUBLE AS x, round(a / b, 6) AS p FROM k""")
def kde_classifier(spark, sf_dir):
    train = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("y"))
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("x"))
    out = density.BayesianKernelDensityClassifier("x", "y", 2.0).fit(train).predict_proba(asked)
    return out.select("x", F.round(F.element_at("probability", 2), 6).alias("p"))


@query("""WITH s AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, var_pop(l_quantity) + 1e-6 AS v, avg(l_discount) AS m2, var_pop(l_discount) + 1e-6 AS v2 FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem),
l AS (SELECT l_quantity, l_discount, f, exp(-0.5 * (ln(v) + pow(l_quantity - m, 2) / v + ln(v2) + pow(l_discount - m2, 2) / v2)) AS e FROM d, s)
SELECT l_quantity, l_discount, round(max(CASE WHEN f = 'A' THEN e END) / sum(e), 6) AS p FROM l GROUP BY 1, 2""")
def gaussian_nb(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag")
    model = density.GaussianMixtureNB(["l_quantity", "l_discount"], "l_returnflag").fit(df)
    out = model.predict_proba(df.select("l_quantity", "l_discount").distinct())
    return out.select("l_quantity", "l_discount", F.round(F.element_at("probability", 1), 6).alias("p"))


@query("""WITH s AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, var_pop(l_quantity) + 1e-6 AS v FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT l_quantity FROM lineitem),
l AS (SELECT l_quantity, f, exp(-0.5 * (ln(v) + pow(l_quantity - m, 2) / v)) AS e FROM d, s) SELECT l_quantity, round(max(CASE WHEN f = 'A' THEN e END) / sum(e), 6) AS p FROM l GROUP BY 1""")
def gmm_classifier(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    out = density.GMMClassifier(["l_quantity"], "l_returnflag").fit(df).predict_proba(df.select("l_quantity").distinct())
    return out.select("l_quantity", F.round(F.element_at("probability", 1), 6).alias("p"))


@query()
def bayesian_gmm_classifier(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return density.BayesianGMMClassifier(["l_quantity", "l_extendedprice"], "l_returnflag", n_components=2).fit(df).predict(df).groupBy("prediction").count()


@query()
def bayesian_gmm_nb(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return density.BayesianGaussianMixtureNB(["l_quantity", "l_extendedprice"], "l_returnflag").fit(df).predict(df).groupBy("prediction").count()


@query("""WITH s AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) + 1e-6 AS v FROM customer), l AS (SELECT c_custkey, -0.5 * (ln(2 * pi()) + ln(v) + pow(c_acctbal - m, 2) / v) AS l FROM customer, s)
SELECT c_custkey, CASE WHEN l >= (SELECT quantile_cont(l, 0.05) FROM l) - 1e-12 THEN 1 ELSE -1 END AS prediction FROM l""")
def gmm_outlier(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return density.GMMOutlierDetector("c_acctbal", 0.95).fit(df).predict(df).drop("c_acctbal")


@query()
def bayesian_gmm_outlier(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return density.BayesianGMMOutlierDetector("c_acctbal", 2.0, "stddev").fit(df).predict(df)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle FROM d),
r AS (SELECT *, (x - mx) * sin(angle) - (y - my) * cos(angle) AS gap FROM d, m)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(gap * sin(angle)) + abs(gap * cos(angle)) > 10 THEN -1 ELSE 1 END AS prediction FROM r""")
def pca_outlier(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return outliers.PCAOutlierDetection(["x", "y"], 1, 10.0, "absolute").fit(df).predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("""WITH d AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_extendedprice / l_quantity AS ratio FROM lineitem), t AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy FROM d),
c AS (SELECT ratio, (xy + 2 * sum(x * y) OVER w) / (xx + 2 * sum(x * x) OVER w) AS b FROM d, t WINDOW w AS (ORDER BY ratio RANGE UNBOUNDED PRECEDING)), n AS (SELECT ratio, b, lead(ratio) OVER (ORDER BY ratio) AS next FROM (SELECT DISTINCT ratio, b FROM c))
SELECT round(b, 4) AS slope FROM n WHERE ratio <= b AND (next > b OR next IS NULL)""")
def imbalanced_regression(spark, sf_dir):
    """Overestimates count three times: those rows whose price for each unit is below the slope."""
    df = read(spark, sf_dir, "lineitem")
    model = linear.ImbalancedLinearRegression(["l_quantity"], "l_extendedprice", 3.0, fit_intercept=False).fit(df)
    return spark.range(1).select(F.round(F.lit(float(model.coef_[0])), 4).alias("slope"))


#: Through the origin the loss is least at the quantile of the ratios that weighs each by its size.
PINBALL_SQL = """WITH d AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_extendedprice / l_quantity AS ratio FROM lineitem),
c AS (SELECT ratio, sum(x) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING) AS below, sum(x) OVER () AS whole FROM d), b AS (SELECT min(ratio) AS b FROM c WHERE below >= {0} * whole)
SELECT count(*) AS n, round(avg(greatest({0} * (y - b * x), ({0} - 1) * (y - b * x))), 2) AS loss, true AS near FROM d, b"""


def pinball(spark, sf_dir, model, quantile):
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    fitted = model(["l_quantity"], "l_extendedprice", fit_intercept=False).fit(df)
    gap = F.col("l_extendedprice") - F.col("prediction")
    below = F.sum(F.when(gap < 0, F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")  # the weighted share below the line is the quantile
    out = fitted.predict(df).agg(F.count("*").alias("n"), F.round(F.avg(F.greatest(gap * quantile, gap * (quantile - 1))), 2).alias("loss"), (F.abs(below - quantile) < 0.005).alias("near"))
    return out


@query(PINBALL_SQL.format(0.5))
def lad_regression(spark, sf_dir):
    return pinball(spark, sf_dir, linear.LADRegression, 0.5)


@query(PINBALL_SQL.format(0.9))
def quantile_regression(spark, sf_dir):
    return pinball(spark, sf_dir, lambda *a, **k: linear.QuantileRegression(*a, quantile=0.9, **k), 0.9)


@query()
def quantile_line(spark, sf_dir):
    """With an intercept: tested against numpy."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return linear.QuantileRegression(["l_quantity"], "l_extendedprice", 0.9).fit(df).predict(df)


@query()
def dead_zone(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return linear.DeadZoneRegressor(["l_quantity"], "price", 0.5, effect="quadratic").fit(df).predict(df)


@query("""WITH w AS (SELECT greatest(0, least(1, sum((l_tax - l_discount) * (l_quantity / 500 - l_discount)) / sum(pow(l_quantity / 500 - l_discount, 2)))) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(w * l_quantity / 500 + (1 - w) * l_discount, 6) AS prediction FROM lineitem, w""")
def prob_weight(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 500).alias("x"), "l_discount", "l_tax")
    return rounded(linear.ProbWeightRegression(["x", "l_discount"], "l_tax").fit(df).predict(df).select("l_orderkey", "l_linenumber", "prediction"), ["prediction"], 6)


@query()
def random_regressor(spark, sf_dir):
    df = read(spark, sf_dir, "supplier")
    return linear.RandomRegressor("s_acctbal", "normal", 3).fit(df).predict(df)


@query()
def demographic_parity(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_nationkey") % 2).alias("side"), F.when(F.col("c_mktsegment") < "F", 1).otherwise(0).alias("y"))
    return linear.DemographicParityClassifier(["balance", "side"], "y", "side", 0.1).fit(df).predict(df)


@query()
def equal_opportunity_classifier(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_nationkey") % 2).alias("side"), F.when(F.col("c_mktsegment") < "F", 1).otherwise(0).alias("y"))
    return linear.EqualOpportunityClassifier(["balance", "side"], "y", "side", 0.1, 1).fit(df).predict(df)


# ---------------------------------------------------------------- splits, pipelines, sources


FOLDS_SQL = """WITH f AS (SELECT k AS fold, (SELECT min(ts) FROM events) + to_days(CAST(5 * k AS INTEGER)) AS a FROM range(0, 10) t(k)), w AS (SELECT fold, 'train' AS part, {} AS lo, a + to_days(10) AS hi FROM f UNION ALL SELECT fold, 'valid', a + to_days(11), a + to_days(16) FROM f)
SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n_rows, count(DISTINCT ts) AS unique_dates, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_date, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INTEGER AS period
FROM w JOIN events ON ts >= lo AND ts < hi WHERE fold * 5 + 10 + 5 + 1 <= (SELECT epoch(max(ts) - min(ts)) / 86400 FROM events) GROUP BY 1, 2"""


def time_folds(spark, sf_dir, window):
    split = TimeGapSplit("ts", timedelta(days=5), timedelta(days=10), timedelta(days=1), window=window)
    out = split.summary(read(spark, sf_dir, "events"))
    return out.select("fold", "part", "n_rows", "unique_dates", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start_date", "end_date")], "period")


@query(FOLDS_SQL.format("a"))
def time_gap_split(spark, sf_dir):
    return time_folds(spark, sf_dir, "rolling")


@query(FOLDS_SQL.format("(SELECT min(ts) FROM events)"))
def time_gap_expanding(spark, sf_dir):
    return time_folds(spark, sf_dir, "expanding")


#: Every way to cut the years into three runs; the first run ends, and the last begins, where it holds nearly a mean size.
@query("""WITH g AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT y, n, row_number() OVER (ORDER BY y) - 1 AS i, sum(n) OVER (ORDER BY y) AS upto, sum(n) OVER (ORDER BY y DESC) AS after, sum(n) OVER () AS whole, count(*) OVER () AS k FROM g),
b AS (SELECT min(CASE WHEN upto - 1 >= 0.9 * whole / 3.0 THEN i END) AS low, max(CASE WHEN after - 1 >= 0.9 * whole / 3.0 THEN i END) + 1 AS high FROM e), a AS (SELECT i FROM e, b WHERE i >= greatest(low, 1) AND i <= least(high, k - 1)),
c AS (SELECT i FROM a WHERE (SELECT count(*) FROM a) >= 2 UNION ALL SELECT i FROM e WHERE i >= 1 AND (SELECT count(*) FROM a) < 2),
p AS (SELECT c.i AS p, d.i AS q FROM c, c AS d WHERE c.i < d.i), s AS (SELECT p, q, abs(3 * sum(n) FILTER (i < p) - any_value(whole)) + abs(3 * sum(n) FILTER (i >= p AND i < q) - any_value(whole)) + abs(3 * sum(n) FILTER (i >= q) - any_value(whole)) AS cost FROM p, e GROUP BY 1, 2),
best AS (SELECT p, q FROM s ORDER BY cost, p, q LIMIT 1)
SELECT CASE WHEN i < p THEN 0 WHEN i < q THEN 1 ELSE 2 END AS block, y, n FROM e, best""")
def group_time_series(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"))
    split = GroupTimeSeriesSplit("y", 2)
    return df.withColumn("block", split.block_of(split.blocks(df))).groupBy("block", "y").agg(F.count("*").alias("n"))


@query()
def cluster_folds(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ClusterFoldValidation(["c_acctbal"]).tagged(df).groupBy("fold").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1), d AS (SELECT count(*) - (SELECT count(*) FROM events) AS rows, 3 - (SELECT count(*) FROM (DESCRIBE events)) AS cols, count(*) AS n FROM t)
SELECT 'log' AS event_type, 0.0::DOUBLE AS total, 0::BIGINT AS n, concat('[totals(df=df)] n_obs=', n, ', n_col=3 delta=(', printf('%+d', rows), ', ', printf('%+d', cols), ') names=[''event_type'', ''total'', ''n'']') AS line FROM d
UNION ALL SELECT event_type, total, n, '' FROM t""")
def logged_step(spark, sf_dir):
    """The table and what was logged of it."""
    lines = []

    @log_step(time_taken=False, shape_delta=True, names=True, print_fn=lines.append)
    def totals(df):
        return df.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))

    out = totals(read(spark, sf_dir, "events"))
    said = spark.range(1).select(F.lit("log"), F.lit(0.0), F.lit(0).cast("long"), F.lit(" | ".join(lines)))
    return said.toDF("event_type", "total", "n", "line").union(out.withColumn("line", F.lit("")))


@query("SELECT '[totals] rows=' || count(DISTINCT event_type) || ' total=' || CAST(count(*) AS VARCHAR) AS line FROM events")
def logged_extra(spark, sf_dir):
    lines = []

    @log_step_extra(lambda df: f"rows={df.count()}", lambda df: f"total={df.agg(F.sum('n')).first()[0]}", print_fn=lines.append)
    def totals(df):
        return df.groupBy("event_type").agg(F.count("*").alias("n"))

    totals(read(spark, sf_dir, "events"))
    return spark.range(1).select(F.lit(" | ".join(lines)).alias("line"))


@query()
def one_vs_rest(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_nationkey") / 25).alias("nation"), "c_mktsegment")
    return linear.OneVsRest(linear.LogisticClassifier(["balance", "nation"], "c_mktsegment")).fit(df).predict(df).groupBy("prediction").count()


@query("""SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 2) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders)""")
def debug_pipeline(spark, sf_dir):
    pipe = make_debug_pipeline(select.ColumnSelector(["o_orderkey", "o_totalprice"]), features.ColumnCapper("o_totalprice", (10, 90)))
    return rounded(pipe.fit_transform(read(spark, sf_dir, "orders")), ["o_totalprice"], 2)


@query()
def simple_series(spark, sf_dir):
    return make_simpleseries(spark, 1000, seed=1)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
