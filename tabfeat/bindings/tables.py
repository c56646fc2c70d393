"""Sources and sinks (S), set operations, ordering, alignment (U, J, O, W), folds and metrics (V)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabfeat.bindings.registry import NET_FEATURES, NET_LINEITEM, net_lineitem, query, r, rounded, union
from tabfeat.functions.columns import q
from tabfeat.operators import folds, reshape
from tabfeat.operators.linear import fit_linear
from tabfeat.session import scratch_path
from tabfeat.sources import models as model_store
from tabfeat.sources import tables

# ---- S ---------------------------------------------------------------------------------------

ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("s1_read_table", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'None' WHEN o_orderkey % 7 <> 0
  THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def read_table(load):
    """Written as CSV with two spellings of a missing value and the level 'None', then read back."""
    orders = load("orders")
    key = F.col("o_orderkey")
    text = orders.select([F.col(c).cast(StringType()).alias(c) for c in orders.columns]).withColumns({
        "o_orderstatus": F.when(key % 5 == 0, "None").when(key % 7 == 0, "NA").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(key % 3 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")),
    })
    path = scratch_path(orders.sparkSession, "orders-csv")
    tables.write_table(text, path)
    back = tables.read_table(orders.sparkSession, path, ORDERS_SCHEMA)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


SPLITS = {"train": (0, 1997), "ext": (1998, 1998), "pseudo": (1999, 1999), "test": (2000, 9999)}


@query("s2_optional_inputs", f"""SELECT CASE WHEN y <= 1997 THEN 'train' WHEN y = 1998 THEN 'ext' WHEN y = 1999 THEN 'pseudo' ELSE 'test' END
  AS _split, count(*) AS n, count(CASE WHEN y < 2000 THEN o_totalprice END) AS labelled, {r('avg(CASE WHEN y < 2000 THEN o_totalprice END)', 2)} AS mean_price
FROM (SELECT year(o_orderdate) AS y, o_totalprice FROM orders) GROUP BY 1""")
def optional_inputs(load):
    orders = load("orders")
    year = F.year("o_orderdate")
    part = {n: orders.where(year.between(lo, hi)) for n, (lo, hi) in SPLITS.items()}
    rows = tables.load_inputs(part["train"], part["test"].drop("o_totalprice"), part["ext"], part["pseudo"])
    return rounded(rows.groupBy("_split").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("labelled"),
                                              F.avg("o_totalprice").alias("mean_price")), 2)


@query("s3_write_predictions", f"""SELECT p_partkey, {r('exp(b0 + b1 * p_size) - 1')} AS price FROM part,
  (SELECT regr_slope(ln(1 + p_retailprice), p_size) AS b1, regr_intercept(ln(1 + p_retailprice), p_size) AS b0 FROM part)""")
def write_predictions(load):
    part = load("part").withColumn("label", F.log1p("p_retailprice"))
    model = fit_linear(part, ["p_size"], "label", "linear")
    path = scratch_path(part.sparkSession, "predictions")
    tables.write_predictions(model.transform(part), path, "p_partkey", out="price")
    return rounded(tables.read_table(part.sparkSession, path, "p_partkey long, price double"))


@query("s4_save_model", union(f"SELECT '{m}' AS model, count(*) AS n, CAST(0 AS DOUBLE) AS gap FROM lineitem" for m in ("ridge", "decision_tree")))
def save_model(load):
    """A linear and a tree model, saved, loaded and compared on every row."""
    from pyspark.ml.regression import DecisionTreeRegressionModel

    from tabfeat.operators.trees import assemble, fit_tree

    df = net_lineitem(load)
    spark = df.sparkSession
    folder = scratch_path(spark, "models")
    linear = fit_linear(df, NET_FEATURES, "label", "ridge", alpha=1.0)
    again = model_store.load_model(spark, model_store.save_model(spark, linear, folder, "ridge"))
    gap = F.max(F.abs(linear.predict(df) - again.predict(df)))
    first = df.agg(F.lit("ridge").alias("model"), F.count(F.lit(1)).alias("n"), gap.alias("gap"))
    tree = fit_tree(df, NET_FEATURES, "label", "decision_tree", {"max_depth": 4})
    loaded = model_store.load_model(spark, model_store.save_model(spark, tree, folder, "tree"), DecisionTreeRegressionModel)
    both = loaded.setPredictionCol("again").transform(tree.transform(assemble(df, NET_FEATURES, None)))
    second = both.agg(F.lit("decision_tree").alias("model"), F.count(F.lit(1)).alias("n"),
                      F.max(F.abs(F.col("prediction") - F.col("again"))).alias("gap"))
    return first.unionByName(second)


# ---- U, J ------------------------------------------------------------------------------------


@query("u1_append_rows", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def append_rows(load):
    customer = load("customer").select(q("c_custkey").alias("id"), q("c_acctbal").alias("balance"), q("c_mktsegment").alias("segment"))
    supplier = load("supplier").select(q("s_acctbal").alias("balance"), q("s_suppkey").alias("id"))
    return reshape.append_rows(customer, supplier)


@query("u2_split_back", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) >= 2000")
def split_back(load):
    orders = load("orders")
    late = F.year("o_orderdate") >= 2000
    whole = tables.load_inputs(orders.where(~late), orders.where(late))
    return reshape.split_back(whole, "test").select("o_orderkey", "o_totalprice")


@query("u3_distinct_levels", "SELECT DISTINCT CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type FROM part")
def distinct_levels(load):
    part = load("part").withColumn("p_type", F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")))
    return reshape.distinct_levels(part, "p_type")


@query("u4_unpivot", union(f"SELECT o_orderkey, '{c}' AS variable, {c} AS value FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def unpivot(load):
    return reshape.unpivot(load("orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("j1_align_columns", f"""SELECT coalesce(o_custkey, c_custkey) AS c_custkey, n, {r('total', 2)} AS total, c_acctbal, c_mktsegment FROM
  (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
  FULL JOIN (SELECT c_custkey + 100 AS c_custkey, c_acctbal, c_mktsegment FROM customer) ON o_custkey = c_custkey""")
def align_columns(load):
    sums = load("orders").groupBy(q("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    # shifted, so that either side has keys without a partner
    out = reshape.align_columns(sums, load("customer").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_acctbal", "c_mktsegment"), "c_custkey")
    return rounded(out, 2)


# ---- O, W ------------------------------------------------------------------------------------


@query("o1_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_rows(load):
    return reshape.sort_rows(load("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice")], ["o_orderkey"])


@query("o2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(load):
    return reshape.top_k(load("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


@query("o2_arg_extreme", """SELECT (SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 1) AS arg_min,
  (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 1) AS arg_max""")
def arg_extreme(load):
    return reshape.arg_extreme(load("part"), "p_size", "p_partkey")


@query("o3_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def first_n(load):
    return reshape.first_n(load("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("w1_competition_rank", """SELECT * FROM (SELECT p_brand, p_partkey, p_size,
  CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS rank FROM part) WHERE rank <= 3""")
def competition_rank(load):
    part = load("part").select("p_brand", "p_partkey", "p_size")
    return reshape.competition_rank(part, "p_size", ["p_brand"], top=3)


# ---- V ---------------------------------------------------------------------------------------


@query("v1_holdout_split", "SELECT o_orderkey, CASE WHEN (o_orderkey * 7919) % 100 < 75 THEN 1 ELSE 0 END AS is_train FROM orders")
def holdout_split(load):
    out = folds.holdout_split_arithmetic(load("orders"), "o_orderkey")
    return out.select("o_orderkey", F.col("is_train").cast("int").alias("is_train"))


@query("v2_kfold_assign", "SELECT o_orderkey, CAST(ntile(4) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold_assign(load):
    return folds.kfold_assign(load("orders"), "o_orderkey", 4).select("o_orderkey", "fold")


@query("v3_metrics", f"""SELECT fold, count(*) AS n, {r('1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*))', 6)} AS r2,
  {r('avg(abs(exp(label) - exp(p)))', 2)} AS mae, {r('sqrt(avg((label - p) * (label - p)))', 6)} AS rmse
FROM (SELECT fold, label, log_price * 1.001 AS p FROM {NET_LINEITEM}) GROUP BY fold""")
def metrics(load):
    scored = net_lineitem(load).withColumn("prediction", F.col("log_price") * 1.001)
    return rounded(folds.metrics(scored, by=["fold"]), 6, mae=2)
