"""Filters and projections (F), derived features (A), missing values and levels (I), encoders and transforms (E, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfeat.bindings.registry import (
    LINEITEM_NULLS, NUMBERS, PART_NULLS, lineitem_nulls, part_nulls, query, r, rounded, union,
)
from tabfeat.functions.columns import any_of, q, right_closed_bin
from tabfeat.operators import derive, encode, impute, predicates, profile, recode, scale, transforms
from tabfeat.operators.impute import ImputeRule, Imputer

# ---- F ---------------------------------------------------------------------------------------


@query("f1_drop_by_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (1, 2, 524, 1299, 999999999)")
def drop_by_key(load):
    return predicates.drop_by_key(load("orders"), "o_orderkey", [1, 2, 524, 1299, 999999999]).select("o_orderkey", "o_totalprice")


@query("f2_conditional_fix", """SELECT o_orderkey, CASE WHEN year(o_orderdate) > 1999 AND o_orderkey % 2 = 1
  THEN year(o_orderdate) - 100 ELSE year(o_orderdate) END AS o_year FROM orders""")
def conditional_fix(load):
    orders = load("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("o_year"))
    return predicates.conditional_fix(orders, "o_year", 1999, -100, where=F.col("o_orderkey") % 2 == 1)


@query("f3_mask_low_quality", f"SELECT p_partkey, CASE WHEN p_size < 6 THEN 1 ELSE 0 END AS low FROM {PART_NULLS}")
def mask_low_quality(load):
    return part_nulls(load).select("p_partkey", predicates.low_quality("p_size").cast("int").alias("low"))


@query("f4_mask_two_storey", f"""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 0 END AS member
FROM {PART_NULLS}""")
def mask_two_storey(load):
    return part_nulls(load).select("p_partkey", predicates.member("p_type", ["ECONOMY", "PROMO"]).cast("int").alias("member"))


CHEAP_SQL = """(coalesce(l_returnflag = 'R', false) OR coalesce(l_quantity < 3, false) OR coalesce(l_tax IN (0.01, 0.02), false)
  OR coalesce(l_linestatus = 'X', false))"""


def _cheap():
    return any_of(q("l_returnflag") == "R", q("l_quantity") < 3, q("l_tax").isin(0.01, 0.02), q("l_linestatus") == "X")


@query("f5_mask_cheap", f"SELECT CAST({CHEAP_SQL} AS INTEGER) AS cheap, l_linestatus, count(*) AS n FROM {LINEITEM_NULLS} GROUP BY ALL")
def mask_cheap(load):
    rows = lineitem_nulls(load).select(_cheap().cast("int").alias("cheap"), "l_linestatus")
    return rows.groupBy("cheap", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("f6_split_by_mask", f"""SELECT CASE WHEN {CHEAP_SQL} THEN 'cheap' ELSE 'pricy' END AS segment, count(*) AS n,
  {r('avg(l_extendedprice)')} AS mean_price FROM {LINEITEM_NULLS} GROUP BY ALL""")
def split_by_mask(load):
    tagged = predicates.split_by_mask(lineitem_nulls(load), _cheap(), ("pricy", "cheap"))
    return rounded(tagged.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price")))


@query("f7_flag_columns", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'Y' ELSE 'N' END AS many,
  CASE WHEN l_tax > 0 THEN 'Y' ELSE 'N' END AS taxed, CASE WHEN l_returnflag = 'N' THEN 'Y' ELSE 'N' END AS is_new
FROM {LINEITEM_NULLS}""")
def flag_columns(load):
    flags = {"many": q("l_quantity") > 25, "taxed": q("l_tax") > 0, "is_new": q("l_returnflag") == "N"}
    return predicates.flag_columns(lineitem_nulls(load), flags).select("l_orderkey", "l_linenumber", *flags)


@query("f8_quadratic", f"""SELECT l_orderkey, {r('l_quantity * l_quantity')} AS l_quantity_quad,
  {r('l_discount * l_discount')} AS l_discount_quad FROM {LINEITEM_NULLS}""")
def quadratic(load):
    out = predicates.quadratic(lineitem_nulls(load), ["l_quantity", "l_discount"])
    return rounded(out.select("l_orderkey", "l_quantity_quad", "l_discount_quad"))


@query("f9_cast_categorical", f"SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM {PART_NULLS}")
def cast_categorical(load):
    return predicates.cast_categorical(part_nulls(load), ["p_size"]).select("p_partkey", "p_size")


@query("f10_drop_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def drop_columns(load):
    return predicates.drop_columns(load("orders"), ["o_custkey", "o_totalprice", "o_orderdate", "absent"])


@query("f11_restore_dtypes", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def restore_dtypes(load):
    out = predicates.restore_dtypes(load("part"), {"int": ["p_partkey", "p_retailprice"], "float": ["p_size"]})
    return out.select("p_partkey", "p_retailprice", "p_size")


# ---- A ---------------------------------------------------------------------------------------


@query("a1_season_flag", """SELECT o_orderkey, CASE WHEN month(o_orderdate) = 7 THEN 1 ELSE 0 END AS july,
  CASE WHEN month(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS summer FROM orders""")
def season_flag(load):
    month = F.month("o_orderdate")
    return load("orders").select("o_orderkey", derive.season_flag(month).alias("july"),
                                 derive.season_flag(month, (6, 7)).alias("summer"))


@query("a2_row_marker", "SELECT o_orderkey, CASE WHEN o_orderkey = 186 THEN 1 ELSE 0 END AS antique FROM orders")
def row_marker(load):
    return derive.row_marker(load("orders"), "o_orderkey", 186, "antique").select("o_orderkey", "antique")


@query("a3_sum_feature", f"SELECT l_orderkey, {r('l_quantity + l_extendedprice')} AS total FROM {LINEITEM_NULLS}")
def sum_feature(load):
    out = derive.sums(lineitem_nulls(load), {"total": {"l_quantity": 1, "l_extendedprice": 1}})
    return rounded(out.select("l_orderkey", "total"))


@query("a4_weighted_sum", f"""SELECT l_orderkey, {r('l_quantity + 0.5 * l_linenumber + l_tax')} AS half,
  {r('l_quantity + l_extendedprice + l_discount')} AS whole FROM {LINEITEM_NULLS}""")
def weighted_sum(load):
    out = derive.sums(lineitem_nulls(load), {
        "half": {"l_quantity": 1, "l_linenumber": 0.5, "l_tax": 1},
        "whole": {"l_quantity": 1, "l_extendedprice": 1, "l_discount": 1}})
    return rounded(out.select("l_orderkey", "half", "whole"))


@query("a5_weighted_area", f"""SELECT l_orderkey, {r('0.8 * l_quantity + 0.6 * l_linenumber + l_extendedprice + 0.9 * l_tax + 0.8 * l_discount')}
  AS area FROM {LINEITEM_NULLS}""")
def weighted_area(load):
    weights = {"l_quantity": 0.8, "l_linenumber": 0.6, "l_extendedprice": 1, "l_tax": 0.9, "l_discount": 0.8}
    return rounded(derive.sums(lineitem_nulls(load), {"area": weights}).select("l_orderkey", "area"))


@query("a6_additional_features", f"""SELECT o_orderkey, year(o_orderdate) AS o_year, CASE WHEN month(o_orderdate) = 7 THEN 1 ELSE 0 END AS season,
  CASE WHEN year(o_orderdate) > 1994 AND year(o_orderdate) <= 1996 THEN '(1994, 1996]'
       WHEN year(o_orderdate) > 1996 AND year(o_orderdate) <= 1999 THEN '(1996, 1999]' END AS period,
  CASE WHEN o_orderkey = 186 THEN 1 ELSE 0 END AS antique, {r('o_totalprice + 0.5 * o_custkey')} AS total FROM orders""")
def additional_features(load):
    df = load("orders").withColumns({"o_year": F.year("o_orderdate").cast("long"), "o_month": F.month("o_orderdate")})
    df = derive.sums(df, {"total": {"o_totalprice": 1, "o_custkey": 0.5}}).withColumns({
        "season": derive.season_flag(q("o_month")), "period": right_closed_bin(q("o_year"), [1994, 1996, 1999])})
    df = derive.row_marker(df, "o_orderkey", 186, "antique")
    return rounded(df.select("o_orderkey", "o_year", "season", "period", "antique", "total"))


CUSTOMER_NATION = "customer JOIN nation ON c_nationkey = n_nationkey"


def _customer_nation(load):
    return load("customer").join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query("a7_district_tag", f"""SELECT c_custkey, n_name || CASE WHEN c_acctbal < 4000 THEN '_Lower' ELSE '_Upper' END AS district
FROM {CUSTOMER_NATION}""")
def district_tag(load):
    return _customer_nation(load).select(
        "c_custkey", derive.district_tag(q("n_name"), predicates.low_quality("c_acctbal", 4000)).alias("district"))


@query("a8_district_tag_two_columns", f"""SELECT c_custkey,
  CASE WHEN c_acctbal < 4000 THEN 'Lower_' || n_name ELSE 'Upper' END AS "LowerDistrict",
  CASE WHEN c_acctbal < 4000 THEN 'Lower' ELSE 'Upper_' || n_name END AS "UpperDistrict" FROM {CUSTOMER_NATION}""")
def district_tag_two_columns(load):
    out = derive.district_tag_two_columns(_customer_nation(load), "n_name", predicates.low_quality("c_acctbal", 4000))
    return out.select("c_custkey", "LowerDistrict", "UpperDistrict")


@query("a9_model_matrix", f"""SELECT 1.0::DOUBLE AS intercept, l_quantity, l_discount, {r('ln(1 + l_extendedprice)', 6)} AS log1p_l_extendedprice,
  {r('l_quantity * l_quantity')} AS l_quantity_sq, {r('l_quantity * l_tax')} AS "l_quantity:l_tax",
  {r('l_extendedprice * l_discount', 6)} AS "l_extendedprice:l_discount", l_extendedprice FROM lineitem""")
def model_matrix(load):
    matrix = derive.ModelMatrix(
        "l_extendedprice", main=["l_quantity", "l_discount"], log1p=["l_extendedprice"], squares=["l_quantity"],
        products=[("l_quantity", "l_tax"), ("l_extendedprice", "l_discount")])
    return rounded(matrix.fit(load("lineitem")).transform(load("lineitem")), log1p_l_extendedprice=6,
                   **{"l_extendedprice:l_discount": 6})


def _hat_sql(x, left, mid, right=None):
    rise = f"({x} - {left}) / ({mid} - {left})"
    return f"greatest({f'least({rise}, ({right} - {x}) / ({right} - {mid}))' if right else rise}, 0.0)"


@query("a10_linear_spline", f"""SELECT {r(_hat_sql('x', 'k0', 'k1', 'k2'), 6)} AS "bs_l_extendedprice_1",
  {r(_hat_sql('x', 'k1', 'k2', 'k3'), 6)} AS "bs_l_extendedprice_2", {r(_hat_sql('x', 'k2', 'k3'), 6)} AS "bs_l_extendedprice_3"
FROM (SELECT l_extendedprice AS x FROM lineitem), (SELECT min(l_extendedprice) AS k0, quantile_cont(l_extendedprice, 1.0 / 3) AS k1,
  quantile_cont(l_extendedprice, 2.0 / 3) AS k2, max(l_extendedprice) AS k3 FROM lineitem)""")
def linear_spline(load):
    matrix = derive.ModelMatrix("none", splines={"l_extendedprice": 3}).fit(load("lineitem"))
    return rounded(matrix.transform(load("lineitem")).drop("intercept"), 6)


@query("a11_group_pc1", f"""SELECT o_orderkey, {r('s * (cos(t) * (x - mx) + sin(t) * (y - my))')} AS pc1 FROM (
  SELECT *, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS s FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey * 100.0 END AS x, o_totalprice AS y FROM orders), (
    SELECT avg(o_custkey * 100.0) AS mx, avg(o_totalprice) AS my, 0.5 * atan2(2 * covar_samp(o_custkey * 100.0, o_totalprice),
      var_samp(o_custkey * 100.0) - var_samp(o_totalprice)) AS t FROM orders WHERE o_orderkey % 7 <> 0))""")
def group_pc1(load):
    df = load("orders").withColumn("x", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") * 100.0))
    return rounded(derive.group_pc1(df, {"pc1": ["x", "o_totalprice"]}).select("o_orderkey", "pc1"))


@query("a12_bin_right_closed", f"""SELECT p_partkey, CASE WHEN p_size > 1 AND p_size <= 10 THEN '(1, 10]'
  WHEN p_size > 10 AND p_size <= 25 THEN '(10, 25]' WHEN p_size > 25 AND p_size <= 40 THEN '(25, 40]' END AS size_bin FROM {PART_NULLS}""")
def bin_right_closed(load):
    return part_nulls(load).select("p_partkey", right_closed_bin(q("p_size"), [1, 10, 25, 40]).alias("size_bin"))


# ---- I ---------------------------------------------------------------------------------------


@query("i1_fill_constant", f"""SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) AS l_quantity,
  coalesce(l_returnflag, 'Missing') AS l_returnflag FROM {LINEITEM_NULLS}""")
def fill_constant(load):
    out = impute.fill_constant(lineitem_nulls(load), {"l_quantity": 0, "l_returnflag": "Missing"})
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("i2_fill_mean", f"""SELECT l_orderkey, {r('coalesce(l_quantity, mq)')} AS l_quantity, {r('coalesce(l_tax, mt)')} AS l_tax
FROM {LINEITEM_NULLS}, (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mt FROM {LINEITEM_NULLS})""")
def fill_mean(load):
    return rounded(impute.fill_mean(lineitem_nulls(load), ["l_quantity", "l_tax"]).select("l_orderkey", "l_quantity", "l_tax"))


def _mode_sql(column, table):
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


@query("i3_fill_mode", f"""SELECT p_partkey, coalesce(p_type, {_mode_sql('p_type', PART_NULLS)}) AS p_type,
  coalesce(p_size, {_mode_sql('p_size', PART_NULLS)}) AS p_size FROM {PART_NULLS}""")
def fill_mode(load):
    return impute.fill_mode(part_nulls(load), ["p_type", "p_size"]).select("p_partkey", "p_type", "p_size")


EVENT_NULLS = """(SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts, CASE WHEN event_id % 3 <> 0 THEN event_type END
  AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id FROM events)"""


@query("i5_impute_features", f"""SELECT event_id, coalesce(user_id, 0) AS user_id, {r('coalesce(value, mv)')} AS value,
  coalesce(event_type, mode) AS event_type, strftime(coalesce(ts, date_trunc('second', mts)), '%Y-%m-%d %H:%M:%S') AS ts
FROM {EVENT_NULLS}, (SELECT avg(value) AS mv, make_timestamp(CAST(floor(avg(epoch_us(ts))) AS BIGINT)) AS mts,
  {_mode_sql('event_type', EVENT_NULLS)} AS mode FROM {EVENT_NULLS})""")
def impute_features(load):
    gaps = {"ts": 5, "event_type": 3, "value": 7}
    events = load("events").withColumns({c: F.when(F.col("event_id") % k != 0, F.col(c)) for c, k in gaps.items()})
    rules = [ImputeRule("zero", "constant", 0, ["user_id"]), ImputeRule("mean", "mean", None, ["value"]),
             ImputeRule("most", "most_frequent", None, ["event_type"]), ImputeRule("date", "mean", None, ["ts"])]
    out = Imputer(rules, keep=["event_id"]).fit(events).transform(events)
    return rounded(out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


@query("i7_recode_levels", f"""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'High'
  WHEN p_type = 'LARGE' THEN 'Big' ELSE p_type END AS p_type,
  CASE WHEN p_size = 1 THEN 2 WHEN p_size IN (48, 49, 50) THEN 47 ELSE p_size END AS p_size FROM {PART_NULLS}""")
def recode_levels(load):
    plan = {"p_type": [(["ECONOMY", "PROMO"], "SMALL"), (["SMALL"], "High"), (["LARGE"], "Big")],
            ("p_size", "absent"): [([1], 2), ([48, 49, 50], 47)]}
    return recode.recode_levels(part_nulls(load), plan).select("p_partkey", "p_type", "p_size")


# ---- E ---------------------------------------------------------------------------------------

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("e1_ordinal_encode", f"""SELECT o_orderkey, CAST(list_position({PRIORITIES}, o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority
FROM orders""")
def ordinal_encode(load):
    out = encode.ordinal_encode(load("orders"), {"o_orderpriority": PRIORITIES})
    return out.select("o_orderkey", "o_orderpriority")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("e3_onehot", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_custkey % 6 <> 0 AND c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def onehot(load):
    customer = load("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")))
    return encode.OneHot(["c_mktsegment"]).fit(customer).transform(customer, keep=["c_custkey"])


@query("e4_appearance_encode", """SELECT c_custkey, c_mktsegment, code AS "c_mktsegment_E" FROM customer JOIN (
  SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) AS code FROM customer GROUP BY c_mktsegment) USING (c_mktsegment)""")
def appearance_encode(load):
    out = encode.appearance_encode(load("customer"), ["c_mktsegment"], "c_custkey")
    return out.select("c_custkey", "c_mktsegment", "c_mktsegment_E")


def _stats(columns, *stats):
    return "(SELECT " + ", ".join(f"{e.format(c)} AS {n}_{c}" for c in columns for n, e in stats) + " FROM lineitem)"


@query("e6_standard_scale", f"""SELECT l_orderkey, {', '.join(f'{r(f"({c} - m_{c}) / s_{c}")} AS {c}_gaus' for c in NUMBERS)}
FROM lineitem, {_stats(NUMBERS, ('m', 'avg({})'), ('s', 'stddev_pop({})'))}""")
def standard_scale(load):
    out, _ = scale.scale_column(load("lineitem"), "standard", NUMBERS, "_gaus")
    return rounded(out.select("l_orderkey", *[f"{c}_gaus" for c in NUMBERS]))


@query("e7_minmax_scale", f"""SELECT l_orderkey, {', '.join(f'{r(f"({c} - a_{c}) / (b_{c} - a_{c})")} AS {c}' for c in NUMBERS)}
FROM lineitem, {_stats(NUMBERS, ('a', 'min({})'), ('b', 'max({})'))}""")
def minmax_scale(load):
    fitted = scale.Scaler({"minmax": NUMBERS}).fit(load("lineitem"))
    return rounded(fitted.transform(load("lineitem"), keep=["l_orderkey"]))


@query("e8_scaled_features", f"""SELECT l_orderkey, {r('(l_discount - a_l_discount) / (b_l_discount - a_l_discount)')} AS l_discount,
  {r('(l_tax - a_l_tax) / (b_l_tax - a_l_tax)')} AS l_tax, {r('(l_extendedprice - m_l_extendedprice) / s_l_extendedprice')} AS l_extendedprice,
  {r('(l_quantity - m_l_quantity) / s_l_quantity')} AS l_quantity
FROM lineitem, {_stats(NUMBERS, ('m', 'avg({})'), ('s', 'stddev_pop({})'), ('a', 'min({})'), ('b', 'max({})'))}""")
def scaled_features(load):
    plan = {"minmax": ["l_discount", "l_tax"], "standard": ["l_extendedprice", "l_quantity"], "power": []}
    return rounded(scale.Scaler(plan).fit(load("lineitem")).transform(load("lineitem"), keep=["l_orderkey"]))


# ---- T ---------------------------------------------------------------------------------------


@query("t1_maxabs_scale", f"SELECT c_custkey, {r('c_acctbal / m')} AS c_acctbal FROM customer, (SELECT max(abs(c_acctbal)) AS m FROM customer)")
def maxabs_scale(load):
    return rounded(scale.Scaler({"maxabs": ["c_acctbal"]}).fit(load("customer")).transform(load("customer"), ["c_custkey"]))


@query("t2_robust_scale", f"""SELECT l_orderkey, {r('(l_extendedprice - q2) / (q3 - q1)')} AS l_extendedprice FROM lineitem,
  (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2,
   quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)""")
def robust_scale(load):
    return rounded(scale.Scaler({"robust": ["l_extendedprice"]}).fit(load("lineitem")).transform(load("lineitem"), ["l_orderkey"]))


@query("t3_row_normalize", f"""SELECT l_orderkey, {r('l_quantity / len', 6)} AS l_quantity_unit, {r('l_linenumber / len', 6)} AS l_linenumber_unit
FROM (SELECT *, sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AS len FROM lineitem)""")
def row_normalize(load):
    out = scale.row_normalize(load("lineitem"), ["l_quantity", "l_linenumber"])
    return rounded(out.select("l_orderkey", "l_quantity_unit", "l_linenumber_unit"), 6)


@query("t4_log_transform", f"""SELECT l_orderkey, {r('ln(l_extendedprice)', 6)} AS l_extendedprice_log, {r('ln(1 + l_tax)', 6)} AS l_tax_log,
  {r('l_extendedprice', 2)} AS price_back, {r('l_tax')} AS tax_back FROM lineitem""")
def log_transform(load):
    cols = ["l_extendedprice", "l_tax"]
    fitted = transforms.fit_log(load("lineitem"), cols)
    out = fitted.transform(load("lineitem")).withColumns({
        "price_back": fitted.inverse(q("l_extendedprice_log"), "l_extendedprice"), "tax_back": fitted.inverse(q("l_tax_log"), "l_tax")})
    return rounded(out.select("l_orderkey", "l_extendedprice_log", "l_tax_log", "price_back", "tax_back"),
                   l_extendedprice_log=6, l_tax_log=6, price_back=2)


@query("t5_gaus_inverse", f"SELECT l_orderkey, {r('l_extendedprice', 2)} AS l_extendedprice FROM lineitem")
def gaus_inverse(load):
    out, fitted = scale.scale_column(load("lineitem"), "standard", ["l_extendedprice"], "_gaus")
    back = fitted.state["standard", "l_extendedprice"].invert(q("l_extendedprice_gaus"))
    return rounded(out.select("l_orderkey", back.alias("l_extendedprice")), 2)


@query("t6_power_fixed", f"""SELECT c_custkey, {r('CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END')} AS yeo_johnson,
  {r('(pow(abs(x) + 1, 0.25) - 1) / 0.25')} AS box_cox FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
def power_fixed(load):
    x = q("c_acctbal")
    return rounded(load("customer").select(
        "c_custkey", transforms.power_value(x, 0.5, "yeo-johnson").alias("yeo_johnson"),
        transforms.power_value(F.abs(x) + 1, 0.25, "box-cox").alias("box_cox")))


@query("t6_power_fitted")
def power_fitted(load):
    """Fitted lambdas: Yeo-Johnson of a signed column, Box-Cox of a positive one."""
    yj = transforms.fit_power(load("customer"), ["c_acctbal"])["c_acctbal"]
    events = load("events").withColumn("value", q("value") + 1)
    bc = transforms.fit_power(events, ["value"], "box-cox")["value"]
    a = load("customer").select(F.lit("c_acctbal").alias("column"), F.lit(round(yj.lam, 4)).alias("lambda"), yj.apply(q("c_acctbal")).alias("z"))
    b = events.select(F.lit("value").alias("column"), F.lit(round(bc.lam, 4)).alias("lambda"), bc.apply(q("value")).alias("z"))
    return rounded(a.unionByName(b).groupBy("column", "lambda").agg(
        F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.skewness("z").alias("skewness")))


@query("t7_johnson_fixed", f"SELECT event_id, {r('1.5 + 2.0 * asinh((value - 10.0) / 25.0)', 6)} AS value_john, {r('value')} AS back FROM events")
def johnson_fixed(load):
    fixed = transforms.JohnsonSU(1.5, 2.0, 10.0, 25.0)
    out = transforms.johnson_features(load("events"), {"value": fixed}).withColumn("back", fixed.invert(q("value_john")))
    return rounded(out.select("event_id", "value_john", "back"), value_john=6)


@query("t7_johnson_fitted")
def johnson_fitted(load):
    fitted = transforms.fit_johnson(load("events"), ["value"])
    out = transforms.johnson_features(load("events"), fitted)
    return rounded(out.agg(F.count("value_john").alias("n"), F.avg("value_john").alias("mean"),
                           F.stddev_pop("value_john").alias("std"), F.skewness("value_john").alias("skewness")))


QUARTERS = [f"quantile_cont(value, {i / 4})" for i in range(5)]


@query("t8_quantile_transform", f"""SELECT event_id, {r('''CASE WHEN value <= q0 + 1e-7 THEN 0.0 WHEN value >= q4 - 1e-7 THEN 1.0
  WHEN value <= q1 THEN 0.25 * (value - q0) / (q1 - q0) WHEN value <= q2 THEN 0.25 + 0.25 * (value - q1) / (q2 - q1)
  WHEN value <= q3 THEN 0.5 + 0.25 * (value - q2) / (q3 - q2) ELSE 0.75 + 0.25 * (value - q3) / (q4 - q3) END''', 6)} AS uniform
FROM events, (SELECT {', '.join(f'{e} AS q{i}' for i, e in enumerate(QUARTERS))} FROM events)""")
def quantile_transform(load):
    fitted = transforms.fit_quantiles(load("events"), ["value"], marks=5)["value"]
    return rounded(load("events").select("event_id", fitted.uniform(q("value")).alias("uniform")), 6)


@query("t8_quantile_normal")
def quantile_normal(load):
    fitted = transforms.fit_quantiles(load("events"), ["value"])["value"]
    return rounded(load("events").select("event_id", fitted.normal(q("value")).alias("normal")))


PANEL_SQL = f"""SELECT event_id, {r('ln(1 + value)')} AS log1p, {r('(value - m) / s')} AS standard, {r('(value - lo) / (hi - lo)')} AS minmax,
  {r('value / hi')} AS maxabs, {r('(value - q2) / (q3 - q1)')} AS robust, {r('CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END')} AS normalized
FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events)"""


@query("t9_transform_panel", PANEL_SQL)
def panel(load):
    out = transforms.transform_panel(load("events"), "value", ["event_id"])
    return rounded(out.drop("yeo_johnson", "gaussian", "uniform"))


@query("t9_transform_panel_all")
def panel_all(load):
    return rounded(transforms.transform_panel(load("events"), "value", ["event_id"]))
