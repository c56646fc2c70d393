"""The whole preparation on hand-made houses, sources, sinks, saved models, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfeat.operators import reshape
from tabfeat.operators.linear import LinearModel, fit_linear
from tabfeat.operators.recode import compose, expand_keys
from tabfeat.plans import house
from tabfeat.plans.prepare import Preparation, held_part, house_plan, train_part
from tabfeat.session import scratch_path
from tabfeat.sources import models, tables

TEXT = {
    "Alley": None, "Street": "Pave", "BsmtExposure": "No", "BsmtCond": "TA", "BsmtQual": "Gd", "GarageCond": "Ex", "GarageQual": "TA",
    "PoolQC": None, "BsmtFinType1": "GLQ", "BsmtFinType2": "Unf", "ExterCond": "TA", "ExterQual": "Gd", "FireplaceQu": None,
    "HeatingQC": "Ex", "KitchenQual": "Gd", "CentralAir": "Y", "Condition1": "Feedr", "Condition2": "Norm", "BldgType": "1Fam",
    "Electrical": "SBrkr", "Heating": "GasA", "RoofMatl": "CompShg", "Utilities": "AllPub", "Exterior1st": "VinylSd",
    "Exterior2nd": "Wd Shng", "Foundation": "PConc", "GarageType": "Attchd", "HouseStyle": "2Story", "MasVnrType": "BrkFace",
    "RoofStyle": "Gable", "SaleType": "WD", "Fence": "MnPrv", "Functional": "Typ", "GarageFinish": "RFn", "LandContour": "Lvl",
    "LandSlope": "Gtl", "LotShape": "IR1", "LotConfig": "FR2", "MiscFeature": None, "MSZoning": "RL", "PavedDrive": "Y",
    "SaleCondition": "Normal", "Neighborhood": "CollgCr",
}
LONGS = ["MSSubClass", "OverallQual", "OverallCond", "BsmtFullBath", "BsmtHalfBath", "FullBath", "HalfBath", "BedroomAbvGr",
         "KitchenAbvGr", "TotRmsAbvGrd", "Fireplaces", "GarageCars", "YrSold", "MoSold", "YearBuilt", "YearRemodAdd", "LotArea",
         "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "TotalBsmtSF", "1stFlrSF", "2ndFlrSF", "LowQualFinSF", "GrLivArea", "GarageArea",
         "WoodDeckSF", "OpenPorchSF", "EnclosedPorch", "3SsnPorch", "ScreenPorch", "PoolArea", "MiscVal"]
DOUBLES = ["LotFrontage", "MasVnrArea", "GarageYrBlt"]
SCHEMA = T.StructType(
    [T.StructField("Id", T.LongType())] + [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.LongType()) for c in LONGS] + [T.StructField(c, T.DoubleType()) for c in DOUBLES]
    + [T.StructField("SalePrice", T.LongType())])


def house_row(i, **changes):
    row = {"Id": i, **TEXT, **{c: 100 + (i * 7 + k * 3) % 50 for k, c in enumerate(LONGS)}, **{c: 10.0 + i for c in DOUBLES}}
    row |= {"OverallQual": 4 + i % 5, "YearBuilt": 1940 + i, "MoSold": 1 + i % 12, "SalePrice": 100000 + 1000 * i}
    row |= changes
    return tuple(row[f.name] for f in SCHEMA.fields)


@pytest.fixture(scope="module")
def houses(spark):
    train = [house_row(i) for i in range(1, 12)] + [house_row(524), house_row(1299)]
    train.append(house_row(20, MSZoning=None, Electrical=None, LotFrontage=None, BsmtQual=None, GarageType=None, Neighborhood="OldTown",
                           OverallQual=1))
    test = [house_row(i, Neighborhood="Veenker") for i in range(2000, 2006)] + [house_row(2006, GarageYrBlt=2207.0, KitchenQual=None)]
    return spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA).drop("SalePrice")


@pytest.fixture(scope="module")
def prepared(houses):
    train, test = houses
    prepare = Preparation(house_plan(marked_key=7))
    rows = prepare.gather(train, test)
    fitted = prepare.fit(rows)
    return fitted, fitted.transform(rows).cache()


def test_rows_and_label(prepared):
    _, out = prepared
    assert train_part(out).count() == 12 and held_part(out).count() == 7
    assert out.where("Id in (524, 1299)").count() == 0
    one = train_part(out).where("Id = 3").first()
    assert math.isclose(one["label"], math.log1p(103000))
    assert "label" not in held_part(out).columns


def test_every_feature_is_numeric_and_complete(prepared):
    fitted, out = prepared
    assert set(out.columns) == {"Id", "_split", "label", *fitted.features}
    for f in out.select(*[F.col(f"`{c}`") for c in fitted.features]).schema.fields:
        assert isinstance(f.dataType, (T.DoubleType, T.IntegerType)), f
    missing = out.select([F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in fitted.features]).first()
    assert sum(missing) == 0


def test_dropped_and_kept_columns(prepared):
    fitted, _ = prepared
    gone = {"OverallQual", "MSSubClass", "BsmtFinSF1", "Utilities", "Neighborhood", "District", "BuiltPeriod", "MiscVal"}
    assert not gone & set(fitted.features)
    assert {"BsmtFinSF2", "BsmtUnfSF", "TotalSF", "Area", "Antique", "SaleSeason"} <= set(fitted.features)
    assert {"District_CollgCr_Lower", "District_CollgCr_Upper", "District_OldTown_Lower", "District_Veenker_Upper"} <= set(fitted.features)


def test_scaling_ranges(prepared):
    fitted, out = prepared
    standard = [c for c in fitted.scaler.plan["standard"] if c in fitted.features]
    pdf = out.toPandas()
    for c in standard:
        assert abs(pdf[c].mean()) < 1e-9 and (math.isclose(pdf[c].std(ddof=0), 1) or pdf[c].nunique() == 1)
    for c in fitted.scaler.plan["minmax"]:
        assert pdf[c].min() >= 0 and pdf[c].max() <= 1
    dummies = [c for c in fitted.features if c.startswith("District_")]
    assert (pdf[dummies].sum(axis=1) == 1).all()


def test_test_year_is_fixed(houses):
    prepare = Preparation(house_plan())
    rows = prepare.gather(*houses)
    assert rows.where("Id = 2006").first()["GarageYrBlt"] == 2107.0


def test_fit_on_train_differs(houses):
    rows = Preparation(house_plan()).gather(*houses)
    both = Preparation(house_plan()).fit(rows).scaler.state
    alone = Preparation(house_plan(), fit_on="train")
    with_test_levels = alone.fit(rows).scaler.state
    assert both["standard", "LotFrontage"] != with_test_levels["standard", "LotFrontage"]


def test_recode_tables_end_in_ordinal_levels():
    levels = expand_keys(house.ORDINAL)
    for column, rules in expand_keys(house.RECODE).items():
        if column in levels:
            outputs = {v for v in compose(rules).values() if isinstance(v, str)}
            assert outputs <= set(levels[column]), column


def test_house_masks_and_flags(houses):
    train, _ = houses
    out = house.facility_flags(train)
    assert out.select("HasPool").distinct().count() == 1 and "IsNew" in out.columns
    assert house.numeric_flags(train).where("IsNew = 1").count() == train.where("YearBuilt > 2000").count()
    assert train.where(house.two_storey_mask()).count() == train.count()
    assert train.where(house.low_quality_mask()).count() == train.where("OverallQual < 6").count()
    assert train.where(house.cheap_mask()).count() == train.where("OverallQual < 3").count()


def test_house_model_matrix(spark, houses):
    train, _ = houses
    coded = train.withColumns({f"{c}_E": F.lit(1.0) + F.col("Id") % 3 for c in (
        "Condition1", "Condition2", "Foundation", "MSZoning", "MasVnrType", "HouseStyle", "CentralAir", "PavedDrive", "ExterQual",
        "LandSlope", "LotConfig", "SaleCondition", "Neighborhood", "BldgType", "PoolQC", "FireplaceQu", "KitchenQual", "GarageQual")})
    coded = coded.withColumn("GarageCond", F.lit(2.0))
    out = house.model_matrix().fit(coded).transform(coded)
    assert out.count() == train.count() and "Neighborhood_E:OverallQual" in out.columns and "SalePrice" in out.columns


# ---- sources ---------------------------------------------------------------------------------


def test_na_spellings_and_none_level(spark):
    path = scratch_path(spark, "csv")
    text = [("1", "NA", "None"), ("2", "", "a"), ("3", "nan", "N/A"), ("4", "2.5", 'say "x", y')]
    tables.write_table(spark.createDataFrame(text, "Id string, x string, s string"), path)
    rows = [tuple(r) for r in tables.read_table(spark, path, "Id long, x double, s string").orderBy("Id").collect()]
    assert rows == [(1, None, "None"), (2, None, "a"), (3, None, None), (4, 2.5, 'say "x", y')]


def test_append_and_split_back(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, x double")
    b = spark.createDataFrame([("p", 5)], "s string, id long")
    both = tables.load_inputs(a, b)
    assert {tuple(r) for r in both.select("id", "x", "s").collect()} == {(1, 2.0, None), (5, None, "p")}
    assert reshape.split_back(both, "test").select("id").first()[0] == 5


def test_saved_linear_model(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("1st.x"), (F.col("id") * 2.0 + 1).alias("y"))
    m = fit_linear(df.withColumnRenamed("1st.x", "x"), ["x"], "y", "linear")
    path = models.save_model(spark, m, scratch_path(spark, "m"), "linear")
    assert models.load_model(spark, path) == LinearModel(m.cols, m.coef, m.intercept)


def test_transform_applies_to_a_stream(spark, prepared, houses):
    """A fitted preparation is a projection, so it runs on a streaming frame unchanged."""
    fitted, batch = prepared
    train, test = houses
    rows = Preparation(house_plan()).gather(train, test)
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    query = fitted.transform(stream).writeStream.format("memory").queryName("prepared_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("prepared_stream").toPandas().sort_values("Id").reset_index(drop=True)
    want = batch.toPandas().sort_values("Id").reset_index(drop=True)
    assert np.allclose(got[fitted.features].to_numpy(float), want[fitted.features].to_numpy(float))
