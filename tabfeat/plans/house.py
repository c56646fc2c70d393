"""The housing table: which columns get which treatment. Everything here is a default argument elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tabfeat.functions.columns import any_of, q, right_closed_bin
from tabfeat.operators import derive, predicates
from tabfeat.operators.derive import ModelMatrix, season_flag

# ---- Fixed values: columns and rows with a special treatment -----------------------------------

KEY = "Id"
TARGET = "SalePrice"
OUTLIER_KEYS = [1299, 524, 935, 314]
YEAR_FIX = ("GarageYrBlt", 2200, -100)
CHEAP_BELOW = 200000
YEAR_EDGES = [1850, 1950, 1975, 2000, 2025]
NONE_COLUMNS = ["BsmtCond", "BsmtQual", "BsmtExposure", "BsmtFinType1", "BsmtFinType2", "GarageCond", "GarageFinish",
                "GarageQual", "GarageType", "MasVnrType", "PoolQC"]
MODE_COLUMNS = ["Electrical", "MSZoning"]
CODE_COLUMNS = ["MSSubClass", "OverallQual", "OverallCond", "BsmtFullBath", "BsmtHalfBath", "FullBath", "HalfBath",
                "Fireplaces", "GarageCars", "YrSold", "MoSold"]
QUADRATIC_COLUMNS = ["OverallQual", "YearBuilt", "YearRemodAdd", "TotalBsmtSF", "2ndFlrSF", "Neighborhood_E",
                     "RoofMatl_E", "GrLivArea"]
QUANTITATIVE = ["LotFrontage", "LotArea", "MasVnrArea", "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "TotalBsmtSF",
                "1stFlrSF", "2ndFlrSF", "LowQualFinSF", "GrLivArea", "GarageArea", "WoodDeckSF", "OpenPorchSF",
                "EnclosedPorch", "3SsnPorch", "ScreenPorch", "PoolArea", "MiscVal", "TotalSF", "Total_sqr_footage",
                "Total_porch_sf", "Area"]
ONEHOT_CODES = ["MSSubClass", "OverallQual", "MoSold", "YrSold"]
ONEHOT_EXCLUDED = ["Neighborhood"]
# BsmtFinSF2 and BsmtUnfSF are not in this list: the workflow keeps them
DROPPED = ["Id", "SalePrice", "MSSubClass", "BsmtFinSF1", "BsmtFinType1", "BsmtFinType2", "BsmtHalfBath",
           "Neighborhood", "Utilities", "YrSold", "MoSold", "MiscVal", "BuiltPeriod", "DataFile", "District"]
TWO_STOREY = ["2Story", "2.5Fin", "2.5Unf", "SFoyer", "SLvl"]
POOR = ["None", "Po", "Fa"]

# ---- Fixed values: weights of the summed features ---------------------------------------------

SUMS = {
    "YrBltAndRemod": {"YearBuilt": 1, "YearRemodAdd": 1},
    "TotalSF": {"TotalBsmtSF": 1, "1stFlrSF": 1, "2ndFlrSF": 1},
    "Total_sqr_footage": {"BsmtFinSF1": 1, "BsmtFinSF2": 1, "1stFlrSF": 1, "2ndFlrSF": 1},
    "Total_Bathrooms": {"FullBath": 1, "HalfBath": 0.5, "BsmtFullBath": 1, "BsmtHalfBath": 0.5},
    "Total_porch_sf": {"OpenPorchSF": 1, "3SsnPorch": 1, "EnclosedPorch": 1, "ScreenPorch": 1, "WoodDeckSF": 1},
    "Area": {"BsmtFinSF1": 0.8, "BsmtFinSF2": 0.8, "BsmtUnfSF": 0.6, "1stFlrSF": 1, "2ndFlrSF": 1, "WoodDeckSF": 0.8,
             "OpenPorchSF": 0.8, "EnclosedPorch": 0.8, "3SsnPorch": 0.9, "ScreenPorch": 0.9, "PoolArea": 0.8,
             "GarageArea": 1},
}

# ---- Fixed values: level merging, (old levels, new level) in order of application --------------

RECODE = {
    "BsmtCond": [(["Po"], "None")],
    "BldgType": [(["2fmCon", "Duplex", "Twnhs"], "Low"), (["TwnhsE", "1Fam"], "Moderate")],
    ("Condition1", "Condition2"): [(["Artery", "Feedr"], "Road"), (["RRAe", "RRAn", "RRNe", "RRNn"], "Railway"),
                                   (["PosN", "PosA"], "PosFeature")],
    "Electrical": [(["FuseA", "FuseF", "FuseP", "Mix"], "Low"), (["SBrkr"], "Moderate")],
    ("Exterior1st", "Exterior2nd"): [
        (["AsbShng", "AsphShn", "BrkComm", "Brk Cmn", "CBlock", "Missing"], "Low"),
        (["BrkFace", "HdBoard", "MetalSd", "Plywood", "Stucco", "Wd Sdng", "WdShing", "Wd Shng"], "Moderate"),
        (["CemntBd", "CmentBd", "ImStucc", "Other", "Stone", "VinylSd"], "High")],
    "Fence": [(["MnWw", "GdWo", "MnPrv", "GdPrv"], "Fence")],
    "Foundation": [(["Slab"], "Low"), (["BrkTil", "CBlock"], "Moderate"), (["Stone", "Wood", "PConc"], "High")],
    "Functional": [(["Maj1", "Maj2", "Sev", "Sal"], "Damaged"), (["Min1", "Min2", "Mod"], "Used")],
    "GarageCond": [(["Po"], "None"), (["Ex"], "Gd")],
    "GarageType": [(["CarPort", "None"], "Low"), (["2Types", "Detchd", "Basment"], "Moderate"),
                   (["Attchd", "BuiltIn"], "High")],
    "Heating": [(["Grav", "Floor", "OthW", "Wall"], "Low"), (["GasA", "GasW"], "Moderate")],
    "HouseStyle": [(["1.5Unf"], "Low"), (["1Story", "1.5Fin", "2.5Unf", "SFoyer", "SLvl"], "Moderate"),
                   (["2.5Fin", "2Story"], "High")],
    "LandSlope": [(["Mod", "Sev"], "Slope")],
    "LotConfig": [(["FR2", "FR3"], "Frontage")],
    "LotShape": [(["IR1", "IR2", "IR3"], "IR123")],
    "MasVnrType": [(["BrkCmn", "None"], "Low"), (["BrkFace"], "Moderate"), (["Stone"], "High")],
    "MiscFeature": [(["TenC", "Shed", "Othr", "Gar2", "Elev"], "MiscFeature")],
    "MSZoning": [(["RM", "RH"], "RM&H")],
    "Neighborhood": [
        (["Missing"], "0"), (["MeadowV", "IDOTRR", "BrDale", "BrkSide"], "1"),
        (["Edwards", "OldTown", "Sawyer", "Blueste", "SWISU", "NPkVill"], "2"), (["NAmes", "Mitchel"], "3"),
        (["SawyerW", "NWAmes"], "4"), (["Blmngtn", "CollgCr", "Gilbert", "Crawfor", "ClearCr"], "5"),
        (["Somerst", "Timber", "Veenker"], "6"), (["NoRidge", "NridgHt", "StoneBr"], "7")],
    "RoofMatl": [(["ClyTile", "CompShg", "Metal", "Roll", "Tar&Grv"], "Low"),
                 (["Membran", "WdShake", "WdShngl"], "Moderate")],
    "RoofStyle": [(["Gambrel"], "Low"), (["Gable"], "Moderate"), (["Flat", "Hip", "Mansard", "Shed"], "High")],
    "SaleType": [(["ConLD", "ConLw", "COD", "Oth"], "Low"), (["ConLI", "CWD", "WD", "VWD"], "Moderate"),
                 (["Con", "New"], "High")],
    "SaleCondition": [(["AdjLand"], "Low"), (["Abnorml", "Family"], "LowMid"), (["Alloca", "Normal"], "HighMid"),
                      (["Partial"], "High")],
    "Utilities": [(["NoSewr", "NoSeWa", "ELO"], "Low"), (["AllPub"], "Moderate")],
    "BedroomAbvGr": [([0], 1), ([5, 6, 7, 8], 4)],
    "BsmtFullBath": [([2, 3, 4], 1)],
    "BsmtHalfBath": [([2, 3, 4], 1)],
    "Fireplaces": [([4], 3)],
    "GarageCars": [([4, 5], 3)],
    "HalfBath": [([2], 1)],
    "KitchenAbvGr": [([0], 1), ([3], 2)],
    "OverallQual": [([1], 2)],
    "PoolQC": [([2, 3, 4, 5], 1)],
    "TotRmsAbvGrd": [([1, 2], 3), ([13, 14, 15], 12)],
}

# ---- Fixed values: order of the levels of ordinal columns --------------------------------------

ORDINAL = {
    ("Alley", "Street"): ["Missing", "Grvl", "Pave"],
    "BsmtExposure": ["None", "No", "Mn", "Av", "Gd"],
    ("BsmtCond", "BsmtQual", "GarageCond", "GarageQual", "PoolQC"): ["None", "Po", "Fa", "TA", "Gd", "Ex"],
    ("BsmtFinType1", "BsmtFinType2"): ["None", "Unf", "LwQ", "Rec", "BLQ", "ALQ", "GLQ"],
    ("ExterCond", "ExterQual", "FireplaceQu", "HeatingQC", "KitchenQual"): ["Missing", "Po", "Fa", "TA", "Gd", "Ex"],
    "CentralAir": ["Missing", "N", "Y"],
    ("Condition1", "Condition2"): ["Missing", "Road", "Railway", "Norm", "PosFeature"],
    ("BldgType", "Electrical", "Heating", "RoofMatl", "Utilities"): ["Missing", "Low", "Moderate"],
    ("Exterior1st", "Exterior2nd", "Foundation", "GarageType", "HouseStyle", "MasVnrType", "RoofStyle", "SaleType"):
        ["Missing", "Low", "Moderate", "High"],
    "Fence": ["Missing", "Fence"],
    "Functional": ["Missing", "Damaged", "Used", "Typ"],
    "GarageFinish": ["None", "Unf", "RFn", "Fin"],
    "LandContour": ["Missing", "Bnk", "Lvl", "Low", "HLS"],
    "LandSlope": ["Missing", "Gtl", "Slope"],
    "LotShape": ["Missing", "Reg", "IR123"],
    "LotConfig": ["Missing", "Inside", "Frontage", "Corner", "CulDSac"],
    "MiscFeature": ["Missing", "MiscFeature"],
    "MSZoning": ["Missing", "C (all)", "RM&H", "RL", "FV"],
    "PavedDrive": ["Missing", "N", "P", "Y"],
    "SaleCondition": ["Missing", "Low", "LowMid", "HighMid", "High"],
}

# ---- Fixed values: terms of the design matrix --------------------------------------------------

MATRIX = dict(
    main=["GarageCars", "ScreenPorch", "Condition1_E", "Condition2_E", "WoodDeckSF", "Foundation_E", "MSZoning_E",
          "MasVnrType_E", "HouseStyle_E", "Fireplaces", "CentralAir_E", "BsmtFullBath", "EnclosedPorch",
          "PavedDrive_E", "ExterQual_E", "OverallQual", "GrLivArea", "1stFlrSF", "2ndFlrSF", "TotalBsmtSF",
          "KitchenAbvGr", "YearBuilt", "Neighborhood_E"],
    log1p=["BsmtFinSF1", "LotArea"],
    squares=["OverallQual", "GrLivArea", "1stFlrSF", "2ndFlrSF", "TotalBsmtSF", "KitchenAbvGr", "YearBuilt",
             "Neighborhood_E"],
    products=[("Neighborhood_E", "OverallQual"), ("MSSubClass", "BldgType_E"), ("ExterQual_E", "OverallQual"),
              ("PoolArea", "PoolQC_E"), ("Fireplaces", "FireplaceQu_E"), ("OverallQual", "KitchenQual_E"),
              ("GarageQual_E", "GarageCond"), ("GarageArea", "GarageCars"), ("1stFlrSF", "TotalBsmtSF"),
              ("TotRmsAbvGrd", "GrLivArea")],
    splines={"OverallCond": 7, "MSSubClass": 7, "LotArea": 2, "FullBath": 3, "HalfBath": 2, "BsmtFullBath": 3,
             "TotRmsAbvGrd": 2, "LandSlope_E": 2, "LotConfig_E": 2, "SaleCondition_E": 3},
)
AREA_GROUPS = {
    "PCABsmtSF": ["BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF"],
    "PCALivArea": ["1stFlrSF", "2ndFlrSF", "WoodDeckSF", "OpenPorchSF", "EnclosedPorch", "3SsnPorch", "ScreenPorch",
                   "PoolArea"],
}


def model_matrix() -> ModelMatrix:
    return ModelMatrix(TARGET, **MATRIX)


def low_quality_mask() -> Column:
    return predicates.low_quality("OverallQual", 6)


def two_storey_mask() -> Column:
    return predicates.member("HouseStyle", TWO_STOREY)


def cheap_mask() -> Column:
    """Any one sign of a low price."""
    return any_of(
        q("MSZoning") == "C (all)", q("Neighborhood").isin("BrDale", "MeadowV"), q("OverallQual") < 3,
        q("ExterQual").isin(POOR), q("BsmtExposure") == "Missing", q("Heating") == "Grav", q("KitchenQual").isin(POOR),
        q("GarageType") == "Missing", q("GarageQual").isin(POOR), q("SaleCondition") == "AdjLand",
    )


def facility_flags(df: DataFrame) -> DataFrame:
    """'Y'/'N' columns."""
    parts = {"HasBasement": "TotalBsmtSF", "HasGarage": "GarageArea", "HasMasVnr": "MasVnrArea",
             "HasPorch": "OpenPorchSF", "HasPool": "PoolArea"}
    flags = {n: q(c) > 0 for n, c in parts.items()} | {"IsNew": q("SaleType") == "New"}
    return predicates.flag_columns(df, flags)


def numeric_flags(df: DataFrame) -> DataFrame:
    """0/1 columns; here a new house is one built after 2000."""
    parts = {"HasBasement": "TotalBsmtSF", "HasGarage": "GarageArea", "Has2ndFloor": "2ndFlrSF",
             "HasMasVnr": "MasVnrArea", "HasWoodDeck": "WoodDeckSF", "HasPorch": "OpenPorchSF", "HasPool": "PoolArea"}
    flags = {n: q(c) > 0 for n, c in parts.items()} | {"IsNew": q("YearBuilt") > 2000}
    return predicates.flag_columns(df, flags, 1, 0)


def additional_features(df: DataFrame, marked_key=None, months=(7,)) -> DataFrame:
    """Season, building period, marked row, sums of areas and years, district; one projection over the row."""
    df = df.withColumns({"YrSold": q("YrSold").cast("long"), "MoSold": q("MoSold").cast("long")})
    df = derive.sums(df, SUMS)
    df = df.withColumns({
        "SaleSeason": season_flag(q("MoSold"), months),
        "BuiltPeriod": right_closed_bin(q("YearBuilt"), YEAR_EDGES),
        "District": derive.district_tag(q("Neighborhood"), low_quality_mask()),
    })
    return derive.row_marker(df, KEY, marked_key, "Antique")
