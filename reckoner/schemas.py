"""Table contracts. ``check_schema`` guards the public entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _STR, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# (ts, k1, k2, item_id) is the total order of one user's rows.
INTERACTIONS = _struct(
    user_id=_LONG, item_id=_LONG, invoice_id=_STR, quantity=_INT, unit_price=_DOUBLE, ts=_TS, k1=_LONG, k2=_LONG
)
ITEM_CATALOG = _struct(item_id=_LONG, stock_code=_STR, description=_STR)
USER_CATALOG = _struct(user_id=_LONG, customer_id=_STR)
PAIRS = _struct(user_id=_LONG, item_id=_LONG)
RECS = _struct(user_id=_LONG, item_id=_LONG, score=_DOUBLE, rank=_INT)
RESULTS = _struct(split=_STR, model=_STR, metric=_STR, k=_INT, value=_DOUBLE, n_users=_LONG)

RAW_RATINGS = _struct(user_id=_STR, parent_asin=_STR, rating=_DOUBLE, timestamp=_LONG)
RAW_META = T.StructType(
    [
        T.StructField("parent_asin", _STR),
        T.StructField("title", _STR),
        T.StructField("main_category", _STR),
        T.StructField("average_rating", _DOUBLE),
        T.StructField("rating_number", _LONG),
        T.StructField("price", _STR),
        T.StructField("store", _STR),
        T.StructField("categories", T.ArrayType(_STR)),
        T.StructField("features", T.ArrayType(_STR)),
        T.StructField("description", T.ArrayType(_STR)),
    ]
)
RETAIL_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
)


def check_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Raise unless ``df`` has every contract column with the contract type (extra columns are fine)."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, got "
        + (actual[f.name].simpleString() if f.name in actual else "nothing")
        for f in contract.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise TypeError("schema mismatch: " + "; ".join(wrong))
    return df
