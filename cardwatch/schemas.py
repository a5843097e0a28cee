"""Column lists and types of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TS = "trans_date_trans_time"
LABEL = "is_fraud"

# The transaction log, in file order.
TRANSACTIONS_RAW = T.StructType(
    [
        T.StructField("trans_date_trans_time", T.TimestampType()),
        T.StructField("cc_num", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amt", T.DoubleType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("city_pop", T.IntegerType()),
        T.StructField("job", T.StringType()),
        T.StructField("dob", T.DateType()),
        T.StructField("trans_num", T.StringType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("merch_lat", T.DoubleType()),
        T.StructField("merch_long", T.DoubleType()),
        T.StructField("merch_zipcode", T.DoubleType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)

# Everything a scoring request carries: the log without its label.
API_FIELDS = [f.name for f in TRANSACTIONS_RAW.fields if f.name != LABEL]

# The same without the id: what a stored prediction repeats of its transaction.
PAYLOAD_TYPES = {f.name: f.dataType for f in TRANSACTIONS_RAW.fields if f.name not in (LABEL, "trans_num")}

# The labelled table stores "long" under another name.
STORED_NAMES = {"long": "longitude"}
TRANSACTION_COLUMNS = [STORED_NAMES.get(f.name, f.name) for f in TRANSACTIONS_RAW.fields]

RISK_TYPE = T.DecimalType(12, 6)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("trans_num", T.StringType()),
        *[T.StructField(name, dtype) for name, dtype in PAYLOAD_TYPES.items()],
        T.StructField("risk_score", RISK_TYPE),
        T.StructField("prediction", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

PREDICTION_BATCHES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("batch_hash", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("threshold", T.DecimalType(10, 4)),
        T.StructField("total_transactions", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Columns that identify or leak rather than describe: never model inputs.
# Columns that modelling leaves out.
DOMAIN_DROPS = (
    "Unnamed: 0",
    "trans_num",
    "first",
    "last",
    "street",
    "cc_num",
    "unix_time",
    "trans_date_trans_time",
    "dob",
)

# Columns worth a leakage review before modelling.
# Columns looked at for leakage.
LEAKAGE_CANDIDATES = ("trans_num", "unix_time", "merch_lat", "merch_long", "lat", "long", "dob")

ENGINEERED_PATTERN = r"^[ATL]\d+_"
