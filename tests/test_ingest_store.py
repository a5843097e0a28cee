import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ingest, store
from cardwatch.schemas import API_FIELDS, PREDICTION_BATCHES, PREDICTIONS
from cardwatch.sources import io

EXAMPLE = {
    "trans_date_trans_time": "2019-01-01 00:00:18", "cc_num": "2703186189652095", "merchant": "Rippin, Kub and Mann", "category": "misc_net",
    "amt": "4.97", "first": "Jennifer", "last": "Banks", "gender": "F", "street": "561 Perry Cove", "city": "Moravian Falls", "state": "NC",
    "zip": "28654", "lat": "36.0788", "long": "-81.1781", "city_pop": "3495", "job": "Psychologist, counselling", "dob": "1988-03-09",
    "trans_num": "t1", "unix_time": "1325376018", "merch_lat": "36.0113", "merch_long": "-82.0483", "merch_zipcode": "28705.0",
}


def frame(spark, *changes):
    rows = [{**EXAMPLE, **c} for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in API_FIELDS) for r in rows], ", ".join(f"`{c}` string" for c in API_FIELDS))


def test_valid_example(spark):
    valid, rejected = ingest.validate_transactions(frame(spark, {}, {"trans_num": "t2", "merch_zipcode": "28,705.0"}, {"trans_num": "t3", "merch_zipcode": ""}))
    assert rejected.count() == 0
    assert [r["merch_zipcode"] for r in valid.orderBy("trans_num").collect()] == [28705.0, 28705.0, None]
    assert dict(valid.dtypes)["cc_num"] == "bigint" and dict(valid.dtypes)["dob"] == "date"


@pytest.mark.parametrize(
    "change, error",
    [
        ({"cc_num": "0"}, "cc_num: below 1"),
        ({"amt": "-1"}, "amt: below 0"),
        ({"amt": "abc"}, "amt: wrong type"),
        ({"trans_date_trans_time": "garbage"}, "trans_date_trans_time: wrong type"),
        ({"merchant": ""}, "merchant: shorter than 1"),
        ({"gender": "FM"}, "gender: longer than 1"),
        ({"state": "NCX"}, "state: longer than 2"),
        ({"lat": "90.5"}, "lat: above 90"),
        ({"long": "-181"}, "long: below -180"),
        ({"dob": None}, "dob: required"),
        ({"trans_num": ""}, "trans_num: shorter than 1"),
    ],
)
def test_rejections(spark, change, error):
    valid, rejected = ingest.validate_transactions(frame(spark, change))
    assert valid.count() == 0 and rejected.first()["errors"] == [error]


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError, match="extra"):
        ingest.validate_transactions(frame(spark, {}).withColumn("extra", F.lit(1)))


def test_clean_keeps_the_declared_first_row(spark):
    raw = spark.createDataFrame(
        [("a", 2, None, "x", 1.0), ("a", 1, 5.0, "2024-01-01 10:00:00", 2.0), ("b", 1, None, "2024-01-01 10:00:00", 3.0)],
        "trans_num string, line int, amt double, trans_date_trans_time string, long double",
    )
    got = {r["trans_num"]: r for r in ingest.clean_transactions(raw, ["line"]).collect()}
    assert got["a"]["amt"] == 5.0 and got["b"]["amt"] == 0.0 and got["a"]["longitude"] == 2.0
    assert "city" in ingest.missing_columns(raw) and "longitude" not in ingest.missing_columns(raw)


def test_ids_are_filled_repeatably(spark):
    raw = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "trans_num string, amt int")
    one, two = (sorted(r[0] for r in ingest.ensure_trans_num(raw).select("trans_num").collect()) for _ in range(2))
    assert one == two and len(set(one)) == 3


def test_contract_lists_what_is_missing(spark):
    with pytest.raises(ValueError, match="b, c"):
        ingest.assert_model_schema(spark.range(1).withColumnRenamed("id", "a"), ["a", "b", "c"])
    with pytest.raises(ValueError, match="trans_num"):
        ingest.select_api_fields(frame(spark, {}).drop("trans_num"))


def scored(spark, score=0.7, nums=("t1", "t2")):
    return frame(spark, *[{"trans_num": n} for n in nums]).withColumns({"risk_score": F.lit(score), "prediction": F.lit(1)})


def test_storing_twice_changes_nothing(spark):
    batches, preds = spark.createDataFrame([], PREDICTION_BATCHES), spark.createDataFrame([], PREDICTIONS)
    batches, preds = store.persist_batch(batches, preds, scored(spark), "m", 0.5, "2024-01-01")
    again, twice = store.persist_batch(batches, preds, scored(spark, 0.1), "m", 0.5, "2024-01-02")
    assert twice.count() == 2 and again.count() == 1
    # The first score wins, the header keeps its creation time.
    assert {float(r["risk_score"]) for r in twice.collect()} == {0.7}
    assert again.first()["created_at"] == batches.first()["created_at"]


def test_hash_ignores_order_and_scores_but_not_content(spark):
    def digest(*nums, model="m", threshold=0.5):
        return store.batch_hash(scored(spark, nums=nums), model, threshold).first()["batch_hash"]

    base = digest("a", "b")
    assert base == digest("b", "a")
    assert len({base, digest("a"), digest("a", "c"), digest("a", "b", "b"), digest("a", "b", model="x"), digest("a", "b", threshold=0.6)}) == 6


def test_backfill_does_not_multiply_rows(spark):
    pred = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "trans_num string, amt double")
    tx = spark.createDataFrame([("a", 5.0, 9.5), ("a", 6.0, 9.5)], "trans_num string, amt double, longitude double")
    got = {r["trans_num"]: r for r in store.backfill_predictions(pred, tx).collect()}
    assert len(got) == 2 and got["a"]["amt"] == 5.0 and got["a"]["long"] == 9.5 and got["b"]["amt"] == 1.0 and got["b"]["long"] is None


def test_csv_round_trip_and_bad_values(spark, tmp_path):
    path = str(tmp_path / "csv")
    io.write_csv(frame(spark, {}, {"trans_num": "t2", "amt": "oops"}), path)
    back = {r["trans_num"]: r for r in io.read_transactions_csv(spark, path).collect()}
    assert back["t1"]["amt"] == 4.97 and back["t2"]["amt"] is None
    target = str(tmp_path / "parquet")
    io.csv_to_parquet(spark, path, target)
    assert io.read_parquet(spark, target).count() == 2
