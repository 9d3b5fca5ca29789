import hashlib

from pyspark.sql import functions as F

from strandwork.functions.hashing import hash52, uniform
from strandwork.functions.sequence import framed, normalised, rejection, token_ids


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_normalised(spark):
    cases = {None: None, "": "", " \t\n\r": "", "ac*dE**": "ACXDE", "a b\nc*": "ABC", "é1-": "XXX", "😀A": "XA", "straße": "STRASSE", "xbuzo": "XBUZO", "***": "", "A\x0bB": "AXB", "J": "X"}
    for raw, wanted in cases.items():
        assert one(spark, raw, normalised) == wanted, raw


def test_rejection(spark):
    wanted = {None: "missing", "A" * 59: "short", "A" * 60: None, "A" * 16385: "long", "A" * 80 + "X" * 20: None, "A" * 79 + "X" * 21: "ambiguous"}
    for raw, reason in wanted.items():
        assert one(spark, raw, rejection) == reason


def test_tokens_and_frames(spark):
    assert one(spark, "LAC?O", token_ids) == [4, 5, 23, 3, 28]
    assert one(spark, "", token_ids) == []
    assert one(spark, "LAG", lambda c: framed(token_ids(c), 6)) == [0, 4, 5, 6, 2, 1]
    assert one(spark, "LAGV", lambda c: framed(token_ids(c), 4, 1)) == [0, 5, 6, 2]


def test_hashes(spark):
    value = int(hashlib.sha256(b"20260820:7").hexdigest()[:13], 16)
    row = spark.range(7, 8).select(hash52(20260820, F.col("id")).alias("h"), uniform(20260820, F.col("id")).alias("u")).first()
    assert row["h"] == value and abs(row["u"] - 0.45329714713650815) < 1e-15
