"""Key bytes in Spark against Python's own, and their order."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import keys

NUMBERS = [0, 1, 2, 255, 256, 257, 65_535, 2**31, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 1]
STRINGS = ["", "a", "ab", "abc", "abcd", "b", "\x7f", "é", "éa", "日本", "zz", "a" * 64, "𝄞"]


@pytest.mark.parametrize("order", ["le", "be"])
def test_number_keys(spark, order):
    df = spark.createDataFrame([(Decimal(n),) for n in NUMBERS], T.StructType([T.StructField("n", keys.U64)]))
    got = df.select("n", keys.key_column(F.col("n"), keys.U64, order).alias("k")).orderBy("k").collect()
    assert {int(r["n"]): bytes(r["k"]) for r in got} == {n: keys.key_bytes(n, order) for n in NUMBERS}
    assert [int(r["n"]) for r in got] == sorted(NUMBERS, key=lambda n: keys.key_bytes(n, order))


def test_long_columns_have_the_same_keys(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS if n < 2**63], "n long")
    for order in ("le", "be"):
        got = df.select("n", keys.key_column(F.col("n"), T.LongType(), order).alias("k")).collect()
        assert all(bytes(r["k"]) == keys.key_bytes(r["n"], order) for r in got)


def test_string_keys_sort_as_bytes(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    by_key = [r["s"] for r in df.orderBy(keys.key_column(F.col("s"), T.StringType())).collect()]
    assert by_key == sorted(STRINGS, key=str.encode) == [r["s"] for r in df.orderBy("s").collect()]


def test_bits_round_trip(spark):
    rng = random.Random(5)
    raw = [b"", b"\x00", b"\xff\x80", *(rng.randbytes(rng.randint(1, 9)) for _ in range(20))]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "k binary")
    for r in df.select("k", keys.key_bits(F.col("k")).alias("bits"), keys.bits_to_key(keys.key_bits(F.col("k"))).alias("back")).collect():
        assert r["bits"] == "".join(f"{b:08b}" for b in r["k"]) and bytes(r["back"]) == bytes(r["k"])


def test_floor_log2(spark):
    got = spark.range(0, 70).select("id", keys.floor_log2(F.col("id")).alias("w")).collect()
    assert all(r["w"] == (r["id"].bit_length() - 1 if r["id"] > 1 else 0) for r in got)


def test_hex_bounds():
    assert keys.hex_bound("-") is None and keys.hex_bound("00ff") == b"\x00\xff"
    for bad in ("abc", "zz", "AB"):
        with pytest.raises(ValueError):
            keys.hex_bound(bad)


def test_out_of_range():
    with pytest.raises(ValueError):
        keys.key_bytes(2**64)
