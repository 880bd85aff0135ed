from decimal import Decimal

from pyspark.sql import functions as F

from ledgerframe.functions import binary
from ledgerframe.functions import columns as C


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_assets(spark):
    texts = {"1.0000 SYM": (10000, 4, "SYM"), "-0.05 A": (-5, 2, "A"), "100 WAX": (100, 0, "WAX"), ".5 X": (5, 1, "X"), "5. X": (5, 0, "X")}
    for t, want in texts.items():
        a = one(spark, C.parse_asset(F.lit(t)))
        assert (a.units, a.precision, a.symbol) == (Decimal(want[0]), *want[1:])
    for t in ("", "1.0", ". X", "1 TOOLONGSYM", "1 sym", "x X", "1  X"):
        assert one(spark, C.parse_asset(F.lit(t))) is None
    assert one(spark, C.format_units(F.lit(-5).cast("decimal(38,0)"), F.lit(4))) == "-0.0005"
    assert one(spark, C.format_units(F.lit(5), F.lit(0))) == "5"


def test_times(spark):
    assert one(spark, C.slot_iso(F.lit(1419922240))) == "2022-07-01T03:25:20.000"
    assert one(spark, F.unix_timestamp(C.parse_utc(F.lit("1970-01-01T00:00:10.5Z")))) == 10
    assert one(spark, C.parse_utc(F.lit("junk"))) is None
    assert one(spark, C.age_seconds(F.lit("1970-01-01").cast("timestamp"), F.lit("1971-01-01").cast("timestamp"))) == 0


def test_numbers(spark):
    assert [one(spark, C.js_number(F.lit(x))) for x in (3.0, 0.5)] == ["3", "0.5"]
    for x in (0, 1, -1, 2**62, -(2**62)):
        assert one(spark, C.zigzag_decode(C.zigzag_encode(F.lit(x).cast("long")))) == x
    assert one(spark, C.unsigned(F.lit(-1).cast("long"))) == Decimal(2**64 - 1)
    assert one(spark, C.fixed_rate(F.lit(-7), F.lit(1), F.lit(2))) == -3
    assert one(spark, C.fixed_rate(F.lit(7), F.lit(1), F.lit(0))) == 0


def test_text(spark):
    assert one(spark, C.snapshot_block(F.lit("/x/snapshot-" + "0000000a" + "f" * 56 + ".bin.zst"))) == 10
    assert one(spark, C.snapshot_block(F.lit("wax-2024-437.bin"))) == 437
    assert one(spark, C.query_map(F.lit("a=1&b=&a=2=3"))) == {"a": "2=3", "b": ""}
    assert one(spark, C.merge_maps(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}


def test_binary(spark):
    df = spark.createDataFrame([("eosio",), ("zzz",), (None,)], "n string")
    got = df.select("n", binary.name_number("n").alias("k"), binary.fnv1a64("n").alias("h")).collect()
    assert got[0].k == Decimal(6138663577826885632) and got[2].k is None
    back = spark.createDataFrame([(6138663577826885632,)], "k long").select(binary.name_text("k").alias("n")).first()
    assert back.n == "eosio"
