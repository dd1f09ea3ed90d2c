import pytest
from pyspark.sql import functions as F

from tandem.functions import columns as C
from tandem.operators import decoders


def test_actions(spark):
    rows = [("all_in", 10, 5, "push"), ("all_in", 5, 5, "match"), ("fold", 0, 5, "exit"), ("raise", 9, 5, "push"), ("call", 5, 5, "match"), ("check", 0, 0, "hold"), (None, 0, 0, None)]
    df = spark.createDataFrame(rows, "a string, amount int, to_call int, want string")
    assert df.where(~C.action_class(F.col("a"), F.col("amount"), F.col("to_call")).eqNullSafe(F.col("want"))).count() == 0
    ok = spark.createDataFrame([(" All-In ",), ("ALL IN",), (None,)], "a string")
    assert [r[0] for r in ok.select(C.normalize_action(F.col("a"), ["all_in"])).collect()] == ["all_in", "all_in", None]
    with pytest.raises(Exception, match="unknown action"):
        spark.createDataFrame([("bluff",)], "a string").select(C.normalize_action(F.col("a"), ["all_in"])).collect()


def test_transfer_and_transforms(spark):
    df = spark.createDataFrame([(-40.0, 30.0, 2.0), (30.0, -40.0, 0.0)], "a double, b double, unit double")
    got = df.select(C.per_unit(C.directed_transfer(F.col("a"), F.col("b")), F.col("unit")), C.directed_transfer(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(15.0, 0.0), (None, 30.0)]
    one = spark.range(1).select(C.expit(C.clipped_logit(F.lit(0.3))), C.signed_log(F.lit(-1.0)), C.surprisal(F.lit(0.0)), C.encode(F.lit("x"), {"x": 4})).first()
    assert one[0] == pytest.approx(0.3) and one[1] == pytest.approx(-0.6931471) and one[2] == pytest.approx(13.8155106) and one[3] == 4


def test_two_types_by_enumeration(spark):
    import itertools

    rows = [(1, 2, e, e, a, b) for e, (a, b) in enumerate([(0.3, 0.2), (0.1, 0.6), (0.5, 0.1), (0.2, 0.3)])]
    got = {r["episode"]: r["decoded"] for r in decoders.two_type_decoder(spark.createDataFrame(rows, "lo long, hi long, episode long, ts long, p_a double, p_b double"), 2).collect()}
    want = dict.fromkeys(got, 0.0)
    for kinds in itertools.product("ABN", repeat=4):
        chance = 1.0
        for kind, r in zip(kinds, rows, strict=True):
            chance *= {"A": r[4], "B": r[5], "N": 1 - r[4] - r[5]}[kind]
        for e in [*(i for i, x in enumerate(kinds) if x == "A"), *(i for i, x in enumerate(kinds) if x == "B")][:2]:
            want[e] += chance
    assert got == pytest.approx(want)
