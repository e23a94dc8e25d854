"""Quantities, unit states, nested records and references."""

import json
from datetime import datetime

import pytest

from stockpot.operators.flatten import Child, emit_tagged, read_table, read_tagged, write_tagged
from stockpot.operators.quantities import Grammar, read_quantities
from stockpot.operators.references import Reference, orphan_cascade, parent_states
from stockpot.operators.unit_states import decode_units, viterbi
from stockpot.runtime import skew_left_join

UNITS = [
    ("g", "g", 1000, ["g", "克"]), ("kg", "g", 1000000, ["kg", "千克"]), ("jin", "g", 500000, ["斤", "市斤"]), ("liang", "g", 50000, ["两", "市两"]), ("oz", "g", 28350, ["oz", "盎司"]),
    ("lb", "g", 453592, ["lb", "磅"]), ("ml", "ml", 1000, ["ml", "毫升", "cc"]), ("litre", "ml", 1000000, ["l", "升"]), ("tbsp", "ml", 15000, ["tbsp", "大匙"]), ("tsp", "ml", 5000, ["tsp", "小匙"]),
    ("cup", "ml", 240000, ["cup", "杯"]), ("floz", "ml", 29574, ["fl oz", None, ""]),
]


@pytest.mark.parametrize(
    "amount, want",
    [
        ("1½ cups", ("ml", 360000)), ("两千克半", ("g", 2500000)), ("一斤半 (750g)", ("g", 750000)), ("1 can (三百五十克)", ("g", 350000)), ("1盒(1,000ml)", ("ml", 1000000)),
        ("2 fl. oz.", ("ml", 59148)), ("3大匙 + 2小匙", ("ml", 55000)), ("2大匙~3大匙", ("ml", 37500)), ("１，５００克", ("g", 1500000)), ("ca. 四大匙、1/2 tsp", ("ml", 62500)),
        ("3斤5两", ("g", 1750000)), ("二两", ("g", 100000)), ("1-2杯 approx", ("ml", 360000)), ("1LB(约454g)", ("g", 453592)), ("30㎖", ("ml", 30000)), ("1/3 杯", ("ml", 80000)),
        ("两 pcs", None), ("10", None), ("适量", None), ("", None), (None, None), ("半个", None), ("1 large egg", None), ("100g 2杯", None), ("x" * 5000, None), ("1/0 g", None),
    ],
)
def test_amounts(amount, want):
    assert Grammar(UNITS).read(amount) == want


def test_read_quantities(spark):
    rows = [(1, "10", "面粉(克)"), (2, "1.5", "盐 [ｋｇ]"), (3, "10", "盐"), (4, None, "盐/g"), (5, "2杯", None), (6, "适量", "盐(g)"), (7, "3", "盐 单位:tѕр")]
    df = spark.createDataFrame(rows, "id long, amount string, name string").selectExpr("*", "'old' AS bare")
    got = {r.id: (r.base_unit, r.quantity_milli, r.bare) for r in read_quantities(df, "amount", UNITS, "name").collect()}
    assert got[1] == ("g", 10000, 10.0) and got[2][:2] == ("g", 1500000) and got[3] == (None, None, 10.0) and got[4] == (None, None, None)
    assert got[5] == ("ml", 480000, None) and got[6] == (None, None, None) and got[7][:2] == ("ml", 15000)
    assert read_quantities(df.where("false"), "amount", UNITS).count() == 0


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng, factors = np.random.default_rng(3), np.array([1.0, 10.0, 1000.0])
    for _ in range(20):
        v, level = 10 ** rng.uniform(-1, 3, 5), 2.0
        got = viterbi(v, level, factors, 0, 2, 0.8, 0.5)

        def score(path):
            fit = sum(-0.5 * ((np.log10(x) + np.log10(factors[s]) - level) / 0.5) ** 2 for x, s in zip(v, path))
            whole = (0, *path, 2)
            return fit + sum(np.log(0.8 if a == b else 0.1) for a, b in zip(whole, whole[1:]))

        assert tuple(got) == max(itertools.product(range(3), repeat=5), key=score)


def test_decode_units(spark):
    rows = [("d", 1, i, 500.0 + i, "g") for i in range(5)] + [("d", 1, 5 + i, 0.5, None) for i in range(4)] + [("d", 1, 20, 510.0, None), (None, 1, 1, 2.0, None), ("e", 1, 1, -1.0, None)]
    got = decode_units(spark.createDataFrame(rows, "device string, period int, seq int, value double, unit string"), {"g": 1.0, "kg": 1000.0}, block=2, context=2)
    out = {(r.device, r.seq): r.decoded for r in got.collect()}
    assert all(out["d", 5 + i] == "kg" for i in range(4)) and out["d", 20] == "g" and out["d", 0] == "g"
    assert out[None, 1] is None and out["e", 1] is None


def test_units_over_blocks_and_periods(spark):
    """Blocks and periods give the path of the whole chain, with the states of both bases apart."""
    import numpy as np

    rng, units, bases = np.random.default_rng(8), {"g": 1.0, "jin": 500.0, "ml": 1.0, "cup": 240.0}, {"g": "m", "jin": "m", "ml": "v", "cup": "v"}
    names, factors, group = list(units), np.array(list(units.values())), np.array([0, 0, 1, 1])
    fixed = [("s", 1, i, 300.0, "g") for i in range(40)] + [("s", 1, 50 + i, 2.0, "cup") for i in range(30)]
    for trial in range(4):
        # the level of each base is that of device s; the periods of x but the outer ones have no stated unit
        values = 10 ** rng.uniform(-0.5, 2.5, 43)
        chain = [("x", 2 + i // 9, i, float(v), None) for i, v in enumerate(values)]
        if trial % 2:
            chain = [("x", 0, -1, 0.6, "jin"), *chain, ("x", 9, 90, 300.0, "g")]
        rows = spark.createDataFrame(fixed + chain, "device string, period int, seq int, value double, unit string")
        got = {r.seq: r.decoded for r in decode_units(rows, units, block=4, bases=bases).where("device = 'x'").collect()}
        vol, share = np.log10(480), np.array([3 / 4, 1 / 4] if trial % 2 else [1 / 2, 1 / 2])
        level = np.where(group == 0, np.log10(300), vol)
        first, last = (1, 0) if trial % 2 else (-1, -1)
        want = viterbi(values, level, factors, first, last, 0.9, 0.5, share[group] / 2)
        assert [got[i] for i in range(43)] == [names[j] for j in want]


def test_p5_units_keeps_the_stated_unit(spark, tmp_path):
    from stockpot.plans.records import p5_units

    rows = [("rice", a, d) for d, a in enumerate(["2斤", "2", "3斤", "300g", "280", "310g"])] + [("milk", a, d) for d, a in enumerate(["2 cups", "1", "2杯", "30ml", "28", "31ml"])]
    items = [(i, datetime(2024, 1 + 2 * d, 1), n, a) for i, (n, a, d) in enumerate(rows)]
    spark.createDataFrame(items, "item_id long, crawled_at timestamp_ntz, name string, amount string").write.parquet(f"{tmp_path}/crawled_ingredients.parquet")
    spark.createDataFrame(UNITS, "unit_code string, base_unit string, factor_milli long, labels array<string>").write.parquet(f"{tmp_path}/measure_units.parquet")
    used = [(5, 7, "3", datetime(2024, 5, 1)), (5, 7, "3", datetime(2024, 6, 1)), (4, 7, "2kg", datetime(2024, 5, 1)), (6, 7, "适量", None), (6, None, "1", None)]
    spark.createDataFrame(used, "recipe_id long, ingredient_id long, amount string, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/recipe_ingredients.parquet")
    rows = p5_units(spark, str(tmp_path)).collect()
    assert [(r.row_id, r.ref_id, r.value, r.decoded) for r in rows if r.source_table == "recipe_ingredients"] == [(5, 7, 3.0, "kg")]
    got = {(r.device, r.value): r.decoded for r in rows if r.source_table == "crawled_ingredients"}
    assert got == {("rice", 2.0): "jin", ("rice", 280.0): "g", ("milk", 1.0): "cup", ("milk", 28.0): "ml"}


LISTS = (Child("ingredients", "name", (Child("items", "name"),)), Child("steps", "instruction", (Child("substeps", "instruction"),)))


def test_flatten(spark):
    recipe = {"ingredients": ["盐", {"name": "糖", "amount": 3}, None, {"group": "g", "items": [{"name": "a"}, "b", {}]}, {"name": " "}], "steps": {"instruction": "do", "substeps": "one"}}
    bodies = [json.dumps({"recipe": recipe}), json.dumps({"recipe": json.dumps({"ingredients": "x"})}), '{"recipe": {"ingredients": [', "[]", None, '{"recipe": null}', '{"recipe": "no"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string").selectExpr("*", "1 AS tag")
    path = write_tagged(emit_tagged(df, "id", "body", "recipe", LISTS))
    got = {(r.doc_key, r.tag, r.parent_pos, r.pos, r.text) for r in read_tagged(spark, path).collect()}
    assert got == {
        (0, "ingredients", 0, 1, "盐"), (0, "ingredients", 0, 2, "糖"), (0, "ingredients", 0, 4, None), (0, "ingredients.items", 4, 1, "a"), (0, "ingredients.items", 4, 2, "b"),
        (0, "ingredients.items", 4, 3, None), (0, "ingredients", 0, 5, " "), (0, "steps", 0, 1, "do"), (0, "steps.substeps", 1, 1, "one"), (1, "ingredients", 0, 1, "x"),
    }
    flat = read_table(spark, path, "ingredients", "name string, amount int").where("text = '糖'").first()
    assert flat.amount == 3
    links = read_tagged(spark, path, "ingredients.items").join(read_tagged(spark, path, "ingredients").selectExpr("doc_key", "pk AS parent"), ["doc_key", "parent"])
    assert links.count() == 3
    assert read_tagged(spark, write_tagged(emit_tagged(df.where("false"), "id", "body", "recipe", LISTS))).count() == 0


def test_cascade(spark):
    t = datetime(2024, 5, 1)
    a = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, datetime(2024, 6, 1)), (2, datetime(2024, 7, 1))], "id long, created timestamp_ntz")
    gone = spark.createDataFrame([(9,), (1,)], "recipe_id long")
    states = parent_states(a, "id", "created", gone, "recipe_id")
    b = spark.createDataFrame([(10, 1, t), (11, 9, t), (11, 9, t), (12, 8, t), (13, 2, t), (14, None, t), (15, 2, None)], "row_id long, ref_id long, ref_time timestamp_ntz")
    c = spark.createDataFrame([(20, 11, t), (21, 10, t), (22, 13, t)], "row_id long, ref_id long, ref_time timestamp_ntz")
    d = spark.createDataFrame([(30, 20, t), (31, 30, t)], "row_id long, ref_id long, ref_time timestamp_ntz")
    graph = [Reference("b", b, "a", states), Reference("c", c, "b", None), Reference("d", d, "c", None), Reference("d", d, "d", None)]
    got = {(r.source_table, r.row_id): (r.reason, r.cause, r.depth) for r in orphan_cascade(graph).collect()}
    assert got == {
        ("b", 11): ("deleted", "direct", 0), ("b", 12): ("missing", "direct", 0), ("b", 13): ("late", "direct", 0),
        ("c", 20): ("inherited", "inherited", 1), ("d", 30): ("inherited", "inherited", 2), ("d", 31): ("inherited", "inherited", 3),
    }
    assert orphan_cascade([Reference("b", b.where("false"), "a", states)]).count() == 0


def test_skew_join_is_a_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 20)], "k long, w long")
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    assert sorted(map(tuple, skew_left_join(left, right, "k", 0.2, 10).select("k", "v", "w").collect()), key=str) == want


def test_too_deep_bodies_are_reported(spark):
    deep = '{"recipe": {"steps": ' + "[" * 100_000 + "]" * 100_000 + "}}"
    rows = emit_tagged(spark.createDataFrame([(1, deep), (2, '{"recipe": {"steps": "a"}}')], "k long, b string"), "k", "b", "recipe", (Child("steps", "instruction"),)).collect()
    assert sorted((r.doc_key, r.tag, r.text) for r in rows) == [(1, "_too_deep", None), (2, "steps", "a")]


def test_cascade_fails_rather_than_stop_early(spark):
    links = spark.createDataFrame([(i, i - 1, None) for i in range(1, 6)], "row_id long, ref_id long, ref_time timestamp")
    none = parent_states(spark.createDataFrame([], "id long, created_at timestamp"), "id", "created_at")
    first = spark.createDataFrame([(0, 77, None)], "row_id long, ref_id long, ref_time timestamp")
    graph = [Reference("t", first, "p", none), Reference("t", links, "t", None)]
    assert orphan_cascade(graph).agg({"depth": "max"}).first()[0] == 5
    with pytest.raises(RuntimeError):
        orphan_cascade(graph, max_rounds=3)


def test_same_amount_with_other_names(spark):
    rows = [(1, "两", "面粉(克)"), (2, "两", "盐(kg)"), (3, "两", None), (4, "12", "水(ml)")]
    df = spark.createDataFrame(rows, "id long, amount string, name string").coalesce(1)
    got = {r.id: (r.base_unit, r.quantity_milli) for r in read_quantities(df, "amount", UNITS, "name").collect()}
    assert got == {1: ("g", 2000), 2: ("g", 2000000), 3: (None, None), 4: ("ml", 12000)}
