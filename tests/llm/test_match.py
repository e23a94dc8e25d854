import random

from stockpot.llm import canonical as C
from stockpot.llm import pairs as P

ENTRIES = [(1, "海盐", ["粗海盐", "sea salt", None, ""]), (2, "荸荠", ["马蹄", "water chestnut"]), (3, "奶酪", ["芝士", "cheese"]), (4, "红枣", None), (5, "泡打粉", ["baking powder", "baking powder"])]
NAMES = {
    "ＳＥＡ ＳＡＬＴ": 1, "sea-salt": 1, "soa salt": 1, "有机海盐丁（克）": 1, "马题": 2, "watr chestnut (optional)": 2, "芝士|奶酪": 3, "chеese": 3, "泡泡打粉": 5, "泡打粉 2个": 5, "陌生牌泡打粉": 5,
    "厨房纸巾": 0, "???": 0, "烧烤签子(大勺)": 0, "   ": 0, "x" * 5000: 0, "紅棗": 4,
}


def test_names(spark):
    entries = spark.createDataFrame(ENTRIES, "id long, name string, aliases array<string>").selectExpr("*", "1 AS entry")
    rows = [(i, n) for i, n in enumerate(NAMES)] + [(0, list(NAMES)[0]), (100, None), (101, "")]
    items = spark.createDataFrame(rows, "item_id long, name string").selectExpr("*", "2 AS item", "3 AS entry")
    got = {r["item"]: r.entry for r in C.map_to_entries(items, "item_id", "name", entries, "id", "name", "aliases").collect()}
    assert {n: got[i] for i, n in enumerate(NAMES)} == NAMES and len(got) == len(NAMES)
    assert C.map_to_entries(items.where("false"), "item_id", "name", entries, "id", "name", "aliases").count() == 0
    none = C.map_to_entries(items, "item_id", "name", entries.where("false"), "id", "name", "aliases").collect()
    assert {r.entry for r in none} == {0} and len(none) == len(NAMES)


def test_symmetric_deletes_find_all_near_keys(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(60)})
    forms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 11))) for _ in range(60)})
    kd = spark.createDataFrame([(i, k, True) for i, k in enumerate(keys)], "entry long, form string, own boolean")
    got = {(r.form, r.entry) for r in C.match_forms(spark.createDataFrame([(f, 0) for f in forms], "form string, whole long"), kd).collect()}
    bound = lambda f: 2 if len(f) >= 9 else 1 if len(f) >= 2 else 0

    def edits(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for f in forms:
        for i, k in enumerate(keys):
            if f in keys:
                assert ((f, i) in got) == (f == k)
            elif edits(f, k) <= bound(f):
                assert (f, i) in got, (f, k)
            elif (f, i) in got:
                assert C.weighted_distance(f, k) <= bound(f)


def test_learned_words_and_slips(spark):
    """What stands beside several entries is taken off, and exchanges that are seen often cost less."""
    keys = spark.createDataFrame([(1, "海盐", True), (2, "红枣", True), (3, "奶酪", True), (4, "brown rice", True)], "entry long, form string, own boolean")
    segs = spark.createDataFrame([(s,) for s in ("岩石牌海盐", "岩石牌红枣", "岩石牌奶酪", "岩石牌红早", "奶酪红枣", "海盐罐", "old brown rice")], "seg string")
    beside = [(10 + i, x) for i, k in enumerate(["海盐", "红枣", "奶酪"]) for x in (k, "去皮")] + [(20, "海盐"), (20, "奶酪"), (20, "一次")]
    values = segs.selectExpr("1L AS name", "seg").unionByName(spark.createDataFrame(beside, "name long, seg string"))
    words = C.describing_words(values, keys, 4)
    assert {tuple(r) for r in words.collect()} == {("before", "岩石牌"), ("apart", "去皮")}
    forms = {(r.seg, r.form, r.tier) for r in C.stripped_forms(segs, words).collect()}
    assert ("岩石牌红早", "红早", 1) in forms and ("海盐罐", "海盐罐", 0) in forms and len(forms) == 11
    cost = lambda n: {r.entry: r.cost for r in C.match_forms(spark.createDataFrame([("红早", n), ("海言", 0)], "form string, whole long"), keys).collect()}
    assert cost(2) == {2: 0.5, 1: 1.0} and cost(1) == {2: 1.0, 1: 1.0}
    assert C.describing_words(values.where("false"), keys, 4).count() == 0


def counts(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    pairs, items = {}, {}
    for s in baskets.values():
        for x in s:
            items[x] = items.get(x, 0) + 1
            for y in s:
                if x < y:
                    pairs[x, y] = pairs.get((x, y), 0) + 1
    return pairs, items, len(baskets)


def test_pair_updates(spark, tmp_path):
    rng = random.Random(7)
    row = lambda: (rng.randint(0, 12), rng.randint(0, 9))
    first, added, removed = [row() for _ in range(60)] + [(None, 1), (1, None)], [row() for _ in range(25)], [row() for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "basket long, item long").selectExpr("*", "1 AS n", "2 AS a")
    store = P.PairStore(spark, str(tmp_path / "pairs"))
    assert P.scores(P.pair_counts(store), store).count() == 0
    P.update(store, frame(first))
    scored, now = P.written(P.pair_counts(store), "scored"), set(first)
    # more rows, some withdrawn; then the withdrawn ones come again; then nothing that isn't known; then all go
    for plus, minus in ((added, removed), (removed, []), (removed, [(99, 99)]), ([], list(set(first + added + removed)))):
        before = counts(now)
        now = (now - (set(minus) - set(plus))) | set(plus)
        changes = P.update(store, frame(plus) if plus else None, frame(minus) if minus else None)
        pairs, items, n = counts(now)
        scored = P.written(P.updated_counts(scored, store, changes), "scored")
        got = {(r.a, r.b): r for r in P.scores(scored, store).collect()}
        assert {k: r.n_ab for k, r in got.items()} == pairs and {tuple(r)[:2] for r in P.pair_counts(store).collect()} == set(pairs)
        assert all((r.n_a, r.n_b, r.n) == (items[k[0]], items[k[1]], n) for k, r in got.items())
        assert {tuple(r) for r in changes.pairs.collect()} == {k for k in set(before[0]) | set(pairs) if before[0].get(k, 0) != pairs.get(k, 0)}
        assert {r.item for r in changes.items.collect()} == {k for k in set(before[1]) | set(items) if before[1].get(k, 0) != items.get(k, 0)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    import os

    store = P.PairStore(spark, str(tmp_path / "pairs"))
    frame = lambda rows: spark.createDataFrame(rows, "basket long, item long")
    P.update(store, frame([(b, i) for b in range(60) for i in range(b % 7, b % 7 + 4)]))
    files = lambda: {n: {f for _, _, fs in os.walk(tmp_path / "pairs" / "pairs" / n) for f in fs} for n in os.listdir(tmp_path / "pairs" / "pairs") if n.startswith("bucket")}
    before = files()
    P.update(store, frame([(0, 50)]))
    after = files()
    changed = {n for n in after if after[n] != before.get(n)}
    assert 0 < len(changed) <= 4 < len(before)


def test_large_baskets_in_blocks(spark):
    rows = spark.createDataFrame([(1, i, True) for i in range(40)] + [(2, i, False) for i in range(3)], "basket long, item long, fresh boolean")
    got = sorted((r.a, r.b) for r in P.basket_pairs(rows, block=7).collect())
    assert got == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(0, 1), (0, 2), (1, 2)])
