"""Freely typed values mapped to a list of canonical entries.

Values are brought to a plain form and cut into segments; each segment, with and without the words that only describe
state, cut, packing or brand, is looked up in the list. Such words are learned from the values: they stand beside whole
keys of several entries. What isn't found is looked up within a bounded edit distance:
the list is stored with all strings that deleting up to ``distance`` characters from a key gives, and so are the
segments, so that near keys meet by equality (symmetric deletes). Candidates are ranked by a weighted
Damerau-Levenshtein distance and then by how often their entry is written exactly. Last, a key that stands whole within
a segment counts. Values that mean no entry are reported with entry 0.

Everything is done once for each different value or form, however often it occurs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import BROADCAST_ROWS, bounded_broadcast, skew_left_join, spread, written
from .plain import with_plain_form

#: Words and runs of characters that describe a name are learned: they stand beside at least so many different entries, and
#: have at most so many characters. So often at least a slip is seen before it counts as likely.
DESCRIBED, DESCRIBING, SLIPS = 3, 12, 2
#: Traditional characters of food names, each before its simplified form (fixed values).
TRADITIONAL_PAIRS = (
    "鹽盐 節节 藥药 鐵铁 蘆芦 絲丝 羅罗 涼凉 陽阳 萵莴 筍笋 葉叶 藍蓝 蘭兰 莢荚 長长 麥麦 穀谷 蘿萝 蔔卜 櫻樱 聖圣 紅红 頭头 薺荠 馬马 鱗鳞 針针 "
    "鮑鲍 側侧 雲云 銀银 蓀荪 樹树 豬猪 腳脚 雞鸡 鷄鸡 鴨鸭 裡里 裏里 蠍蝎 煙烟 菸烟 臘腊 腸肠 風风 鵪鹌 鶉鹑 鹹咸 魚鱼 鮭鲑 鱈鳕 帶带 黃黄 鱸鲈 鰻鳗 "
    "魷鱿 烏乌 賊贼 貝贝 貽贻 蠔蚝 蠣蛎 參参 蝦虾 張张 乾干 納纳 漿浆 蕎荞 麵面 龍龙 綠绿 鷹鹰 蘋苹 檸柠 鳳凤 棗枣 圓圆 無无 塊块 蘇苏 優优 煉炼 開开 "
    "渾浑 楓枫 欖榄 陳陈 紹绍 醬酱 薑姜 發发 鹼碱 膠胶 湯汤 條条 餅饼 蔥葱 蛻蜕 蟶蛏 鯽鲫 醃腌 楊杨 蓮莲 燒烧 錦锦 雪雪"
).split()
TRADITIONAL = "".join(p[0] for p in TRADITIONAL_PAIRS)
SIMPLIFIED = "".join(p[1] for p in TRADITIONAL_PAIRS)
#: Measures that may stand with a name and mean no entry (fixed values).
MEASURES = "克 公克 千克 公斤 斤 市斤 两 市两 盎司 磅 毫升 厘升 分升 升 公升 汤匙 大勺 大匙 茶匙 小勺 小匙 杯 量杯 碗 液量盎司 个 只 根 包 袋 盒 g kg gr oz lb ml cl dl l cc tbsp tsp cup bowl pcs".split()

_CJK = r"\p{IsHan}"


def fold(plain: Column) -> Column:
    """Lower case and simplified characters of a plain form."""
    return F.translate(F.lower(plain), TRADITIONAL, SIMPLIFIED)


def segments(folded: Column) -> Column:
    """The parts of a folded value between separators, units and remarks left out."""
    s = F.regexp_replace(folded, r"单位\s*:?.*$", "|")
    s = F.regexp_replace(s, r"(?<=[a-z])-(?=[a-z])", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{M}\p{N} ]+", "|")
    s = F.regexp_replace(s, rf"(?<={_CJK}) | (?={_CJK})|(?<=\d)(?={_CJK})|(?<={_CJK})(?=[\da-z])|(?<=[a-z])(?={_CJK})", "|")
    s = F.regexp_replace(s, r"(^|\|) *\d+ (?:packs?|cans?|bags?|pcs) ", "|")
    return F.filter(F.array_distinct(F.transform(F.split(s, r"\|"), lambda x: F.trim(x))), lambda x: (F.length(x) > 0) & ~x.isin(*MEASURES))


def _cuts(text: Column, most: int) -> Column:
    """All ways to cut a segment in two (left, right) with at most ``most`` characters, or words, on one side."""
    n, words = F.length(text), F.split(text, " ")
    w = F.size(words)
    near = lambda i, n: (i < n) & ((i <= most) | (i >= n - most))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: near(i, n))
    by = F.filter(F.sequence(F.lit(1), F.greatest(w - 1, F.lit(1))), lambda i: near(i, w))
    han = F.transform(at, lambda i: F.struct(F.substring(text, F.lit(1), i).alias("left"), F.substring(text, i + 1, n).alias("right")))
    latin = F.transform(by, lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("left"), F.array_join(F.slice(words, i + 1, w), " ").alias("right")))
    return F.when(text.rlike(_CJK), han).otherwise(latin)


def describing_words(values: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """(side, piece): what stands before or after a whole key in a segment of ``values`` (name, seg), or apart from it in
    the same value, beside several entries.

    Of the keys that begin or end a segment the longest counts. A piece that is itself a key describes nothing.
    """
    segs = values.select("seg").distinct()
    cut = segs.select("seg", F.explode(_cuts(F.col("seg"), max(longest, DESCRIBING))).alias("c")).select("seg", "c.left", "c.right")
    known = bounded_broadcast(keys.select("form", "entry"))
    sides = (("before", "left", "right"), ("after", "right", "left"))
    beside = [cut.join(known, F.col(key) == F.col("form")).select("seg", F.lit(side).alias("side"), F.col(piece).alias("piece"), "entry", F.length("form").alias("size")) for side, piece, key in sides]
    best = beside[0].unionByName(beside[1]).groupBy("seg", "side").agg(F.max_by(F.struct("piece", "entry"), F.struct("size", "entry")).alias("x"))
    named = values.join(known, F.col("seg") == F.col("form")).select("name", "entry")
    apart = values.join(named, "name").select(F.lit("apart").alias("side"), F.col("seg").alias("piece"), "entry").distinct()
    every = best.select("side", "x.piece", "x.entry").unionByName(apart)
    counted = every.groupBy("side", "piece").agg(F.count_distinct("entry").alias("n"))
    return counted.where((F.col("n") >= DESCRIBED) & (F.length("piece") <= DESCRIBING)).join(known, F.col("piece") == F.col("form"), "left_anti").select("side", "piece")


def stripped_forms(segs: DataFrame, words: DataFrame, times: int = 2) -> DataFrame:
    """(seg, form, tier): each distinct segment (seg) as it is and without up to ``times`` describing words before and after
    it; tier tells how many are off."""
    words = bounded_broadcast(words)
    forms = segs.select("seg", F.col("seg").alias("form"), F.lit(0).alias("tier"))
    for side, piece, rest in (("before", "left", "right"), ("after", "right", "left")):
        last = forms
        for _ in range(times):
            cut = last.select("seg", "tier", F.explode(_cuts(F.col("form"), DESCRIBING)).alias("c")).select("seg", "tier", F.col(f"c.{piece}").alias("piece"), F.col(f"c.{rest}").alias("form"))
            last = cut.join(words.where(F.col("side") == side), "piece", "left_semi").select("seg", "form", (F.col("tier") + 1).alias("tier"))
            last = written(last.groupBy("seg", "form").agg(F.min("tier").alias("tier")), "stripped")
            forms = forms.unionByName(last)
        forms = written(forms.groupBy("seg", "form").agg(F.min("tier").alias("tier")), "forms")
    return forms


def _shorter(strings: Column) -> Column:
    """All strings that deleting one character from each of ``strings`` gives."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.flatten(F.transform(strings, cut))


def delete_variants(text: Column, distance: int) -> Column:
    """``text`` and all that deleting up to ``distance`` characters from it gives."""
    out, step = F.array(text), F.array(text)
    for _ in range(distance):
        step = F.array_distinct(_shorter(step))
        out = F.array_union(out, step)
    return out


def bound_for(text: Column, distance: int) -> Column:
    """The edit distance allowed for a text: 2 from 9 characters on, 1 from 2 on."""
    return F.when(F.length(text) >= 9, distance).when(F.length(text) >= 2, min(1, distance)).otherwise(0)


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance in which likely slips cost less than others.

    Doubling a character or leaving out one of two equal ones, and a plural s, cost 0.4; a swap of neighbours 0.6; any
    other insertion or deletion 0.9; an exchange 1.
    """

    def gap(s: str, i: int) -> float:
        if (i > 0 and s[i] == s[i - 1]) or (i + 1 < len(s) and s[i] == s[i + 1]):
            return 0.4
        return 0.4 if s[i] == "s" and i == len(s) - 1 else 0.9

    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        d[i + 1][0] = d[i][0] + gap(a, i)
    for j in range(len(b)):
        d[0][j + 1] = d[0][j] + gap(b, j)
    for i in range(len(a)):
        for j in range(len(b)):
            best = min(d[i][j] + (a[i] != b[j]), d[i][j + 1] + gap(a, i), d[i + 1][j] + gap(b, j))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j] and a[i] != b[j]:
                best = min(best, d[i - 1][j - 1] + 0.6)
            d[i + 1][j + 1] = best
    return d[-1][-1]


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)])


def _exchange(form: Column, key: Column) -> Column:
    """The two characters exchanged, lesser first, where the texts differ in just one of them; else null."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1))), lambda i: F.substring(form, i, F.lit(1)) != F.substring(key, i, F.lit(1)))
    x, y = F.substring(form, at[0], F.lit(1)), F.substring(key, at[0], F.lit(1))
    return F.when((F.length(form) == F.length(key)) & (F.size(at) == 1), F.concat(F.least(x, y), F.greatest(x, y)))


def entry_keys(entries: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """(entry, form, own): the folded name (own) and aliases of each entry; blank and null ones are left out."""
    each = entries.select(F.col(key).alias("entry"), F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array()))).alias("__t"), F.col(name).alias("__n"))
    plain = with_plain_form(each, "__t").where("plain_text <> ''")
    form = F.regexp_replace(fold(F.col("plain_text")), "(?<=[a-z])-(?=[a-z])", " ")
    return plain.select("entry", form.alias("form"), (F.col("__t") == F.col("__n")).alias("own")).groupBy("entry", "form").agg(F.max("own").alias("own"))


def match_forms(forms: DataFrame, keys: DataFrame, distance: int = 2) -> DataFrame:
    """(form, entry, own, cost): for each distinct ``form`` (form, whole) the entries whose keys equal it, else near it.

    ``whole`` tells how often the form stands as it is, nothing taken off. An exchange of two characters that whole forms
    and keys near them show at least ``SLIPS`` times is a likely slip and costs 0.5.
    """
    forms = written(forms.select("form", "whole"), "distinct-forms")
    keys = bounded_broadcast(keys)
    exact = forms.join(keys, "form").select("form", "entry", "own", F.lit(0.0).alias("cost"))
    longest = keys.agg(F.coalesce(F.max(F.length("form")), F.lit(0)).alias("longest"))
    # a form longer than every key by more than the distance can't be near any
    open_ = forms.join(keys.select("form").distinct(), "form", "left_anti").crossJoin(F.broadcast(longest)).where(F.length("form") <= F.col("longest") + distance)

    def variants(df: DataFrame) -> DataFrame:
        one = df.where(F.length("form") < 9).withColumn("variant", F.explode(delete_variants(F.col("form"), min(1, distance))))
        two = df.where(F.length("form") >= 9).withColumn("variant", F.explode(delete_variants(F.col("form"), distance)))
        return one.unionByName(two)

    # keys of 8 characters may be near forms of 9, so keys give the variants of the larger bound
    stored = keys.withColumn("variant", F.explode(delete_variants(F.col("form"), distance))).withColumnRenamed("form", "key")
    stored = bounded_broadcast(written(stored, "delete-variants"), BROADCAST_ROWS)
    near = variants(open_.select("form")).join(stored, "variant").select("form", "key", "entry", "own").distinct()
    near = near.where(F.levenshtein("form", "key") <= 2 * bound_for(F.greatest("form", "key"), distance))
    near = written(near.withColumn("exchange", _exchange(F.col("form"), F.col("key"))), "near-keys")
    likely = near.select("form", "key", "exchange").distinct().join(forms, "form").groupBy("exchange").agg(F.sum("whole").alias("n"))
    likely = bounded_broadcast(written(likely.where((F.col("n") >= SLIPS) & F.col("exchange").isNotNull()).select("exchange", F.lit(0.5).alias("slip")), "slips"))
    priced = spread(near).join(likely, "exchange", "left").withColumn("cost", F.coalesce("slip", _distance("form", "key")))
    return exact.unionByName(priced.where(F.col("cost") <= bound_for(F.col("form"), distance)).select("form", "entry", "own", "cost"))


def _within(seg: Column, longest: int, most_words: int) -> Column:
    """Every run of 2 to ``longest`` Chinese characters and of 1 to ``most_words`` words within a segment."""
    chars = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(seg) - 1, F.lit(1))),
            lambda i: F.transform(F.sequence(F.lit(2), F.lit(max(2, longest))), lambda n: F.substring(seg, i, n)),
        )
    )
    words = F.split(seg, " ")
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.array_join(F.slice(words, i, n), " ")),
        )
    )
    return F.array_distinct(F.when(seg.rlike(_CJK), chars).otherwise(runs))


def canonical_names(values: DataFrame, keys: DataFrame, distance: int = 2) -> DataFrame:
    """(name, entry): each distinct non-empty ``name`` of ``values`` (name, times) with its entry, 0 where none is meant.

    Rank: lower cost, then the less stripped form, then a name before an alias, then the entry written exactly more
    often, then the lesser id.
    """
    plain = with_plain_form(values.select("name", "times"), "name").select("name", "times", fold(F.col("plain_text")).alias("folded"))
    segs = written(plain.select("name", "times", F.explode_outer(segments(F.col("folded"))).alias("seg")), "segments")
    sizes = keys.agg(F.max(F.when(F.col("form").rlike(_CJK), F.length("form"))).alias("han"), F.max(F.size(F.split("form", " "))).alias("words")).first()
    longest, most_words = max(2, sizes.han or 2), sizes.words or 1
    each = written(segs.where("seg is not null").groupBy("seg").agg(F.sum("times").alias("times")), "distinct-segments")
    words = written(describing_words(segs.where("seg is not null").select("name", "seg"), keys, max(longest, most_words)), "describing-words")
    # a segment that is itself a describing word is a remark, not a name misspelt
    stripped = stripped_forms(each.select("seg"), words).join(bounded_broadcast(words.select(F.col("piece").alias("form")).distinct()), "form", "left_anti")
    whole = stripped.join(each, "seg").groupBy("form").agg(F.sum(F.when(F.col("tier") == 0, F.col("times")).otherwise(0)).alias("whole"))
    matched = written(match_forms(whole, keys, distance), "matches")
    forms = segs.where("seg is not null").join(stripped, "seg").select("name", "seg", "times", "form", "tier")
    often = forms.join(matched.where("cost = 0"), "form").groupBy("entry").agg(F.sum("times").alias("often"))
    # two Chinese characters of which one is exchanged for an unlike one say too little once a third was taken off
    weak = (F.length("form") <= 2) & F.col("form").rlike(_CJK) & (F.col("cost") > 0.6) & (F.col("tier") > 0)
    hits = forms.join(matched, "form").where(~weak).select("name", "entry", "own", F.col("cost"), "tier")
    # whole keys within segments of names that have no match so far
    left = segs.where("seg is not null").join(hits.select("name").distinct(), "name", "left_anti")
    inner = left.select("name", F.explode(_within(F.col("seg"), longest, most_words)).alias("form")).join(bounded_broadcast(keys), "form")
    inner = inner.select("name", "entry", "own", (F.lit(10.0) - F.length("form") / 100).alias("cost"), F.lit(9).alias("tier"))
    ranked = hits.unionByName(inner).join(bounded_broadcast(written(often, "often")), "entry", "left")
    order = F.struct("cost", "tier", (~F.col("own")).alias("alias"), (-F.coalesce("often", F.lit(0))).alias("rarely"), "entry")
    best = ranked.groupBy("name").agg(F.min(order).alias("best")).select("name", F.col("best.entry").alias("entry"))
    return plain.select("name").join(best, "name", "left").select("name", F.coalesce("entry", F.lit(0).cast("long")).alias("entry"))


def map_to_entries(items: DataFrame, item: str, name: str, entries: DataFrame, key: str, label: str, aliases: str, distance: int = 2) -> DataFrame:
    """(item, entry) for each item whose name is neither null nor empty; 0 where no entry is meant.

    Repeated items give one row. A list with two entries of the same key maps to the one that is written more often.
    The list is broadcast if it is small, else joined by a shuffle. Very frequent names are joined apart.
    """
    named = items.select(F.col(item).alias("item"), F.col(name).alias("name")).where("name is not null and name <> ''")
    values = named.groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    keys = written(entry_keys(entries, key, label, aliases), "keys")
    mapped = written(canonical_names(values, keys, distance), "names")
    return skew_left_join(named, mapped, "name").select("item", "entry").distinct()
