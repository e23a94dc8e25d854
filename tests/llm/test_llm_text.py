import random
import unicodedata

import pytest
import regex

from stockpot.functions.lookalike import LATIN, LOOK
from stockpot.llm.plain import changed_forms, with_plain_form, word_scripts

TABLE = str.maketrans(LOOK, LATIN)


def plain(t):
    x = regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}", "", t)))
    fold = lambda m: m[0].translate(TABLE) if regex.search(r"\p{Latin}", m[0]) else m[0]
    x = unicodedata.normalize("NFKC", regex.sub(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}]+", fold, x))
    return regex.sub(r"\p{White_Space}+", " ", x).strip(" ")


CASES = ["Ｓａｌｔ", "sаlt", "Борщ", "Борщ with sаlt", "café", "cafе́", "a​\xa0 b　", "  ", "", "①½㎖", "Μushrοοm", "e‍́", "（糖）", "ﬁg", "⽠", "жa", "αβγ a", "x" * 3000 + "о"]


@pytest.mark.parametrize("seed", range(2))
def test_against_model(spark, seed):
    rng = random.Random(seed)
    alphabet = "aеоbс ​́\xa0Ａ糖，οж­1"
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "id long, t string")
    got = {r.id: r.plain_text for r in with_plain_form(df, "t").collect()}
    assert got[9999] is None
    assert [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_changed_rows(spark):
    df = spark.createDataFrame([(1, "ok"), (2, " ok"), (2, " ok"), (3, None)], "id long, name string").selectExpr("*", "'x' AS plain_text", "1 AS row_id")
    assert [tuple(r) for r in changed_forms(df, "s", "id", "name").collect()] == [("s", 2, "ok")]
    assert changed_forms(df.where("false"), "s", "id", "name").count() == 0


def test_scripts(spark):
    df = spark.createDataFrame([(1, "sаlt Борщ сосо жa"), (2, None)], "id long, t string")
    got = {r.word: (r.kind, r.resolved) for r in word_scripts(df, "id", "t").collect()}
    assert got == {"sаlt": ("mixed", ["Latin"]), "сосо": ("whole", ["Latin", "Cyrillic"]), "жa": ("mixed", ["Cyrillic"])}


def test_words_of_both_tables(spark, tmp_path):
    from stockpot.llm.q_text import p2_words

    spark.createDataFrame([(1, "sаlt"), (2, "salt"), (3, None)], "id long, title string").write.parquet(f"{tmp_path}/recipes.parquet")
    names = [(1, "Борщ"), (7, "сосо"), (7, "сосо"), (8, "οil"), (9, None)]
    spark.createDataFrame(names, "item_id long, name string").write.parquet(f"{tmp_path}/crawled_ingredients.parquet")
    got = sorted((r.source_table, r.row_id, r.word, r.kind) for r in p2_words(spark, str(tmp_path)).collect())
    assert got == [("crawled_ingredients", 7, "сосо", "whole"), ("crawled_ingredients", 8, "οil", "mixed"), ("recipes", 1, "sаlt", "mixed")]
