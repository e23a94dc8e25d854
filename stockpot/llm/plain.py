"""One consistent form for texts that look alike.

The plain form has compatibility characters replaced by the ordinary ones and accents composed, no format characters,
single spaces, and each word spelt in one script. For the last, the set of scripts a word can be spelt in is the
intersection of the sets of its letters (a letter has its own script and those in which a letter looks the same); a
word whose letters come from several scripts is a mixed-script confusable and takes the Latin spelling where it holds
Latin letters; a word all of whose letters could be Latin but none is (a whole-script confusable) is only reported.

Script sets, spelling, format characters and white space are Spark expressions; only the normalization form, which
Spark has no function for, is a vectorised function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.lookalike import CYRILLIC, CYRILLIC_LATIN, GREEK, GREEK_LATIN, LATIN, LOOK

_WORD = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}]"
_SPACES = r"[\t-\r\x{20}\x{85}\p{Z}]+"


@pandas_udf(T.StringType())
def _normalized(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: So that a filter on the result doesn't make Spark run the function twice.
_nfkc = _normalized.asNondeterministic()


#: Scripts that have letters looking alike, as bits of a set; marks and other characters can stand in each of them.
SCRIPTS = {"Latin": 1, "Cyrillic": 2, "Greek": 4}
EVERY = sum(SCRIPTS.values())


def _script_sets() -> dict[str, int]:
    """The scripts in which a letter has a spelling, for the letters that have one in another script than their own."""
    sets: dict[str, int] = {}
    for letters, latin, script in ((CYRILLIC, CYRILLIC_LATIN, "Cyrillic"), (GREEK, GREEK_LATIN, "Greek")):
        for own, other in zip(letters, latin):
            sets[own] = SCRIPTS[script] | SCRIPTS["Latin"]
            sets[other] = sets.get(other, SCRIPTS["Latin"]) | SCRIPTS[script]
    return sets


_SETS = _script_sets()


def _own_script(letter: Column, otherwise: int) -> Column:
    out = None
    for name, bit in SCRIPTS.items():
        test = letter.rlike(rf"^\p{{Is{name}}}")
        out = F.when(test, bit) if out is None else out.when(test, bit)
    assert out is not None
    return out.otherwise(otherwise)


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def script_bits(word: Column) -> Column:
    """The scripts of which ``word`` has letters, as bits."""
    return F.aggregate(_letters(word), F.lit(0), lambda acc, c: acc.bitwiseOR(_own_script(c, 0)))


def resolved_bits(word: Column) -> Column:
    """The scripts in which the whole ``word`` has a spelling, as bits: the intersection of its letters' script sets."""
    known = F.create_map(*[F.lit(x) for item in _SETS.items() for x in item])
    return F.aggregate(_letters(word), F.lit(EVERY), lambda acc, c: acc.bitwiseAND(F.coalesce(known[c], _own_script(c, EVERY))))


def _named(bits: Column) -> Column:
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in SCRIPTS.items())))


def scripts(word: Column) -> Column:
    """Names of the scripts of which ``word`` has letters."""
    return _named(script_bits(word))


def resolved_scripts(word: Column) -> Column:
    """Names of the scripts in which the whole ``word`` has a spelling."""
    return _named(resolved_bits(word))


def _kind(own: Column, resolved: Column) -> Column:
    """``mixed`` for letters of several scripts, ``whole`` for a word that Latin letters could spell but none does."""
    latin = SCRIPTS["Latin"]
    several = own.bitwiseAND(own - 1) != 0
    return F.when(several, "mixed").when((resolved.bitwiseAND(F.lit(latin)) != 0) & (own != 0) & (own.bitwiseAND(F.lit(latin)) == 0), "whole")


def consistent_spelling(word: Column) -> Column:
    """``word`` in its one script: a mixed-script confusable that holds Latin letters is spelt in Latin ones.

    Where Latin is among the resolved scripts the whole word is so; letters that have no Latin spelling stay as they are.
    Whole-script confusables and words of one script keep theirs.
    """
    own, latin = script_bits(word), F.lit(SCRIPTS["Latin"])
    mixed = _kind(own, resolved_bits(word)) == "mixed"
    return F.when(mixed & (own.bitwiseAND(latin) != 0), F.translate(word, LOOK, LATIN)).otherwise(word)


def _one_script(text: Column) -> Column:
    """``text`` with every word in its consistent spelling; texts of one script can't hold a mixed word."""
    mixed = text.rlike(r"\p{IsLatin}") & text.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    parts = F.regexp_extract_all(text, F.lit(rf"({_WORD}+|(?!{_WORD})[\s\S])"), F.lit(1))
    return F.when(mixed, F.array_join(F.transform(parts, consistent_spelling), "")).otherwise(text)


def with_plain_form(df: DataFrame, text: str, to: str = "plain_text") -> DataFrame:
    """``df`` with the plain form of ``text``; null stays null, a text of nothing but spaces becomes empty."""
    step = df.withColumn(to, _nfkc(F.regexp_replace(F.col(text), r"\p{Cf}+", "")))
    step = step.withColumn("__one", F.regexp_replace(_one_script(F.col(to)), r"\p{Cf}+", ""))
    # accents that a changed letter can take up are composed; unchanged texts need no second pass
    step = step.withColumn("__again", _nfkc(F.when(F.col("__one") != F.col(to), F.col("__one"))))
    done = F.coalesce("__again", "__one")
    return step.withColumn(to, F.regexp_replace(F.regexp_replace(done, _SPACES, " "), "^ | $", "")).drop("__one", "__again")


def word_scripts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, scripts, resolved, kind): the words with letters of more than one script, or that could be Latin.

    kind is ``mixed`` or ``whole``. Null texts give no row; a word that occurs twice in a text gives one row.
    """
    norm = df.select(key, _nfkc(F.regexp_replace(F.col(text), r"\p{Cf}+", "")).alias("t")).where(F.col("t").rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
    words = norm.select(key, F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(rf"({_WORD}+)"), F.lit(1)))).alias("word"))
    w = F.col("word")
    bits = words.select(key, "word", script_bits(w).alias("own"), resolved_bits(w).alias("all"))
    kinds = bits.withColumn("kind", _kind(F.col("own"), F.col("all"))).where("kind is not null")
    return kinds.select(key, "word", _named(F.col("own")).alias("scripts"), _named(F.col("all")).alias("resolved"), "kind")


def changed_forms(df: DataFrame, source: str, key: str, text: str) -> DataFrame:
    """(source_table, row_id, plain_text) of the rows whose text differs from its plain form, distinct."""
    plain = with_plain_form(df.select(F.col(key).alias("row_id"), F.col(text).alias("__t")), "__t")
    return plain.where("__t <> plain_text").select(F.lit(source).alias("source_table"), "row_id", "plain_text").distinct()
