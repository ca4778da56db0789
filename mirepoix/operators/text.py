"""Ingredient names from the lines people write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.operators.skew import salted_join

# Words that measure, characters that separate, what counts as a word.
UNIT_WORDS = (
    "tablespoon", "tablespoons", "teaspoon", "teaspoons", "cup", "cups", "ounce", "ounces", "inch",
    "inches",
)
SEPARATORS = r"[,.:;()!/%0-9]"
WORD = r"^[a-zA-Z-]+$"
MIN_LETTERS = 3


def main_words(text: Column) -> Column:
    """Array of the words of a line that may name an ingredient, in order, case kept."""
    words = F.split(F.regexp_replace(text, SEPARATORS, " "), r"\s+")
    return F.filter(
        words,
        lambda w: w.rlike(WORD) & (F.length(w) >= MIN_LETTERS) & ~w.isin(*UNIT_WORDS),
    )


def ingredient_tokens(
    df: DataFrame,
    text: str = "TEXT_VALUE",
    line: str = "LINE_NO",
    ingredient: str = "ID_INGREDIENT",
) -> DataFrame:
    """(ingredient, line, position, word), positions counted from 0 among the kept words."""
    return df.select(ingredient, line, F.posexplode(main_words(F.col(text))).alias("position", "word"))


def lemmatise(tokens: DataFrame, lemmas: DataFrame, word: str = "word", lemma: str = "lemma") -> DataFrame:
    """Replace words by their lemma from a (word, lemma) table; unknown words stay as they are.

    Of a word listed repeatedly the first lemma counts. Spark broadcasts the table if its size allows.
    """
    looked_up = tokens.join(lemmas.groupBy(word).agg(F.min(lemma).alias(lemma)), word, "left")
    named = F.coalesce(F.col(lemma), F.col(word)).alias(word)
    return looked_up.select(*[named if c == word else F.col(c) for c in tokens.columns])


def ingredient_names(
    df: DataFrame,
    lemmas: DataFrame | None = None,
    text: str = "TEXT_VALUE",
    line: str = "LINE_NO",
    ingredient: str = "ID_INGREDIENT",
    max_lines: int | None = None,
) -> DataFrame:
    """Name each ingredient by the words its lines agree on.

    Words of the first line always stay; others need half of the lines, rounded down. They are listed by
    their place in the first line, new words with the first, ties by word. Repeats of a line count once.
    ``max_lines`` looks at the first lines only; that limit is applied below the shuffle. By default all
    lines count and no task sees an ingredient as a whole: its lines are counted, and its words are
    filtered before they are gathered.
    """
    lines = df.select(ingredient, line, text).distinct()
    if max_lines is not None:
        in_order = W.partitionBy(ingredient).orderBy(line, text)
        lines = lines.withColumn("__rn", F.row_number().over(in_order)).filter(F.col("__rn") <= max_lines).drop("__rn")
    place = F.struct(F.col(line).alias("line"), F.col(text).alias("text"))
    heads = lines.groupBy(ingredient).agg(F.min(place).alias("__head"), F.count(F.lit(1)).alias("n_lines"))
    words = salted_join(lines, heads, [ingredient]).select(
        ingredient, line, text, (place == F.col("__head")).alias("__opening"), F.posexplode(main_words(F.col(text))).alias("position", "word")
    )
    if lemmas is not None:
        words = lemmatise(words, lemmas)
    per_line = words.groupBy(ingredient, "word", line, text, "__opening").agg(F.min("position").alias("__pos"))
    per_word = per_line.groupBy(ingredient, "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__opening"), F.col("__pos"))).alias("first")
    )
    kept = salted_join(per_word, heads.drop("__head"), [ingredient])
    kept = kept.filter(F.col("first").isNotNull() | (F.col("n") >= F.floor(F.col("n_lines") / 2)))
    entry = F.struct(F.coalesce(F.col("first"), F.lit(0)).alias("place"), F.col("word"))
    grouped = kept.groupBy(ingredient).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    grouped = heads.select(ingredient).join(grouped, ingredient, "left")
    kept = F.coalesce(F.transform("entries", lambda e: e["word"]), F.array().cast("array<string>"))
    return grouped.select(ingredient, F.concat_ws(" ", kept).alias("NAME"))
