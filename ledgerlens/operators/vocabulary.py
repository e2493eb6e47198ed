"""Resolve words of a question to standard words of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(dictionary: DataFrame) -> DataFrame:
    """dictionary(field, standard_word, synonyms array) to (term, field, standard_word).

    A standard word stands for itself, too.
    """
    words = F.array_union(F.array("standard_word"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return dictionary.select(F.explode(words).alias("_w"), "field", "standard_word").select(
        F.lower("_w").alias("term"), "field", "standard_word"
    ).distinct()


def resolve_synonyms(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """mentions(…, term, context): add field and standard_word; context, if given, names the field."""
    known = entries(dictionary).withColumnRenamed("term", "_term")
    same = (F.lower("term") == F.col("_term")) & (F.col("context").isNull() | (F.col("context") == F.col("field")))
    return mentions.join(known, same).drop("_term")


# A Chinese or Japanese character is a word of its own, other letters, digits and underlines make words in runs.
_ALONE = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
WORD = f"[{_ALONE}]|[\\p{{L}}\\p{{N}}_&&[^{_ALONE}]]+"


def word_list(text: Column | str) -> Column:
    """The words of a text in lower case; hyphens, apostrophes and other marks part words. Terms and texts are cut by this alone."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def phrase_index(dictionary: DataFrame) -> DataFrame:
    """(first, size, words, field, standard_word): each term as a list of words. Terms without a word are left out."""
    listed = entries(dictionary).select(word_list("term").alias("words"), "field", "standard_word").where(F.size("words") > 0)
    return listed.select(F.col("words")[0].alias("first"), F.size("words").alias("size"), F.array_join("words", " ").alias("words"), "field", "standard_word").distinct()


def find_terms(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Every place of a text at which a term of the dictionary stands: the columns of ``texts`` and start, term, field, standard_word.

    A place is tried with the lengths of those terms only that begin with its word, up to the longest term there is. Starts count
    words from 1; terms that overlap are all told. A null text has no words.
    """
    index = phrase_index(dictionary)
    longest = index.agg(F.max("size")).first()[0] or 0
    lengths = index.groupBy("first").agg(F.collect_set("size").alias("_sizes")).withColumnRenamed("first", "_first")
    words = F.col("_words")
    ahead = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.slice(words, i, longest))
    places = (
        texts.withColumn("_words", word_list(text))
        .where(F.size(words) > 0)
        .select(*texts.columns, F.posexplode(ahead).alias("start", "_ahead"))
        .withColumn("start", F.col("start") + 1)
    )
    tried = places.join(lengths, F.col("_ahead")[0] == F.col("_first")).withColumn("_size", F.explode("_sizes"))
    tried = tried.where(F.size("_ahead") >= F.col("_size")).withColumn("term", F.array_join(F.slice("_ahead", 1, F.col("_size")), " "))
    named = index.select(F.col("words").alias("term"), "field", "standard_word")
    return tried.join(named, "term").select(*texts.columns, "start", "term", "field", "standard_word")


def ambiguous_synonyms(dictionary: DataFrame) -> DataFrame:
    """Terms with more than one target."""
    target = F.struct("field", "standard_word")
    return entries(dictionary).groupBy("term").agg(F.countDistinct(target).alias("targets")).where("targets > 1")


def language_column(name: str, language: str):
    """The column of a bilingual pair ``<name>_en`` / ``<name>_zh``."""
    if language not in ("en", "zh"):
        raise ValueError("language must be 'en' or 'zh'")
    return F.col(f"{name}_{language}")


# Question tags that mark special understanding.
TRAITS = {"synonym": "trait-synonym", "time_aware": "trait-time-aware", "knowledge": "trait-knowledge"}


def trait_flags(questions: DataFrame, traits: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    traits = traits or {name: (tag,) for name, tag in TRAITS.items()}
    flags = [F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])).alias(name) for name, tags in traits.items()]
    return questions.select("id", *flags)
