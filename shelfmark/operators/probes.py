"""The probe set of the semantic gate, and the rules that a probe set must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import tokens

#: Groups of titles about one kind of object; every group shares a telling word and no two groups do.
PROBE_GROUPS: dict[str, tuple[str, ...]] = {
    "kettle": ("Gooseneck pour kettle", "Cordless glass kettle", "Whistling copper kettle", "Folding travel kettle"),
    "lantern": ("Rechargeable camping lantern", "Paper garland lantern", "Hanging solar lantern", "Hurricane oil lantern"),
    "backpack": ("Hiking backpack, forty liters", "School dinosaur backpack", "Waterproof rolltop backpack", "Slim laptop backpack"),
    "guitar": ("Acoustic spruce guitar", "Electric starter guitar", "Classical nylon guitar", "Maple bass guitar"),
    "puzzle": ("Wooden map puzzle", "Thousand piece puzzle", "Jigsaw puzzle mat", "Baby animal puzzle"),
    "pillow": ("Memory foam pillow", "Pregnancy pillow", "Feather pillow pair", "Cooling gel pillow"),
}

#: Words that say nothing about an object and may occur anywhere.
GENERIC_WORDS = frozenset("a and against as beside for from in like made of over pair set showing that the up with without".split())


def probe_table(spark: SparkSession, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(idx, grp, title) of a probe set, by default the one above."""
    rows = [(g, t) for g, titles in (groups or PROBE_GROUPS).items() for t in titles]
    return spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(rows)], "idx int, grp string, title string")


def group_words(df: DataFrame, group: str, idx: str, text: str, generic: frozenset[str] = GENERIC_WORDS) -> DataFrame:
    """(group, word) for each text's words that aren't generic."""
    own = tokens(F.col(text), "a-z")
    if generic:
        own = F.array_except(own, F.array(*[F.lit(w) for w in sorted(generic)]))
    return df.select(F.col(group).alias("grp"), F.col(idx).alias("idx"), F.explode(F.array_distinct(own)).alias("word"))


def head_nouns(df: DataFrame, group: str = "grp", idx: str = "idx", text: str = "title", generic: frozenset[str] = GENERIC_WORDS) -> DataFrame:
    """(grp, word): words that every text of a group has."""
    sizes = df.groupBy(F.col(group).alias("grp")).agg(F.countDistinct(idx).alias("texts"))
    held = group_words(df, group, idx, text, generic).groupBy("grp", "word").agg(F.countDistinct("idx").alias("n"))
    return held.join(sizes, "grp").filter("n = texts").select("grp", "word")


def shared_words(df: DataFrame, group: str = "grp", idx: str = "idx", text: str = "title", generic: frozenset[str] = GENERIC_WORDS) -> DataFrame:
    """(word, groups): words that several groups have."""
    return group_words(df, group, idx, text, generic).groupBy("word").agg(F.countDistinct("grp").alias("groups")).filter("groups > 1")


def probe_faults(df: DataFrame) -> list[str]:
    """What is wrong with a probe set; empty if it is sound."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"), F.countDistinct("grp").alias("groups")).first()
    small = df.groupBy("grp").count().filter("count < 2").count()
    found = []
    if n["titles"] < n["n"]:
        found.append("titles repeat")
    if n["groups"] < 3:
        found.append("fewer than three groups")
    if small:
        found.append("a group has a single title")
    if head_nouns(df).select("grp").distinct().count() < n["groups"]:
        found.append("a group shares no telling word")
    if shared_words(df).limit(1).count():
        found.append("a telling word occurs in two groups")
    return found
