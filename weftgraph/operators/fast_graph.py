"""Entities and relationships without a model: noun phrases, and their co-occurrence within a text unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.order import place_order
from weftgraph.functions.text import digest, entity_id, norm_title, noun_phrases, snippet
from weftgraph.lineage import cut

#: Units of a phrase whose pairs are made in one place.
LISTED = 100_000


def unit_phrases(units: DataFrame, most: int = 24) -> DataFrame:
    """Units with the array `phrases` of (title, norm_title), at most `most`, the best first, and the beginning of the text."""
    made = F.transform("names", lambda p: F.struct(p.alias("title"), norm_title(p).alias("norm_title")))
    return units.select("id", "unit_ord", snippet(F.col("text"), 180).alias("text"), noun_phrases(F.col("text"), most).alias("names")).select("id", "unit_ord", "text", made.alias("phrases"))


def exploded_phrases(phrases: DataFrame) -> DataFrame:
    return phrases.select(F.col("id").alias("unit_id"), "unit_ord", F.posexplode("phrases").alias("phrase_rank", "p"), snippet(F.col("text"), 180).alias("snippet")).select(
        "unit_id", "unit_ord", "phrase_rank", "p.title", "p.norm_title", "snippet"
    )


def ordered_ids(order: str, value: str) -> F.Column:
    """Distinct values in order."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]))


def entities(phrases: DataFrame, min_frequency: int = 1) -> DataFrame:
    """One entity for each normalised title: first seen spelling, frequency as rank, units in order, three snippets."""
    rows = exploded_phrases(phrases)
    seen = F.struct("unit_ord", "phrase_rank")
    units = F.array_sort(F.collect_set(F.struct("unit_ord", "unit_id")))
    grouped = rows.groupBy("norm_title").agg(
        F.count("*").alias("frequency"), F.min_by("title", seen).alias("title"), F.min(seen).alias("first"), units.alias("units")
    )
    # only the ids are gathered for all units; texts are fetched for the first three
    grouped = grouped.filter(F.col("frequency") >= min_frequency)
    three = grouped.select("norm_title", F.posexplode(F.slice("units", 1, 3)).alias("place", "u")).select("norm_title", "place", F.col("u.unit_id").alias("id"))
    texts = phrases.select("id", snippet(F.col("text"), 180).alias("snippet")).dropDuplicates(["id"])
    told = three.join(texts, "id").groupBy("norm_title").agg(F.array_sort(F.collect_list(F.struct("place", "snippet"))).alias("t"))
    told = told.select("norm_title", F.substring(F.array_join(F.transform("t", lambda x: x["snippet"]), " | "), 1, 500).alias("description"))
    return grouped.join(told, "norm_title", "left").select(
        entity_id(F.col("title")).alias("id"),
        "title",
        F.lit("NOUN_PHRASE").alias("type"),
        F.coalesce("description", "title").alias("description"),
        F.array_distinct(F.transform("units", lambda u: u["unit_id"])).alias("text_unit_ids"),
        F.col("frequency").cast("double").alias("rank"),
        "norm_title",
        place_order(F.col("first.unit_ord"), F.col("first.phrase_rank")).alias("ord"),
    )


def _named_phrases(phrases: DataFrame, kept: DataFrame, among: list[str] | None) -> DataFrame:
    """(unit_id, unit_ord, n, named): of each distinct key that is kept the frequency, the entity's title and the place among all `n` keys.

    Titles are looked up before pairs are made, as a unit has far fewer phrases than pairs. Of a unit's rows one has its id.
    """
    keys = F.transform(F.array_distinct(F.transform("phrases", lambda p: p["norm_title"])), lambda k, i: F.struct(k.alias("norm_title"), i.alias("at")))
    rows = phrases.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("unit_id"), "unit_ord", keys.alias("keys")).withColumn("n", F.size("keys"))
    if among is not None:
        rows = rows.withColumn("keys", F.filter("keys", lambda k: k["norm_title"].isin(among)))
    rows = rows.filter(F.size("keys") > 1).select("row", "unit_id", "unit_ord", "n", F.posexplode("keys").alias("i", "k"))
    once = [F.when(F.col("i") == 0, F.col(c)).alias(c) for c in ("unit_id", "unit_ord", "n")]
    names = kept.select("norm_title", F.col("title").alias("kept_title"), F.coalesce(F.col("rank").cast("long"), F.lit(1).cast("long")).alias("often"))
    found = rows.select("row", *once, "k.norm_title", "k.at").join(names, "norm_title", "left").drop("norm_title")
    one = F.when(F.col("kept_title").isNotNull(), F.struct("often", F.col("kept_title").alias("title"), "at"))
    return found.repartition("row").groupBy("row").agg(F.max("unit_id").alias("unit_id"), F.max("unit_ord").alias("unit_ord"), F.max("n").alias("n"), F.array_sort(F.collect_list(one)).alias("named"))


def _joined(titles: F.Column) -> F.Column:
    """Strings of any kind as one, `_parted` again."""
    return F.array_join(F.transform(titles, lambda t: F.replace(F.replace(t, F.lit("\2"), F.lit("\2b")), F.lit("\1"), F.lit("\2a"))), "\1")


def _parted(titles: F.Column) -> F.Column:
    return F.transform(F.split(titles, "\1"), lambda t: F.replace(F.replace(t, F.lit("\2a"), F.lit("\1")), F.lit("\2b"), F.lit("\2")))


def cooccurrences(phrases: DataFrame, kept: DataFrame, among: list[str] | None = None, listed: int = LISTED) -> DataFrame:
    """Pairs of the titles of kept entities in one unit: (a, b, part, unit_id, unit_ord, place), a being the rarer one.

    Pairs are made within the row, so a frequent phrase is never joined with itself. It isn't the pairs that are shuffled: the
    rarer phrase of each gets a list of its partners in the unit, and its pairs are made where all its lists have come. Those of a
    phrase in more than `listed` units come to several places, parted by the partners' hash. Rows are partitioned by (a, part).
    """
    rows = _named_phrases(phrases, kept, among).select("unit_id", "unit_ord", "n", "named", F.posexplode("named").alias("i", "own")).filter(F.col("i") < F.size("named") - 1)
    lo, hi = (lambda x: F.least(x["at"], "own.at")), (lambda x: F.greatest(x["at"], "own.at"))
    place = lambda x: F.floor(lo(x) * (2 * F.col("n") - lo(x) - 1) / 2).cast("int") + hi(x) - lo(x) - 1
    others = F.transform(F.slice("named", F.col("i") + 2, F.size("named")), lambda x: F.struct(x["title"].alias("title"), place(x).alias("place")))
    parts = F.ceil(F.col("own.often") / listed).cast("long")
    rows = rows.select("unit_id", "unit_ord", F.col("own.title").alias("a"), parts.alias("parts"), others.alias("others"))
    part_of = lambda x: F.pmod(F.xxhash64(x["title"]), "parts").cast("int")
    places = F.when(F.col("parts") <= 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("others", part_of)))
    rows = rows.withColumn("part", F.explode(places))
    rows = rows.withColumn("others", F.when(F.col("parts") <= 1, F.col("others")).otherwise(F.filter("others", lambda x: part_of(x) == F.col("part"))))
    # one string and one list of numbers take a third of the room of a list of pairs
    sent = rows.select("a", "part", "unit_id", "unit_ord", _joined(F.col("others.title")).alias("titles"), F.col("others.place").alias("places"))
    # as many as there are to be: joined into larger ones by their size as lists, they would be too large as pairs and spill
    sent = sent.repartition(int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "part")
    made = sent.select("a", "part", "unit_id", "unit_ord", "places", F.posexplode(_parted(F.col("titles"))).alias("i", "b"))
    return made.select("a", "b", "part", "unit_id", "unit_ord", F.get("places", "i").alias("place"))


def relationships(phrases: DataFrame, kept: DataFrame, among: list[str] | None = None) -> DataFrame:
    """Co-occurring pairs of kept entities, or of those of them that `among` lists by norm_title, weighted by their number of units."""
    pairs = cooccurrences(phrases, kept, among).groupBy("a", "part", "b").agg(
        F.count("*").alias("n"), ordered_ids("unit_ord", "unit_id").alias("text_unit_ids"), F.min(F.struct("unit_ord", "place")).alias("first")
    )
    pairs = pairs.withColumn("na", norm_title(F.col("a"))).withColumn("nb", norm_title(F.col("b")))
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    return pairs.select(
        digest(F.concat(low, F.lit("|"), high), 16, "rel_").alias("id"),
        F.when(F.col("na") < F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("source"),
        F.when(F.col("na") < F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("target"),
        F.format_string("together in a text unit, %d times", "n").alias("description"),
        F.col("n").cast("double").alias("weight"),
        "text_unit_ids",
        F.col("n").cast("double").alias("rank"),
        low.alias("norm_source"),
        high.alias("norm_target"),
        place_order(F.col("first.unit_ord"), F.col("first.place")).alias("ord"),
    )


def with_ids(relationships: DataFrame) -> DataFrame:
    """Relationships with source_id and target_id: the entities of this module have ids made from their titles."""
    return relationships.withColumn("source_id", entity_id(F.col("source"))).withColumn("target_id", entity_id(F.col("target")))


def sharing_units(phrases: DataFrame, titles: DataFrame | list[str]) -> DataFrame:
    """(norm_title): all titles of the units that hold one of `titles`, a list or a table of norm_title."""
    keys = F.transform("phrases", lambda p: p["norm_title"])
    if isinstance(titles, list):
        held = phrases.filter(F.arrays_overlap(keys, F.array(*map(F.lit, titles)))) if titles else phrases.limit(0)
        return held.select(F.explode(keys).alias("norm_title")).distinct()
    rows = phrases.select(F.monotonically_increasing_id().alias("row"), keys.alias("keys")).select("row", F.explode("keys").alias("norm_title"))
    held = rows.join(titles.select("norm_title"), "norm_title", "left_semi").select("row").distinct()
    return rows.join(held, "row", "left_semi").select("norm_title").distinct()


def extract_graph(units: DataFrame, *, min_frequency: int = 1, most_phrases: int = 24) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of the units."""
    phrases = cut(unit_phrases(units, most_phrases))  # read three times
    kept = entities(phrases, min_frequency)
    return kept, relationships(phrases, kept)
