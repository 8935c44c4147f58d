"""Dictionary matching with the dictionary as a table: any number of phrases, none of them in the plan.

Dictionary: label (spelling to return) and, optionally, `place` (smaller wins where two spellings fold alike).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import extract as ex
from postmill.functions import text as tx
from postmill.operators.analytics import skill_status
from postmill.operators.retrieve import met_texts
from postmill.session import cut, small

SHORTEST = 2
#: Phrases up to which a text is searched for all of them at once, by a tree of their letters.
TREE_PHRASES = 50_000


def phrase_index(dictionary: DataFrame) -> DataFrame:
    """(key, label, term): folded phrase, its first spelling, and the words it is looked up by."""
    place = F.col("place") if "place" in dictionary.columns else F.lit(0)
    keyed = dictionary.select(tx.fold(F.col("label")).alias("key"), F.struct(place.alias("place"), "label").alias("spelling"))
    one = keyed.filter(F.length("key") >= SHORTEST).groupBy("key").agg(F.min("spelling").alias("spelling"))
    return one.select("key", F.col("spelling.label").alias("label"), tx.normalize(F.col("key")).alias("term"))


def _longest_first(phrases: Column) -> Column:
    """Pattern that takes the longest phrase at a place."""
    ordered = F.array_sort(phrases, lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).otherwise(1))
    quoted = F.transform(ordered, lambda p: F.concat(F.lit("\\Q"), F.replace(p["key"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("("), F.array_join(quoted, "|"), F.lit(")"))


def known_skills(texts: DataFrame, dictionary: DataFrame, key: str = "listing_id", text: str = "text") -> DataFrame:
    """(key, skills): phrases found reading each text left to right, longest first, each once, in order of appearance.

    Equal to `functions.extract.known_skills`, which holds its dictionary in the plan. Phrases that are counted to be few enough
    are one tree of letters, which a text is read along where it lies: nothing is shuffled, and a place costs the letters that
    phrases share with it, however many they are. A larger dictionary meets the texts word by word.
    Texts without any phrase, null texts included, give no row; keys are unique. A text without key is searched for phrases
    of signs alone.
    """
    c = F.col
    rows = texts.filter(c(text).isNotNull()).select(c(key).alias("listing_id"), c(text).alias("_raw"))
    index = cut(phrase_index(dictionary))
    few = index.count() <= TREE_PHRASES
    return (_read_along_tree if few else _meet_words)(rows, index).select(c("listing_id").alias(key), "skills")


def _read_along_tree(rows: DataFrame, index: DataFrame) -> DataFrame:
    """`known_skills` by one pattern for all phrases; it is a row of a table, not a part of the plan."""
    c, phrases = F.col, index.collect()
    trees = [ex.tree_pattern([p.key for p in some]) for some in (phrases, [p for p in phrases if not p.term])]
    every, signs = rows.sparkSession.createDataFrame([tuple(t or None for t in trees)], "every string, signs string"), F.lit(None)
    if trees[1]:
        signs = every.select("signs").scalar()
    pattern = F.when(c("listing_id").isNotNull(), every.select("every").scalar()).otherwise(signs)
    # generators run once a row; projections would be computed again by the filter behind them
    keys = F.array_distinct(F.regexp_extract_all(tx.fold(c("_raw")), pattern, F.lit(0)))
    read = rows.select("listing_id", F.explode(F.array(keys)).alias("skills")).filter(F.size("skills") > 0)
    spellings = {p.key: p.label for p in phrases if p.key != p.label}
    if not spellings:
        return read

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, labels = pa.array(list(spellings), pa.string()), pa.array(list(spellings.values()), pa.string())
        for batch in batches:
            found = batch.column("skills")
            words = found.flatten()
            words = pc.coalesce(labels.take(pc.index_in(words, value_set=known)), words)
            starts = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.list_value_length(found)).cast(pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column("listing_id"), pa.ListArray.from_arrays(starts, words)], names=["listing_id", "skills"])

    return read.mapInArrow(spelled, read.schema)


def _meet_words(rows: DataFrame, index: DataFrame) -> DataFrame:
    """`known_skills` by joins of the words of texts and phrases, which leave every text the few phrases that can stand in it;
    only those are searched for, so the cost of a text doesn't grow with the dictionary. Phrases of signs alone have no words
    to be looked up by; every text is searched for them."""
    c = F.col
    worded, signs = index.filter("term <> ''"), index.filter("term = ''")
    met = met_texts(rows.select("listing_id", tx.normalize(c("_raw")).alias("text")), worded.select("term"))
    # the words of a text are still together, so its phrases are one row before they are shuffled
    phrases = met.join(small(worded), "term").groupBy("listing_id").agg(F.collect_set(F.struct("key", "label")).alias("_met"))
    # the few phrases without words, one short array
    always = signs.agg(F.collect_list(F.struct("key", "label"))).scalar()
    every = F.concat(F.coalesce("_met", F.array().cast("array<struct<key:string,label:string>>")), always)
    # generators run once a row; projections would be computed again by the filters behind them and by every use
    folded = rows.join(phrases, "listing_id", "left").select("listing_id", F.inline(F.array(F.struct(tx.fold(c("_raw")).alias("_text"), every.alias("_met")))))
    # most phrases only share a word with the text; what it holds is a short pattern
    held = folded.select("listing_id", "_text", F.explode(F.array(F.filter("_met", lambda p: F.contains(c("_text"), p["key"])))).alias("_held")).filter(F.size("_held") > 0)
    keys = F.array_distinct(F.regexp_extract_all("_text", _longest_first(c("_held")), F.lit(1)))
    read = held.select("listing_id", "_held", F.explode(F.array(keys)).alias("_keys"))
    labels = F.map_from_entries("_held")
    return read.select("listing_id", tx.let(labels, lambda m: F.transform("_keys", lambda k: F.element_at(m, k))).alias("skills"))


def counted_skills(texts: DataFrame, dictionary: DataFrame, key: str = "listing_id", text: str = "text") -> DataFrame:
    """(key, skill): normalised skills of `known_skills` that also stand in the text as words (phrases: as written)."""
    c = F.col
    found = known_skills(texts, dictionary, key, text).select(key, F.explode(F.array_distinct(F.transform("skills", tx.normalize))).alias("skill"))
    form = texts.select(key, F.concat(F.lit(" "), tx.normalize(c(text)), F.lit(" ")).alias("_form"))
    one_word = F.contains("_form", F.concat(F.lit(" "), "skill", F.lit(" ")))
    stands = F.when(F.contains("skill", F.lit(" ")), F.contains("_form", "skill")).otherwise(one_word)
    return found.join(form, key).filter(stands).select(key, "skill")


def heatmap_by(
    pairs: DataFrame, texts: DataFrame, dictionary: DataFrame, own_skills: DataFrame, key: str = "profile_id", top: int = 20
) -> DataFrame:
    """Heat map per profile: `pairs` (key, listing_id) says whose sample a listing is in, `own_skills` (key, own_skills) what it has.

    Skills are taken once per distinct listing of the sample, whatever the number of profiles that retrieved it.
    """
    sample = texts.join(pairs.select("listing_id").distinct(), "listing_id", "left_semi")
    skills = counted_skills(sample, dictionary)
    counts = pairs.join(skills, "listing_id").groupBy(key, "skill").agg(F.count("*").alias("n"))
    sizes = pairs.groupBy(key).agg(F.count("*").alias("sample_size"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), "skill")
    best = counts.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= top)
    return best.join(sizes, key).join(own_skills, key).select(
        key, "position", "skill", "n", (F.col("n") / F.col("sample_size")).alias("share"),
        skill_status(F.col("own_skills"), F.col("skill")).alias("status"),
    )
