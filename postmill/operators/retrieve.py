"""Candidate retrieval and relevance for all profiles at once.

Profiles: profile_id, target_role, titles, skills, keywords, query_variations (arrays).
Listings: listing_id, title, company, description, last_seen (sortable recency), status.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import lexicon as lx
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.session import cut, small


POSTING_SALTS = 16


def newest(df: DataFrame, key: str, limit: int, salts: int = 1) -> DataFrame:
    """Newest rows per key; the rank filter also runs map-side, so hot keys never travel whole.

    With `salts` a key is first ranked in that many parts, so that the rows that very many tasks send of a
    common key don't meet in one.
    """
    order = [F.desc("last_seen"), F.desc("listing_id")]

    def top(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")

    if salts > 1:
        df = top(df.withColumn("_salt", F.pmod(F.xxhash64("listing_id"), F.lit(salts))), key, "_salt").drop("_salt")
    return top(df, key)


def fulltext_tokens(c: Column) -> Column:
    return F.filter(
        F.array_distinct(F.split(tx.normalize(c), " ")),
        lambda w: (F.length(w) >= lx.FULLTEXT_MIN_TOKEN) & ~w.isin(lx.FULLTEXT_STOPWORDS),
    )


def fulltext_query(
    target_role: Column, titles: Column, variations: Column, skills: Column, keywords: Column, max_titles: int | None = None,
    max_variations: int | None = None, max_skills: int | None = None, max_keywords: int | None = None,
) -> Column:
    """What a profile is searched by: all its terms, unless a limit keeps the first of a kind."""
    terms = F.concat(
        F.array(target_role), tx.first(titles, max_titles), tx.first(variations, max_variations), tx.first(skills, max_skills),
        tx.first(keywords, max_keywords),
    )
    usable = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.length(t) >= 2)
    return F.array_join(tx.distinct_ignore_case(usable), " ")


def like_terms(
    target_role: Column, titles: Column, variations: Column, skills: Column, max_titles: int | None = None,
    max_variations: int | None = None, max_skills: int | None = None, limit: int | None = None,
) -> Column:
    """Terms a listing may hold as they are: all, unless limits are given."""
    terms = F.concat(F.array(target_role), tx.first(titles, max_titles), tx.first(variations, max_variations), tx.first(skills, max_skills))
    usable = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.length(t) >= 2)
    return tx.first(F.filter(tx.distinct_ignore_case(usable), lambda t: F.length(t) >= 3), limit)


#: Rows of what terms are looked up by, up to which they are broadcast to the texts.
LOOKED_UP = 200_000


def containing_texts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact substring join: (term, listing_id) with `term` contained in the normalised `text`.

    Where what the terms are looked up by is counted to be small, a text is searched while its words are at hand, so neither
    texts nor pairs to be checked are shuffled. A term of one word gives an id once, a longer one every row of `texts` that holds it.
    """
    places = looked_up(texts, terms)
    if places.count() > LOOKED_UP:
        candidates = _tokens(texts).join(places, "token").select("term", "n", "listing_id").distinct()
        verified = (
            candidates.filter("n > 1").join(texts, "listing_id").filter(F.contains("text", "term")).select("term", "listing_id")
        )
        return candidates.filter("n = 1").select("term", "listing_id").unionByName(verified)
    rows = texts.select("listing_id", "text", F.monotonically_increasing_id().alias("_row"))
    met = rows.select("*", _words(F.col("text")).alias("token")).join(F.broadcast(places), "token")
    holds = (F.col("n") == 1) | (F.col("listing_id").isNotNull() & F.contains("text", "term"))
    return met.filter(holds).select("term", "listing_id", F.when(F.col("n") > 1, F.col("_row")).alias("_row")).distinct().select("term", "listing_id")


def met_texts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n, listing_id): every text that holds the term of `n` words, and for n > 1 a few that don't.

    A pair may come more than once, all times from one row of `texts`. What the terms are looked up by is small beside
    the texts; where it is counted to be, no word of a text is shuffled.
    """
    return _tokens(texts).join(small(looked_up(texts, terms), LOOKED_UP), "token").select("term", "n", "listing_id")


def _words(text: Column) -> Column:
    return F.explode(F.array_distinct(F.split(text, " ")))


def _tokens(texts: DataFrame) -> DataFrame:
    return texts.select("listing_id", _words(F.col("text")).alias("token"))


def looked_up(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n, token): the tokens of the texts that lead to a term of `n` words.

    No text meets a term it shares nothing with: words of a term are looked up in the vocabulary
    (through short character grams, because the first and last word may stand inside longer
    words), and the rarest word of each term leads to its texts.
    """
    vocabulary = _tokens(texts).groupBy("token").agg(F.count("*").alias("texts")).filter("token <> ''")
    n = F.size("words")
    parts = (
        terms.select("term").filter("term <> ''").distinct()
        .select("term", F.split("term", " ").alias("words"))
        .select("term", n.alias("n"), F.posexplode("words").alias("pos", "word"))
        .withColumn(
            "kind",
            F.when(F.col("n") == 1, "inside").when(F.col("pos") == 0, "end")
            .when(F.col("pos") == F.col("n") - 1, "start").otherwise("whole"),
        )
    )
    # a whole word is looked up as it is, a first or last word by its end or start, and a word
    # that may stand anywhere inside a token by its first three letters
    word = F.col("word")
    key = F.concat_ws(
        " ", "kind",
        F.when(F.col("kind") == "whole", word).when(F.col("kind") == "end", F.right(word, F.lit(3))).otherwise(F.left(word, F.lit(3))),
    )
    asked = cut(parts.select("word", "kind").distinct().withColumn("key", key))
    # only the keys that some word asks for are made: at most three lengths of a kind
    sizes: dict[str, list[int]] = {}
    for row in asked.select("kind", F.least(F.length("word"), F.lit(3)).alias("g")).distinct().collect():
        sizes.setdefault(row.kind, []).append(row.g)

    def grams(kind: str) -> Column:
        token, lengths = F.col("token"), sorted(sizes[kind])
        if kind == "whole":
            return F.array(F.concat(F.lit("whole "), token))
        if kind == "inside":
            inside = F.array_distinct(F.concat(*[F.regexp_extract_all(token, F.lit(f"(?=(.{{{g}}}))"), F.lit(1)) for g in lengths]))
            return F.transform(inside, lambda g: F.concat(F.lit("inside "), g))
        end = F.left if kind == "start" else F.right
        return F.array_distinct(F.array(*[F.concat(F.lit(f"{kind} "), end(token, F.lit(g))) for g in lengths]))

    keys = F.concat(*[grams(kind) for kind in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    found = cut(
        vocabulary.select("token", "texts", F.explode(keys).alias("key")).join(small(asked), "key")
        .filter(
            F.when(F.col("kind") == "inside", F.contains("token", "word"))
            .when(F.col("kind") == "end", F.endswith("token", "word"))
            .when(F.col("kind") == "start", F.startswith("token", "word"))
            .otherwise(F.lit(True))
        )
        .select("word", "kind", "token", "texts")
    )
    cost = found.groupBy("word", "kind").agg(F.sum("texts").alias("cost"))
    anchors = (
        parts.join(cost, ["word", "kind"])
        .groupBy("term", "n")
        .agg(F.min(F.struct("cost", "word", "kind")).alias("rarest"), F.count("*").alias("matched"))
        .filter("matched = n")
        .select("term", "n", F.col("rarest.word").alias("word"), F.col("rarest.kind").alias("kind"))
    )
    return cut(anchors.join(found.select("word", "kind", "token"), ["word", "kind"]).select("term", "n", "token"))


def retrieve(profiles: DataFrame, listings: DataFrame, limit: int = lx.RETRIEVAL_LIMIT, top_up: int = lx.TOP_UP_LIMIT) -> DataFrame:
    """(profile_id, listing_id, tier, last_seen), at most `limit` per profile.

    Tier 1 takes listings with any full-text token, tier 2 (only for profiles below the limit)
    listings containing one of the strongest terms, tier 3 (only for profiles with nothing) the
    newest listings. A profile's newest `limit` come from the newest `limit` of each of its
    terms, so postings are cut per term before the join without changing the result.
    """
    c = F.col
    active = listings.filter("status = 'active'")
    text = F.concat_ws(" ", "title", "company", "description")
    query = fulltext_query(c("target_role"), c("titles"), c("query_variations"), c("skills"), c("keywords"))
    wanted = profiles.select("profile_id", F.explode(fulltext_tokens(query)).alias("token"))
    # tokens that nobody asks for end right after the scan
    asked = active.select("listing_id", "last_seen", F.explode(fulltext_tokens(text)).alias("token")).join(
        wanted.select("token").distinct(), "token", "left_semi"
    )
    postings = newest(asked, "token", limit, salts=POSTING_SALTS)
    hits = wanted.join(postings, "token").select("profile_id", "listing_id", "last_seen").distinct()
    first = cut(newest(hits, "profile_id", limit).select("profile_id", "listing_id", F.lit(1).alias("tier"), "last_seen"))

    counts = first.groupBy("profile_id").agg(F.count("*").alias("have"))
    short = cut(
        profiles.join(counts, "profile_id", "left")
        .filter(F.coalesce("have", F.lit(0)) < limit)
        .select(
            "profile_id",
            F.explode(like_terms(c("target_role"), c("titles"), c("query_variations"), c("skills"))).alias("raw"),
        )
        .select("profile_id", tx.normalize(c("raw")).alias("term"))
    )
    lacking = profiles.join(counts.filter(c("have") >= limit), "profile_id", "left_anti").select("profile_id")
    if lacking.isEmpty():
        return first

    texts = cut(active.select("listing_id", tx.normalize(text).alias("text")))
    matches = newest(
        containing_texts(texts, short).join(active.select("listing_id", "last_seen"), "listing_id"), "term", limit
    )
    second = newest(
        short.join(matches, "term").select("profile_id", "listing_id", "last_seen").distinct(), "profile_id", limit
    ).withColumn("tier", F.lit(2))

    merged = (
        first.unionByName(second).groupBy("profile_id", "listing_id").agg(F.min("tier").alias("tier"), F.max("last_seen").alias("last_seen"))
    )
    order = Window.partitionBy("profile_id").orderBy("tier", F.desc("last_seen"), F.desc("listing_id"))
    kept = cut(merged.withColumn("_rank", F.row_number().over(order)).filter(c("_rank") <= limit).drop("_rank"))
    empty = profiles.select("profile_id").join(kept.select("profile_id").distinct(), "profile_id", "left_anti")
    result = kept.select("profile_id", "listing_id", "tier", "last_seen")
    if empty.isEmpty():
        return result

    # the top-up pool is one short array, read as a scalar subquery
    pool = active.orderBy(F.desc("last_seen"), F.desc("listing_id")).limit(top_up).agg(
        F.collect_list(F.struct("listing_id", "last_seen"))
    )
    third = empty.select("profile_id", F.explode(pool.scalar()).alias("p")).select(
        "profile_id", "p.listing_id", F.lit(3).alias("tier"), "p.last_seen"
    )
    return result.unionByName(third)


def relevance(terms: Column, title: Column, body: Column) -> Column:
    """Title holds one term or the body two different ones; empty inputs decide nothing and pass.

    `title` (title and company) and `body` are normalised.
    """
    in_title = F.exists(terms, lambda t: F.contains(title, t))
    in_body = F.size(F.filter(terms, lambda t: F.contains(body, t))) >= 2
    return (F.size(terms) <= 0) | ((title == "") & (body == "")) | ((title != "") & in_title) | in_body


def relevant_by_terms(profile_terms: DataFrame, title_hits: DataFrame, body_hits: DataFrame) -> DataFrame:
    """The same gate for all profiles x listings from containment hits (term, listing_id)."""
    titles = profile_terms.join(title_hits, "term").select("profile_id", "listing_id").distinct()
    bodies = (
        profile_terms.join(body_hits, "term").groupBy("profile_id", "listing_id").agg(F.count("*").alias("terms"))
        .filter("terms >= 2").select("profile_id", "listing_id")
    )
    return titles.unionByName(bodies).distinct()


def relevant_everywhere(profile_terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(profile_id, listing_id) of all relevant pairs: `relevant_by_terms` over every profile and every listing.

    `profile_terms`: profile_id, term. `texts`: listing_id, head, body, normalised. Where the terms are counted to be few enough
    to be held by the tasks, a listing is read where it lies and gives its profiles at once: neither texts nor hits nor pairs are
    shuffled or kept. Rows that share an id are judged together, so those, and all where the terms are many, meet in joins.
    """
    terms = cut(profile_terms.groupBy("profile_id", "term").agg(F.count("*").alias("times")))

    def joined(rows: DataFrame) -> DataFrame:
        sides = [rows.select("listing_id", F.col(n).alias("text")) for n in ("head", "body")]
        asked = terms.select("term").distinct()
        return relevant_by_terms(profile_terms, *[containing_texts(cut(side), asked) for side in sides])

    if terms.count() > LOOKED_UP:
        return joined(texts)
    again = cut(texts.groupBy("listing_id").agg(F.count("*").alias("n")).filter("n > 1 OR listing_id IS NULL").select(F.col("listing_id").alias("_again")))
    single = texts.join(small(again.filter("_again IS NOT NULL")), F.col("listing_id") == F.col("_again"), "left_anti").filter("listing_id IS NOT NULL")
    found = _relevant_rows(terms, single)
    if again.isEmpty():
        return found
    return found.unionByName(joined(texts.join(small(again), F.col("listing_id").eqNullSafe(F.col("_again")), "left_semi")))


#: Words of which a task remembers the terms, and rows that it judges at once.
KNOWN_TOKENS, JUDGED_ROWS = 200_000, 200


class _TermsOfWord(dict):
    """Word of a text -> (terms of one word that stand in it, longer terms whose first word ends it), by their numbers."""

    def __init__(self, terms: list[str]) -> None:
        super().__init__()
        self.single = {t: k for k, t in enumerate(terms) if t and " " not in t}
        self.longer: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            if " " in t:
                self.longer.setdefault(t.split(" ", 1)[0], []).append(k)
        self.sizes, self.ends = sorted({len(t) for t in self.single}), sorted({len(t) for t in self.longer})

    def __missing__(self, word: str) -> tuple[list[int], list[int]]:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        inside = {word[i: i + n] for n in self.sizes for i in range(len(word) - n + 1)}
        ends = [k for n in self.ends if n <= len(word) for k in self.longer.get(word[len(word) - n:], ())]
        found = [self.single[x] for x in inside if x in self.single], ends
        if len(word) <= 64:
            self[word] = found
        return found


def _relevant_rows(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """The gate of `relevant_everywhere` row by row; `terms` (profile_id, term, times) are held by every task."""
    schema = T.StructType([terms.schema["profile_id"], texts.schema["listing_id"]])
    table = terms.orderBy("term").toArrow()
    names = table.column("term").to_pylist()
    new = [k for k, t in enumerate(names) if not k or t != names[k - 1]]
    profiles = table.column("profile_id").combine_chunks().dictionary_encode("encode")
    # term -> its profiles, one run after the other
    held = terms.sparkSession.sparkContext.broadcast((
        [names[k] for k in new], np.array([*new, len(names)]), profiles.indices.to_numpy(), table.column("times").to_numpy(), profiles.dictionary
    ))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, starts, owners, times, ids = held.value
        known = _TermsOfWord(wanted)

        def hits(text: str | None) -> set[int]:
            found, longer = set(), set()
            for word in set((text or "").split(" ")):
                inside, ends = known[word]
                found.update(inside)
                longer.update(ends)
            return found.union(k for k in longer if wanted[k] in text)

        def owned(rows: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
            """row and profile of every hit, as one number, and how often the profile has the term"""
            row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            term = np.fromiter((k for x in rows for k in x), "int64", len(row))
            n = starts[term + 1] - starts[term]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n)
            return np.repeat(row, n) * len(ids) + owners[at], times[at]

        for batch in batches:
            for lower in range(0, batch.num_rows, JUDGED_ROWS):
                part = batch.slice(lower, JUDGED_ROWS)
                in_head, _ = owned([hits(x.as_py()) for x in part.column(1)])
                in_body, counts = owned([hits(x.as_py()) for x in part.column(2)])
                both, place = np.unique(in_body, return_inverse=True)
                twice = both[np.bincount(place, counts, len(both)) >= 2] if len(both) else both
                pairs = np.union1d(in_head, twice)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs % len(ids))), part.column(0).take(pa.array(pairs // len(ids)))], names=schema.names)

    return texts.select("listing_id", "head", "body").mapInArrow(judge, schema) if names else texts.sparkSession.createDataFrame([], schema)


def in_wanted_city(
    location: Column, work_mode: Column, wanted: Column, location_mode: Column, profile_mode: Column
) -> Column:
    """City filter: unknown places and remote listings stay, remote profiles are not filtered."""
    place = tx.normalize(F.coalesce(location, F.lit("")))
    keys = F.filter(F.transform(wanted, lambda w: tx.normalize(w)), lambda w: w != "")
    hit = tx.let(place, lambda p: F.exists(keys, lambda w: F.contains(p, w)))
    return (
        (location_mode != "cities") | (profile_mode == "remote") | (F.size(keys) == 0) | (place == "") | hit
        | F.coalesce(work_mode == "remote", F.lit(False))
    )


# --- professions -------------------------------------------------------------------------


def lookup_profession(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """title_id, title -> canonical: the exact alias, else the longest equivalent alias it contains.

    `aliases`: canonical, alias, kind ('equivalent' | 'related'). An alias two entries claim
    belongs to the one that calls it equivalent, else to the first by name.
    """
    keyed = aliases.select("canonical", tx.normalize(F.col("alias")).alias("alias"), "kind").filter("alias <> ''")
    owners = keyed.groupBy("alias").agg(
        F.min(F.struct(F.when(F.col("kind") == "equivalent", 0).otherwise(1).alias("o"), "canonical")).alias("owner")
    ).select("alias", F.col("owner.canonical").alias("canonical"), (F.col("owner.o") == 0).alias("equivalent"))
    keys = titles.select("title_id", tx.normalize(F.col("title")).alias("text"))
    exact = keys.join(owners.withColumnRenamed("alias", "text"), "text").select("title_id", "canonical")
    rest = keys.join(exact, "title_id", "left_anti").filter("text <> ''")
    distinct_texts = rest.groupBy("text").agg(F.min("title_id").alias("listing_id"))
    loose = owners.filter(F.col("equivalent") & (F.length("alias") >= 5))
    inside = containing_texts(distinct_texts, loose.select(F.col("alias").alias("term")))
    best = (
        inside.join(loose, inside["term"] == loose["alias"])
        .groupBy("listing_id")
        .agg(F.max(F.struct(F.length("alias").alias("size"), "alias", "canonical")).alias("best"))
        .select("listing_id", F.col("best.canonical").alias("canonical"))
    )
    found = (
        rest.join(distinct_texts, "text").join(best, "listing_id").select("title_id", "canonical")
    )
    return exact.unionByName(found)


def expand_profession(lookups: DataFrame, titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """profile_id -> equivalents (without the profile's own titles), related, canonicals.

    `titles`: profile_id, title_id, title.
    """
    own = titles.groupBy("profile_id").agg(F.collect_set(tx.normalize(F.col("title"))).alias("own"))
    hits = titles.join(lookups, "title_id").select("profile_id", "canonical").distinct()
    terms = hits.join(aliases, "canonical").groupBy("profile_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "equivalent", F.col("alias")))).alias("equivalents"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "related", F.col("alias")))).alias("related"),
        F.sort_array(F.collect_set("canonical")).alias("canonicals"),
    )
    return terms.join(own, "profile_id").select(
        "profile_id",
        F.filter("equivalents", lambda a: ~F.array_contains(F.col("own"), tx.normalize(a))).alias("equivalents"),
        "related", "canonicals",
    )


# --- search plans ------------------------------------------------------------------------

TECH_PROFILE = (
    r"developer|engineer|software|frontend|backend|full stack|data|devops|qa|react|node|python|java|sql|ui/ux|product"
)


def search_plans(
    target_role: Column, titles: Column, skills: Column, locations: Column, location_mode: Column, work_mode: Column
) -> Column:
    """array<struct(query, base_score, category)>: at most five distinct plans"""
    role, s1, s2 = target_role, F.get(skills, F.lit(0)), F.get(skills, F.lit(1))
    work = F.when(work_mode == "remote", "remote").when(work_mode == "hybrid", "hibrit")
    city = F.when(location_mode == "cities", F.get(locations, F.lit(0)))
    other = F.get(F.filter(titles, lambda t: t != role), F.lit(0))

    def plan(query: Column, score: int, category: str, when: Column | None = None) -> Column:
        row = F.struct(query.alias("query"), F.lit(score).alias("base_score"), F.lit(category).alias("category"))
        return row if when is None else F.when(when, row)

    tech = is_tech_profile(skills, titles)
    plans = F.filter(
        F.array(
            plan(pf.join_query(role, s1, s2, work), 88, "recommended"),
            plan(pf.join_query(role, s1), 82, "recommended"),
            plan(pf.join_query(role, city), 78, "general", city.isNotNull()),
            plan(pf.join_query(other, s1), 76, "general", other.isNotNull()),
            plan(pf.join_query(role, F.coalesce(s1, F.lit("technology"))), 74, "tech", tech),
        ),
        lambda p: p.isNotNull() & (p["query"] != ""),
    )
    return tx.let(
        plans,
        lambda p: F.slice(
            tx.distinct_by_key(p, F.transform(p, lambda x: tx.turkish_lower(x["query"]))), 1, 5
        ),
    )


def is_tech_profile(skills: Column, titles: Column) -> Column:
    return tx.turkish_lower(F.array_join(F.concat(skills, titles), " ")).rlike(TECH_PROFILE)


def search_links(profiles: DataFrame, platforms: list[tuple] = lx.SEARCH_PLATFORMS, limit: int = 14) -> DataFrame:
    """Search links per profile: its plans on the platforms that fit, distinct URLs, best first.

    Plans and platforms are short constant arrays, so everything happens inside the profile row.
    """
    c = F.col
    table = F.array(*[
        F.struct(
            F.lit(i).alias("no"), F.lit(name).alias("platform"), F.lit(category).alias("category"),
            F.lit(boost).alias("boost"), F.lit(direct).alias("direct"), F.lit(url).alias("template"),
        )
        for i, (name, category, boost, direct, url) in enumerate(platforms)
    ])
    skills = F.slice(c("skills"), 1, 4)
    bonus = (
        F.when(F.size(skills) >= 2, 3).otherwise(0)
        + F.when(c("location_mode") == "cities", 2).otherwise(0)
        + F.when(c("work_mode") != "any", 2).otherwise(0)
    )
    planned = profiles.select(
        "profile_id", bonus.alias("bonus"), is_tech_profile(c("skills"), c("titles")).alias("tech"),
        F.posexplode(
            search_plans(c("target_role"), c("titles"), skills, c("locations"), c("location_mode"), c("work_mode"))
        ).alias("plan_no", "plan"),
    )

    def fits(p: Column) -> Column:
        return (
            F.when(p["category"] == "public", c("plan_no") == 0)
            .when(p["platform"] == "LinkedIn", c("plan_no") <= 1)
            .when(p["platform"] == "Toptalent", c("tech") | (c("plan_no") == 0))
            .when((c("plan_no") >= 2) & (p["platform"] == "Yenibiriş"), F.lit(False))
            .otherwise(
                (p["category"] == "general") | (c("plan.category") == p["category"])
                | (c("plan.category") == "recommended")
            )
        )

    chosen = F.filter(table, fits)
    links = planned.select(
        "profile_id", "plan_no", "plan", "bonus",
        F.explode(F.when(c("plan_no") == 0, F.slice(chosen, 1, 7)).otherwise(F.slice(chosen, 1, 4))).alias("p"),
    ).select(
        "profile_id", "plan_no", c("p.no").alias("platform_no"), "p.platform", c("plan.query").alias("query"),
        tx.fill_search_template(c("p.template"), c("plan.query")).alias("url"),
        F.least(F.lit(98), F.greatest(F.lit(45), c("plan.base_score") + c("p.boost") + c("bonus"))).alias("score"),
        c("p.direct").alias("direct"),
    )
    first = Window.partitionBy("profile_id", tx.turkish_lower(F.regexp_replace("url", "/+$", ""))).orderBy("plan_no", "platform_no")
    best = Window.partitionBy("profile_id").orderBy(F.desc("score"), "plan_no", "platform_no")
    return (
        links.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
        .withColumn("position", F.row_number().over(best)).filter(c("position") <= limit)
        .withColumn(
            "confidence", F.when(~c("direct"), "low").when(c("score") >= 86, "high").otherwise("medium")
        )
        .select("profile_id", "position", "platform", "query", "url", "score", "confidence")
    )
