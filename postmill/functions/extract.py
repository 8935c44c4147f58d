"""Extraction from listing texts: requirements, skills, contact addresses."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import quality as ql
from postmill.functions import text as tx


def first_match(folded: Column, rules: Sequence[tuple[str, str]], default: str | None = lx.UNSPECIFIED) -> Column:
    """Label of the first rule whose pattern is found; `folded` is computed once, not once a rule."""
    def chain(text: Column) -> Column:
        (pattern, label), *others = rules
        found = F.when(text.rlike(pattern), label)
        for pattern, label in others:
            found = found.when(text.rlike(pattern), label)
        return found.otherwise(F.lit(default))

    return tx.let(folded, chain)


def strip_criteria_noise(c: Column) -> Column:
    """Cut at each advert marker unless the text starts with it; a text without any is looked through once per marker."""
    def cut_at(marker: str):
        return lambda x: F.when(F.startswith(x, F.lit(marker)), x).otherwise(F.substring_index(x, marker, 1))

    def cut_all(x: Column) -> Column:
        rest = x
        for marker in lx.CRITERIA_NOISE:
            rest = tx.let(rest, cut_at(marker))
        noisy = reduce(or_, (F.contains(x, F.lit(marker)) for marker in lx.CRITERIA_NOISE))
        return F.when(noisy, rest).otherwise(x)

    return tx.squeeze(tx.let(c, cut_all))


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


MIN_YEARS = r"en\s*az\s*([0-9]+)\s*yil"
MAX_YEARS = r"en\s*cok\s*([0-9]+)\s*yil"


def experience_requirement(c: Column) -> Column:
    """struct(min_years, max_years, accepts_no_experience)"""
    text = tx.fold(strip_criteria_noise(F.regexp_replace(c, "(?i)^Tecr[üu]be", "")))
    least = _number(text, MIN_YEARS)
    return F.struct(
        least.alias("min_years"),
        _number(text, MAX_YEARS).alias("max_years"),
        (text.rlike("tecrubesiz") & (F.coalesce(least, F.lit(0)) == 0)).alias("accepts_no_experience"),
    )


def education_requirement(c: Column) -> Column:
    """array<struct(level, student, graduate)>, one entry per level in order of appearance"""
    text = F.regexp_replace(tx.fold(strip_criteria_noise(c)), r"^egitim\s*seviyesi", "")
    pattern = F.lit(r"([^,()]+)\(([^)]*)\)")
    named = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("state"),
    )
    found = F.filter(
        F.transform(
            named,
            lambda x: F.struct(
                first_match(x["name"], lx.EDUCATION_PATTERNS, None).alias("level"),
                x["state"].rlike("ogrenci").alias("student"),
                x["state"].rlike("mezun").alias("graduate"),
            ),
        ),
        lambda x: x["level"].isNotNull(),
    )
    return tx.let(
        found,
        lambda all_: F.transform(
            F.array_distinct(F.transform(all_, lambda x: x["level"])),
            lambda level: F.struct(
                level.alias("level"),
                F.exists(all_, lambda x: (x["level"] == level) & x["student"]).alias("student"),
                F.exists(all_, lambda x: (x["level"] == level) & x["graduate"]).alias("graduate"),
            ),
        ),
    )


def language_requirement(c: Column) -> Column:
    """array<struct(language, level)>"""
    text = F.regexp_replace(strip_criteria_noise(c), r"(?i)^Yabanc[ıi]\s*Dil", "")
    pattern = F.lit(r"([A-Za-zÇĞİÖŞÜçğıöşü]+)\s*\(([^)]*)\)")
    named = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("language"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("grade"),
    )
    return F.transform(
        F.filter(named, lambda x: F.length(x["language"]) >= 3),
        lambda x: F.struct(
            x["language"].alias("language"),
            first_match(tx.fold(x["grade"]), lx.LANGUAGE_LEVEL_PATTERNS).alias("level"),
        ),
    )


def employment_type(c: Column) -> Column:
    return first_match(tx.fold(c), lx.EMPLOYMENT_PATTERNS)


def seniority(c: Column) -> Column:
    return first_match(tx.fold(c), lx.SENIORITY_PATTERNS)


def _sentences(clean: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(clean, r"(?<=[.;])\s+|\n+|(?<=,)\s(?=[A-ZÇĞİÖŞÜ])"), lambda s: F.trim(s)),
        lambda s: F.length(s) >= 8,
    )
    return tx.let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(clean)))


def requirement_sentences(lines: Column) -> Column:
    usable = F.filter(lines, lambda x: ~ql.is_code_noise(x))
    clean = F.filter(F.transform(usable, strip_criteria_noise), lambda x: F.length(x) >= 8)
    return F.flatten(F.transform(clean, _sentences))


def is_preferred(sentence: Column) -> Column:
    return tx.fold(sentence).rlike(lx.PREFERRED_MARKERS)


def split_requirements(lines: Column) -> Column:
    """struct(required, preferred); sentences without a marker are required"""
    def sides(marked: Column) -> Column:
        def side(flag: Column) -> Column:
            return F.transform(F.filter(marked, lambda m: m["preferred"] == flag), lambda m: m["sentence"])

        return F.struct(side(F.lit(False)).alias("required"), side(F.lit(True)).alias("preferred"))

    # every sentence is searched for markers once
    return tx.let(F.transform(requirement_sentences(lines), lambda x: F.struct(x.alias("sentence"), is_preferred(x).alias("preferred"))), sides)


def role_requirements(
    title: Column, description: Column, requirements: Column, criteria: Column, location: Column, work_mode: Column
) -> Column:
    """What a listing asks for, as one struct."""
    none = F.array().cast("array<string>")
    requirements, criteria = F.coalesce(requirements, none), F.coalesce(criteria, none)
    description, title = F.coalesce(description, F.lit("")), F.coalesce(title, F.lit(""))

    def lines_of(pattern: str) -> Column:
        return F.filter(criteria, lambda x: tx.fold(F.trim(x)).rlike(pattern))

    experience_lines, education_lines, language_lines = (
        lines_of(p) for p in (r"^tecrube", r"^egitim\s*seviyesi", r"^yabanci\s*dil")
    )
    experience = F.when(
        F.size(experience_lines) > 0, experience_requirement(F.element_at(experience_lines, -1))
    )
    education = F.coalesce(
        F.when(F.size(education_lines) > 0, education_requirement(F.element_at(education_lines, -1))),
        F.array().cast("array<struct<level:string,student:boolean,graduate:boolean>>"),
    )
    languages = F.coalesce(
        F.when(F.size(language_lines) > 0, language_requirement(F.element_at(language_lines, -1))),
        F.array().cast("array<struct<language:string,level:string>>"),
    )
    full = F.concat_ws("\n", title, description, F.array_join(requirements, "\n"), F.array_join(criteria, "\n"))
    inline_years = _number(tx.fold(full), MIN_YEARS)
    usable = F.filter(requirements, lambda x: ~ql.is_code_noise(x))
    split = split_requirements(F.when(F.size(usable) > 0, usable).otherwise(F.array(description)))
    head = F.concat_ws("\n", title, description)

    def count(flag: Column) -> Column:
        return flag.cast("int")

    def assemble(x: Column) -> Column:
        years = x["experience"]["min_years"]
        return F.struct(
            F.coalesce(years, x["inline_years"]).alias("min_years"),
            x["experience"]["max_years"].alias("max_years"),
            F.coalesce(x["experience"]["accepts_no_experience"], F.lit(False)).alias("accepts_no_experience"),
            x["education"].alias("education"),
            (
                (F.size(x["education"]) > 0)
                & F.forall(x["education"], lambda e: e["graduate"] & ~e["student"])
            ).alias("requires_graduate"),
            F.exists(x["education"], lambda e: e["student"]).alias("accepts_student"),
            x["languages"].alias("languages"),
            x["employment"].alias("employment_type"),
            x["seniority"].alias("seniority"),
            x["split"]["required"].alias("required_skills"),
            x["split"]["preferred"].alias("preferred_skills"),
            # what terms are sought in, once per listing and not per pair
            tx.normalize(F.array_join(x["split"]["required"], " ")).alias("required_text"),
            tx.normalize(F.array_join(x["split"]["preferred"], " ")).alias("preferred_text"),
            F.when(F.coalesce(location, F.lit("")) != "", F.array(location)).otherwise(none).alias("locations"),
            F.coalesce(work_mode, F.lit("any")).alias("work_mode"),
            (
                F.size(experience_lines)
                + F.when(F.size(x["education"]) > 0, F.size(education_lines)).otherwise(0)
                + F.when(F.size(x["languages"]) > 0, F.size(language_lines)).otherwise(0)
                + count(x["employment"] != lx.UNSPECIFIED)
                + count(x["seniority"] != lx.UNSPECIFIED)
                + count(years.isNull() & x["inline_years"].isNotNull())
            ).alias("extracted_fields"),
        )

    return tx.let(
        F.struct(
            experience.alias("experience"),
            education.alias("education"),
            languages.alias("languages"),
            inline_years.alias("inline_years"),
            employment_type(head).alias("employment"),
            seniority(head).alias("seniority"),
            split.alias("split"),
        ),
        assemble,
    )


def section_sentences(c: Column, marker: str, until: str | None = None, window: int | None = None, limit: int | None = None) -> Column:
    """Sentences from a section marker to the marker of another section (`until`) or the end.

    A window in characters and a number of sentences limit them if given.
    """
    folded = tx.fold(c)
    start = F.regexp_instr(folded, F.lit(marker))
    block = F.substring(c, start, F.length(c) if window is None else F.lit(window))
    if until is not None:
        other = F.regexp_instr(F.substring(folded, start + 1, F.length(c)), F.lit(until))
        block = F.when(other > 0, F.substring(block, F.lit(1), other)).otherwise(block)
    pieces = F.filter(
        F.transform(F.split(block, r"[-–•\n]|\.\s+"), tx.clean_html), lambda s: F.length(s) > 12
    )
    return F.when(start > 0, tx.first(pieces, limit)).otherwise(F.array().cast("array<string>"))


# --- dictionary terms ----------------------------------------------------------------

_LETTER_CLASS = {"i": "[iİIı]", "g": "[gğĞG]", "u": "[uüÜU]", "s": "[sşŞS]", "o": "[oöÖO]", "c": "[cçÇC]"}


def _fold_py(value: str) -> str:
    return value.translate(str.maketrans(lx.TURKISH_FROM, lx.TURKISH_TO)).lower()


def normalize_py(value: str) -> str:
    """The same comparison form as `text.normalize`, for dictionary literals."""
    return re.sub(r"[^a-z0-9+#.]+", " ", _fold_py(value)).strip()


def tree_pattern(keys: Sequence[str], literal: Callable[[str], str] = re.escape) -> str:
    """One pattern matching the longest of `keys` at a position; shared prefixes are factored out."""
    tree: dict = {}
    for key in keys:
        node = tree
        for char in key:
            node = node.setdefault(char, {})
        node[""] = {}

    def build(node: dict) -> str:
        branches = []
        for char, child in sorted(node.items()):
            if char:
                run = literal(char)
                # a run without branches is no recursion
                while len(child) == 1 and "" not in child:
                    (char, child), = child.items()
                    run += literal(char)
                branches.append(run + build(child))
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return build(tree)


def longest_first_pattern(terms: Sequence[str], raw: bool = False) -> str:
    """One pattern matching the longest term at a position; shared prefixes are factored out."""
    def literal(char: str) -> str:
        if not raw:
            return re.escape(char)
        if char in _LETTER_CLASS:
            return _LETTER_CLASS[char]
        return f"[{char}{char.upper()}]" if char.isalpha() else re.escape(char)

    return tree_pattern([_fold_py(term) for term in terms], literal)


def _labels(terms: Sequence[str]) -> Column:
    canonical: dict[str, str] = {}
    for term in terms:
        canonical.setdefault(_fold_py(term), term)
    return F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])


def known_skills(c: Column, dictionary: Sequence[str] = lx.SAMPLE_SKILLS) -> Column:
    """Dictionary terms found reading left to right, longest term first, each once."""
    terms = [t for t in dictionary if len(_fold_py(t)) >= 2]
    found = F.regexp_extract_all(tx.fold(c), F.lit(f"({longest_first_pattern(terms)})"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda key: F.element_at(_labels(terms), key))


def counted_skills(c: Column, dictionary: Sequence[str] = lx.SAMPLE_SKILLS) -> Column:
    """Normalised skills that also stand in the text as whole words (phrases: as written)."""
    def verify(text: Column) -> Column:
        return tx.let(
            F.split(text, " "),
            lambda tokens: F.filter(
                F.array_distinct(F.transform(known_skills(c, dictionary), tx.normalize)),
                lambda s: F.when(F.contains(s, F.lit(" ")), F.contains(text, s)).otherwise(
                    F.array_contains(tokens, s)
                ),
            ),
        )

    return tx.let(tx.normalize(c), verify)


def split_skill_segment(c: Column, dictionary: Sequence[str] = lx.SAMPLE_SKILLS) -> Column:
    """Split a run-on block ("ReactHTMLCSS") into its skills; other segments stay whole."""
    terms = [t for t in dictionary if len(_fold_py(t)) >= 2]
    pattern = longest_first_pattern(terms, raw=True)
    labels = _labels(terms)
    segment = F.trim(c)
    next_chars = F.regexp_extract_all(segment, F.lit(f"(?>{pattern})(?=((?s:.?)))"), F.lit(1))
    touching = F.exists(next_chars, lambda x: x.rlike("^[A-ZÇĞİÖŞÜ]"))
    found = known_skills(segment, dictionary)
    covered = F.length(F.replace(F.array_join(F.transform(found, tx.normalize), ""), F.lit(" "), F.lit("")))
    whole = F.length(F.replace(tx.normalize(segment), F.lit(" "), F.lit("")))
    run_on = (
        (F.length(segment) >= 8)
        & ~segment.rlike("[,;|•·]")
        & (touching | ((F.size(found) >= 2) & (covered / whole >= 0.7)))
    )
    marked = F.regexp_replace(segment, f"(?>({pattern}))", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")

    def piece(p: Column, i: Column) -> Column:
        rest = F.trim(p)
        keep = (F.length(rest) >= 4) & rest.rlike("[a-zA-ZçğıöşüÇĞİÖŞÜ]")
        return F.when(i % 2 == 1, F.element_at(labels, tx.fold(p))).when(keep, rest)

    with_rest = F.filter(F.transform(pieces, piece), lambda p: p.isNotNull())
    with_rest = tx.let(
        with_rest, lambda items: tx.let(
            F.transform(items, tx.normalize), lambda keys: tx.distinct_by_key(items, keys)
        )
    )
    return (
        F.when(segment == "", F.array().cast("array<string>"))
        .when((F.length(segment) > 40) & (F.size(with_rest) >= 2), with_rest)
        .when((F.length(segment) <= 40) & run_on & (F.size(found) >= 2), found)
        .otherwise(F.array(segment))
    )


def drop_subsumed(terms: Column) -> Column:
    """Drop a term whose comparison form is part of a longer one."""
    return tx.let(
        F.transform(terms, tx.normalize),
        lambda keys: F.filter(
            terms,
            lambda _, i: ~F.exists(
                keys,
                lambda other: (F.length(other) > F.length(F.get(keys, i))) & F.contains(other, F.get(keys, i)),
            ),
        ),
    )


def boundary_terms(c: Column, dictionary: Sequence[str] = lx.SAMPLE_SKILLS) -> Column:
    """Dictionary terms standing alone in the text; overlapping places count, contained terms do not."""
    edge = "[a-z0-9+#.]"
    body = longest_first_pattern(dictionary)
    found = F.regexp_extract_all(tx.fold(c), F.lit(f"(?<!{edge})(?=({body})(?!{edge}))"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda key: F.element_at(_labels(dictionary), key))


def listing_terms(
    title: Column, description: Column, requirements: Column, criteria: Column,
    dictionary: Sequence[str] = lx.SAMPLE_SKILLS, max_skills: int | None = None, max_requirements: int | None = None,
) -> Column:
    """struct(skills, requirements), all of them unless a limit is given"""
    lines = F.concat(requirements, criteria)
    text = F.concat_ws("\n", title, F.array_join(lines, "\n"), description)
    cleaned = F.filter(
        F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\s•\-–—*·]+", ""))),
        lambda x: F.length(x).between(12, 160),
    )
    # dictionary order, as listed
    ordered = tx.let(
        boundary_terms(text, dictionary),
        lambda found: F.filter(tx.lit_array(list(dictionary)), lambda t: F.array_contains(found, t)),
    )
    return F.struct(
        tx.first(tx.let(ordered, drop_subsumed), max_skills).alias("skills"),
        tx.first(tx.distinct_ignore_case(cleaned), max_requirements).alias("requirements"),
    )


# --- contact address -----------------------------------------------------------------


def application_email(c: Column) -> Column:
    """Best application address in a text, or NULL when no address shows any sign of being one."""
    blocked_domains = "|".join(re.escape(d) for d in lx.PLATFORM_DOMAINS)
    blocked_boxes = "|".join(re.escape(b) for b in lx.BLOCKED_MAILBOXES)
    preferred = "|".join(re.escape(b) for b in lx.HIRING_MAILBOXES)

    def rate(address: Column, i: Column, lower: Column) -> Column:
        local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
        at = F.call_function("locate", address, lower)
        start = F.greatest(at - 120, F.lit(1))
        context = F.substring(lower, start, at + F.length(address) + 60 - start)
        score = (
            F.when(local.rlike(f"^(?:{preferred})"), 50).otherwise(0)
            + F.when((at > 0) & tx.fold(context).rlike(lx.APPLY_CONTEXT), 30).otherwise(0)
            + F.when(local.rlike("^[a-z]+[.][a-z]+$"), 5).otherwise(0)
        )
        allowed = (
            (local != "") & (domain != "")
            & ~domain.rlike(f"(?:^|[.])(?:{blocked_domains})$")
            & ~local.rlike(f"^(?:{blocked_boxes})(?:[.]|$)")
        )
        return F.when(allowed, F.struct(score.alias("score"), (-i).alias("order"), address.alias("email")))

    addresses = F.transform(
        F.regexp_extract_all(c, F.lit(f"({lx.EMAIL})"), F.lit(1)),
        lambda e: F.regexp_replace(F.lower(e), r"[.,;:)]+$", ""),
    )
    best = tx.let(
        F.lower(c), lambda lower: F.array_max(F.transform(addresses, lambda a, i: rate(a, i, lower)))
    )
    return F.when(best["score"] > 0, best["email"])


def application_channel(description: Column, requirements: Column, criteria: Column) -> Column:
    """struct(channel, recipient_email, recipient_source)"""
    from_lines = application_email(F.array_join(F.concat(requirements, criteria), "\n"))
    from_text = application_email(F.coalesce(description, F.lit("")))
    return tx.let(
        F.struct(from_lines.alias("lines"), from_text.alias("text")),
        lambda x: F.struct(
            F.when(x["lines"].isNotNull() | x["text"].isNotNull(), "email").otherwise("portal").alias("channel"),
            F.coalesce(x["lines"], x["text"]).alias("recipient_email"),
            F.when(x["lines"].isNotNull(), "listing_requirements")
            .when(x["text"].isNotNull(), "listing_description")
            .alias("recipient_source"),
        ),
    )
