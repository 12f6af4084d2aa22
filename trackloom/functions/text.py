"""Text columns: tokens of place names, near matches, display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short forms that count as the whole word.
ALIASES = {"kere": "lake", "lake": "kere", "stn": "station", "rly": "railway", "univ": "university", "hosp": "hospital"}


def tokens(s: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda x: x != "")


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or replacement apart."""
    return (F.levenshtein(a, b) <= 1) & (F.abs(F.length(a) - F.length(b)) <= 1)


def token_match(query: Column, word: Column, last: Column) -> Column:
    """2: equal or alias; 1: prefix (last token, two letters or more) or one typo (four letters or more); 0: none."""
    alias = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), query), query)
    return F.when((query == word) | (alias == word), 2).when(last & (F.length(query) >= 2) & word.startswith(query), 1).when((F.length(query) >= 4) & within_one_edit(query, word), 1).otherwise(0)


def search_score(query_tokens: list[str], names: list[Column]) -> Column:
    """Sum over query tokens of the best match with any word of the names (arrays of tokens); null if a token has none.

    One more if one of the names has as many words as the query.
    """
    words = F.flatten(F.array(*names))

    def best(q: str, last: bool) -> Column:
        return F.coalesce(F.array_max(F.transform(words, lambda w: token_match(F.lit(q), w, F.lit(last)))), F.lit(0))

    scores = [best(q, i == len(query_tokens) - 1) for i, q in enumerate(query_tokens)]
    found = F.array(*scores)
    whole = F.array_contains(F.array(*[F.size(n) for n in names]), len(query_tokens))
    return F.when(F.forall(found, lambda m: m > 0), F.aggregate(found, F.lit(0), lambda t, m: t + m) + F.when(whole, 1).otherwise(0))


def distance_text(metres: Column) -> Column:
    """"350 m" to the next ten below a kilometre, "1.2 km" from there."""
    return F.when(metres < 1000, F.format_string("%d m", (F.round(metres / 10) * 10).cast("long"))).otherwise(F.format_string("%.1f km", metres / 1000))


def confidence_band(radius: Column) -> Column:
    return F.when(radius < 25, "tight").when(radius < 75, "medium").otherwise("loose")


def turn_kind(radius: Column) -> Column:
    return F.when(radius < 20, "hairpin").when(radius < 60, "sharp").otherwise("bend")


def maneuver_text(angle_deg: Column) -> Column:
    """What to say for a turn of so many degrees, left positive."""
    side = F.when(angle_deg > 0, "left").otherwise("right")
    size = F.abs(angle_deg)
    return F.when(size >= 165, "Make a U-turn").when(size >= 140, F.concat(F.lit("Turn sharp "), side)).when(size >= 50, F.concat(F.lit("Turn "), side)).otherwise(F.concat(F.lit("Keep "), side))


def tag_text(tag: Column) -> Column:
    """What follows "=", with blanks for underscores; a bare "yes" is a building."""
    value = F.regexp_replace(F.substring_index(tag, "=", -1), "_", " ")
    return F.when(value == "yes", "building").otherwise(value)
