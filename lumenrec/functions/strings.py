"""Text expressions: sentences, tokens, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that overlap scoring leaves out.
STOP_WORDS = (
    "the a an is are was were in on at to for of and or but it this that with by from as be has have had "
    "do does did will would can could not no so if its also than then"
).split()

#: The formats of generated sentences.
SAME_GENRE = "'%s' and '%s' both belong to the %s."
CO_LIKED = "Users who watched '%s' also frequently watched '%s', and fans of '%s' often enjoy '%s' as well."
CONNECTED = "'%s' connects to '%s' via %s → %s → %s."
DIRECT = "'%s' connects to '%s' via %s."
QUESTION = "Why should someone who enjoyed %s watch %s?"
QUESTION_GENRES = "%s The movie is a %s film."
CHUNK_OVERVIEW, CHUNK_TAGLINE, CHUNK_GENRE = "%s: %s", '%s — "%s"', "%s is a %s film."
CHUNK_CAST, CHUNK_CAST_DIRECTOR, CHUNK_DIRECTOR = "%s stars %s.", "%s stars %s, directed by %s.", "%s is directed by %s."


def tokens(text: Column) -> Column:
    """Lower-case words between white space; none for blank text."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def sentences(text: Column, short: int = 20) -> Column:
    """Sentences end at . ! ? before white space; one shorter than ``short`` joins its predecessor."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    parts = F.filter(F.transform(F.split(F.btrim(text, blank), r"(?<=[.!?])\s+"), lambda s: F.btrim(s, blank)), lambda s: s != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(
        parts,
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.length(s) < short),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.lit(" "), s))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def retrieval_query(title: Column, genres: Column, history: Column, most: int = 5) -> Column:
    """The retrieval question; the genre sentence follows only where there are genres (array)."""
    ask = F.format_string(QUESTION, F.array_join(F.slice(history, 1, most), ", "), title)
    listed = F.array_join(genres, ", ")
    return F.when(F.coalesce(listed, F.lit("")) == "", ask).otherwise(F.format_string(QUESTION_GENRES, ask, listed))


def shorten(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def path_sentence(rel1: Column, mid: Column, rel2: Column, source_title: Column, mid_title: Column, target_title: Column) -> Column:
    """A graph path as a sentence: shared genre, co-liked chain, direct link, or any other relation."""
    label = F.when(mid.startswith("genre_"), F.concat(F.substring(mid, F.lit(7), F.lit(1 << 20)), F.lit(" genre"))).when(mid.startswith("movie_"), mid_title).otherwise(mid)
    first, second = (F.replace(r, F.lit("_"), F.lit(" ")) for r in (rel1, rel2))
    both = lambda name: (rel1 == name) & (rel2 == name)
    return (
        F.when(rel2.isNull(), F.format_string(DIRECT, source_title, target_title, first))
        .when(both("has_genre"), F.format_string(SAME_GENRE, source_title, target_title, label))
        .when(both("co_liked"), F.format_string(CO_LIKED, source_title, label, label, target_title))
        .otherwise(F.format_string(CONNECTED, source_title, target_title, first, label, second))
    )


def seeded(*parts: Column | str, seed: int = 42) -> Column:
    """A number from 0 to 2**32 - 1 by the md5 of the parts, the same in any engine."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("bigint")
