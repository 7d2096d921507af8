"""Metadata lookup over a search service: search, details, credits of the first hit.

``fetch(path, params)`` returns decoded JSON; callers inject it, so that tests
and offline runs need no network.  Each Arrow batch keeps to ``pause`` seconds
between items; items without a hit come back with ``tmdb_id`` null.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "movie_id bigint, tmdb_id bigint, title string, year int, genres array<string>, actors array<string>, directors array<string>, overview string, "
    "tagline string, release_date string, vote_average double, vote_count bigint, popularity double"
)


def lookup(movies: DataFrame, fetch: Callable[[str, dict], dict], pause: float = 0.0, top_cast: int = 5) -> DataFrame:
    """(movie_id, title, year) -> metadata rows."""

    def one(movie_id, title, year) -> tuple:
        none = (movie_id, None, title, year, [], [], [], None, None, None, None, None, None)
        params = {"query": title} | ({"year": int(year)} if year is not None and year == year else {})
        hits = fetch("search/movie", params).get("results") or []
        if not hits:
            return none
        i = hits[0]["id"]
        d, c = fetch(f"movie/{i}", {}), fetch(f"movie/{i}/credits", {})
        return (
            movie_id, i, d.get("title", title), year, [g["name"] for g in d.get("genres", [])], [a["name"] for a in c.get("cast", [])[:top_cast]],
            [p["name"] for p in c.get("crew", []) if p.get("job") == "Director"], d.get("overview"), d.get("tagline"), d.get("release_date"),
            d.get("vote_average"), d.get("vote_count"), d.get("popularity"),
        )

    names = [f.strip().split(" ")[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for m, t, y in zip(f["movie_id"], f["title"], f["year"], strict=True):
                rows.append(one(m, t, y))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=names)

    return movies.select("movie_id", "title", "year").mapInPandas(run, SCHEMA)


def not_yet(movies: DataFrame, done: DataFrame) -> DataFrame:
    """Movies without stored metadata, for a resumed run."""
    return movies.join(done.select("movie_id").distinct(), "movie_id", "left_anti")
