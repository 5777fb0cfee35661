"""Listings and fetches from a service, given the function that asks it.

``ask`` and ``fetch`` are plain functions, so that tests and closed networks pass their own.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE, TRIES = 50, 3


def listed(spark: SparkSession, ask: Callable[[int, int], tuple[list[str], bool]]) -> DataFrame:
    """(place, id) of a paged catalogue: pages are asked one after another until none follows.

    ask(page, size) gives the ids of a page and whether there is another.
    """

    def names() -> Iterator[tuple[int, str]]:
        page, place, more = 1, 0, True
        while more:
            ids, more = ask(page, PAGE)
            for i in ids:
                yield place, i
                place += 1
            page += 1

    return spark.createDataFrame(list(names()), "place bigint, id string")  # as many as the catalogue has entries


def chosen_files(paths: list[str], allow: list[str], ignore: list[str]) -> list[str]:
    """Paths that fit any of the allowed globs and none of the ignored ones."""
    return [p for p in paths if any(fnmatch.fnmatch(p, g) for g in allow) and not any(fnmatch.fnmatch(p, g) for g in ignore)]


def fetched(ids: DataFrame, fetch: Callable[[str], str], done: DataFrame | None = None, tries: int = TRIES) -> DataFrame:
    """(id, status): skipped if done holds the id, else what fetch says (done or no_match); failed after ``tries`` errors."""
    known = done.select("id").distinct().withColumn("_done", F.lit(True)) if done is not None else None
    rows = ids.join(known, "id", "left") if known is not None else ids.withColumn("_done", F.lit(None).cast("boolean"))

    def one(name: str) -> str:
        for _ in range(tries):
            try:
                return fetch(name)
            except Exception:  # noqa: BLE001, whatever goes wrong is tried again
                continue
        return "failed"

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "status": ["skipped" if d else one(i) for i, d in zip(pdf["id"], pdf["_done"].eq(True), strict=True)]})

    return rows.select("id", "_done").mapInPandas(run, "id string, status string")
