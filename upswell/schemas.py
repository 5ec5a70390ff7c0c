"""Explicit schemas of the stored tables and of the landed JSON documents."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
FLOAT, FLAG, DAY, TIME = T.FloatType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _row(required: str = "", **columns: T.DataType) -> T.StructType:
    """A struct of the given columns; the space-separated ``required`` ones are NOT NULL."""
    names = required.split()
    return T.StructType([T.StructField(n, t, n not in names) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "songs": _row(
        "id title", id=LONG, title=TEXT, publish_date=DAY, song_type=TEXT,
        nico_video_id=TEXT, youtube_video_id=TEXT, created_at=TIME, updated_at=TIME,
    ),
    "artists": _row(
        "id name", id=LONG, name=TEXT, artist_type=TEXT, created_at=TIME, updated_at=TIME
    ),
    "song_artists": _row("song_id artist_id role", song_id=LONG, artist_id=LONG, role=TEXT),
    "tags": _row(
        "id name canon_status", id=LONG, name=TEXT, category=TEXT,
        canon_name=TEXT, canon_confidence=FLOAT, canon_status=TEXT,
    ),
    "song_tags": _row("song_id tag_id", song_id=LONG, tag_id=LONG),
    "derived_works": _row(
        "original_song_id derived_song_id", original_song_id=LONG, derived_song_id=LONG,
        relation_type=TEXT, derived_publish_date=DAY, discovered_at=TIME,
    ),
    "metrics_daily": _row(
        "song_id metric_date source", song_id=LONG, metric_date=DAY, source=TEXT,
        views=LONG, comments=LONG, mylists=LONG, likes=LONG,
    ),
    "weekly_peaks": _row(
        "song_id week", song_id=LONG, week=DAY, seen=FLAG, peak=LONG, best=LONG, weeks=LONG
    ),
    "folded_weeks": _row("week files", week=DAY, files=TEXT),
    "trend_scores": _row(
        "song_id week", song_id=LONG, week=DAY, view_velocity=FLOAT, deriv_velocity=FLOAT,
        is_coldstart=FLAG, cluster_id=INT, computed_at=TIME,
    ),
    "weekly_reports": _row(
        "week", week=DAY, narrative=TEXT, evidence=TEXT, model=TEXT, generated_at=TIME
    ),
    "escalation_log": _row(
        "run id status", run=TEXT, id=LONG, status=TEXT, canon_name=TEXT, lite_canon=TEXT
    ),
    "song_embeddings": _row(
        "song_id", song_id=LONG, embedding=T.ArrayType(FLOAT), source_text=TEXT,
        model=TEXT, updated_at=TIME,
    ),
}

#: Key columns, which the upserts join on.
KEYS: dict[str, list[str]] = {
    "songs": ["id"],
    "artists": ["id"],
    "song_artists": ["song_id", "artist_id", "role"],
    "tags": ["id"],
    "song_tags": ["song_id", "tag_id"],
    "derived_works": ["original_song_id", "derived_song_id"],
    "metrics_daily": ["song_id", "metric_date", "source"],
    "weekly_peaks": ["song_id", "week"],
    "folded_weeks": ["week"],
    "trend_scores": ["song_id", "week"],
    "weekly_reports": ["week"],
    "escalation_log": ["run", "id"],
    "song_embeddings": ["song_id"],
}

#: Columns that refer to the id of another table's row and go with it: (table, column) by that table.
REFERS: dict[str, list[tuple[str, str]]] = {
    "songs": [
        ("song_artists", "song_id"),
        ("song_tags", "song_id"),
        ("derived_works", "original_song_id"),
        ("metrics_daily", "song_id"),
        ("weekly_peaks", "song_id"),
        ("trend_scores", "song_id"),
        ("song_embeddings", "song_id"),
    ],
    "artists": [("song_artists", "artist_id")],
    "tags": [("song_tags", "tag_id")],
}

#: Columns the daily tables and those of weekly runs are laid out by, so that reads prune.
DATED_BY: dict[str, str] = {
    "metrics_daily": "metric_date",
    "weekly_peaks": "week",
    "folded_weeks": "week",
    "escalation_log": "run",
    "trend_scores": "week",
    "weekly_reports": "week",
}

#: Entity and link tables are laid out by ranges of an id, so that a merge reads and
#: rewrites only the ranges its updates fall in; new entities have the highest ids.
RANGED_BY: dict[str, str] = {
    "songs": "id",
    "artists": "id",
    "tags": "id",
    "song_embeddings": "song_id",
    "song_artists": "song_id",
    "song_tags": "song_id",
    "derived_works": "original_song_id",
}
ID_RANGE = 1_000_000

SONG_ITEM = _row(
    id=LONG, name=TEXT, publishDate=TEXT, songType=TEXT, originalVersionId=LONG,
    artists=T.ArrayType(
        _row(artist=_row(id=LONG, name=TEXT, artistType=TEXT), categories=TEXT, roles=TEXT)
    ),
    tags=T.ArrayType(_row(count=LONG, tag=_row(id=LONG, name=TEXT, categoryName=TEXT))),
    pvs=T.ArrayType(_row(service=TEXT, pvId=TEXT, pvType=TEXT)),
)
# ``page`` is the request offset a collector may store with each document; it orders
# pages that share a file. Documents without it are ordered by file.
SONG_PAGE = _row(page=LONG, items=T.ArrayType(SONG_ITEM), totalCount=LONG)
METRIC_PAGE = _row(
    page=LONG,
    data=T.ArrayType(
        _row(contentId=TEXT, viewCounter=LONG, commentCounter=LONG, mylistCounter=LONG, likeCounter=LONG)
    ),
)
SPAN = _row(spanKind=TEXT, attributes=TEXT)
