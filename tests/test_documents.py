import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from upswell.functions import documents
from upswell.operators import catalogue, rollups
from upswell.schemas import METRIC_PAGE, SONG_PAGE
from upswell.sources import landed

def credit(artist, role="Default", group="Other", **names):
    return {"artist": artist, "categories": group, "roles": role, **names}


def upload(pv, kind, service="NicoNicoDouga"):
    return {"service": service, "pvId": pv, "pvType": kind}


def song(number, **fields):
    return {"id": number, "name": f"song {number}", **fields}


def bundles(spark, tmp_path, *pages):
    for i, page in enumerate(pages):
        (tmp_path / f"page-{i:03d}.json").write_text(json.dumps(page, indent=1))
    return catalogue.bundles(landed.read_song_pages(spark, str(tmp_path), whole_files=True))


def one_song(spark, tmp_path, **fields):
    return bundles(spark, tmp_path, {"items": [song(40, **fields)]}).first()


def test_bare_song(spark, tmp_path):
    row = one_song(spark, tmp_path)
    assert row.song.asDict() == {
        "id": 40, "title": "song 40", "publish_date": None, "song_type": None, "nico_video_id": None, "youtube_video_id": None
    }
    assert (row.artists, row.tags, row.original_version_id) == ([], [], None)


def test_dates_types_and_originals(spark, tmp_path):
    row = one_song(spark, tmp_path, publishDate="2019-02-28T23:30:00Z", songType="Remix", originalVersionId=12)
    assert (row.song.publish_date, row.song.song_type, row.original_version_id) == (dt.date(2019, 2, 28), "Remix", 12)


def test_uploads(spark, tmp_path):
    mixed = [upload("sm30", "Other"), upload("sm31", "Original"), upload("sm32", "Original"), upload("yt5", "Reprint", "Youtube")]
    row = one_song(spark, tmp_path, pvs=mixed)
    assert (row.song.nico_video_id, row.song.youtube_video_id) == ("sm31", "yt5")


def test_credits(spark, tmp_path):
    names = ["Ada", "Ben", "Cy", "Di", "Ed"]
    people = [{"id": 900 + i, "name": n, "artistType": "Person" if i % 2 else None} for i, n in enumerate(names)]
    given = [
        credit(people[0], "Arranger"), credit(people[1], "Default", "Illustrator"), credit(people[2], "Default", "Vocalist"),
        credit(people[3], "Mastering", "Producer"), {"categories": "Other", "roles": "Default", "name": "guest"}, credit({}), credit(people[4]),
    ]
    row = one_song(spark, tmp_path, artists=given)
    roles = {900: "Arranger", 901: "Illustrator", 902: "Vocalist", 903: "Mastering", 904: "Other"}
    assert {a.artist_id: a.role for a in row.artists} == roles
    assert [a.artist_type for a in row.artists] == [p["artistType"] for p in people]


def test_tags(spark, tmp_path):
    labels = [{"id": 70 + i, "name": n, "categoryName": c} for i, (n, c) in enumerate([("slow", "Tempo"), ("live", None)])]
    row = one_song(spark, tmp_path, tags=[{"count": 9, "tag": labels[0]}, {"tag": {}}, {"tag": labels[1]}, {"count": 2}])
    assert [tuple(t) for t in row.tags] == [(70, "slow", "Tempo"), (71, "live", None)]


@pytest.mark.parametrize(
    "broken",
    [{"name": "x"}, {"id": 1}, song(1, artists=[credit({"name": "nobody"})]), song(1, tags=[{"tag": {"name": "nothing"}}])],
)
def test_missing_ids_and_names_fail(spark, tmp_path, broken):
    with pytest.raises(Exception, match="landed page: a"):
        bundles(spark, tmp_path, {"items": [song(2), broken]}).collect()


def test_missing_items_and_order_of_pages(spark, tmp_path):
    out = bundles(
        spark, tmp_path,
        {"items": [{"id": 1, "name": "old"}, {"id": 1, "name": "newer"}]}, {"totalCount": 0},
        {"items": [{"id": 1, "name": "newest", "originalVersionId": 0}]},
    )
    frames = catalogue.catalogue_frames(out, F.col("seq"))
    assert [r.title for r in frames["songs"].collect()] == ["newest"]
    assert frames["derived_works"].count() == 0


def test_coverage(spark):
    pages = [("a", 0, 2, 120), ("a", 1, 2, 120), ("b", 0, 2, 3), ("c", 0, 0, 900)]
    rows = [(run, no, [{"id": i, "name": "x"} for i in range(n)], total) for run, no, n, total in pages]
    frame = spark.createDataFrame(
        [(run, json.dumps({"page": no, "items": items, "totalCount": total})) for run, no, items, total in rows],
        "run string, raw string",
    ).select("run", F.from_json("raw", SONG_PAGE).alias("p")).select("run", "p.*")
    found = {r.run: tuple(r)[1:] for r in landed.page_coverage(frame, ["run"], size=50, max_pages=2).collect()}
    assert found == {"a": (2, 4, 120, False, True), "b": (1, 2, 3, True, False), "c": (1, 0, 900, True, False)}


def test_metric_page(spark, tmp_path):
    page = {
        "data": [
            {"contentId": "sm1", "viewCounter": 10, "commentCounter": 1, "mylistCounter": 2, "likeCounter": 3},
            {"contentId": "sm2", "viewCounter": 5}, {"viewCounter": 1}, {"contentId": "", "viewCounter": 1},
            {"contentId": "sm1", "viewCounter": 11},
        ]
    }
    (tmp_path / "a.json").write_text(json.dumps(page))
    found = {r.content_id: tuple(r)[1:] for r in landed.read_metric_pages(spark, str(tmp_path)).collect()}
    assert found == {"sm1": (11, None, None, None), "sm2": (5, None, None, None)}
    assert METRIC_PAGE.names == ["page", "data"]


def test_shared_video_and_missing(spark):
    songs = spark.createDataFrame([(1, "sm1"), (2, "sm1"), (3, "gone"), (4, None)], "id bigint, nico_video_id string")
    readings = spark.createDataFrame(
        [("sm1", 10, 1, 2, 3)], "content_id string, views bigint, comments bigint, mylists bigint, likes bigint"
    )
    targets = catalogue.metric_targets(songs)
    rows = catalogue.metric_rows(targets, readings, F.lit(dt.date(2026, 7, 20)), "s").collect()
    assert sorted(r.song_id for r in rows) == [1, 2]
    assert [r.id for r in catalogue.missing_targets(targets, readings).collect()] == [3]


def test_spans(spark, tmp_path):
    nested = {"llm": {"response": {"model": "lite"}, "token_count": {"total": 40}}}
    flat = {"llm.response.model": "flash", "llm.token_count.total": 7}
    spans = [
        {"spanKind": "LLM", "attributes": json.dumps(nested)},
        {"spanKind": "llm", "attributes": json.dumps(flat)},
        {"spanKind": "CHAIN", "attributes": json.dumps(flat)},
        {"spanKind": "llm", "attributes": json.dumps({"llm": {"response": {"model": ""}, "model_name": "raw"}})},
        {"spanKind": "llm", "attributes": "{}"},
        {"spanKind": "LLM", "attributes": json.dumps({"llm": {"response": {"model": "lite"}}})},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, spans)))
    read = landed.read_spans(spark, str(tmp_path))
    got = sorted(map(tuple, read.collect()), key=repr)
    assert got == sorted([("lite", 40), ("flash", 7), ("raw", None), (None, None), ("lite", None)], key=repr)
    rolled = {r.model: tuple(r)[1:] for r in rollups.span_rollup(read, {"lite": 1500, "flash": 250}).collect()}
    assert rolled == {"lite": (False, 2, 40, 0.1), "flash": (False, 1, 7, 0.4), "raw": (True, 1, None, None)}


def test_source_text(one):
    def text(title, kind, artists, tags):
        lists = [F.array(*map(F.lit, x)).cast("array<string>") for x in (artists, tags)]
        return documents.source_text(F.lit(title), F.lit(kind).cast("string"), *lists)

    shown = one(text("Blau", "Cover", ["mo", "al", "ze"], ["jazz"]), text("Leer", None, [], []))
    assert shown == ("Blau\ntype: Cover\nartists: al, mo, ze\ntags: jazz", "Leer\ntype: \nartists: \ntags: ")


def test_status_rollup_and_agreement(spark):
    counts = {"canon_lite": 31, "canon_flash": 9, "pending": 6, "demoted": 4}
    rows = [(status,) for status, n in counts.items() for _ in range(n)] + [("odd",)]
    out = rollups.status_rollup(spark.createDataFrame(rows, "canon_status string")).first()
    accepted = counts["canon_lite"] + counts["canon_flash"]
    assert out.total == sum(counts.values()) and out.cache_hit_rate == round(accepted / out.total, 3)
    assert out.escalation_rate == round(counts["canon_flash"] / accepted, 3)
    assert out.demotion_rate == round(counts["demoted"] / (accepted + counts["demoted"]), 3)
    log = spark.createDataFrame(
        [("canon_flash", "A", "A"), ("canon_flash", "B", "C"), ("canon_flash", "D", None), ("demoted", None, "E")],
        "status string, canon_name string, lite_canon string",
    )
    assert tuple(rollups.agreement_rate(log).first()) == (2, 1, 0.5)
    assert tuple(rollups.agreement_rate(log.limit(0)).first()) == (0, 0, None)
