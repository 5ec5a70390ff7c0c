"""Embedding similarity, evidence, the weekly run and streams."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from registry.base import fresh_folder, query
from registry.weekly_queries import STEPS, WEEK, trend
from upswell.functions import documents as doc
from upswell.operators import evidence, quantised, shares, similarity, upserts
from upswell.plans import embed_run, weekly_run
from upswell.schemas import METRIC_PAGE
from upswell.session import materialize
from upswell.sources import report_files, tables
from upswell.streaming import jobs

RUN_AT = dt.datetime(2024, 1, 22, 6, 0)

# ---- source texts --------------------------------------------------------------
SOURCE = dict(
    by_artist="""
    select sa.song_id, list(distinct a.name order by a.name) as artists
    from {song_artists} sa join {artists} a on a.id = sa.artist_id group by sa.song_id""",
    by_tag="""
    select st.song_id, list(distinct case when canon_status in ('canon_lite', 'canon_flash') and canon_name is not null
                                         then canon_name else name end
                            order by case when canon_status in ('canon_lite', 'canon_flash') and canon_name is not null
                                         then canon_name else name end) as tags
    from {song_tags} st join {tags} t on t.id = st.tag_id group by st.song_id""",
    rows="""
    select s.id as song_id, s.title, s.song_type, coalesce(array_to_string(artists, '|'), '') as artists,
           coalesce(array_to_string(tags, '|'), '') as tags
    from {songs} s left join {by_artist} a on a.song_id = s.id left join {by_tag} t on t.song_id = s.id""",
    texts="""
    select song_id, concat(title, chr(10), 'type: ', coalesce(song_type, ''), chr(10), 'artists: ',
             replace(artists, '|', ', '), chr(10), 'tags: ', replace(tags, '|', ', ')) as source_text
    from {rows}""",
)


def _rows(v):
    return similarity.source_rows(v.songs, v.song_artists, v.artists, v.song_tags, v.tags)


def _texts(v, rows=None):
    text = doc.source_text(F.col("title"), F.col("song_type"), F.col("artists"), F.col("tags"))
    return (_rows(v) if rows is None else rows).select("song_id", text.alias("source_text"))


@query("k5_collect_artists", "select song_id, array_to_string(artists, '|') as artists from {by_artist}", **SOURCE)
def _(v):
    found = similarity.collect_artists(v.song_artists, v.artists)
    return found.select("song_id", F.array_join("artists", "|").alias("artists"))


@query("k6_collect_tags", "select song_id, array_to_string(tags, '|') as tags from {by_tag}", **SOURCE)
def _(v):
    found = similarity.collect_tags(v.song_tags, v.tags)
    return found.select("song_id", F.array_join("tags", "|").alias("tags"))


@query("v4_source_rows", "select * from {rows}", **SOURCE)
def _(v):
    return _rows(v).withColumns({c: F.array_join(c, "|") for c in ("artists", "tags")})


@query("p14_source_text", "select * from {texts}", **SOURCE)
def _(v):
    return _texts(v)


def _stored(v, texts=None):
    """What an earlier run left: nothing for pending orders, an old model for open ones."""
    done = (_texts(v) if texts is None else texts).join(v.orders.where("o_orderstatus <> 'P'"), F.col("song_id") == F.col("o_orderkey"))
    model = F.when(F.col("o_orderstatus") == "O", "old").otherwise("m1")
    return done.select(
        "song_id",
        F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>").alias("embedding"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat("source_text", F.lit("!")))
        .otherwise(F.col("source_text")).alias("source_text"),
        model.alias("model"),
        F.lit(dt.datetime(2024, 1, 1)).alias("updated_at"),
    )


_STALE = """
    select t.song_id, t.source_text from {texts} t join {orders} o on o.o_orderkey = t.song_id
    where o_orderstatus <> 'F' or o_orderpriority = '1-URGENT'"""


@query("k10_stale_anti", "select song_id from {stale}", **SOURCE, stale=_STALE)
def _(v):
    return similarity.select_stale(_rows(v), _stored(v), "m1").select("song_id")


@query("v5_select_stale", "select * from {stale}", **SOURCE, stale=_STALE)
def _(v):
    return similarity.select_stale(_rows(v), _stored(v), "m1")


def _measure(texts: list[str]) -> str:
    """A stand-in for the embedding service: two counts per text, in reverse order."""
    data = [{"index": i, "embedding": [len(t), t.count("a")]} for i, t in enumerate(texts)]
    return json.dumps({"data": data[::-1]})


@query("v6_run_embed", """
    select t.song_id, t.source_text,
           case when s.song_id is null then 0 else length(t.source_text) end as size,
           case when s.song_id is null then 0
                else length(t.source_text) - length(replace(t.source_text, 'a', '')) end as letters, 'm1' as model
    from {texts} t left join {stale} s on s.song_id = t.song_id""", **SOURCE, stale=_STALE)
def _(v):
    # Both tables are read by several steps: they are made once.
    rows = materialize(_rows(v))
    stored = materialize(_stored(v, _texts(v, rows)))
    table, _ = embed_run.run_embed(rows, stored, _measure, "m1", F.lit(RUN_AT))
    return table.select(
        "song_id", "source_text", F.col("embedding")[0].cast("bigint").alias("size"),
        F.col("embedding")[1].cast("bigint").alias("letters"), "model",
    )


@query("a17_embed_summary", """
    select (select count(*) from {songs}) as songs, count(*) as stale, count(*) as embedded from {stale}""",
    **SOURCE, stale=_STALE)
def _(v):
    rows = materialize(_rows(v))
    return embed_run.run_embed(rows, _stored(v, _texts(v, rows)), _measure, "m1", F.lit(RUN_AT))[1]


@query("j3_parse_vectors", """
    select vec_id // 64 as batch_no, cast(row_number() over (partition by vec_id // 64 order by vec_id) - 1 as int) as index,
           round_even(list_sum(embedding::double[]), 4) as total
    from {embeddings} where (vec_id // 64) % 3 <> 0""")
def _(v):
    # Responses of 64 vectors in reverse order. Every third lacks its last item.
    rows = v.embeddings.select(F.floor(F.col("vec_id") / 64).alias("batch_no"), "vec_id", "embedding")
    listed = rows.groupBy("batch_no").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e")
    )
    data = F.reverse(
        F.transform("e", lambda x, i: F.struct(i.alias("index"), x["embedding"].alias("embedding")))
    )
    n = F.size("e")
    keep = F.when(F.col("batch_no") % 3 == 0, n - 1).otherwise(n)
    raw = F.to_json(F.struct(F.slice(data, 1, keep).alias("data")))
    found = similarity.parse_vectors(listed.select("batch_no", n.alias("n"), raw.alias("raw")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("batch_no", "index", F.bround(total, 4).alias("total"))


@query("u10_embedding_upsert", """
    select vec_id as song_id, case when label = 1 then embedding[64] else embedding[1] end as head from {embeddings}
    union all
    select vec_id + 1000000, embedding[1] from {embeddings} where label = 2""")
def _(v):
    flipped = v.embeddings.where("label = 1").select(F.col("vec_id").alias("song_id"), F.reverse("embedding").alias("embedding"))
    fresh = v.embeddings.where("label = 2").select((F.col("vec_id") + 1000000).alias("song_id"), "embedding")
    table = v.song_embeddings
    for _ in range(2):
        table = upserts.update_all(table, flipped.unionByName(fresh), ["song_id"])
    return table.select("song_id", F.col("embedding")[0].alias("head"))


# ---- neighbours ----------------------------------------------------------------
_NEAR = """
    select e.song_id, s.title, round_even(1 - list_cosine_similarity(e.embedding::double[], r.embedding::double[]), 6) as dist
    from {song_embeddings} e join {songs} s on s.id = e.song_id
    join {song_embeddings} r on r.song_id = 7 and e.song_id <> 7
    order by list_cosine_similarity(e.embedding::double[], r.embedding::double[]) desc, e.song_id limit 10"""


@query("v1_cosine_topk", _NEAR)
def _(v):
    return similarity.cosine_topk(v.song_embeddings, v.songs, 7).withColumn("dist", F.bround("dist", 6))


@query("v2_cosine_topk_all", """
    select a.song_id, b.song_id as neighbour,
           round_even(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as dist,
           cast(row_number() over (partition by a.song_id
             order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.song_id) as int) as rank
    from {song_embeddings} a join {song_embeddings} b on a.song_id <> b.song_id qualify rank <= 10""")
def _(v):
    return similarity.cosine_topk_all(v.song_embeddings).withColumn("dist", F.bround("dist", 6))


@query("v3_ann_topk", """
    select (select count(*) from {song_embeddings}) as indexed,
           (select count(*) from {song_embeddings} where song_id % 50 = 0) as queries,
           true as recalled, true as exact, true as ranked""")
def _(v):
    # At the default width: every song in one list, recall of 0.9 against the exact
    # neighbours, distances that agree, and ten ranks per query.
    emb = v.song_embeddings
    index = quantised.ListIndex.fit(emb)
    path = fresh_folder(v.spark, "lists")
    quantised.write_lists(index.encode(emb), path)
    codes = v.spark.read.schema(quantised._CODES).parquet(path)
    queries = emb.where("song_id % 50 = 0")
    near = quantised.ann_topk_all(index, codes, emb, queries)
    exact = similarity.cosine_topk_all(emb).where("song_id % 50 = 0").select("song_id", "neighbour", F.col("dist").alias("d"))
    met = exact.join(near, ["song_id", "neighbour"], "full")
    counted = met.agg(
        F.count_distinct("song_id").alias("queries"),
        (F.count(F.when(F.col("dist").isNotNull() & F.col("d").isNotNull(), 1)) >= 0.9 * F.count("d")).alias("recalled"),
        F.every(F.coalesce(F.abs(F.col("dist") - F.col("d")) < 1e-9, F.lit(True))).alias("exact"),
        (F.count("rank") == F.count("d")).alias("ranked"),
    )
    return counted.withColumn("indexed", codes.agg(F.count_distinct("song_id")).scalar())


# ---- evidence ------------------------------------------------------------------
EV = dict(
    **STEPS,
    named="select t.*, s.title, s.publish_date from {trend} t join {esongs} s on s.id = t.song_id",
    best="""
    select cast(row_number() over (order by view_velocity desc, song_id) as int) as rank, song_id, title,
           round_even(view_velocity, 2) as view_velocity, round_even(deriv_velocity, 2) as deriv_velocity, cluster_id
    from {named} where not is_coldstart and view_velocity is not null qualify rank <= 15""",
    cold="""
    select cast(row_number() over (order by publish_date desc nulls first, song_id) as int) as rank, song_id, title
    from {named} where is_coldstart qualify rank <= 15""",
    members="""
    select cluster_id, string_agg(title, '|' order by view_velocity desc, song_id) as titles
    from {named} where cluster_id is not null group by cluster_id""",
    ecounts="""
    select t.canon_name as canon,
           count(distinct s.id) filter (where s.publish_date >= date '2024-01-15') as n_this,
           count(distinct s.id) filter (where s.publish_date < date '2024-01-15') as n_prev
    from {esongs} s join {esong_tags} st on st.song_id = s.id join {etags} t on t.id = st.tag_id
    where s.publish_date >= date '2024-01-08' and s.publish_date < date '2024-01-22'
      and t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null
    group by t.canon_name""",
    etotals="""
    select count(*) filter (where publish_date >= date '2024-01-15' and publish_date < date '2024-01-22') as total_this,
           count(*) filter (where publish_date >= date '2024-01-08' and publish_date < date '2024-01-15') as total_prev
    from {esongs}""",
    edeltas="""
    select canon, round_even(100.0::double * n_this / total_this, 1) as share_pct,
           round_even(100.0::double * n_this / total_this
             - case when total_prev = 0 then 0.0::double else 100.0::double * n_prev / total_prev end, 1) as delta_pp
    from {ecounts}, {etotals} where n_this > 0 order by 3 desc, 1 limit 15""",
)


def _scores(v):
    """The week's scores, stored once because several reports read them."""
    return materialize(trend(v))


def _deltas(v):
    return shares.tag_deltas(v.esongs, v.esong_tags, v.etags, WEEK)


def _snapshot(v):
    return materialize(evidence.evidence(_scores(v), v.esongs, _deltas(v), WEEK))


@query("k2_scores_with_titles", """
    select song_id, title, publish_date, is_coldstart, cluster_id from {named}""", **EV)
def _(v):
    rows = evidence.scores_with_titles(trend(v), v.esongs, WEEK)
    return rows.select("song_id", "title", "publish_date", "is_coldstart", "cluster_id")


@query("w5_evidence_top", "select * from {best}", **EV)
def _(v):
    return evidence.evidence_top(trend(v), v.esongs, WEEK)


@query("w6_watchlist", "select * from {cold}", **EV)
def _(v):
    return evidence.watchlist(trend(v), v.esongs, WEEK)


@query("a15_cluster_titles", "select * from {members}", **EV)
def _(v):
    found = evidence.cluster_titles(trend(v), v.esongs, WEEK)
    return found.select("cluster_id", F.array_join("titles", "|").alias("titles"))


_PARTS = """
    select 'top' as part, rank as at, title as label, view_velocity as a, deriv_velocity as b, cluster_id as c from {best}
    union all
    select 'delta', cast(row_number() over (order by delta_pp desc, canon) as int), canon, share_pct, delta_pp, null from {edeltas}
    union all
    select 'cluster', cast(row_number() over (order by cluster_id) as int), titles, null, null, cluster_id from {members}
    union all
    select 'watch', rank, title, null, null, null from {cold}"""


def _parts(snap):
    """Every list of an evidence snapshot as rows."""

    def part(name, array, label, a, b, c):
        rows = snap.select(F.posexplode(array).alias("at", "x"))
        none = F.lit(None).cast("double")
        return rows.select(
            F.lit(name).alias("part"), (F.col("at") + 1).alias("at"), label.alias("label"),
            (none if a is None else F.col(a)).alias("a"), (none if b is None else F.col(b)).alias("b"),
            (F.lit(None).cast("int") if c is None else F.col(c)).alias("c"),
        )

    title = F.col("x.title")
    return (
        part("top", "top_songs", title, "x.view_velocity", "x.deriv_velocity", "x.cluster_id")
        .unionByName(part("delta", "tag_deltas", F.col("x.canon"), "x.share_pct", "x.delta_pp", None))
        .unionByName(part("cluster", "clusters", F.array_join("x.titles", "|"), None, None, "x.cluster_id"))
        .unionByName(part("watch", "watchlist", title, None, None, None))
    )


_EVIDENCE = (
    "week date, top_songs array<struct<song_id:bigint,title:string,view_velocity:double,deriv_velocity:double,"
    "cluster_id:int>>, tag_deltas array<struct<canon:string,share_pct:double,delta_pp:double>>,"
    " clusters array<struct<cluster_id:int,titles:array<string>>>, watchlist array<struct<song_id:bigint,title:string>>"
)


_FIELDS = _EVIDENCE.replace("week date", "week:date").replace(" array<", ":array<")


@query("r2_evidence", _PARTS, **EV)
def _(v):
    return _parts(_snapshot(v))


@query("j7_evidence_json", _PARTS, **EV)
def _(v):
    # Read back from the JSON text, value by value.
    text = evidence.evidence_json(_snapshot(v))
    return _parts(text.select(F.from_json("evidence", _EVIDENCE, {"mode": "FAILFAST"}).alias("e")).select("e.*"))


# ---- upserts of weekly tables ----------------------------------------------------
@query("u8_trend_upsert", """
    select s.id as song_id, coalesce(round_even(t.view_velocity, 6), case when t.song_id is null then -1.0::double end)
             as view_velocity, t.is_coldstart, t.cluster_id
    from {songs} s left join {trend} t on t.song_id = s.id""", **STEPS)
def _(v):
    # An earlier run of the week scored every song of the larger catalogue.
    earlier = v.songs.select(
        F.col("id").alias("song_id"), F.lit(WEEK).alias("week"), F.lit(-1.0).alias("view_velocity"),
        F.lit(None).cast("double").alias("deriv_velocity"), F.lit(None).cast("boolean").alias("is_coldstart"),
        F.lit(None).cast("int").alias("cluster_id"),
    )
    rows = trend(v).withColumn("view_velocity", F.bround("view_velocity", 6))
    table = upserts.update_all(earlier, rows, ["song_id", "week"])
    return table.select("song_id", "view_velocity", "is_coldstart", "cluster_id")


_REPORTS = """
    select cast(date_trunc('week', publish_date) as date) as week, 'old' as narrative,
           concat('{{"songs":', cast(count(*) as varchar(20)), '}}') as evidence
    from {songs} group by cast(date_trunc('week', publish_date) as date)"""


@query("u9_report_upsert", """
    select week, case when week >= date '1998-01-01' then 'new' else 'old' end as narrative, evidence from {reports}""",
    reports=_REPORTS)
def _(v):
    stored = v.songs.groupBy(F.trunc("publish_date", "week").alias("week")).agg(F.count(F.lit(1)).alias("songs"))
    stored = stored.select("week", F.lit("old").alias("narrative"), F.to_json(F.struct("songs")).alias("evidence"))
    fresh = stored.where("week >= date '1998-01-01'").withColumn("narrative", F.lit("new"))
    return evidence.report_upsert(stored, fresh)


# ---- whole runs ------------------------------------------------------------------
def _stored_week(v):
    """The event catalogue as stored tables."""
    root = fresh_folder(v.spark, "weekly")
    tables.create_tables(v.spark, root)
    made = {
        "songs": v.esongs, "tags": v.etags, "song_tags": v.esong_tags,
        "metrics_daily": v.emetrics, "derived_works": v.ederived,
    }
    for name, frame in made.items():
        missing = [f for f in tables.TABLES[name] if f.name not in frame.columns]
        if missing:
            frame = frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        tables.write_table(frame, root, name)
    return root


def _narrate(text: str) -> str:
    return f"{len(text) > 0}"


def _settle(model: str, payload: str, vocab: str) -> str:
    """A stand-in for the model: the second tier is sure of every third tag, as a new term."""
    items = [
        {"id": i["id"], "canonical": f"term {i['id'] % 4}", "confidence": 0.9 if i["id"] % 3 == 0 else 0.1, "is_new": True}
        for i in json.loads(payload)
    ]
    return json.dumps({"items": items})


@query("r3_weekly_run", """
    select 'score' as kind, song_id as id, round_even(view_velocity::float::double, 3) as a, is_coldstart as flag, cluster_id as c, null as name
    from {trend}
    union all
    select 'tag', id, null, null, null, status || coalesce(' ' || term, '') from (
        select id, case when n > 40 then canon_status when id % 3 = 0 then 'canon_flash' else 'demoted' end as status,
               case when n <= 40 and id % 3 = 0 then concat('term ', id % 4) end as term
        from (select t.*, row_number() over (order by coalesce(uses, 0) desc, id) as n
              from {etags} t left join (select tag_id, count(*) as uses from {esong_tags} group by tag_id) u on u.tag_id = t.id
              where canon_status in ('pending', 'demoted')))
    union all
    select 'log', id, null, null, null, case when id % 3 = 0 then 'canon_flash' else 'demoted' end from (
        select id from {etags} t left join (select tag_id, count(*) as uses from {esong_tags} group by tag_id) u on u.tag_id = t.id
        where canon_status in ('pending', 'demoted') order by coalesce(uses, 0) desc, id limit 40)""", **EV)
def _(v):
    # The whole queue in one round with a budget of 40, then the stored tables.
    root = _stored_week(v)
    before = v.etags.where("canon_status in ('pending', 'demoted')").select("id")
    weekly_run.run_weekly(
        v.spark, root, WEEK, f"{root}/published", _narrate, _settle, limit=None, cap=40, batches_per_round=1000
    )
    none = {"a": F.lit(None).cast("double"), "flag": F.lit(None).cast("boolean"), "c": F.lit(None).cast("int")}
    name = F.lit(None).cast("string").alias("name")
    scores = tables.scan(v.spark, root, "trend_scores").select(
        F.lit("score").alias("kind"), F.col("song_id").alias("id"), F.bround(F.col("view_velocity").cast("double"), 3).alias("a"),
        F.col("is_coldstart").alias("flag"), F.col("cluster_id").alias("c"), name,
    )
    tags = tables.scan(v.spark, root, "tags").join(before, "id").select(
        F.lit("tag").alias("kind"), "id", *[c.alias(n) for n, c in none.items()],
        F.concat_ws(" ", "canon_status", F.when(F.col("canon_status") == "canon_flash", F.col("canon_name"))).alias("name"),
    )
    log = tables.scan(v.spark, root, "escalation_log").select(
        F.lit("log").alias("kind"), "id", *[c.alias(n) for n, c in none.items()], F.col("status").alias("name")
    )
    return scores.unionByName(tags).unionByName(log)


@query("s6_write_report_json", """
    select file, date '2024-01-15' as week, 'words' as narrative, p.*
    from {parts} p, (select unnest(['report-2024-01-15.json', 'latest.json']) as file) f""",
    **EV, parts=_PARTS)
def _(v):
    reports = evidence.report_rows(_snapshot(v), F.lit("words"), "tier-2", F.lit(RUN_AT))
    written = report_files.write_report_json(reports, WEEK, fresh_folder(v.spark, "published"))
    out = None
    for path in written:
        document = v.spark.read.schema(f"week date, narrative string, evidence struct<{_FIELDS}>").json(path)
        head = document.select(F.lit(path.rsplit("/", 1)[1]).alias("file"), "week", "narrative")
        # One document per file, so the parts join its one row.
        part = _parts(document.select("evidence.*")).withColumns({c: head.select(c).scalar() for c in head.columns})
        out = part if out is None else out.unionByName(part)
    return out


# ---- streams ---------------------------------------------------------------------
@query("m1_stream_metrics", """
    select user_id as song_id, date '2024-02-01' as metric_date, 'niconico' as source, event_id as views, k as comments
    from {ev} qualify row_number() over (partition by user_id order by event_id desc) = 1""")
def _(v):
    root = fresh_folder(v.spark, "stream")
    tables.create_tables(v.spark, root)
    songs = v.ev.select(F.col("user_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("song-"), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("nico_video_id"),
    )
    missing = [f for f in tables.TABLES["songs"] if f.name not in songs.columns]
    tables.write_table(songs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}), root, "songs")
    pages = v.ev.select(
        F.col("event_id").alias("page"),
        F.array(F.struct(
            F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("contentId"),
            F.col("event_id").alias("viewCounter"), F.col("k").alias("commentCounter"),
            F.lit(None).cast("bigint").alias("mylistCounter"), F.lit(None).cast("bigint").alias("likeCounter"),
        )).alias("data"),
    )
    assert pages.schema["data"].dataType.elementType.names == METRIC_PAGE["data"].dataType.elementType.names
    pages.select(F.to_json(F.struct("page", "data")).alias("value")).write.text(f"{root}/pages")
    stream = jobs.stream_metrics(v.spark, root, f"{root}/pages", dt.date(2024, 2, 1), f"{root}/_progress")
    stream.awaitTermination()
    stored = tables.scan(v.spark, root, "metrics_daily")
    return stored.select("song_id", "metric_date", "source", "views", "comments")


def _derived_stream(v):
    """Derived works arriving as files, as the events table is."""
    events = v.events
    arriving = v.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
    stream = arriving.parquet(v.folder)
    return stream.select(
        (F.col("user_id") * 5 + F.col("event_id") % 5).alias("original_song_id"),
        F.col("event_id").alias("derived_song_id"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("ts").cast("timestamp").alias("discovered_at"),
    )


@query("m2_stream_deriv_weekly", """
    select original_song_id as song_id, cast(date_trunc('week', discovered_at) as date) as week, count(*) as n
    from {ederived} group by 1, 2""")
def _(v):
    root = fresh_folder(v.spark, "weekly-counts")
    jobs.stream_deriv_weekly(_derived_stream(v), f"{root}/counts", f"{root}/_progress").awaitTermination()
    return v.spark.read.schema("song_id bigint, n bigint, week date").parquet(f"{root}/counts")


@query("m3_stream_dedupe_links", "select distinct user_id, event_type from {ev}")
def _(v):
    root = fresh_folder(v.spark, "links")
    stream = jobs.stream_dedupe_links(
        _derived_stream(v), ["user_id", "event_type"], "discovered_at",
        f"{root}/links", f"{root}/_progress",
    )
    stream.awaitTermination()
    return v.spark.read.parquet(f"{root}/links").select("user_id", "event_type")
