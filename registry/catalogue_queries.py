"""Landed documents, catalogue merges, upserts and table sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry.base import fresh_folder, query
from upswell.functions import documents as doc
from upswell.operators import catalogue, upserts
from upswell.plans import collect, removal
from upswell.schemas import SONG_PAGE
from upswell.session import materialize
from upswell.sources import landed, tables

# ---- documents made from the order lines ------------------------------------
# One page per order line, holding one song document with two credits, one credit
# without a record, one tag, one tag without a record and three uploads.
_SOURCE = """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
           cast(l_shipdate as date) as shipped, o_custkey, o_orderstatus, o_orderpriority,
           cast(o_orderdate as date) as ordered, s_name, p_name, p_type,
           row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey,
             l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity) as seq
    from {lineitem} join {orders} on o_orderkey = l_orderkey
    join {supplier} on s_suppkey = l_suppkey join {part} on p_partkey = l_partkey"""

SONG_DOCS = """
    select 1000000 * seq + l_orderkey as page, l_returnflag as run,
      array(named_struct(
        'id', l_orderkey,
        'name', concat('song-', cast(l_orderkey as string), '-', cast(l_linenumber as string)),
        'publishDate', case when o_orderstatus = 'P' then '' else concat(cast(ordered as string), 'T00:00:00Z') end,
        'songType', o_orderpriority,
        'originalVersionId', o_custkey,
        'artists', array(
          named_struct('artist', named_struct('id', l_suppkey, 'name', s_name, 'artistType', 'Producer'),
                       'categories', 'Producer',
                       'roles', case when l_linestatus = 'O' then 'Default' else 'Mixer' end),
          named_struct('artist', cast(null as struct<id: bigint, name: string, artistType: string>),
                       'categories', 'Vocalist', 'roles', 'Default')),
        'tags', array(
          named_struct('count', 1L, 'tag', named_struct('id', l_partkey, 'name', p_name, 'categoryName', p_type)),
          named_struct('count', 2L, 'tag', cast(null as struct<id: bigint, name: string, categoryName: string>))),
        'pvs', array(
          named_struct('service', case when l_returnflag = 'A' then 'Youtube' else 'NicoNicoDouga' end,
                       'pvId', concat('a', cast(l_partkey as string)), 'pvType', 'Reprint'),
          named_struct('service', 'NicoNicoDouga', 'pvId', case when l_returnflag = 'R' then '' else concat('b', cast(l_suppkey as string)) end,
                       'pvType', case when l_linestatus = 'F' then 'Original' else 'Reprint' end),
          named_struct('service', 'Youtube', 'pvId', concat('c', cast(l_linenumber as string)), 'pvType', 'Original'))
      )) as items,
      case when l_returnflag = 'A' then 1L else 1000000000000L end as totalCount
    from {src}"""

# What the documents say, read straight from the tables.
BUNDLE = """
    select l_orderkey as id, seq, concat('song-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as title,
           case when o_orderstatus <> 'P' then ordered end as publish_date, o_orderpriority as song_type,
           case when l_returnflag = 'R' then concat('a', cast(l_partkey as varchar))
                when l_returnflag = 'A' then concat('b', cast(l_suppkey as varchar))
                when l_linestatus = 'F' then concat('b', cast(l_suppkey as varchar))
                else concat('a', cast(l_partkey as varchar)) end as nico_video_id,
           concat('c', cast(l_linenumber as varchar)) as youtube_video_id,
           l_suppkey as artist_id, s_name as artist_name,
           case when l_linestatus = 'O' then 'Producer' else 'Mixer' end as role,
           l_partkey as tag_id, p_name as tag_name, p_type as category,
           nullif(o_custkey, 0) as original_version_id
    from {src}"""
STEPS = dict(src=_SOURCE, bundle=BUNDLE)


#: Order lines that a task numbers and makes documents of, on average.
LINES_EACH = 200_000


def _source(v):
    """The rows of ``_SOURCE``: lines meet parts and suppliers while they are narrow, and move once
    more, in partitions of bounded size, to meet their order and be numbered in it."""
    lines = v.lineitem.join(v.part.select("p_partkey", "p_name", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    lines = lines.join(v.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    width = max(v.spark.sparkContext.defaultParallelism, -(-v.lineitem.count() // LINES_EACH))
    orders = v.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("ordered")
    )
    joined = lines.repartition(width, "l_orderkey").join(
        orders.repartition(width, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"]
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.col("l_shipdate").cast("date").alias("shipped"), "o_custkey", "o_orderstatus", "o_orderpriority",
        "ordered", "s_name", "p_name", "p_type",
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("seq"),
    )


def _pages(v):
    """The documents as a frame of pages."""
    return v.spark.sql(SONG_DOCS, src=_source(v))


def _landed_pages(v):
    """The documents written as compressed JSON lines and read back, by run."""
    folder = fresh_folder(v.spark, "songs")
    # Lines are sorted by run, which the writer asks for, before they become long documents.
    pages = v.spark.sql(SONG_DOCS, src=_source(v).sortWithinPartitions("l_returnflag"))
    out = pages.select("run", F.to_json(F.struct("page", "items", "totalCount")).alias("value"))
    out.write.partitionBy("run").option("zlib.compress.level", "BEST_SPEED").text(folder, compression="gzip")
    return folder


def _bundles(v):
    return catalogue.bundles(landed.song_items(_pages(v)))


def _frames(v):
    return catalogue.catalogue_frames(_bundles(v), F.col("seq"))


@query("s1_scan_tables", """
    select 'songs' as name, count(*) as n, cast(sum(id) as bigint) as keys from {songs}
    union all select 'artists', count(*), cast(sum(id) as bigint) from {artists}
    union all select 'song_artists', count(*), cast(sum(song_id) as bigint) from {song_artists}
    union all select 'tags', count(*), cast(sum(id) as bigint) from {tags}
    union all select 'song_tags', count(*), cast(sum(song_id) as bigint) from {song_tags}
    union all select 'derived_works', count(*), cast(sum(original_song_id) as bigint) from {ederived}
    union all select 'metrics_daily', count(*), cast(sum(song_id) as bigint) from {emetrics}
    union all select 'song_embeddings', count(*), cast(sum(song_id) as bigint) from {song_embeddings}""")
def _(v):
    root = fresh_folder(v.spark, "tables")
    made = {
        "songs": v.songs, "artists": v.artists, "song_artists": v.song_artists, "tags": v.tags,
        "song_tags": v.song_tags, "derived_works": v.ederived, "metrics_daily": v.emetrics,
        "song_embeddings": v.song_embeddings,
    }
    key = {"derived_works": "original_song_id"}
    out = None
    for name, frame in made.items():
        tables.write_table(_padded(frame, name), root, name)
        k = key.get(name, "id" if name in ("songs", "artists", "tags") else "song_id")
        part = tables.scan(v.spark, root, name).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("keys"))
        part = part.select(F.lit(name).alias("name"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


def _padded(frame, table):
    """Adds the columns of the stored table that a view does not have."""
    missing = [f for f in tables.TABLES[table] if f.name not in frame.columns]
    return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else frame


@query("s2_read_song_pages", """
    select l_orderkey as id, concat('song-', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as name,
           2 as n_artists, 2 as n_tags, 3 as n_pvs from {src}""", **STEPS)
def _(v):
    items = landed.read_song_pages(v.spark, _landed_pages(v))
    return items.select(
        "item.id", "item.name", F.size("item.artists").alias("n_artists"),
        F.size("item.tags").alias("n_tags"), F.size("item.pvs").alias("n_pvs"),
    )


METRIC_DOCS = """
    select event_id as page, array(
        named_struct('contentId', cast(null as string), 'viewCounter', 1L, 'commentCounter', 1L,
                     'mylistCounter', 1L, 'likeCounter', 1L),
        named_struct('contentId', case when event_type = 'error' then '' else concat('v', cast(user_id as string)) end,
                     'viewCounter', event_id, 'commentCounter', k,
                     'mylistCounter', cast(null as bigint),
                     'likeCounter', case when k < 50 then cast(floor(value) as bigint) end)) as data
    from {ev}"""
READINGS = """
    select concat('v', cast(user_id as varchar)) as content_id, event_id as views, k as comments,
           cast(null as bigint) as mylists, case when k < 50 then cast(floor(value) as bigint) end as likes
    from {ev} where event_type <> 'error'
    qualify row_number() over (partition by user_id order by event_id desc) = 1"""


@query("s3_read_metric_pages", "select * from {readings}", readings=READINGS)
def _(v):
    folder = fresh_folder(v.spark, "metrics")
    v.sql(METRIC_DOCS).select(F.to_json(F.struct("page", "data")).alias("value")).write.text(folder)
    return landed.read_metric_pages(v.spark, folder)


@query("p15_metric_validity", """
    select count(*) as readings, count(likes) as with_likes, count(mylists) as with_mylists from {readings}""",
    readings=READINGS)
def _(v):
    found = landed.metric_readings(v.sql(METRIC_DOCS))
    return found.agg(
        F.count(F.lit(1)).alias("readings"), F.count("likes").alias("with_likes"),
        F.count("mylists").alias("with_mylists"),
    )


# Nested attributes for users, flat ones for assistants, only a model name for the rest.
SPAN_DOCS = """
    select case role when 'assistant' then 'llm' when 'user' then 'LLM' else 'Llm' end as spanKind,
      case role
        when 'user' then to_json(named_struct('llm', named_struct('response', named_struct('model', role),
              'token_count', named_struct('total', length(text)))))
        when 'assistant' then to_json(map('llm.response.model', role, 'llm.token_count.total', cast(length(text) as string)))
        else to_json(named_struct('llm', named_struct('response', named_struct('model', ''), 'model_name', role)))
      end as attributes
    from {conversations}
    union all select 'CHAIN', '[]' from {conversations}"""
SPAN_FIELDS = """
    select role as model, case when role in ('user', 'assistant') then cast(length(text) as bigint) end as tokens
    from {conversations}"""


def _spans(v):
    return v.sql(SPAN_DOCS)


@query("s4_read_spans", SPAN_FIELDS)
def _(v):
    folder = fresh_folder(v.spark, "spans")
    _spans(v).select(F.to_json(F.struct("spanKind", "attributes")).alias("value")).write.text(folder)
    return landed.read_spans(v.spark, folder)


@query("j5_span_fields", SPAN_FIELDS)
def _(v):
    return landed.model_spans(_spans(v))


@query("j4_dig", """
    select event_id, cast(k as varchar) as flat, cast(k as varchar) as nested, cast(k as varchar) as both
    from {ev}""")
def _(v):
    k = F.col("k")
    flat = F.to_json(F.create_map(F.lit("a.b"), k))
    nested = F.to_json(F.struct(F.struct(k.alias("b")).alias("a")))
    both = F.to_json(F.struct(k.alias("a.b"), F.struct((k + 1).alias("b")).alias("a")))
    return v.ev.select(
        "event_id",
        doc.dig(flat, "a", "b").alias("flat"),
        doc.dig(nested, "a", "b").alias("nested"),
        doc.dig(both, "a", "b").alias("both"),
    )


@query("s5_page_coverage", """
    select l_returnflag as run, count(*) as pages, count(*) as fetched,
           case when l_returnflag = 'A' then 1::bigint else 1000000000000 end as total_matching,
           l_returnflag = 'A' as complete, l_returnflag <> 'A' and count(*) >= 40 as at_limit
    from {src} group by l_returnflag""", **STEPS)
def _(v):
    pages = landed.read_pages(v.spark, _landed_pages(v), SONG_PAGE)
    return landed.page_coverage(pages, ["run"], size=1)


@query("s7_write_partitioned", """
    select metric_date, count(*) as n, cast(sum(views) as bigint) as views from {emetrics} group by metric_date""")
def _(v):
    path = fresh_folder(v.spark, "metrics-daily")
    tables.write_partitioned(v.emetrics, path, ["metric_date"])
    # Writing one week again must leave the other days as they are.
    week = v.emetrics.where("metric_date between date '2024-01-15' and date '2024-01-21'")
    tables.write_partitioned(week, path, ["metric_date"])
    stored = v.spark.read.parquet(path)
    return stored.groupBy("metric_date").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))


# ---- scalar parsing over every order line -----------------------------------
@query("p11_parse_date", """
    select o_orderkey as id, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as day from {orders}""")
def _(v):
    text = F.when(F.col("o_orderstatus") == "P", "").otherwise(
        F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z"))
    )
    return v.orders.select(F.col("o_orderkey").alias("id"), doc.parse_date(text).alias("day"))


@query("p12_pick_pv", "select id, seq, nico_video_id, youtube_video_id from {bundle}", **STEPS)
def _(v):
    item = _pages(v).select("page", F.explode("items").alias("i"))
    return item.select(
        "i.id",
        ((F.col("page") - F.col("i.id")) / 1000000).cast("bigint").alias("seq"),
        doc.pick_pv(F.col("i.pvs"), "NicoNicoDouga").alias("nico_video_id"),
        doc.pick_pv(F.col("i.pvs"), "Youtube").alias("youtube_video_id"),
    )


@query("p13_artist_role", "select role, count(*) as n from {bundle} group by role", **STEPS)
def _(v):
    credit = _pages(v).select(F.explode(F.col("items")[0]["artists"]).alias("a")).where("a.artist is not null")
    role = doc.artist_role(F.col("a.roles"), F.col("a.categories"))
    return credit.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("j1_parse_song", """
    select id, title, publish_date, song_type, nico_video_id, youtube_video_id, original_version_id,
           concat(cast(artist_id as varchar), ':', artist_name, ':', role) as artists,
           concat(cast(tag_id as varchar), ':', tag_name, ':', category) as tags
    from {bundle}""", **STEPS)
def _(v):
    credit = F.transform(
        "artists", lambda a: F.concat_ws(":", a["artist_id"].cast("string"), a["name"], a["role"])
    )
    label = F.transform(
        "tags", lambda t: F.concat_ws(":", t["tag_id"].cast("string"), t["name"], t["category"])
    )
    return _bundles(v).select(
        "song.*", "original_version_id",
        F.array_join(credit, ",").alias("artists"), F.array_join(label, ",").alias("tags"),
    )


# ---- deduplication and merges -----------------------------------------------
LAST = dict(
    **STEPS,
    last="""
    select id, title, publish_date, song_type, nico_video_id, youtube_video_id from {bundle}
    qualify row_number() over (partition by id order by seq desc) = 1""",
    last_tag="""
    select tag_id as id, max(tag_name) as name, max(category) as category from {bundle} group by tag_id""",
)


@query("u1_last_wins", "select * from {last}", **LAST)
def _(v):
    return _frames(v)["songs"]


@query("o4_dedupe_links", "select distinct id as song_id, artist_id, role from {bundle}", **STEPS)
def _(v):
    return _frames(v)["song_artists"]


@query("u2_update_all", """
    select coalesce(l.id, s.id) as id, coalesce(l.title, s.title) as title,
           case when l.id is null then s.publish_date else l.publish_date end as publish_date
    from {last} l full join {songs} s on s.id = l.id""", **LAST)
def _(v):
    base = v.songs.select("id", "title", "publish_date")
    return upserts.update_all(base, _frames(v)["songs"].select("id", "title", "publish_date"), ["id"])


@query("u3_update_some", """
    select p_partkey as id, case when t.id is null then p_name else concat(p_name, '!') end as name,
           p_type as category, g.canon_name, g.canon_status
    from {part} join {tags} g on g.id = p_partkey left join {last_tag} t on t.id = p_partkey
    where p_size > 10
    union all
    select t.id, concat(t.name, '!'), t.category, null, 'pending' from {last_tag} t
    join {part} on p_partkey = t.id where p_size <= 10""", **LAST)
def _(v):
    # The smaller parts are not stored yet; every document carries a changed name.
    small = v.part.where("p_size <= 10").select(F.col("p_partkey").alias("id"))
    base = v.tags.join(small, "id", "left_anti")
    fresh = _frames(v)["tags"].withColumn("name", F.concat("name", F.lit("!")))
    return upserts.upsert_tags(base, fresh).drop("canon_confidence")


@query("u4_insert_only", """
    select distinct l_orderkey as song_id, l_partkey as tag_id from {lineitem}""")
def _(v):
    stored = v.song_tags.join(v.orders.where("o_orderstatus = 'F'"), F.col("song_id") == F.col("o_orderkey"))
    links = v.lineitem.select(F.col("l_orderkey").alias("song_id"), F.col("l_partkey").alias("tag_id"))
    return upserts.insert_only(stored.select("song_id", "tag_id"), links, ["song_id", "tag_id"])


@query("u5_keep_first", """
    select l_orderkey as original_song_id, l_suppkey as derived_song_id,
           coalesce(min(case when l_returnflag = 'R' then l_shipdate end), min(l_shipdate)) as discovered_at
    from {lineitem} group by 1, 2""")
def _(v):
    seen = v.lineitem.select(
        F.col("l_orderkey").alias("original_song_id"),
        F.col("l_suppkey").alias("derived_song_id"),
        F.col("l_shipdate").alias("discovered_at"),
        "l_returnflag",
    )
    keys = ["original_song_id", "derived_song_id"]
    stored = seen.where("l_returnflag = 'R'").groupBy(*keys).agg(F.min("discovered_at").alias("discovered_at"))
    return upserts.keep_first(stored, seen.drop("l_returnflag"), keys, "discovered_at")


@query("u6_orphan_guard", """
    select l_orderkey as song_id, l_partkey as tag_id, 'kept' as verdict from {lineitem}
    join {orders} on o_orderkey = l_orderkey where o_orderstatus <> 'P'
    union all
    select l_orderkey, l_partkey, 'orphan' from {lineitem}
    join {orders} on o_orderkey = l_orderkey where o_orderstatus = 'P'""")
def _(v):
    parents = v.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    links = v.lineitem.select(F.col("l_orderkey").alias("song_id"), F.col("l_partkey").alias("tag_id"))
    kept = upserts.linked(links, parents, "song_id", "id").withColumn("verdict", F.lit("kept"))
    lost = upserts.orphans(links, parents, "song_id", "id").withColumn("verdict", F.lit("orphan"))
    return kept.unionByName(lost)


_CHAIN = """
    select o_orderkey as id, o_orderstatus as status,
           lead(o_orderkey) over (partition by o_custkey, year(o_orderdate) order by o_orderkey) as next_id,
           max(case when o_orderstatus = 'P' then 1 else 0 end) over (
             partition by o_custkey, year(o_orderdate) order by o_orderkey rows unbounded preceding) as gone
    from {orders}"""


@query("u6_remove_closure", """
    select 'song' as kind, id, cast(null as bigint) as other from {chain} where gone = 0
    union all
    select 'work', id, next_id from {chain} where gone = 0 and next_id is not null
    union all
    select distinct 'tag', l_orderkey, l_partkey from {lineitem} join {chain} on id = l_orderkey where gone = 0""", chain=_CHAIN)
def _(v):
    # Each order's next one is derived from it; removing some removes all that follow them.
    root = fresh_folder(v.spark, "removal")
    tables.create_tables(v.spark, root)
    chain = materialize(v.spark.sql(_CHAIN, orders=v.orders))
    made = {
        "songs": chain.select("id", F.concat(F.lit("song-"), F.col("id").cast("string")).alias("title")),
        "derived_works": chain.where("next_id is not null").selectExpr("id as original_song_id", "next_id as derived_song_id"),
        "song_tags": v.lineitem.selectExpr("l_orderkey as song_id", "l_partkey as tag_id").distinct(),
    }
    for name, frame in made.items():
        missing = [f for f in tables.TABLES[name] if f.name not in frame.columns]
        tables.write_table(frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}), root, name)
    removal.remove(v.spark, root, "songs", chain.where("status = 'P'").select("id"), derived=True)
    songs, works, links = (tables.scan(v.spark, root, n) for n in ("songs", "derived_works", "song_tags"))
    none = F.lit(None).cast("bigint").alias("other")
    return (
        songs.select(F.lit("song").alias("kind"), "id", none)
        .unionByName(works.select(F.lit("work").alias("kind"), F.col("original_song_id").alias("id"), F.col("derived_song_id").alias("other")))
        .unionByName(links.select(F.lit("tag").alias("kind"), F.col("song_id").alias("id"), F.col("tag_id").alias("other")))
    )


@query("k7_semi_originals", """
    select distinct original_version_id as original_song_id, b.id as derived_song_id
    from {bundle} b join {orders} o on o.o_orderkey = b.original_version_id""", **STEPS)
def _(v):
    frames = _frames(v)
    songs = upserts.update_all(v.songs.select("id"), frames["songs"].select("id"), ["id"])
    derived = frames["derived_works"].select("original_song_id", "derived_song_id")
    return upserts.linked(derived, songs, "original_song_id", "id")


@query("a13_ingest_summary", """
    select count(distinct id) as songs, count(distinct artist_id) as artists, count(distinct tag_id) as tags,
           count(distinct (id, artist_id, role)) as song_artists, count(distinct (id, tag_id)) as song_tags,
           count(distinct case when original_version_id in (select id from {bundle})
                               then (original_version_id, id) end) as derived_linked,
           count(distinct case when original_version_id is not null then (original_version_id, id) end) as derived_seen
    from {bundle}""", **STEPS)
def _(v):
    # Parsed once, as in a collection run; every frame reads its own columns.
    frames = catalogue.catalogue_frames(materialize(_bundles(v)), F.col("seq"))
    return catalogue.ingest_summary(frames, frames["songs"])


# ---- daily readings ----------------------------------------------------------
TARGETS = """
    select id, concat('v', cast(cast(floor(id / 4) as int) as varchar(20))) as nico_video_id from {esongs}"""
BOUND = """
    select t.id as song_id, date '2024-02-01' as metric_date, 'niconico' as source,
           r.views, r.comments, r.mylists, r.likes
    from {targets} t join {readings} r on r.content_id = t.nico_video_id"""
DAILY = dict(readings=READINGS, targets=TARGETS, bound=BOUND)
DAY = dt.date(2024, 2, 1)


@query("k8_metrics_match", "select * from {bound}", **DAILY)
def _(v):
    readings = landed.metric_readings(v.sql(METRIC_DOCS))
    return catalogue.metric_rows(v.sql(TARGETS), readings, F.lit(DAY), "niconico")


@query("k9_missing_targets", """
    select t.id, t.nico_video_id from {targets} t
    where not exists (select 1 from {readings} r where r.content_id = t.nico_video_id)""", **DAILY)
def _(v):
    return catalogue.missing_targets(v.sql(TARGETS), landed.metric_readings(v.sql(METRIC_DOCS)))


@query("u7_metrics_upsert", """
    select song_id, metric_date, source, views, comments from {emetrics}
    where metric_date <> date '2024-01-22'
    union all
    select song_id, metric_date, source, views + 1, comments from {emetrics}
    where metric_date = date '2024-01-22'""")
def _(v):
    root = fresh_folder(v.spark, "day")
    tables.write_table(_padded(v.emetrics, "metrics_daily"), root, "metrics_daily")
    again = v.emetrics.where("metric_date = date '2024-01-22'").withColumn("views", F.col("views") + 1)
    for _ in range(2):
        collect.upsert_day(v.spark, root, _padded(again, "metrics_daily"))
    stored = tables.scan(v.spark, root, "metrics_daily")
    return stored.select("song_id", "metric_date", "source", "views", "comments")
