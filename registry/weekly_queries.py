"""Scalar expressions, weekly scoring, clusters and shares."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.base import fresh_folder, query
from upswell.functions import scores as fn
from upswell.operators import shares, weekly
from upswell.operators.ranking import batches
from upswell.plans import collect, kept_weeks
from upswell.session import materialize
from upswell.sources import tables

WEEK = dt.date(2024, 1, 15)
SHARE_WEEK = dt.date(1998, 6, 1)

# ---- pieces of SQL shared by several oracles --------------------------------
DELTAS = """
    select song_id,
           max(views) filter (where metric_date < date '2024-01-08') as v_prev,
           max(views) filter (where metric_date < date '2024-01-15') as v_start,
           max(views) filter (where metric_date < date '2024-01-22') as v_end,
           count(distinct date_trunc('week', metric_date))
             filter (where metric_date < date '2024-01-22') as weeks
    from {emetrics} group by song_id"""
DERIV_BASE = """
    select original_song_id as song_id,
           count(*) filter (where date_trunc('week', discovered_at) = date '2024-01-15') as n_this,
           count(*) filter (where date_trunc('week', discovered_at)
             in (date '2024-01-08', date '2024-01-01', date '2023-12-25', date '2023-12-18')) as n_prev
    from {ederived} where discovered_at < timestamp '2024-01-22' group by original_song_id"""
SCORED = """
    select d.song_id, weeks < 2 as is_coldstart,
           case when weeks >= 2 and v_start - v_prev > 0
                then (v_end - v_start)::double / (v_start - v_prev) end as view_velocity,
           case when weeks >= 2 and coalesce(n_prev, 0) <> 0
                then coalesce(n_this, 0) / (n_prev / 4.0::double) end as deriv_velocity
    from {deltas} d left join {deriv_base} b on b.song_id = d.song_id"""
TOP = """
    select song_id, view_velocity,
           row_number() over (order by view_velocity desc, song_id) as rank
    from {scored} where view_velocity is not null
    qualify rank <= 15"""
CLUSTERS = """
    select a.canon as tag_a, b.canon as tag_b, list(t.song_id order by t.rank) as songs,
           row_number() over (order by min(t.rank), a.canon, b.canon) as cluster_id
    from {top} t join {etagged} a on a.song_id = t.song_id
    join {etagged} b on b.song_id = t.song_id and a.canon < b.canon
    group by a.canon, b.canon having count(*) >= 6"""
CLUSTER_OF = """
    select song_id, min(cluster_id) as cluster_id
    from (select unnest(songs) as song_id, cluster_id from {clusters}) c group by song_id"""
TREND = """
    select s.song_id, date '2024-01-15' as week, s.view_velocity, s.deriv_velocity,
           s.is_coldstart, c.cluster_id::int as cluster_id
    from {scored} s left join {cluster_of} c on c.song_id = s.song_id"""
STEPS = dict(
    deltas=DELTAS, deriv_base=DERIV_BASE, scored=SCORED, top=TOP, clusters=CLUSTERS,
    cluster_of=CLUSTER_OF, trend=TREND,
)


def scored(v):
    return weekly.score(weekly.view_deltas(v.emetrics, WEEK), weekly.deriv_base(v.ederived, WEEK))


def clusters(v):
    top = weekly.top_velocity(scored(v))
    return weekly.detect_clusters(top, weekly.tags_of(top, v.esong_tags, v.etags))


def trend(v):
    return weekly.trend_rows(v.emetrics, v.ederived, v.esong_tags, v.etags, WEEK)


# ---- projections ------------------------------------------------------------
@query("p1_view_velocity", """
    select song_id, case when v_start - v_prev > 0
                    then (v_end - v_start)::double / (v_start - v_prev) end as view_velocity
    from {deltas}""", **STEPS)
def _(v):
    c = weekly.view_deltas(v.emetrics, WEEK)
    gain, base = F.col("v_end") - F.col("v_start"), F.col("v_start") - F.col("v_prev")
    return c.select("song_id", fn.view_velocity(base, gain).alias("view_velocity"))


@query("p2_deriv_velocity", """
    select song_id, case when n_prev <> 0 then n_this / (n_prev / 4.0::double) end as deriv_velocity
    from {deriv_base}""", **STEPS)
def _(v):
    base = weekly.deriv_base(v.ederived, WEEK)
    return base.select("song_id", fn.deriv_velocity(F.col("n_prev"), F.col("n_this")).alias("deriv_velocity"))


SHARE_COUNTS = """
    select t.canon_name as canon,
           count(distinct s.id) filter (where s.publish_date >= date '1998-06-01') as n_this,
           count(distinct s.id) filter (where s.publish_date < date '1998-06-01') as n_prev
    from {songs} s join {song_tags} st on st.song_id = s.id join {tags} t on t.id = st.tag_id
    where s.publish_date >= date '1998-05-25' and s.publish_date < date '1998-06-08'
      and t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null
    group by t.canon_name"""
SHARE_TOTALS = """
    select count(*) filter (where publish_date >= date '1998-06-01' and publish_date < date '1998-06-08') as total_this,
           count(*) filter (where publish_date >= date '1998-05-25' and publish_date < date '1998-06-01') as total_prev
    from {songs}"""
SHARES = """
    select canon, n_this, n_prev,
           case when total_this = 0 then 0.0::double else 100.0::double * n_this / total_this end as share_this,
           case when total_prev = 0 then 0.0::double else 100.0::double * n_prev / total_prev end as share_prev
    from {share_counts}, {share_totals}"""
SHARE_STEPS = dict(share_counts=SHARE_COUNTS, share_totals=SHARE_TOTALS, shares=SHARES)


@query("p3_tag_share", "select canon, round_even(share_this, 6) as share_pct from {shares}", **SHARE_STEPS)
def _(v):
    total = shares.week_totals(v.songs, SHARE_WEEK).select("total_this").scalar()
    counts = shares.tag_week_counts(v.songs, v.song_tags, v.tags, SHARE_WEEK)
    return counts.select("canon", F.bround(fn.tag_share(F.col("n_this"), total), 6).alias("share_pct"))


@query("p4_tag_share_delta", """
    select canon, round_even(share_this - share_prev, 6) as delta_pp from {shares}""", **SHARE_STEPS)
def _(v):
    totals = shares.week_totals(v.songs, SHARE_WEEK)
    counts = shares.tag_week_counts(v.songs, v.song_tags, v.tags, SHARE_WEEK)
    this = fn.tag_share(F.col("n_this"), totals.select("total_this").scalar())
    prev = fn.tag_share(F.col("n_prev"), totals.select("total_prev").scalar())
    return counts.select("canon", F.bround(fn.tag_share_delta(prev, this), 6).alias("delta_pp"))


@query("p5_is_coldstart", "select song_id, weeks < 2 as is_coldstart from {deltas}", **STEPS)
def _(v):
    c = weekly.view_deltas(v.emetrics, WEEK)
    return c.select("song_id", fn.is_coldstart(F.col("weeks")).alias("is_coldstart"))


@query("p6_week_start", "select id, cast(date_trunc('week', publish_date) as date) as week from {songs}")
def _(v):
    return v.songs.select("id", fn.week_start(F.col("publish_date")).alias("week"))


@query("p7_ratio", """
    select p_brand as brand,
           round_even(count(*) filter (where p_size % 5 = 4)::double / count(*), 3) as demoted_rate
    from {part} group by p_brand""")
def _(v):
    return v.part.groupBy(F.col("p_brand").alias("brand")).agg(
        fn.ratio(F.count_if(F.col("p_size") % 5 == 4), F.count(F.lit(1))).alias("demoted_rate")
    )


@query("p8_round2", "select o_orderkey as id, round_even(o_totalprice / 7, 2) as value from {orders}")
def _(v):
    return v.orders.select(F.col("o_orderkey").alias("id"), fn.round2(F.col("o_totalprice") / 7).alias("value"))


@query("p9_confirmed_canon", """
    select id, canon_name from {tags}
    where canon_status in ('canon_lite', 'canon_flash') and canon_name is not null""")
def _(v):
    return v.tags.where(fn.confirmed_canon(F.col("canon_status"), F.col("canon_name"))).select("id", "canon_name")


@query("p10_effective_tag", """
    select id, case when canon_status in ('canon_lite', 'canon_flash') and canon_name is not null
                    then canon_name else name end as tag from {tags}""")
def _(v):
    tag = fn.effective_tag(F.col("canon_status"), F.col("canon_name"), F.col("name"))
    return v.tags.select("id", tag.alias("tag"))


# ---- joins and pairs --------------------------------------------------------
@query("k1_tag_map", """
    select distinct st.song_id, t.canon_name as canon from {song_tags} st join {tags} t on t.id = st.tag_id
    where t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null""")
def _(v):
    return weekly.tag_map(v.song_tags, v.tags)


@query("k3_three_way_share", """
    select distinct t.canon_name as canon, s.id as song_id, s.publish_date >= date '1998-06-01' as is_this
    from {songs} s join {song_tags} st on st.song_id = s.id join {tags} t on t.id = st.tag_id
    where s.publish_date >= date '1998-05-25' and s.publish_date < date '1998-06-08'
      and t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null""")
def _(v):
    return shares.song_canons(v.songs, v.song_tags, v.tags, SHARE_WEEK)


@query("k11_prev_week_lookup", "select canon, n_this, n_prev from {share_counts} where n_this > 0", **SHARE_STEPS)
def _(v):
    return shares.tag_week_counts(v.songs, v.song_tags, v.tags, SHARE_WEEK).where(F.col("n_this") > 0)


@query("k12_pair_self_join", """
    select a.canon as tag_a, b.canon as tag_b, count(*) as songs
    from {tagged} a join {tagged} b on a.song_id = b.song_id and a.canon < b.canon
    group by a.canon, b.canon having count(*) >= 6""",
    tagged="""
    select distinct st.song_id, t.canon_name as canon from {song_tags} st join {tags} t on t.id = st.tag_id
    where t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null""")
def _(v):
    return weekly.tag_pairs(weekly.tag_map(v.song_tags, v.tags), min_songs=6)


# ---- aggregates -------------------------------------------------------------
@query("a1_view_deltas", "select * from {deltas}", **STEPS)
def _(v):
    return weekly.view_deltas(v.emetrics, WEEK)


@query("a2_deriv_counts", """
    select original_song_id as song_id, cast(date_trunc('week', discovered_at) as date) as week, count(*) as n
    from {ederived} group by 1, 2""")
def _(v):
    return weekly.deriv_counts(v.ederived)


@query("a3_deriv_4wk_base", "select song_id, n_this, n_prev from {deriv_base}", **STEPS)
def _(v):
    return weekly.deriv_base(v.ederived, WEEK)


@query("a4_tag_week_counts", "select canon, n_this, n_prev from {share_counts}", **SHARE_STEPS)
def _(v):
    return shares.tag_week_counts(v.songs, v.song_tags, v.tags, SHARE_WEEK)


@query("a5_week_totals", "select total_this, total_prev from {share_totals}", **SHARE_STEPS)
def _(v):
    return shares.week_totals(v.songs, SHARE_WEEK)


@query("a12_trend_summary", """
    select week, count(*) filter (where not is_coldstart) as scored,
           count(*) filter (where is_coldstart) as coldstart, count(cluster_id) as clustered
    from {trend} group by week""", **STEPS)
def _(v):
    return weekly.trend_summary(trend(v))


# ---- windows ----------------------------------------------------------------
@query("w1_top_velocity", """
    select song_id, round_even(view_velocity, 6) as view_velocity, rank::int as rank from {top}""", **STEPS)
def _(v):
    return weekly.top_velocity(scored(v)).withColumn("view_velocity", F.bround("view_velocity", 6))


@query("w2_detect_clusters", """
    select concat(tag_a, '+', tag_b) as tags, array_to_string(songs, ',') as songs from {clusters}""", **STEPS)
def _(v):
    return clusters(v).select(
        F.array_join("tags", "+").alias("tags"), F.array_join("songs", ",").alias("songs")
    )


@query("w3_cluster_numbering", "select song_id, cluster_id::int as cluster_id from {cluster_of}", **STEPS)
def _(v):
    return weekly.cluster_of(clusters(v))


@query("w7_tag_deltas", """
    select canon, round_even(share_this, 1) as share_pct, round_even(share_this - share_prev, 1) as delta_pp
    from {shares} where n_this > 0 order by 3 desc, 1 limit 15""", **SHARE_STEPS)
def _(v):
    return shares.tag_deltas(v.songs, v.song_tags, v.tags, SHARE_WEEK)


@query("w8_batching", """
    select id, floor((row_number() over (order by publish_date, id) - 1) / 64)::bigint as batch_no,
           ((row_number() over (order by publish_date, id) - 1) % 64 + 1)::int as pos
    from {songs}""")
def _(v):
    placed = batches(v.songs.select("id", "publish_date"), 64, F.asc("publish_date"), F.asc("id"))
    return placed.select("id", "batch_no", "pos")


@query("o2_scored_union_cold", """
    select song_id, round_even(view_velocity, 6) as view_velocity,
           round_even(deriv_velocity, 6) as deriv_velocity, is_coldstart from {scored}""", **STEPS)
def _(v):
    return scored(v).select(
        "song_id",
        F.bround("view_velocity", 6).alias("view_velocity"),
        F.bround("deriv_velocity", 6).alias("deriv_velocity"),
        "is_coldstart",
    )


@query("r1_trend_rows", """
    select song_id, week, round_even(view_velocity, 6) as view_velocity,
           round_even(deriv_velocity, 6) as deriv_velocity, is_coldstart, cluster_id from {trend}""", **STEPS)
def _(v):
    return _rounded(trend(v))


def _rounded(rows):
    return rows.withColumns(
        {c: F.bround(c, 6) for c in ("view_velocity", "deriv_velocity")}
    )


RANGE_STEPS = dict(
    weeks="""
    select cast(unnest([date '2024-01-01', date '2024-01-08', date '2024-01-15',
                        date '2024-01-22', date '2024-01-29']) as date) as week""",
    deltas="""
    select w.week, m.song_id,
           max(views) filter (where metric_date < w.week - 7) as v_prev,
           max(views) filter (where metric_date < w.week) as v_start,
           max(views) filter (where metric_date < w.week + 7) as v_end,
           count(distinct date_trunc('week', metric_date)) filter (where metric_date < w.week + 7) as weeks
    from {emetrics} m, {weeks} w group by w.week, m.song_id""",
    found="""
    select original_song_id as song_id, cast(date_trunc('week', discovered_at) as date) as found, count(*) as n
    from {ederived} group by 1, 2""",
    base="""
    select w.week, f.song_id, sum(n) filter (where found = w.week) as n_this,
           sum(n) filter (where found < w.week) as n_prev
    from {found} f, {weeks} w where found between w.week - 28 and w.week group by w.week, f.song_id""",
    scored="""
    select d.song_id, d.week, weeks < 2 as is_coldstart,
           case when weeks >= 2 and v_start - v_prev > 0
                then (v_end - v_start)::double / (v_start - v_prev) end as view_velocity,
           case when weeks >= 2 and coalesce(n_prev, 0) <> 0
                then coalesce(n_this, 0)::double / (n_prev::double / 4) end as deriv_velocity
    from {deltas} d left join {base} b on b.song_id = d.song_id and b.week = d.week""",
    top="""
    select week, song_id, row_number() over (partition by week order by view_velocity desc, song_id) as rank
    from {scored} where view_velocity is not null qualify rank <= 15""",
    clusters="""
    select t.week, list(t.song_id) as songs,
           row_number() over (partition by t.week order by min(t.rank), a.canon, b.canon) as cluster_id
    from {top} t join {etagged} a on a.song_id = t.song_id
    join {etagged} b on b.song_id = t.song_id and a.canon < b.canon
    group by t.week, a.canon, b.canon having count(*) >= 6""",
    cluster_of="""
    select week, song_id, min(cluster_id) as cluster_id
    from (select week, unnest(songs) as song_id, cluster_id from {clusters}) c group by week, song_id""",
)


@query("r4_incremental_range", """
    select s.song_id, s.week, round_even(s.view_velocity, 6) as view_velocity,
           round_even(s.deriv_velocity, 6) as deriv_velocity, s.is_coldstart, c.cluster_id::int as cluster_id
    from {scored} s left join {cluster_of} c on c.song_id = s.song_id and c.week = s.week""", **RANGE_STEPS)
def _(v):
    return _rounded(
        weekly.trend_range(
            v.emetrics, v.ederived, v.esong_tags, v.etags, dt.date(2024, 1, 1), dt.date(2024, 1, 29)
        )
    )


@query("a1_late_days", """
    select song_id, week, max(case when metric_date < week - interval 7 day then views end) as v_prev,
           max(case when metric_date < week then views end) as v_start,
           max(case when metric_date < week + interval 7 day then views end) as v_end,
           count(distinct case when metric_date < week + interval 7 day then date_trunc('week', metric_date) end) as weeks
    from {emetrics}, (select unnest([date '2024-01-08', date '2024-01-15', date '2024-01-22', date '2024-02-05']) as week) w
    group by song_id, week""")
def _(v):
    # Kept peaks: some days arrive late, others are corrected downwards.
    root = fresh_folder(v.spark, "late-days")
    tables.create_tables(v.spark, root)
    missing = [f for f in tables.TABLES["metrics_daily"] if f.name not in v.emetrics.columns]
    rows = materialize(v.emetrics.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))
    day = F.dayofmonth("metric_date")
    early = rows.where(day % 3 != 0).withColumn("views", F.when(day % 5 == 0, F.col("views") + 700).otherwise(F.col("views")))
    for arriving in (early, rows.where((day % 3 == 0) | (day % 5 == 0))):
        collect.upsert_day(v.spark, root, arriving)
        kept_weeks.refresh(v.spark, root)
    peaks = tables.scan(v.spark, root, "weekly_peaks")
    kept = weekly.kept_deltas(peaks, dt.date(2024, 1, 8), dt.date(2024, 2, 5))
    return kept.where(F.col("week") != dt.date(2024, 1, 29)).select("song_id", "week", "v_prev", "v_start", "v_end", "weeks")
