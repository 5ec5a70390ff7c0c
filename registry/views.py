"""The reference tables seen as a music catalogue.

Each view is SQL that both engines run. Two catalogues are made: one of orders
(large joins), one of events (weekly series). A view may use the tables and the
views above it; ``{name}`` stands for either.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # ---- orders as songs -------------------------------------------------
    "songs": """
        select o_orderkey as id, concat('song-', cast(o_orderkey as varchar(20))) as title,
               cast(o_orderdate as date) as publish_date, o_orderpriority as song_type
        from {orders}""",
    "artists": """
        select s_suppkey as id, s_name as name, 'Producer' as artist_type from {supplier}""",
    "song_artists": """
        select distinct l_orderkey as song_id, l_suppkey as artist_id, l_returnflag as role
        from {lineitem}""",
    "tags": """
        select p_partkey as id, p_name as name, p_type as category,
               case when p_size % 5 in (0, 1, 2) then p_brand end as canon_name,
               cast(case when p_size % 5 in (0, 1, 2) then 0.5 end as float) as canon_confidence,
               case when p_size % 5 in (0, 1) then 'canon_lite' when p_size % 5 = 2 then 'canon_flash'
                    when p_size % 5 = 3 then 'pending' else 'demoted' end as canon_status
        from {part}""",
    "song_tags": """
        select distinct l_orderkey as song_id, l_partkey as tag_id from {lineitem}""",
    # ---- events as songs: one per user and kind of event -----------------
    "ev": """
        select user_id * 5 + case event_type when 'click' then 0 when 'view' then 1
                   when 'signup' then 2 when 'purchase' then 3 else 4 end as song_id,
               event_id, user_id, event_type, value, ts, cast(ts as date) as day,
               cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k
        from {events}""",
    "esongs": """
        select song_id as id, concat('esong-', cast(song_id as varchar(20))) as title,
               min(day) as publish_date, min(event_type) as song_type
        from {ev} group by song_id""",
    "etags": """
        select distinct k as id, concat('tag-', cast(k as varchar(20))) as name,
               case when k < 85 then concat('family-', cast(floor(k / 10) as int)) end as canon_name,
               case when k < 70 then 'canon_lite' when k < 85 then 'canon_flash'
                    when k < 92 then 'pending' else 'demoted' end as canon_status
        from {ev}""",
    "esong_tags": """
        select distinct song_id, k as tag_id from {ev}""",
    "emetrics": """
        select song_id, day as metric_date, 'events' as source,
               cast(sum(n) over (partition by song_id order by day) as bigint) as views,
               n as comments
        from (select song_id, day, count(*) as n from {ev} group by song_id, day) t""",
    "ederived": """
        select user_id * 5 + event_id % 5 as original_song_id, event_id as derived_song_id,
               event_type as relation_type, day as derived_publish_date, ts as discovered_at
        from {ev}""",
    "etagged": """
        select distinct st.song_id, t.canon_name as canon
        from {esong_tags} st join {etags} t on t.id = st.tag_id
        where t.canon_status in ('canon_lite', 'canon_flash') and t.canon_name is not null""",
    # ---- vectors ---------------------------------------------------------
    "song_embeddings": """
        select vec_id as song_id, embedding from {embeddings}""",
    # ---- model spans -----------------------------------------------------
    "spans": """
        select role as model, cast(length(text) as bigint) as tokens from {conversations}""",
}


class Views:
    """The tables of one folder and the views on them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                frame = self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})
            self._made[name] = frame
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over ``{view}`` names."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def oracle(text: str, extra: dict[str, str] | None = None) -> str:
    """The same question as plain SQL: used views become common table expressions."""
    known = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(part: str) -> None:
        for name in _names(part):
            if name in known and name not in needed:
                needed.add(name)
                visit(known[name])

    visit(text)
    ctes = [f"{n} as ({_plain(known[n])})" for n in known if n in needed]
    body = _plain(text)
    return f"with {', '.join(ctes)} {body}" if ctes else body


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
