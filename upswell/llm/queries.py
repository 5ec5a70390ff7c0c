"""The text operators applied to whole tables, and SQL with the same answer where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.llm import (
    decontaminate,
    exact,
    hosts,
    merkle,
    mixing,
    privacy,
    quality,
    repeats,
    sharding,
    simhash,
    spelling,
    templates,
    warc,
)
from upswell.session import apply_conf, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(read)``; ``read(table)`` gives a whole table."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_conf(spark)
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op4_exact_dedup",
    """
    select doc_id,
           max(doc_id) over same as keep_id,
           count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept,
           sha256(coalesce(text, '')) as text_sha256
    from documents
    window same as (partition by coalesce(text, ''))
    """,
)
def exact_dedup(read) -> DataFrame:
    return exact.exact_groups(read("documents"))


#: Rules written by hand: longest fitting one first, before any reputation.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

_SUFFIX = r"(?:(?:com|co|org|net|gov|edu|ac)\.[a-z]{2}|[^.]+)"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _level(name: str, rows: str) -> str:
    """One level of the beta-binomial tree: ``rows`` has n, k and the prior mean m."""
    return f"""
    {name}_rows as ({rows}),
    {name}_fit as (
        select least(greatest(
            coalesce((sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5),
            0.001), 0.9) as r
        from {name}_rows where n > 0),
    {name} as (
        select x.*, (1 - r) / r as c, (k + (1 - r) / r * m) / (n + (1 - r) / r) as mean
        from {name}_rows x, {name}_fit)"""


@query(
    "op2_host_reputation",
    rf"""
    with rest as (
        select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r
        from pages),
    parts as (
        select page_id, translate(regexp_extract(r, '^[^/?#]*'), {_LETTERS}) as host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
        from (select page_id, coalesce(r, '') as r from rest)),
    fits as (
        select *, case
            when (host = 'www.example.com' or suffix(host, '.www.example.com')) and prefix(path, '/en/') then 'www.example.com/en/'
            when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/') then 'example.com/en/'
            when (host = 'net' or suffix(host, '.net')) and prefix(path, '/es/') then 'net/es/'
            when (host = 'net' or suffix(host, '.net')) and prefix(path, '/fr/') then 'net/fr/'
            when (host = 'com' or suffix(host, '.com')) and prefix(path, '/') then 'com/' end as rule
        from parts),
    per_host as (
        select host, count(l.doc_id) as n, count(case when quality = 1 and toxic = 0 then 1 end) as k
        from parts left join labels l on page_id = l.doc_id group by host),
    names as (select *, regexp_replace(host, ':[0-9]*$', '') as name from per_host),
    tree as (
        select host, n::double as n, k::double as k,
               case when name ~ '^[0-9.]+$' or prefix(name, '[') then '' else regexp_extract(name, '(?:^|\.)({_SUFFIX})$', 1) end as sfx,
               case when name ~ '^[0-9.]+$' or prefix(name, '[') or regexp_extract(name, '([^.]+\.{_SUFFIX})$', 1) = ''
                    then name else regexp_extract(name, '([^.]+\.{_SUFFIX})$', 1) end as domain
        from names),
    {_level("s", "select sfx, sum(n) as n, sum(k) as k, (select sum(k) / sum(n) from tree) as m from tree group by sfx")},
    {_level("d", "select t.sfx, domain, sum(t.n) as n, sum(t.k) as k, any_value(s.mean) as m from tree t join s using (sfx) group by t.sfx, domain")},
    {_level("h", "select t.host, t.n, t.k, d.mean as m from tree t join d using (sfx, domain)")}
    select page_id, host, path, rule,
           case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
                when mean + 1.64 * sqrt(mean * (1 - mean) / (n + c + 1)) < 0.5 then 'block' else 'allow' end as verdict,
           round(mean, 6) as reputation
    from fits join h using (host)
    """,
)
def host_reputation(read) -> DataFrame:
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    labels = read("labels").select(F.col("doc_id").alias("page_id"), good)
    return hosts.judge_urls(read("pages"), labels, RULES)


@query(
    "op9_mix_sources",
    """
    with k as (
        select doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
               md5(coalesce('0' || doc_id, '1') || ':' || md5(coalesce(text, '')) || ':'
                   || coalesce('0' || source, '1')) as doc_key
        from documents),
    d as (
        select doc_id, source, size, md5('0:' || doc_key || case when nth > 1 then ':' || nth else '' end) as mixed
        from (select *, row_number() over (partition by doc_key) as nth from k)),
    s as (
        select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nth
        from d group by source),
    w as (
        select *, [5, 2, 1][(nth - 1) % 3 + 1] as weight, 2 * source_size::double as cap,
               sum(source_size) over ()::double as everything
        from s),
    held as (
        select *,
               coalesce(sum(cap) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0) as held,
               sum(weight) over (order by cap / weight, nth rows between current row and unbounded following)::double as open
        from w),
    level as (
        select (1.5::double * everything - held) / open as level from held
        where weight * ((1.5::double * everything - held) / open) <= cap order by cap / weight, nth limit 1),
    t as (select w.*, least(weight * level, cap) as target from w, level),
    q as (
        select d.*, source_size, target, everything,
               sum(size) over (partition by d.source order by mixed rows unbounded preceding)::bigint as until
        from d join t on d.source is not distinct from t.source),
    c as (
        select q.*, turn,
               case when target > 0 then (until + turn * source_size)::double / target else 0::double end as finish
        from q, (values (0), (1)) as turns(turn)),
    p as (
        select *, sum(size) over (order by finish, mixed, turn rows unbounded preceding) <= 1.5::double * everything as taken
        from c)
    select doc_id, size, source_size, target, (size * count(case when taken then 1 end))::bigint as taken
    from p group by doc_id, mixed, size, source_size, target
    """,
)
def mix_sources(read) -> DataFrame:
    return mixing.mix(read("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_shards")
def shards(read) -> DataFrame:
    """Law ``rows``: the counts of the shards differ by one at most."""
    placed = sharding.shuffled_shards(read("documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        sharding.record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op5_decontaminate",
    f"""
    with i as (select item_id, {_WORDS} as w from benchmark),
    iw as (
        select distinct item_id, least(len(w), 13) as width, array_to_string(w[p:p + 12], ' ') as win
        from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from i where len(w) > 0)),
    d as (select doc_id, {_WORDS} as w from documents),
    widths as (select distinct width from iw),
    dw as (
        select doc_id, width, p, array_to_string(w[p:p + width - 1], ' ') as win
        from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as p from d, widths where len(w) >= width)),
    m as (select doc_id, width, p, item_id from dw join iw using (width, win)),
    hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + width)) as q from m) group by doc_id),
    items as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct doc_id, item_id::varchar as item_id from m) group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
           coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join hits using (doc_id) left join items using (doc_id)
    """,
)
def decontaminated(read) -> DataFrame:
    found = decontaminate.scan(read("documents").select("doc_id", "text"), read("benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query(
    "op6_warc_revisits",
    """
    with p as (
        select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
        from pages),
    f as (select *, min(page_id) over (partition by payload_digest) as first from p)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and page_id <> first then first end as refers_to
    from f
    """,
)
def warc_revisits(read) -> DataFrame:
    pages = read("pages")
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.resolved(warc.read_archives(pages.sparkSession, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op7_simhash")
def simhash_groups(read) -> DataFrame:
    return simhash.near_groups(read("documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_ordinal_quality")
def ordinal_quality(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(read("labels")))
    return quality.rate(docs, model).select(
        "doc_id", "expected_grade", "tail", quality.selected().alias("kept")
    )


_TOKENS = "list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end)"


@query(
    "op1_line_templates",
    f"""
    with split as (
        select doc_id, text, md5(coalesce(text, '')) as text_key,
               case when text is null then [] else string_split(text, chr(10)) end as ls
        from documents),
    line as (select doc_id, text_key, unnest(ls) as l, generate_subscripts(ls, 1) as nth from split),
    tokened as (
        select * exclude (l), {_TOKENS} as t, array_to_string(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), ' ') as literal
        from line),
    every as (
        select *, array_to_string(t, ' ') as line, len(t) || ' ' || array_to_string(t[1:2], ' ') as leaf
        from tokened where len(t) > 0),
    found as (
        select * from every where leaf in (select leaf from every group by leaf having count(distinct text_key) >= 5)),
    weight as (select leaf, line, any_value(t) as t, count(distinct text_key) as w from found group by leaf, line),
    token as (select leaf, line, w, unnest(t) as token, generate_subscripts(t, 1) as place from weight),
    part as (
        select *, token <> '<*>' and sum(w) over (partition by leaf, place, token) >= 5 as constant from token),
    template as (
        select line, string_agg(case when constant then token else '<*>' end, ' ' order by place) as template
        from part group by line having count(case when constant then 1 end) >= 0.5 * count(*)),
    matched as (select found.*, template from found join template using (line)),
    unchanged as (select * from found where len(list_filter(t, lambda x: x <> '<*>')) < 0.5 * len(t)),
    gone as (
        select doc_id, text_key, nth from matched
        where template in (select template from matched group by template having count(distinct text_key) >= 5)
        union
        select doc_id, text_key, nth from unchanged
        where literal in (select literal from unchanged group by literal having count(distinct text_key) >= 5)),
    per_doc as (select doc_id, text_key, list(nth) as nths from gone group by doc_id, text_key)
    select doc_id, len(ls)::bigint as n_lines, coalesce(len(nths), 0)::bigint as n_dropped,
           sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: not list_contains(coalesce(nths, []), i)), chr(10)), ''))
               as kept_sha256
    from split left join per_doc using (doc_id, text_key)
    """,
)
def line_templates(read) -> DataFrame:
    cleaned = templates.drop_recurring_lines(read("documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return cleaned.select("doc_id", "n_lines", "n_dropped", digest)


@query("op3_suffix_repeats")
def suffix_repeats(read) -> DataFrame:
    return repeats.repeated_spans(read("documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


#: CRC-32 bit by bit: a table of 256 remainders, then one step per UTF-8 byte of ``text``.
_CRC_TABLE = """
    crc_table as (
        select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)),
            lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as remainders)"""


def _crc(text: str) -> str:
    code = f"""flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint]
        else [192 + (unicode(c)::bigint >> 6), 128 + (unicode(c)::bigint & 63)] end))"""
    step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: {step}), 4294967295)"


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_encoded(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _merkle_tree(name: str, feet: str) -> str:
    """All levels over feet (tree, size, pos, digest), and each node's siblings in its run."""
    return f"""
    {name}_up as (
        select tree, size, 0 as level, pos, digest from {feet}
        union all
        select tree, any_value((size + 2) // 3), level + 1, pos // 3, sha256(string_agg(digest, '' order by pos))
        from {name}_up where size > 1 group by tree, level, pos // 3),
    {name}_runs as (
        select tree, level, pos,
               coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as l,
               coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as r
        from {name}_up where size > 1 window run as (partition by tree, level, pos // 3 order by pos))"""


@query(
    "op11_merkle_manifest",
    f"""
    with recursive {_CRC_TABLE},
    d as (
        select doc_id, source, {_leaf("text")} as leaf,
               case when {_crc("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")}
                    else {_leaf("text")} end as claimed
        from documents, crc_table),
    trees as (select source, count(*) as size, row_number() over (order by source nulls first) as tree from d group by source),
    feet as (
        select doc_id, leaf, claimed, tree, size, leaf as digest,
               row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos
        from d join trees on d.source is not distinct from trees.source),
    {_merkle_tree("low", "feet")},
    tops as (
        select 0 as tree, count(*) over () as size, tree - 1 as pos, digest from low_up where size = 1),
    {_merkle_tree("top", "tops")},
    climb as (
        select doc_id, leaf, tree, pos as foot, pos, 0 as level, claimed as folded, '' as proof from feet
        union all
        select doc_id, leaf, c.tree, foot, c.pos // 3, c.level + 1, sha256(l || folded || r), proof || l || r
        from climb c join low_runs n on c.tree = n.tree and c.level = n.level and c.pos = n.pos),
    under as (select * from climb qualify level = max(level) over (partition by tree, foot)),
    on_top as (
        select doc_id, leaf, tree, foot, tree - 1 as pos, 0 as level, folded, proof from under
        union all
        select doc_id, leaf, c.tree, foot, c.pos // 3, c.level + 1, sha256(l || folded || r), proof || l || r
        from on_top c join top_runs n on c.level = n.level and c.pos = n.pos),
    done as (select * from on_top qualify level = max(level) over (partition by tree, foot)),
    subroots as (select tree, digest as subroot from low_up where size = 1),
    roots as (select digest as root from top_up where size = 1)
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
    from done join subroots using (tree), roots
    """,
)
def merkle_manifest(read) -> DataFrame:
    """Every second document (by the checksum of its id) is checked with its line ends gone."""
    docs = read("documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select(
        "doc_id", "source", merkle.leaf([*columns, "text"]).alias("leaf"), merkle.leaf([*columns, text]).alias("claimed")
    )
    proven = merkle.climb(*merkle.manifest(rows, "source", "doc_id"), "row.claimed")
    return proven.select(
        "row.doc_id",
        *[merkle.hexed(c).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


_RUN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')"


@query(
    "op12_spelling_variants",
    f"""
    with recursive {_CRC_TABLE},
    runs as (select doc_id, unnest({_RUN}) as run from documents),
    checked as (
        select run, coalesce({_crc("(doc_id || ':' || run)")}, 1) as h from runs, crc_table where length(run) >= 7),
    damaged as (
        select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
                    else run end as word
        from checked),
    w as (select word, count(*) as n from damaged where length(word) >= 7 group by word having count(*) >= 2),
    place as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
    gap as (select word, n, i, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) as open, substr(word, 1, i - 1) || substr(word, i + 1) as short from place),
    near as (
        select a.word, b.word as other, b.n as m from gap a join gap b on a.open = b.open and a.word <> b.word
        union
        select w.word, g.word, g.n from gap g join w on g.short = w.word
        union
        select g.word, w.word, w.n from gap g join w on g.short = w.word),
    best as (
        select word, count(*) as n_near, (array_agg(other order by m desc, other))[1] as other, max(m) as m from near group by word),
    formed as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form,
               case when m >= 10 * n then m end as form_n
        from w left join best using (word)),
    follow as (
        select word, word as last, 0 as steps from formed
        union all
        select f.word, formed.form, steps + 1 from follow f join formed on f.last = formed.word where formed.form is not null),
    ends as (select word, arg_max(last, steps) as root from follow group by word)
    select word, form, root, n, n_near, form_n from formed join ends using (word)
    """,
)
def spelling_variants(read) -> DataFrame:
    runs = spelling.runs(read("documents"), 7)
    words = runs.select(spelling.damaged(F.col("run"), F.col("doc_id")).alias("word"))
    return spelling.variants(spelling.word_counts(words)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_private_spans")
def private_spans(read) -> DataFrame:
    found = privacy.find(read("documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{name}") for kind, name in enumerate(privacy.KINDS[:4])],
        F.sha2(privacy.listed(base), 256).alias("base_sha256"),
        privacy.listed(F.col("spans")).alias("spans"),
    )
