"""Work queue, vocabulary, reply gates, escalation and cost rollups."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from registry.base import query
from upswell.operators import canon, rollups, routing, upserts
from upswell.plans.canon_run import normalize_growing, score_batches

WEEK = dt.date(2024, 1, 15)
CAP = 300

# ---- SQL of the ladder --------------------------------------------------------
_USES = """
    select t.id, t.name, count(st.tag_id) as uses
    from {tags} t left join {song_tags} st on st.tag_id = t.id
    where t.canon_status in ('pending', 'demoted') group by t.id, t.name"""
_WORK = """
    select (row_number() over (order by uses desc, id) - 1) // 20 as batch_no,
           cast((row_number() over (order by uses desc, id) - 1) % 20 + 1 as int) as pos, id, name, uses
    from {uses}"""
# What the made-up model proposes for a part, and how sure it is.
_ITEM = """
    select w.batch_no, w.pos, w.id, w.name, p_brand, p_type = 'LARGE' as is_new,
           case p_type when 'PROMO' then ' ' when 'LARGE' then concat('New-', p_brand)
                when 'ECONOMY' then concat('Odd-', p_brand) else p_brand end as canonical,
           (p_size % 10) / 10.0 as sure,
           case p_size % 10 when 3 then 0.85 when 4 then 0.5 when 8 then 0.9 else 0.8 end as flash_sure
    from {work} w join {part} on p_partkey = w.id"""
_KNOWN = """
    select distinct canon_name as term from {tags}
    where canon_status in ('canon_lite', 'canon_flash') and canon_name is not null"""
# The first reply of every third batch is cut off, the second of every fifth.
_LITE = """
    select i.*, batch_no % 15 <> 0 as batch_ok,
           case when batch_no % 3 <> 0 then sure::double else 0.95::double end as confidence
    from {item} i"""
_JUDGED = """
    select l.*, trim(canonical) <> '' as shape_ok, canonical in (from {known}) and not is_new as vocab_ok,
           confidence >= 0.8 as conf_ok
    from {lite} l"""
_ESCALATION = """
    select j.*, batch_ok and shape_ok and vocab_ok and conf_ok as passed,
           case when batch_ok then 21 - pos else pos end as turn
    from {judged} j"""
_CAPPED = """
    select id, row_number() over (order by batch_no, turn) as place,
           row_number() over (order by batch_no, turn) <= 300 as escalated
    from {escalation} where not passed"""
_RESULT = """
    select e.batch_no, e.pos, e.id,
           case when passed then 'canon_lite' when not c.escalated then 'pending'
                when e.batch_no % 7 <> 1 and trim(canonical) <> '' and flash_sure >= 0.8 then 'canon_flash'
                else 'demoted' end as status,
           case when passed then canonical
                when c.escalated and e.batch_no % 7 <> 1 and trim(canonical) <> '' and flash_sure >= 0.8
                then canonical end as canon_name,
           case when passed then confidence
                when c.escalated and e.batch_no % 7 <> 1 and trim(canonical) <> '' and flash_sure >= 0.8
                then flash_sure::double end as confidence,
           coalesce(not passed and c.escalated and e.batch_no % 7 <> 1 and trim(canonical) <> ''
             and flash_sure >= 0.8 and is_new, false) as registers_vocab,
           case when not passed and c.escalated and batch_ok and trim(canonical) <> '' then canonical end as lite_canon
    from {escalation} e left join {capped} c on c.id = e.id"""
STEPS = dict(
    uses=_USES, work=_WORK, item=_ITEM, known=_KNOWN, lite=_LITE, judged=_JUDGED,
    escalation=_ESCALATION, capped=_CAPPED, result=_RESULT,
)


# ---- the same inputs as Spark frames ------------------------------------------
def _work(v):
    return canon.full_queue(v.tags, v.song_tags)


def _item(v, work):
    return v.spark.sql(
        _ITEM.replace("0.85", "0.85D").replace("0.5 ", "0.5D ").replace("0.9 ", "0.9D ")
        .replace("0.8 end", "0.8D end").replace("/ 10.0", "/ 10.0D"),
        work=work, part=v.part,
    )


def _reply(items, confidence: str, order):
    """One JSON reply per batch; a batch has twenty items."""
    entry = F.struct(
        order.alias("_turn"),
        F.struct("id", "canonical", F.col(confidence).alias("confidence"), "is_new").alias("i"),
    )
    listed = items.groupBy("batch_no").agg(F.array_sort(F.collect_list(entry))["i"].alias("items"))
    wrapped = F.concat(F.lit("```json\n"), F.to_json(F.struct("items")), F.lit("\n```"))
    even = F.col("batch_no") % 2 == 0
    return listed.select("batch_no", F.when(even, wrapped).otherwise(F.to_json("items")).alias("raw"))


def _lite(v, work):
    """Replies of both attempts; the second is surer than the first."""
    items = _item(v, work)
    first = _reply(items, "sure", -F.col("pos"))
    second = _reply(items.withColumn("again", F.lit(0.95)), "again", -F.col("pos"))

    def cut(every: int):
        broken = F.col("batch_no") % every == 0
        return F.when(broken, F.substring("raw", 1, 40)).otherwise(F.col("raw"))

    return first.select("batch_no", F.lit(1).alias("attempt"), cut(3).alias("raw")).unionByName(
        second.select("batch_no", F.lit(2).alias("attempt"), cut(5).alias("raw"))
    )


def _flash(v, work, capped):
    """Replies to what was escalated; those of some batches name a wrong id."""
    sent = capped.where("escalated").select("batch_no", "id")
    items = _item(v, work).join(sent, ["batch_no", "id"])
    wrong = F.when((F.col("batch_no") % 7 == 1) & (F.col("id") == F.col("_first")), F.lit(-1)).otherwise(F.col("id"))
    first = sent.groupBy("batch_no").agg(F.min("id").alias("_first"))
    return _reply(items.join(first, "batch_no").withColumn("id", wrong), "flash_sure", F.col("pos"))


def _capped(v, work):
    return routing.escalate(work, _lite(v, work), canon.vocabulary(v.tags), cap=CAP)


def _gated(v, work):
    return routing.gate_ids(routing.requested_ids(work), routing.parse_replies(_lite(v, work)))


def _valid(v):
    work = _work(v)
    return routing.first_valid(routing.requested_ids(work), _lite(v, work)).where("items is not null")


def _judged(v):
    return routing.gate_items(_valid(v), canon.vocabulary(v.tags))


def _results(v, outages=None):
    """What the ladder makes of the queue; the second tier answers what was sent to it."""
    work = _work(v)
    live = work if outages is None else routing.before_outage(work, outages)
    capped = _capped(v, live)
    results = routing.settle(live, capped, _flash(v, live, capped))
    return results if outages is None else results.unionByName(routing.deferred(work, outages))


# ---- queue and vocabulary ------------------------------------------------------
@query("k4_work_left_join", "select id, name, uses from {uses}", **STEPS)
def _(v):
    return canon.usage_counts(v.tags, v.song_tags)


@query("a6_usage_counts", "select id, uses from {uses}", **STEPS)
def _(v):
    return canon.usage_counts(v.tags, v.song_tags).select("id", "uses")


@query("w4_work_queue", "select batch_no, pos, id, name, uses from {work} order by uses desc, id limit 500", **STEPS)
def _(v):
    return canon.work_queue(v.tags, v.song_tags)


@query("a16_vocab", "select term from {known}", **STEPS)
def _(v):
    return canon.confirmed_terms(v.tags)


_SEED = ", ".join("'" + t.replace("'", "''") + "'" for t in canon.SEED_VOCAB)


@query("o1_vocab_union", f"select term from {{known}} union select unnest([{_SEED}]) as term", **STEPS)
def _(v):
    return canon.vocabulary(v.tags)


@query("j6_batch_payload", """
    select batch_no, concat('[', string_agg(concat('{"id":', cast(id as varchar), ',"name":"', name, '"}'), ','
                                            order by pos), ']') as payload
    from {work} group by batch_no""".replace('{"id"', '{{"id"').replace('"}', '"}}'), **STEPS)
def _(v):
    return canon.batch_payload(_work(v)).select("batch_no", "payload")


# ---- replies and gates ---------------------------------------------------------
@query("j2_parse_responses", """
    select batch_no, 1 as attempt, 21 - pos as pos, id, nullif(canonical, ' ') as canonical,
           sure::double as confidence, is_new
    from {sized} where batch_no % 3 <> 0
    union all
    select batch_no, 2, 21 - pos, id, nullif(canonical, ' '), 0.95::double, is_new
    from {sized} where batch_no % 5 <> 0""", **STEPS,
    sized="""
    select i.* replace (cast(20 - n + pos as int) as pos) from {item} i
    join (select batch_no, count(*) as n from {work} group by batch_no) b using (batch_no)""")
def _(v):
    parsed = routing.parse_replies(_lite(v, _work(v)))
    return parsed.select("batch_no", "attempt", F.explode("items").alias("i")).select("batch_no", "attempt", "i.*")


_ATTEMPTS = """
    select batch_no, 1 as attempt, batch_no % 3 <> 0 as ids_ok from {work} group by batch_no
    union all select batch_no, 2, batch_no % 5 <> 0 from {work} group by batch_no"""


@query("t1_gate_ids", _ATTEMPTS, **STEPS)
def _(v):
    return _gated(v, _work(v)).select("batch_no", "attempt", "ids_ok")


@query("o3_id_set_equality", """
    select attempt, count(*) as batches, count(*) filter (where ids_ok) as equal from {attempts} group by attempt""",
    **STEPS, attempts=_ATTEMPTS)
def _(v):
    return _gated(v, _work(v)).groupBy("attempt").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if("ids_ok").alias("equal")
    )


@query("t2_retry_once", """
    select batch_no, count(*) as items, max(confidence) as top_confidence
    from {lite} where batch_ok group by batch_no""", **STEPS)
def _(v):
    return _valid(v).select(
        "batch_no",
        F.size("items").cast("bigint").alias("items"),
        F.array_max(F.transform("items", lambda i: i["confidence"])).alias("top_confidence"),
    )


@query("t3_gate_shape", "select batch_no, id, shape_ok from {judged} where batch_ok", **STEPS)
def _(v):
    return _judged(v).select("batch_no", "id", "shape_ok")


@query("t4_gate_vocab", "select batch_no, id, vocab_ok from {judged} where batch_ok", **STEPS)
def _(v):
    return _judged(v).select("batch_no", "id", "vocab_ok")


@query("t5_gate_conf", "select batch_no, id, conf_ok from {judged} where batch_ok", **STEPS)
def _(v):
    return _judged(v).select("batch_no", "id", "conf_ok")


@query("t6_cap_escalation", "select id, escalated from {capped}", **STEPS)
def _(v):
    return _capped(v, _work(v)).where("escalated is not null").select("id", "escalated")


@query("w9_run_cap", """
    select batch_no, cast(300 - used as int) as granted from (
      select batch_no, coalesce(sum(n) over (order by batch_no rows between unbounded preceding and 1 preceding), 0) as used
      from (select batch_no, count(*) as n from {escalation} where not passed group by batch_no) a) b
    where used < 300""", **STEPS)
def _(v):
    work = _work(v)
    cands = routing.candidates(work, _lite(v, work), canon.vocabulary(v.tags))
    return routing.escalation_budget(cands, CAP)


@query("t7_accept_flash", """
    select r.id, r.status = 'canon_flash' as accepted from {result} r join {capped} c on c.id = r.id
    where c.escalated""", **STEPS)
def _(v):
    work = _work(v)
    capped = _capped(v, work)
    judged = routing.accept_flash(capped, _flash(v, work, capped))
    return judged.select("id", F.col("flash").isNotNull().alias("accepted"))


@query("t8_final_status", "select * from {result}", **STEPS)
def _(v):
    return _results(v)


@query("t9_escalation_log", """
    select 'run-1' as run, id, status, canon_name, lite_canon from {result}
    where status in ('canon_flash', 'demoted')""", **STEPS)
def _(v):
    return routing.escalation_log(_results(v), F.lit("run-1"))


def _coins(model: str, payload: str, vocab: str) -> str:
    """A stand-in for the model: one of many terms, new unless the vocabulary has it."""
    known = set(json.loads(vocab))
    items = []
    for item in json.loads(payload):
        term = f"coined {item['id'] % 1009}"
        items.append({"id": item["id"], "canonical": term, "confidence": 0.9, "is_new": term not in known})
    return json.dumps({"items": items})


_COINED = """
    select id, batch_no, pos, id % 1009 as k, batch_no = min(batch_no) over (partition by id % 1009) as first
    from {work}"""
_TRIED = """
    select *, count(case when first then 1 end) over (order by batch_no, pos) <= 300 as within from {coined}"""
_JUDGED_COINS = """
    select *, first and within as confirmed,
           min(case when first and within then batch_no end) over (partition by k) < batch_no as known
    from {tried}"""


@query("t10_vocab_growth", """
    select id, batch_no, case when confirmed or known then concat('coined ', k) end as canon_name,
           case when confirmed then 'canon_flash' when known then 'canon_lite' else 'pending' end as status
    from {judged_coins}""", **STEPS, coined=_COINED, tried=_TRIED, judged_coins=_JUDGED_COINS)
def _(v):
    # The whole queue in its strict order: a term that the second tier confirmed is known
    # to all later batches, until the budget of the run is spent.
    results, _ = normalize_growing(_work(v), canon.vocabulary(v.tags), _coins, cap=CAP)
    return results.select("id", "batch_no", "canon_name", "status")


@query("t11_defer_outage", """
    select batch_no, pos, id, case when batch_no < 5 then status else 'pending' end as status,
           case when batch_no < 5 then canon_name end as canon_name from {result}""", **STEPS)
def _(v):
    # The service failed on the ninth and fifth batch of the queue.
    outages = _work(v).where("batch_no in (5, 9)").select("batch_no").distinct()
    return _results(v, outages).select("batch_no", "pos", "id", "status", "canon_name")


def _shout(model: str, payload: str, vocab: str) -> str:
    """A stand-in for the model: proposes every name in capitals."""
    items = [{"id": i["id"], "canonical": i["name"].upper(), "confidence": 1} for i in json.loads(payload)]
    return json.dumps({"items": items})


@query("t12_score_batches", "select batch_no, id, upper(name) as canonical from {work}", **STEPS)
def _(v):
    batched = canon.batch_payload(_work(v))
    replies = score_batches(batched, _shout, "tier-1", canon.vocabulary_json(canon.vocabulary(v.tags)), 1)
    items = routing.parse_replies(replies).select("batch_no", F.explode("items").alias("i"))
    return items.select("batch_no", "i.id", "i.canonical")


@query("u11_canon_apply", """
    select t.id, case when r.status in ('canon_lite', 'canon_flash') then r.canon_name else t.canon_name end as canon_name,
           cast(case when r.status in ('canon_lite', 'canon_flash') then r.confidence else t.canon_confidence end as float)
             as canon_confidence,
           case when r.status in ('canon_lite', 'canon_flash', 'demoted') then r.status else t.canon_status end as canon_status
    from {tags} t left join {result} r on r.id = t.id""", **STEPS)
def _(v):
    return upserts.canon_apply(v.tags, _results(v)).select("id", "canon_name", "canon_confidence", "canon_status")


# ---- rollups -------------------------------------------------------------------
@query("a7_status_counts", "select canon_status, count(*) as n from {tags} group by canon_status")
def _(v):
    return rollups.status_counts(v.tags)


@query("a8_status_rollup", """
    select total, lite, flash, demoted, pending, round_even((lite + flash)::double / total, 3) as cache_hit_rate,
           pending as pending_backlog, round_even(flash::double / (lite + flash), 3) as escalation_rate,
           round_even(demoted::double / (lite + flash + demoted), 3) as demotion_rate
    from (select count(*) as total, count(*) filter (where canon_status = 'canon_lite') as lite,
                 count(*) filter (where canon_status = 'canon_flash') as flash,
                 count(*) filter (where canon_status = 'demoted') as demoted,
                 count(*) filter (where canon_status = 'pending') as pending from {tags}) c""")
def _(v):
    return rollups.status_rollup(v.tags)


@query("a9_span_rollup", """
    select model, model not in ('user', 'assistant') as off_tier, count(*) as calls,
           cast(case when model in ('user', 'assistant') then sum(tokens) end as bigint) as tokens,
           case model when 'user' then round_even(100.0::double * count(*) / 1500, 1)
                      when 'assistant' then round_even(100.0::double * count(*) / 250, 1) end as quota_pct
    from {spans} group by model""")
def _(v):
    return rollups.span_rollup(v.spans, {"user": 1500, "assistant": 250})


@query("a10_agreement_rate", """
    select count(*) as escalation_pairs, count(*) filter (where canon_name = lite_canon) as agreed,
           case when count(*) > 0 then
             round_even(count(*) filter (where canon_name = lite_canon)::double / count(*), 3) end as agreement_rate
    from {result} where status = 'canon_flash' and lite_canon is not null""", **STEPS)
def _(v):
    return rollups.agreement_rate(routing.escalation_log(_results(v), F.lit("run-1")))


@query("a11_fetch_sanity", """
    select (select count(*) from {esongs}) as songs, count(*) as week_metrics,
           count(distinct metric_date) as week_days, cast(null as varchar) as halted
    from {emetrics} where metric_date >= date '2024-01-15' and metric_date < date '2024-01-22'""")
def _(v):
    return rollups.fetch_sanity(v.esongs, v.emetrics, WEEK)


@query("a14_run_summary", """
    select count(*) filter (where status = 'canon_lite') as canon_lite,
           count(*) filter (where status = 'canon_flash') as canon_flash,
           count(*) filter (where status = 'demoted') as demoted,
           count(*) filter (where status = 'pending') as pending, count(*) as total
    from {result}""", **STEPS)
def _(v):
    return rollups.run_summary(_results(v))
