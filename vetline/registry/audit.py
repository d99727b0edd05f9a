"""Audit chains, throttle and digests."""

from pyspark.sql import functions as F

from vetline.feeds import ctes, frame
from vetline.functions import digest
from vetline.operators import audit, folds
from vetline.operators.topk import best_row
from vetline.registry.core import query
from vetline.session import stored

GENESIS = digest.GENESIS

_CHAIN_SQL = f"""
src as (
  select *, sha256(payload) payload_hash, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') t,
         row_number() over (partition by chain_id order by id) rn
  from audit_source),
chain as (
  select src.*, '{GENESIS}' previous_hash,
         sha256(concat_ws('|', chain_id, '{GENESIS}', t, actor, event_type, payload_hash)) event_hash
  from src where rn = 1
  union all
  select s.*, c.event_hash, sha256(concat_ws('|', s.chain_id, c.event_hash, s.t, s.actor, s.event_type, s.payload_hash))
  from chain c join src s on s.chain_id = c.chain_id and s.rn = c.rn + 1),
log as (
  select chain_id, id, ts, actor, event_type, event_hash, rn,
         case when id % 101 = 7 then sha256(payload_hash) else payload_hash end payload_hash,
         case when id % 103 = 5 then sha256(previous_hash) else previous_hash end previous_hash
  from chain)"""
_WITH_CHAIN = ctes("audit_source").replace("with ", "with recursive ", 1) + "," + _CHAIN_SQL


def _source(spark, sf_dir):
    return frame(spark, sf_dir, "audit_source")


def _log(spark, sf_dir):
    """A stored, chained log with planted faults: some payload hashes and some links altered. What verifies it reads
    the table, as of any log."""
    chain = stored(folds.build_chain(_source(spark, sf_dir)), "log")
    return chain.withColumns({
        "payload_hash": F.when(F.col("id") % 101 == 7, F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash")),
        "previous_hash": F.when(F.col("id") % 103 == 5, F.sha2("previous_hash", 256)).otherwise(
            F.col("previous_hash"))})


@query("audit_chain_build", "WN-12 SA-1 SD-10", _WITH_CHAIN + """
select chain_id, id, payload_hash, previous_hash, event_hash from chain""")
def _(spark, sf_dir):
    return folds.build_chain(_source(spark, sf_dir)).select(
        "chain_id", "id", "payload_hash", "previous_hash", "event_hash")


_LINKS_SQL = f""", links as (
  select *, previous_hash = coalesce(lag(event_hash) over (partition by chain_id order by id), '{GENESIS}') link_ok,
         event_hash = sha256(concat_ws('|', chain_id, previous_hash, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), actor,
                                       event_type, payload_hash)) hash_ok
  from log)"""


@query("audit_chain_links", "WN-2", _WITH_CHAIN + _LINKS_SQL + """
select chain_id, id, link_ok, hash_ok from links""")
def _(spark, sf_dir):
    return audit.chain_links(_log(spark, sf_dir)).select("chain_id", "id", "link_ok", "hash_ok")


@query("audit_chain_breaks", "WN-3", _WITH_CHAIN + _LINKS_SQL + """,
bad as (select *, row_number() over (partition by chain_id order by id) k from links where not link_ok or not hash_ok)
select n.chain_id, bad.id is null is_valid, total_events, bad.id tampered_at_event_id, bad.event_type,
       case when not link_ok then 'LINK' when not hash_ok then 'HASH' end fault
from (select chain_id, count(*) total_events from log group by 1) n
left join bad on bad.chain_id = n.chain_id and k = 1""")
def _(spark, sf_dir):
    return audit.first_break(_log(spark, sf_dir))


@query("audit_chain_summary", "WN-4", _WITH_CHAIN + f"""
select c.c_custkey chain_id, count(log.id) total_events,
       coalesce(arg_min(previous_hash, log.id), '{GENESIS}') genesis_hash,
       coalesce(arg_max(event_hash, log.id), '{GENESIS}') head_hash
from customer c left join log on log.chain_id = c.c_custkey group by 1""")
def _(spark, sf_dir):
    chains = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain_id"))
    return audit.chain_summary(_log(spark, sf_dir), chains)


@query("throttle_accepted_only", "WN-7", """
with recursive src as (
  select user_id, event_id, epoch_us(ts) t, row_number() over (partition by user_id order by event_id) rn from events),
walk as (
  select user_id, event_id, rn, true accepted, [t] kept from src where rn = 1
  union all
  select s.user_id, s.event_id, s.rn, len(k) < 3, case when len(k) < 3 then list_append(k, s.t) else k end
  from (select s.*, list_filter(w.kept, lambda x: x > s.t - 21600000000) k
        from walk w join src s on s.user_id = w.user_id and s.rn = w.rn + 1) s)
select user_id, event_id, accepted from walk""")
def _(spark, sf_dir):
    ev = frame(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return folds.throttle(ev, "user_id", "event_id", "ts", 3, 6 * 3600).select("user_id", "event_id", "accepted")


@query("payload_json_digest", "SA-2", """
select event_id, sha256('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k')
                        || ',"user_id":' || user_id || '}') digest from events""")
def _(spark, sf_dir):
    ev = frame(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return ev.select("event_id", digest.json_digest(
        {"user_id": F.col("user_id"), "event_type": F.col("event_type"), "k": F.col("p.k")}).alias("digest"))


@query("utc_second_text", "SD-10", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') at_text from events")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", digest.utc_seconds(F.col("ts")).alias("at_text"))


@query("latest_event_per_chain", "WN-1", """
select user_id chain_id, max(event_id) id, arg_max(event_type, event_id) event_type, arg_max(ts, event_id) ts from events group by 1""")
def _(spark, sf_dir):
    return best_row(_source(spark, sf_dir), ["chain_id"], F.col("id")).select("chain_id", "id", "event_type", "ts")
