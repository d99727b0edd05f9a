"""Filters, keyed lookups, counts, pages."""

from pyspark.sql import functions as F

from vetline.feeds import ctes, frame
from vetline.functions import text
from vetline.operators import aggregates, filters, joins, sets, topk
from vetline.registry.core import query, rnd

V = "coalesce(nullif(upper(role), ''), 'OFFICER')"


@query("case_by_id", "FP-1", ctes("screenings") + "select id, status, risk_score from screenings where id = 77")
def _(spark, sf_dir):
    return filters.by_id(frame(spark, sf_dir, "screenings"), "id", 77).select("id", "status", "risk_score")


@query("cases_under_review", "FP-2 AG-3", ctes("screenings") + """
select document_type, count(*) n from screenings where status in ('MANUAL_REVIEW_REQUIRED','MANUAL_REVIEW') group by 1""")
def _(spark, sf_dir):
    return filters.with_status(frame(spark, sf_dir, "screenings"), filters.REVIEW_STATUSES).groupBy(
        "document_type").agg(F.count(F.lit(1)).alias("n"))


@query("active_checkpoints", "FP-3", ctes("checkpoints") + "select id, name from checkpoints where is_active")
def _(spark, sf_dir):
    return filters.active(frame(spark, sf_dir, "checkpoints")).select("id", "name")


@query("visible_cases_for_officer", "FP-4", ctes("screenings") +
       "select id, checkpoint_id from screenings where checkpoint_id = 'CP-07'")
def _(spark, sf_dir):
    return filters.scope_for(frame(spark, sf_dir, "screenings"), "officer", " CP-07").select("id", "checkpoint_id")


@query("visible_case_counts", "FP-4", ctes("screenings", "users") + f"""
select u.id user_id, case when {V} = 'OFFICER' and trim(u.checkpoint_id) <> ''
  then (select count(*) from screenings s where s.checkpoint_id = trim(u.checkpoint_id))
  else (select count(*) from screenings) end visible from users u""")
def _(spark, sf_dir):
    return filters.visible_counts(frame(spark, sf_dir, "screenings"), frame(spark, sf_dir, "users"))


@query("access_denied_events", "FP-5", ctes("requests", "users", "screenings") + f"""
select user_id, screening_id, 'ACCESS_DENIED' event_type, {V} || ':' || username actor,
       trim(u.checkpoint_id) user_station, trim(s.checkpoint_id) row_station
from requests r join users u on u.id = r.user_id join screenings s on s.id = r.screening_id
where {V} not in ('SUPERVISOR','ADMIN') and trim(u.checkpoint_id) <> '' and trim(s.checkpoint_id) <> ''
  and trim(u.checkpoint_id) <> trim(s.checkpoint_id)""")
def _(spark, sf_dir):
    return filters.access_decisions(frame(spark, sf_dir, "requests").drop("l_linenumber"), frame(spark, sf_dir, "users"),
                                    frame(spark, sf_dir, "screenings"))


@query("granted_permissions", "FP-6", ctes("users") + f"""
, p(permission, level) as (values ('screening:create',0),('screening:view',0),('media:access',0),('report:download',0),
 ('audit:view',0),('audit:verify',0),('blockchain:anchor',0),('blockchain:verify',0),('watchlist:view',0),
 ('analytics:view',0),('case:review',1),('watchlist:manage',1),('system:admin',2))
select id user_id, permission from users, p
where level <= case {V} when 'ADMIN' then 2 when 'SUPERVISOR' then 1 else 0 end""")
def _(spark, sf_dir):
    return filters.permissions(frame(spark, sf_dir, "users"))


@query("watchlist_search", "FP-7", ctes("watchlist") + """
select document_id, full_name from watchlist
where contains(lower(document_id), 'r#0000000') or contains(lower(full_name), 'r#0000000')""")
def _(spark, sf_dir):
    wl = frame(spark, sf_dir, "watchlist")
    return filters.search(wl, "R#0000000", ["document_id", "full_name"]).select("document_id", "full_name")


_IDS = ("case when l_linenumber = 1 then 'a' when l_linenumber = 2 then concat('CASE 2026-', cast(l_orderkey as string)) "
        "else concat(' CASE-2026_', cast(l_orderkey as string)) end")


@query("identifier_syntax", "FP-8", f"""
select valid, count(*) n from (select regexp_full_match(trim({_IDS}), '[A-Za-z0-9_-]{{3,64}}') valid from lineitem)
group by 1""")
def _(spark, sf_dir):
    ids = frame(spark, sf_dir, "lineitem").select(F.expr(_IDS).alias("case_id"))
    return ids.groupBy(text.valid_identifier(F.col("case_id")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("risk_level_quarantine", "FP-9", ctes("screenings") + """
select id, risk_band from screenings where risk_band not in ('LOW','MEDIUM','HIGH','CRITICAL')""")
def _(spark, sf_dir):
    df = frame(spark, sf_dir, "screenings")
    return filters.quarantine(df, filters.in_domain(F.col("risk_band"), filters.RISK_LEVELS))[1].select("id", "risk_band")


@query("watchlist_ingest", "FP-14 SF-13", ctes("watchlist_raw") + """
select * from (select upper(regexp_replace(document_id, '[^A-Za-z0-9_-]', '', 'g')) document_id,
  substr(upper(trim(full_name)),1,100) full_name, substr(upper(trim(nationality)),1,10) nationality,
  substr(trim(reason),1,500) reason, substr(upper(trim(risk_category)),1,30) risk_category,
  substr(upper(trim(status)),1,20) status from watchlist_raw)
qualify row_number() over (partition by document_id order by full_name, nationality, reason, risk_category, status) = 1""")
def _(spark, sf_dir):
    return filters.clean_watchlist(frame(spark, sf_dir, "watchlist_raw"))


@query("sensitive_column_report", "FP-15", """
select 'text' column_name, false banned_name, count(*) filter (length(text) > 256) too_long from documents
union all select 'lang', false, count(*) filter (length(lang) > 256) from documents
union all select 'source', false, count(*) filter (length(source) > 256) from documents
union all select 'doc_number', true, count(*) filter (length(cast(doc_id as varchar)) > 256) from documents""")
def _(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").withColumn("doc_number", F.col("doc_id").cast("string"))
    return filters.minimised_report(docs)


@query("status_changes", "FP-17", ctes("screenings", "status_updates") + """
, u as (select case_id, seq, upper(trim(status)) new_status from status_updates
  where upper(trim(status)) in ('CLEARED','MANUAL_REVIEW_REQUIRED','ESCALATED','SUSPENDED'))
, l as (select *, lag(new_status) over (partition by case_id order by seq) before from u)
select id, seq, coalesce(before, s.status) old_status, coalesce(new_status, s.status) new_status, l.case_id is not null changed
from screenings s left join l on l.case_id = s.id""")
def _(spark, sf_dir):
    return filters.apply_status(frame(spark, sf_dir, "screenings"), frame(spark, sf_dir, "status_updates"))


# -- joins ---------------------------------------------------------------------

@query("watchlist_hits", "JN-1", ctes("passports", "watchlist") + """
select p.doc_id, document_id document_number, w.full_name listed_name, risk_category
from passports p join watchlist w on upper(replace(p.passport_number, ' ', '')) = w.document_id""")
def _(spark, sf_dir):
    return joins.watchlist_hits(frame(spark, sf_dir, "passports"), frame(spark, sf_dir, "watchlist"),
                                "passport_number").select("doc_id", "document_number", "listed_name", "risk_category")


_CHILDREN = ["extracted_fields", "findings", "tamper_findings", "face_results", "identity_matches", "case_events", "case_anchors"]


@query("case_dossier", "JN-2", ctes("screenings", *_CHILDREN) + """
, c as (select screening_id case_id, 'extracted_fields' section, seq position, field_name code, visual_value detail, confidence score, null::timestamp "at" from extracted_fields
 union all select screening_id, 'findings', seq, rule_id, severity, null, null from findings
 union all select screening_id, 'tamper_findings', seq, technique, severity, score, null from tamper_findings
 union all select screening_id, 'face_results', 0, verification_result, appearance_level, similarity_score, null from face_results
 union all select screening_id, 'identity_matches', 0, matched_document_id, matched_name, similarity, null from identity_matches
 union all select screening_id, 'audit_events', event_id, event_type, actor, null, ts from case_events
 union all select screening_id, 'anchors', 0, status, transaction_id, null, null from case_anchors)
, d as (select id case_id, 'screening' section, 0 position, status code, document_type detail, risk_score score, created_at::timestamp "at" from screenings
 union all select * from c where case_id in (select id from screenings))
select case_id, section, cast(position as bigint) position, code, detail, cast(score as double) score,
 strftime("at", '%Y-%m-%d %H:%M:%S') "at" from d""")
def _(spark, sf_dir):
    fields, findings, tamper, faces, matches, events, anchors = (frame(spark, sf_dir, n) for n in _CHILDREN)
    col, section = F.col, joins.section
    return joins.dossier(
        section("screening", frame(spark, sf_dir, "screenings"), "id", code=col("status"), detail=col("document_type"),
                score=col("risk_score"), at=col("created_at")),
        [section("extracted_fields", fields, position=col("seq"), code=col("field_name"), detail=col("visual_value"), score=col("confidence")),
         section("findings", findings, position=col("seq"), code=col("rule_id"), detail=col("severity")),
         section("tamper_findings", tamper, position=col("seq"), code=col("technique"), detail=col("severity"), score=col("score")),
         section("face_results", faces, code=col("verification_result"), detail=col("appearance_level"), score=col("similarity_score")),
         section("identity_matches", matches, code=col("matched_document_id"), detail=col("matched_name"), score=col("similarity")),
         section("audit_events", events, position=col("event_id"), code=col("event_type"), detail=col("actor"), at=col("ts")),
         section("anchors", anchors, code=col("status"), detail=col("transaction_id"))]
    ).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


_EVIDENCE = """, registry as (select page_id screening_id,
   case when page_id % 7 = 3 then sha256(url) else sha256(html) end document_hash,
   case when page_id % 5 = 2 then sha256(html) else sha256(url) end result_hash from pages where length(url) > 30),
 evidence as (select page_id screening_id, upper(sha256(html)) || ' ' document_hash, sha256(url) result_hash from pages)"""


@query("digest_verification", "JN-10", "with x as (select 1)" + _EVIDENCE + """
select e.screening_id, coalesce(r.document_hash = lower(trim(e.document_hash)), false) document_hash_matches,
 coalesce(r.result_hash = e.result_hash, false) result_hash_matches,
 case when r.screening_id is null then 'NOT_ANCHORED'
  when r.document_hash = lower(trim(e.document_hash)) and r.result_hash = e.result_hash then 'VERIFIED'
  when r.document_hash = lower(trim(e.document_hash)) then 'RESULT_MISMATCH'
  when r.result_hash = e.result_hash then 'DOCUMENT_MISMATCH' else 'BOTH_MISMATCH' end outcome
from evidence e left join registry r using (screening_id)""")
def _(spark, sf_dir):
    pages = frame(spark, sf_dir, "pages").withColumnRenamed("page_id", "screening_id")
    html, url = F.sha2("html", 256), F.sha2("url", 256)
    evidence = pages.select("screening_id", F.concat(F.upper(html), F.lit(" ")).alias("document_hash"),
                            url.alias("result_hash"))
    registry = pages.filter(F.length("url") > 30).select(
        "screening_id", F.when(F.col("screening_id") % 7 == 3, url).otherwise(html).alias("document_hash"),
        F.when(F.col("screening_id") % 5 == 2, html).otherwise(url).alias("result_hash"))
    return joins.verify_digests(evidence, registry, "screening_id")


@query("cases_without_findings", "JN-11", ctes("screenings", "findings") + """
select id from screenings s where not exists (select 1 from findings f where f.screening_id = s.id)""")
def _(spark, sf_dir):
    return joins.unanchored(frame(spark, sf_dir, "screenings"), frame(spark, sf_dir, "findings"), "id",
                            "screening_id").select("id")


@query("missing_document_kinds", "JN-12", ctes("entity_rows") + """
, kinds(missing_kind) as (values ('PASSPORT'),('VISA'),('VISA_VARIANTS'))
select entity, missing_kind from (select distinct entity from entity_rows) e, kinds
where not exists (select 1 from entity_rows r where r.entity = e.entity and r.kind = missing_kind)""")
def _(spark, sf_dir):
    return joins.missing_kinds(frame(spark, sf_dir, "entity_rows"), "entity", "kind",
                               ["PASSPORT", "VISA", "VISA_VARIANTS"])


@query("exact_duplicates", "JN-14 WN-8", """
select doc_id, sha256(text) digest, row_number() over w > 1 is_duplicate,
  case when row_number() over w > 1 then first_value(doc_id) over w end duplicate_of
from documents window w as (partition by sha256(text) order by source, doc_id)""")
def _(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return joins.first_seen(docs, "digest", ["source", "doc_id"]).drop("source")


@query("distinct_parents", "SO-4", """
select sha256(text) digest, arg_min(doc_id, doc_id) doc_id, arg_min(source, doc_id) source from documents group by 1""")
def _(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return joins.distinct_by(docs, "digest", ["doc_id"])


@query("operator_attribution", "JN-15", ctes("screenings", "users") + """
select s.id, coalesce(u.username, 'SYSTEM') operator_name from screenings s left join users u on u.id = s.operator_id""")
def _(spark, sf_dir):
    return joins.with_operator(frame(spark, sf_dir, "screenings"), frame(spark, sf_dir, "users")).select(
        "id", "operator_name")


@query("station_binding_violations", "JN-16", ctes("logins", "users", "checkpoints") + """
, j as (select l.*, u.username uu, u.is_active ua, trim(u.checkpoint_id) us, c.id cid, c.is_active ca, c.username cu,
          nullif(trim(claimed_checkpoint), '') claim
  from logins l left join users u on u.username = trim(l.username)
  left join checkpoints c on c.id = nullif(trim(claimed_checkpoint), ''))
select * from (select login_id, username, claimed_checkpoint, case when uu is null then 'Invalid credentials'
  when not ua then 'User account deactivated'
  when claim is not null and (cid is null or not ca) then 'Invalid checkpoint credentials'
  when claim is not null and us <> cid and uu <> cu then 'Checkpoint-user binding mismatch' end reason from j)
where reason is not null""")
def _(spark, sf_dir):
    return joins.binding_violations(frame(spark, sf_dir, "logins"), frame(spark, sf_dir, "users"),
                                    frame(spark, sf_dir, "checkpoints"))


@query("append_once", "IO-9", ctes("requests") + """
select screening_id, arg_min(user_id, (l_linenumber, user_id)) user_id,
       min(l_linenumber) l_linenumber
from (select screening_id, user_id, l_linenumber from requests) r
where not exists (select 1 from customer c where c.c_custkey = r.screening_id) group by 1""")
def _(spark, sf_dir):
    existing = frame(spark, sf_dir, "customer").select(F.col("c_custkey").alias("screening_id"))
    return joins.append_once(existing, frame(spark, sf_dir, "requests"), "screening_id", ["l_linenumber", "user_id"])


# -- aggregates ----------------------------------------------------------------

@query("operational_summary", "AG-1 AG-3 AG-4 AG-6", ctes("screenings") + f"""
select count(*) total_screenings,
 count(*) filter (status in ('MANUAL_REVIEW_REQUIRED','MANUAL_REVIEW')) manual_reviews_required,
 coalesce({rnd('avg(execution_latency_ms)', 1)}, 0) average_latency_ms,
 {rnd("count(*) filter (status in ('MANUAL_REVIEW_REQUIRED','MANUAL_REVIEW')) / greatest(count(*),1) * 100", 1)}
   manual_review_rate_pct from screenings""")
def _(spark, sf_dir):
    return aggregates.summary(frame(spark, sf_dir, "screenings"))


@query("case_total", "AG-1", "select count(*) total from orders")
def _(spark, sf_dir):
    return aggregates.total(frame(spark, sf_dir, "screenings"))


@query("risk_band_counts", "AG-2", ctes("screenings") + """
select band, count(id) count from (values ('LOW'),('MEDIUM'),('HIGH'),('CRITICAL')) b(band)
left join screenings on risk_band = band group by 1""")
def _(spark, sf_dir):
    return aggregates.band_counts(frame(spark, sf_dir, "screenings"))


@query("tamper_technique_counts", "AG-5", ctes("tamper_findings") +
       "select technique, count(*) count from tamper_findings group by 1")
def _(spark, sf_dir):
    return aggregates.counts_by(frame(spark, sf_dir, "tamper_findings"), "technique")


@query("document_type_distribution", "AG-7", ctes("screenings") + f"""
select document_type, count(*) count, {rnd('count(*) / (select count(*) from screenings) * 100', 1)} share_pct
from screenings group by 1""")
def _(spark, sf_dir):
    return aggregates.distribution(frame(spark, sf_dir, "screenings"), "document_type")


@query("stage_stats", "AG-8", f"""
select event_type, {rnd('avg(value)', 4)} mean, {rnd('stddev_pop(value)', 4)} std from events group by 1""")
def _(spark, sf_dir):
    return aggregates.stage_stats(frame(spark, sf_dir, "events"), "event_type", "value")


@query("stage_share", "AG-21", f"""
select event_type, {rnd('sum(value)', 2)} "cost", {rnd('sum(value) / (select sum(value) from events) * 100', 1)} share_pct
from events group by 1""")
def _(spark, sf_dir):
    return aggregates.stage_share(frame(spark, sf_dir, "events"), "event_type", "value")


@query("slowest_stages", "WN-10", f"""
select event_type, {rnd('sum(value)', 2)} "cost", cast(row_number() over (order by {rnd('sum(value)', 2)} desc, event_type) as int) rank
from events group by 1 order by rank limit 5""")
def _(spark, sf_dir):
    return aggregates.rank_stages(frame(spark, sf_dir, "events"), "event_type", "value")


@query("tamper_detection_eval", "AG-9", f"""
with c as (select count(*) filter (quality = 0 and d) tp, count(*) filter (quality <> 0 and d) fp,
   count(*) filter (quality = 0 and not d) fn, count(*) filter (quality <> 0 and not d) tn
 from (select quality, length(text) < 900 d from labels join documents using (doc_id))),
pr as (select *, tp / greatest(tp + fp, 1) p, tp / greatest(tp + fn, 1) r from c)
select tp, fp, fn, tn, {rnd('p', 3)} "precision", {rnd('r', 3)} recall, {rnd('2*p*r/greatest(p+r, 1e-6)', 3)} f1
from pr""")
def _(spark, sf_dir):
    rows = frame(spark, sf_dir, "labels").join(frame(spark, sf_dir, "documents"), "doc_id")
    return aggregates.binary_eval(rows, F.col("quality") == 0, F.length("text") < 900)


@query("verification_pair_rates", "AG-11", ctes("pair_verdicts") + f"""
, c as (select count(*) filter (same_person and verdict <> 'MISMATCH') true_matches,
 count(*) filter (same_person and verdict = 'MISMATCH') false_rejects,
 count(*) filter (not same_person and verdict = 'MISMATCH') true_rejections,
 count(*) filter (not same_person and verdict = 'MATCH') false_accepts from pair_verdicts)
select *, {rnd('true_matches / greatest(true_matches + false_rejects, 1) * 100', 1)} match_rate,
 {rnd('true_rejections / greatest(true_rejections + false_accepts, 1) * 100', 1)} rejection_rate from c""")
def _(spark, sf_dir):
    return aggregates.pair_rates(frame(spark, sf_dir, "pair_verdicts"), F.col("same_person"), "verdict")


@query("tamper_summary", "AG-17", ctes("tamper_findings") + """
select screening_id, max(score) composite_tamper_score, count(*) findings_count from tamper_findings group by 1""")
def _(spark, sf_dir):
    return aggregates.tamper_summary(frame(spark, sf_dir, "tamper_findings"))


@query("top_rule_failures", "TK-1", ctes("findings") + """
select rule_id, count(*) count from findings group by 1 order by 2 desc, 1 limit 5""")
def _(spark, sf_dir):
    return topk.top_groups(frame(spark, sf_dir, "findings"), "rule_id")


@query("newest_cases_page", "TK-2", ctes("screenings") + """
select id, created_at from screenings order by created_at desc, id desc limit 100 offset 40""")
def _(spark, sf_dir):
    return topk.page(frame(spark, sf_dir, "screenings"), 500, 40).select("id", "created_at")


@query("watchlist_head", "TK-3", ctes("watchlist") + "select document_id, status from watchlist order by 1 limit 50")
def _(spark, sf_dir):
    return topk.head(frame(spark, sf_dir, "watchlist"), 50, "document_id").select("document_id", "status")


@query("all_findings", "SO-1", ctes("findings", "tamper_findings") + """
select screening_id, kind, severity, count(*) n from (
 select screening_id, 'VALIDATION' kind, severity from findings union all
 select screening_id, 'TAMPER', severity from tamper_findings) group by all""")
def _(spark, sf_dir):
    both = sets.union_all(
        frame(spark, sf_dir, "findings").select("screening_id", F.lit("VALIDATION").alias("kind"), "severity"),
        frame(spark, sf_dir, "tamper_findings").select("screening_id", F.lit("TAMPER").alias("kind"), "severity"))
    return both.groupBy("screening_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))
