"""Comparisons, rules, classification and risk."""

from pyspark.sql import functions as F

from vetline.feeds import ctes, frame
from vetline.functions import fields as fl
from vetline.functions import mrz
from vetline.operators import aggregates, joins, topk
from vetline.plans import classify, crosscheck as cc, screening as sc
from vetline.registry.core import AS_OF, query, rnd
from vetline.registry.pages import _LINES, _MRZ, _decoded
from vetline.registry.scalars import _nested_strip

# -- two readings ------------------------------------------------------------------------


def _ntext(c):
    """Normalised text: placeholders, labels, filler, blanks."""
    return (f"case when upper(trim({c})) in ('','UNKNOWN','NOT_AVAILABLE','NOT_FOUND','N/A','NONE','NULL') then null else "
            f"nullif(trim(regexp_replace({_nested_strip(f"replace(upper(trim({c})), '<', ' ')")}, '\\s+', ' ', 'g')), '') end")


def _ndate(c):
    return (f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {c} "
            f"when regexp_full_match({c}, '[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}}') then "
            f"{c}[7:10] || '-' || {c}[4:5] || '-' || {c}[1:2] else {c} end")


_DIFF = ctes("passports", "visas") + f"""
, w as (select doc_id, {_ntext("coalesce(p.name, p.given_names || ' ' || p.surname)")} pn,
   {_ntext("coalesce(v.name, v.given_names || ' ' || v.surname)")} vn, {_ndate('p.date_of_birth')} pb, {_ndate('v.date_of_birth')} vb,
   {_ntext('p.sex')} ps, {_ntext('v.sex')} vs, {_ntext('p.nationality')} pt, {_ntext('v.nationality')} vt,
   {_ntext('p.passport_number')} pp, {_ntext('v.passport_number')} vp, {_ndate('p.date_of_expiry')} pe, {_ndate('v.date_of_expiry')} ve
  from passports p full join visas v using (doc_id))
, raw as (select doc_id, 'name' field, pn a, vn b,
    pn = vn or list_sort(list_distinct(string_split(pn, ' '))) = list_sort(list_distinct(string_split(vn, ' '))) same from w
  union all select doc_id, 'date_of_birth', pb, vb, pb = vb from w
  union all select doc_id, 'sex', ps, vs, ps[1] = vs[1] from w
  union all select doc_id, 'nationality', pt, vt, pt = vt or (pt in ('IND','INDIAN') and vt in ('IND','INDIAN')) from w
  union all select doc_id, 'passport_number', pp, vp, pp = vp from w
  union all select doc_id, 'date_of_expiry', pe, ve, pe = ve from w)
, diff as (select doc_id, field, coalesce(a, 'UNKNOWN') reference_value, coalesce(b, 'UNKNOWN') observed_value,
   case when a is null or b is null then 'UNKNOWN' when same then 'MATCH' else 'MISMATCH' end status from raw)
, graded as (select *, case when status <> 'MISMATCH' then 'LOW' when field = 'passport_number' then 'CRITICAL' else 'HIGH' end severity
   from diff)
, summ as (select doc_id, count(*) total_fields, count(*) filter (status = 'MATCH') matched_fields,
   count(*) filter (status = 'MISMATCH') mismatched_fields, count(*) filter (status = 'UNKNOWN') unknown_fields,
   count(*) filter (status = 'MISMATCH' and field <> 'date_of_expiry') identity_mismatches,
   count(*) filter (status = 'MISMATCH' and field = 'date_of_expiry') control_mismatches,
   case when count(*) filter (status = 'MISMATCH' and field <> 'date_of_expiry') >= 2 or
      count(*) filter (severity = 'CRITICAL') > 0 then 'CRITICAL' when count(*) filter (status = 'MISMATCH') > 0 then 'HIGH'
      when count(*) filter (status = 'UNKNOWN') > 3 then 'MEDIUM' else 'LOW' end overall_severity,
   'Field Consistency: ' || count(*) filter (status = 'MATCH') || '/6 matched' consistency_label
  from graded group by 1)"""


def _diffs(spark, sf_dir):
    return cc.field_diff(frame(spark, sf_dir, "passports"), frame(spark, sf_dir, "visas"), "doc_id")


@query("field_differences", "JN-3 DC-15 SF-1 SF-14 SD-1 SO-3", _DIFF + " select * from graded")
def _(spark, sf_dir):
    return _diffs(spark, sf_dir)


@query("difference_summary", "AG-14 DC-15", _DIFF + " select * from summ")
def _(spark, sf_dir):
    return cc.diff_summary(_diffs(spark, sf_dir), "doc_id")


@query("passport_visa_linkage", "JN-4", _DIFF + """
, g as (select doc_id, count(*) filter (status = 'MATCH') m, count(*) filter (status = 'MISMATCH') x,
   count(*) filter (status = 'UNKNOWN') u, bool_or(field = 'passport_number' and status = 'MATCH') linked
  from diff where field <> 'date_of_expiry' group by 1)
select doc_id, cast(m as int) matched, cast(x as int) mismatched, cast(u as int) unknown, linked number_linked,
 case when x = 0 and m >= 3 and linked then 'MATCH' when x > 0 then 'MISMATCH' when m >= 1 then 'PARTIAL_MATCH'
   else 'UNABLE_TO_VERIFY' end linkage_status, case when doc_id % 5 = 0 then 'UNKNOWN' when (doc_id % 100) / 100.0 >= 0.65 then 'MATCH'
   when (doc_id % 100) / 100.0 >= 0.5 then 'BORDERLINE' else 'MISMATCH' end similarity_status from g""")
def _(spark, sf_dir):
    sim = F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 100) / 100.0)
    return cc.linkage(frame(spark, sf_dir, "passports"), frame(spark, sf_dir, "visas").withColumn("sim", sim), "doc_id", "sim")


@query("mutation_report", "JN-17", _DIFF.replace("passports as", "mutations as materialized (select c_custkey case_id, "
       "case c_custkey % 4 when 0 then 'FIELD_TAMPERING' when 1 then 'MRZ_TAMPERING' when 2 then 'DATE_TAMPERING' else "
       "'VISA_TAMPERING' end category, case c_custkey % 3 when 0 then 'name' when 1 then 'date_of_birth' else "
       "'passport_number' end target_field from customer), passports as", 1) + """
select m.case_id, category, target_field, case when mismatched_fields > 0 then 'Discrepancy detected in ' || target_field
  else 'Forensic anomaly flagged' end detected_change,
 case when mismatched_fields > 0 or m.case_id % 50 > 30 then 'DETECTED' else 'FLAGGED' end detection_status
from mutations m join summ s on s.doc_id = m.case_id""")
def _(spark, sf_dir):
    seen = cc.diff_summary(_diffs(spark, sf_dir), "doc_id").select(
        F.col("doc_id").alias("case_id"), "mismatched_fields", (F.col("doc_id") % 50).alias("risk_score"))
    return joins.mutation_report(frame(spark, sf_dir, "mutations"), seen)


# -- visual reading and zone -----------------------------------------------------------------

_PAIR = _MRZ.replace("with mrz_lines", "with visas as materialized (" + ctes("visas").split("materialized (", 1)[1] +
                     ", mrz_lines", 1) + f"""
, pair as (select d.doc_id, parsed, coalesce(all_checks_passed, false) zone_valid,
   case when v.doc_id % 3 = 0 then 'VISA' else 'PASSPORT' end v_document_type,
   case when parsed then replace(header[1:2], '<', '') end z_document_type,
   v.passport_number v_document_number, case when parsed then replace(num, '<', '') end z_document_number,
   v.surname v_surname, case when parsed then d.surname end z_surname,
   case when v.doc_id % 6 = 0 then 'Given names' else v.given_names end v_given_names, case when parsed then d.given_names end z_given_names,
   v.name v_full_name, case when parsed then case when d.given_names <> '' then trim(d.given_names || ' ' || d.surname) else d.surname end end z_full_name,
   v.nationality v_nationality, case when parsed then replace(data[11:13], '<', '') end z_nationality,
   v.date_of_birth v_date_of_birth, case when parsed then d.date_of_birth end z_date_of_birth,
   v.date_of_expiry v_date_of_expiry, case when parsed then d.date_of_expiry end z_date_of_expiry,
   v.sex v_sex, case when parsed then case data[sp] when 'M' then 'MALE' when 'F' then 'FEMALE' else 'UNSPECIFIED' end end z_sex
  from dec d join visas v on v.doc_id = d.doc_id)"""


def _pairs(spark, sf_dir):
    z = _decoded(spark, sf_dir).select(
        "doc_id", "parsed", F.col("all_checks_passed").alias("zone_valid"), F.col("document_code").alias("z_document_type"),
        *[F.col(c).alias(f"z_{c}") for c in cc.CANONICAL if c != "document_type"])
    v = frame(spark, sf_dir, "visas").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "VISA").otherwise("PASSPORT").alias("v_document_type"),
        F.col("passport_number").alias("v_document_number"), F.col("surname").alias("v_surname"),
        F.when(F.col("doc_id") % 6 == 0, "Given names").otherwise(F.col("given_names")).alias("v_given_names"),
        F.col("name").alias("v_full_name"), F.col("nationality").alias("v_nationality"),
        F.col("date_of_birth").alias("v_date_of_birth"), F.col("date_of_expiry").alias("v_date_of_expiry"),
        F.col("sex").alias("v_sex"))
    return z.join(v, "doc_id")


def _sdate(c):
    return (f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then strftime(try_cast({c} as date), '%Y-%m-%d') "
            f"when regexp_full_match({c}, '[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}}') then strftime(try_cast({c}[7:10] || '-' || {c}[4:5] || '-' || {c}[1:2] as date), '%Y-%m-%d') end")


def _toks(c, least=1):
    return f"list_filter(list_distinct(regexp_extract_all(upper({c}), '[A-Z]+')), lambda w: length(w) >= {least})"


def _long_pairs(value):
    return " union all ".join(
        f"select doc_id, zone_valid, parsed, '{f}' field, {value('v_' + f, f)} v, {value('z_' + f, f)} z from pair" for f in cc.CANONICAL)


_OVER = "len(list_intersect({a}, {b})) / greatest(len({a}), len({b}), 1) >= 0.7"


@query("field_cross_check", "DC-14 SF-21 FP-12", _PAIR + f"""
, l as ({_long_pairs(lambda c, f: c)})
select doc_id, field, v visual_value, z zone_value, case when v is not null and z is not null then
  case when upper(trim(v)) = upper(trim(z))
    or (field in ('date_of_birth','date_of_expiry') and coalesce({_sdate('v')}, v) = coalesce({_sdate('z')}, z))
    or (field = 'nationality' and (starts_with(v, z) or starts_with(z, v)))
    or (field = 'sex' and v[1] = z[1])
    or (field = 'full_name' and {_OVER.format(a=_toks('v'), b=_toks('z'))} and len({_toks('v')}) > 0)
    or (field = 'document_number' and regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(z), '[^A-Z0-9]', '', 'g'))
    or (field = 'document_type' and v in ('PASSPORT','P') and z in ('PASSPORT','P')) then 'MATCH' else 'MISMATCH' end
  when z is not null then 'MRZ_ONLY' else 'VIZ_ONLY' end status
from l where v is not null or z is not null""")
def _(spark, sf_dir):
    return cc.cross_check(_pairs(spark, sf_dir), "doc_id")


def _shown(c, f):
    """Values of these feeds that a display shows."""
    ok = f"length({c}) >= 2 and lower({c}) <> 'given names'"
    if f in ("sex", "document_type"):
        ok = f"({c} in ('PASSPORT','VISA','P','V','M','F') or length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 1)"
    return f"case when {c} <> '' and {ok} then trim({c}) end"


_DISPLAY = _PAIR + f", l as ({_long_pairs(_shown)})" + f"""
, shown as (select doc_id case_id, field, v visual_value, z zone_value, case
  when v is not null and z is not null then case when case
     when field like 'date%' and {_sdate('v')} is not null and {_sdate('z')} is not null then {_sdate('v')} = {_sdate('z')}
     else starts_with(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(z), '[^A-Z0-9]', '', 'g'))
       or starts_with(regexp_replace(upper(z), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'))
       or (field = 'document_type' and ((v in ('PASSPORT','P') and z in ('PASSPORT','P')) or (v in ('VISA','V') and z in ('VISA','V'))))
       or (field = 'sex' and v[1] = z[1] and z <> 'UNSPECIFIED')
       or (field = 'full_name' and {_OVER.format(a=_toks('v', 2), b=_toks('z', 2))}) end then 'MATCH' else 'MISMATCH' end
  when z is not null then 'MRZ_ONLY' when v is not null then 'VIZ_ONLY' else 'NOT_PRESENT' end status from l)"""


@query("display_cross_check", "DC-14 SF-21 FP-11", _DISPLAY + " select * from shown")
def _(spark, sf_dir):
    return cc.cross_check(_pairs(spark, sf_dir), "doc_id", "display").withColumnRenamed("doc_id", "case_id")


@query("verified_field_counts", "AG-23", _DISPLAY + """
select case_id, count(*) filter (status in ('MATCH','VIZ_ONLY','MRZ_ONLY')) verified, count(*) checked from shown group by 1""")
def _(spark, sf_dir):
    rows = cc.cross_check(_pairs(spark, sf_dir), "doc_id", "display").withColumnRenamed("doc_id", "case_id")
    return aggregates.verified_counts(rows)


@query("resolved_fields", "FP-18", _PAIR + f"""
, l as ({_long_pairs(_shown)})
, r as (select doc_id, """ + ", ".join(
    f"max(case when field = '{f}' then case when zone_valid and z is not null then z else coalesce(v, z) end end) {f}" for f in cc.CANONICAL) + """
 from l group by 1)
select * replace (coalesce(full_name, concat_ws(' ', given_names, surname)) as full_name) from r""")
def _(spark, sf_dir):
    return cc.resolved_fields(_pairs(spark, sf_dir), "doc_id")


@query("zone_backfill", "FP-19", _PAIR + f"""
, l as ({_long_pairs(lambda c, f: c)})
, k as (select doc_id, field, v, case when not parsed then null when field = 'nationality' and z = 'IND' then 'INDIAN'
    when field = 'sex' and z = 'UNSPECIFIED' then null else nullif(z, '') end z,
   coalesce(v, '') = '' or (field in ('surname','given_names','full_name') and (lower(v) = 'given names' or
     len(regexp_extract_all(upper(v), '[A-Z]+')) > 3 or length(v) <= case when field = 'full_name' then 4 else 2 end)) weak from l
  where field <> 'document_type')
select doc_id, field, case when weak and z is not null then z else v end value,
 case when weak and z is not null then 'MRZ_VERIFIED' when v is not null then 'VIZ' end source,
 cast(case when weak and z is not null then 0.99 end as double) confidence from k""")
def _(spark, sf_dir):
    return cc.backfilled(_pairs(spark, sf_dir), "doc_id")


@query("zone_findings", "DC-11", _PAIR + f"""
, found as (select doc_id, 'VIZ_MRZ_DOC_NUM_MATCH' rule_id, 'CRITICAL' severity, z_document_number expected, v_document_number observed
   from pair where parsed and v_document_number <> z_document_number
 union all select doc_id, 'VIZ_MRZ_DOB_MATCH', 'CRITICAL', z_date_of_birth, v_date_of_birth from pair
   where parsed and {_sdate('v_date_of_birth')} <> z_date_of_birth
 union all select doc_id, 'VIZ_MRZ_EXPIRY_MATCH', 'HIGH', z_date_of_expiry, v_date_of_expiry from pair
   where parsed and {_sdate('v_date_of_expiry')} <> z_date_of_expiry
 union all select doc_id, 'VIZ_MRZ_NAME_MATCH', 'HIGH', z_full_name, v_full_name from pair
   where parsed and len({_toks('v_full_name')}) > 0 and len({_toks('z_full_name')}) > 0
     and not list_has_any({_toks('v_full_name')}, {_toks('z_full_name')}))
select * from found""")
def _(spark, sf_dir):
    return cc.zone_findings(_pairs(spark, sf_dir), "doc_id").drop("field")


@query("zone_states", "DC-5", _MRZ + """
select doc_id, case when doc_id % 10 = 9 then 'MRZ_INPUT_INSUFFICIENT' when parsed and all_checks_passed then 'MRZ_VALID'
 when parsed then 'MRZ_INVALID' when doc_id % 4 = 3 and doc_id % 3 = 0 then 'MRZ_NOT_APPLICABLE' when doc_id % 4 = 3 then 'MRZ_UNPARSED'
 when doc_id % 8 = 2 then 'MRZ_NOT_DETECTED' else 'MRZ_UNPARSED' end state from dec""")
def _(spark, sf_dir):
    k = F.col("doc_id")
    return _decoded(spark, sf_dir).select("doc_id", mrz.mrz_state(
        F.when(k % 4 == 3, "visa").otherwise("PASSPORT"), F.when(k % 20 == 9, "PASSPORT_COVER").otherwise("PASSPORT_IDENTITY_PAGE"),
        k % 20 != 19, F.when(k % 8 == 2, 0).otherwise(2), k % 3 > 0, F.col("parsed"), F.col("all_checks_passed")).alias("state"))


# -- rules -------------------------------------------------------------------------------------

def _vdate(c):
    return (f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then strftime(try_cast({c} as date), '%Y-%m-%d') "
            f"when regexp_full_match({c}, '[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}') then strftime(try_cast({c}[7:10]||'-'||{c}[4:5]||'-'||{c}[1:2] as date), '%Y-%m-%d') "
            f"when {c} like '% MAR %' then {c}[8:11] || '-03-' || {c}[1:2] end")


@query("visa_rule_findings", "DC-10 SD-3 SD-7 SD-8", ctes("visas") + f"""
, v as (select *, {_vdate('valid_until')} u, {_vdate('valid_from')} f, try_cast(nullif(regexp_extract(stay_duration, '([0-9]+)\\s*DAY', 1), '') as bigint) nd,
   coalesce(visa_type, 'TOURIST') kind from visas)
select doc_id, 'VISA_NUMBER_FORMAT' rule_id, 'HIGH' severity, coalesce(visa_number, 'NOT_FOUND') observed from v
  where visa_number is null or length(visa_number) < 6 or not regexp_full_match(visa_number, '[A-Z0-9]+')
union all select doc_id, 'VISA_EXPIRY_CHECK', 'CRITICAL', u from v where cast(u as date) < timestamp '{AS_OF}'
union all select doc_id, 'VISA_DATE_RANGE_INVALID', 'CRITICAL', 'From: ' || f || ' > Until: ' || u from v where f > u
union all select doc_id, 'VISA_STAY_DURATION', 'MEDIUM', nd || ' Days (' || kind || ')' from v where kind in ('TOURIST','TRANSIT') and nd > 180
union all select doc_id, 'VISA_PASSPORT_CROSS_CHECK', 'CRITICAL', passport_number from v
  where passport_number <> 'Z' || lpad(cast(doc_id as varchar), 7, '0')""")
def _(spark, sf_dir):
    v = frame(spark, sf_dir, "visas").withColumn(
        "presented", F.concat(F.lit("z "), F.lpad(F.col("doc_id").cast("string"), 7, "0")))
    return cc.visa_findings(v, "doc_id", AS_OF, "presented").drop("field", "expected")


@query("passport_rule_findings", "DC-17 JN-1 SD-6", ctes("passports", "watchlist") + f"""
select doc_id, 'DOCUMENT_NOT_EXPIRED' rule_id, 'HIGH' severity, date_of_expiry observed from passports
  where cast(date_of_expiry as date) < timestamp '{AS_OF}'
union all select doc_id, 'IDENTITY_PAGE_REQUIRED', 'CRITICAL', 'PASSPORT_COVER' from passports where doc_id % 9 = 4
union all select doc_id, 'WATCHLIST_MATCH', 'CRITICAL', 'FLAGGED (' || risk_category || ')' from passports p
  join watchlist w on w.document_id = p.passport_number""")
def _(spark, sf_dir):
    cover = F.col("doc_id") % 9 == 4
    docs = frame(spark, sf_dir, "passports").select(
        "doc_id", F.col("passport_number").alias("document_number"), "date_of_expiry", (~cover).alias("is_identity_page"),
        F.when(cover, "PASSPORT_COVER").otherwise("PASSPORT_IDENTITY_PAGE").alias("page_type"))
    return cc.passport_findings(docs, frame(spark, sf_dir, "watchlist"), "doc_id", AS_OF).drop("field", "expected")


# -- classification ------------------------------------------------------------------------------

def _any(c, needles):
    return "(" + " or ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def _classify_sql(source, key):
    def rx(p):
        return f"regexp_matches(t, '{p}')"
    ids = " + ".join(f"contains(t, '{w}')::int" for w in classify.IDENTITY_WORDS)
    return f"""
, b as (select {key}, replace(text, chr(10), ' ') raw, upper(replace(text, chr(10), ' ')) t, list_transform(string_split(text, chr(10)),
    lambda l: upper(replace(l, ' ', ''))) ls from {source})
, m as (select *, len(ls) nl, len(list_filter(ls, lambda l: (regexp_matches(l, '^(P<|P0|P«)') or
     length(l) - length(replace(l, '<', '')) >= 4) and length(l) >= 25)) z,
   len(list_filter(ls, lambda l: l like 'P<%')) > 0 pl, len(list_filter(ls, lambda l: regexp_matches(l, '^V[<0«]'))) > 0 vl,
   {rx('\\b([A-Z]\\s*[0-9]{7,8})\\b')} num, {rx('\\bP\\s+IND\\b')} pi, contains(t, 'IDENTITY PAGE') ip, {ids} ids,
   {_any('t', classify.COVER_WORDS)} cov from b)
, k as (select *, (z >= 1)::int + {rx('\\b(PASSPORT|PASSEPORT|PASAPORTE)\\b')}::int
   + {_any('t', ['REPUBLIC OF INDIA', 'UNION OF INDIA', 'INDIAN PASSPORT'])}::int + (num and (contains(t, 'PASSPORT') or z >= 1))::int
   + (contains(t, 'TYPE P') or {rx('\\bTYPE\\s*[:/]?\\s*P\\b')} or pi or ip)::int pm,
   vl::int + ({rx('\\b(VISA|VIZUM)\\b')} or (contains(t, 'VISA') and {_any('t', ['ENTRIES', 'VALID FOR', 'DURATION OF STAY'])}))::int
   + {rx('\\b(VISA TYPE|TYPE OF VISA|VISA CATEGORY|CATEGORY)\\b')}::int + {rx('\\b(ENTRIES|ENTRY)\\b')}::int
   + {rx('\\b(VALID FROM|VALID UNTIL|DATE OF EXPIRY|EXPIRY DATE)\\b')}::int
   + {rx('\\b(VISA NO|VISA NUMBER|VIGNETTE NO)[\\s:.]*([A-Z0-9]{6,12})\\b')}::int vn,
   {rx('\\b(DURATION OF STAY|PERIOD OF STAY|STAY FOR)\\b')}::int st,
   case when {rx('\\b(AADHAAR|AADHAR|UIDAI)\\b')} or {_any('t', ['MERA AADHAAR', 'UNIQUE IDENTIFICATION', 'ENROLMENT NO', 'ENROLLMENT NO'])}
       or regexp_matches(raw, '\\b[0-9]{{4}}\\s[0-9]{{4}}\\s[0-9]{{4}}\\b') then 'AADHAAR'
     when {_any('t', ['INCOME TAX DEPARTMENT', 'PERMANENT ACCOUNT NUMBER'])} or (contains(t, 'GOVT. OF INDIA') and contains(t, 'PAN'))
       or ({rx('\\b[A-Z]{5}[0-9]{4}[A-Z]\\b')} and {_any('t', ['INCOME', 'TAX', 'FATHER', 'PAN'])}) then 'PAN'
     when {rx('\\bDRIVING LICEN[CS]E\\b')} or {_any('t', ['MOTOR VEHICLES', 'TRANSPORT DEPARTMENT', 'FORM 7'])}
       or {rx('\\bDL\\s*(NO|NUM|:)')} or {rx('\\b[A-Z]{2}[0-9]{13}\\b')} then 'DRIVING_LICENCE'
     when {_any('t', ['ELECTION COMMISSION', 'ELECTOR PHOTO', 'VOTER ID'])} or ({rx('\\b[A-Z]{3}[0-9]{7}\\b')} and {_any('t', ['ELECT', 'VOTER'])}) then 'VOTER_ID'
     when {rx('\\b(STUDENT ID|STUDENT IDENTITY|COLLEGE OF|UNIVERSITY|CAMPUS|EMPLOYEE ID|STAFF CARD|EMPLOYEE IDENTITY|STAFF ID)\\b')} or contains(t, 'ROLL NO') then 'STUDENT_OR_EMPLOYEE_ID'
     when {_any('t', ['NATIONAL IDENTITY CARD', 'CITIZEN CARD', 'RESIDENCE PERMIT'])} then 'NATIONAL_ID' end fam from m)
, d as (select *, (z >= 1 and pm >= 2) or z >= 2 or (contains(t, 'PASSPORT') and (contains(t, 'REPUBLIC') or num))
     or (contains(t, 'REPUBLIC OF INDIA') and (pi or ip or num)) isp,
   (vn + st >= 2 and (vn > 0 or contains(t, 'VISA'))) or vl isv,
   case when cov and not (ip or ids >= 2) then false else z >= 1 or ids >= 2 or ip or (ids >= 1 and num) end idp from k)
, e as (select *, case when fam is not null then 'UNSUPPORTED_DOCUMENT' when isp and (not isv or (z >= 2 and pl and vn + st < 3)) then 'PASSPORT'
   when isv then 'VISA' when nl < 2 or length(trim(t)) < 20 then 'UNABLE_TO_CLASSIFY' else 'UNSUPPORTED_DOCUMENT' end verdict from d)
select {key}, verdict, case when fam is not null then fam when verdict = 'PASSPORT' then case when idp then 'PASSPORT' else 'PASSPORT_COVER' end
   when verdict = 'VISA' then 'VISA' when verdict = 'UNABLE_TO_CLASSIFY' then 'RANDOM_OR_UNREADABLE' else 'OTHER_DOCUMENT' end detected_type,
 case when verdict = 'PASSPORT' then case when idp then 'PASSPORT_IDENTITY_PAGE' else 'PASSPORT_COVER' end when verdict = 'VISA' then 'VISA_VIGNETTE' end page_type,
 cast(case when fam in ('AADHAAR','PAN') then 0.98 when fam = 'DRIVING_LICENCE' then 0.95 when fam = 'VOTER_ID' then 0.96 when fam = 'NATIONAL_ID' then 0.9
  when fam is not null then 0.92 when verdict = 'PASSPORT' then case when z >= 2 then 0.98 else 0.9 end
  when verdict = 'VISA' then case when vn + st >= 3 or vl then 0.95 else 0.85 end when verdict = 'UNABLE_TO_CLASSIFY' then 0.2 else 0.85 end as double) confidence
from e"""


@query("page_classes", "DC-9", ctes("travel_texts") + _classify_sql("travel_texts", "doc_id"))
def _(spark, sf_dir):
    return classify.classify_text(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")


@query("document_classes", "DC-9", "with x as (select 1)" + _classify_sql("documents", "doc_id"))
def _(spark, sf_dir):
    return classify.classify_text(frame(spark, sf_dir, "documents"), "doc_id", "text")


# -- quality, forensics ------------------------------------------------------------------------------

@query("capture_quality", "DC-7 SM-2", ctes("capture_metrics") + f"""
, s as (select *, {rnd('''least(blur/300.0, 1.0)*35.0 + greatest(0.0, 1.0 - glare/0.25)*25.0 + least(contrast/60.0, 1.0)*20.0
   + greatest(0.0, 1.0 - abs(brightness - 128.0)/128.0)*20.0''', 1)} overall_score,
   concat_ws(',', case when blur < 50 then 'BLUR' end, case when glare > 0.25 then 'GLARE' end, case when contrast < 18 then 'CONTRAST' end,
     case when brightness < 25 then 'DARK' when brightness > 245 then 'WASHED_OUT' end,
     case when not ((width >= 640 and height >= 480) or (greatest(width, height) >= 480 and least(width, height) >= 200)
        or width * height >= 120000) then 'RESOLUTION' end) reasons from capture_metrics)
select id, overall_score, reasons, case when reasons = '' and overall_score >= 50 then 'GOOD' else 'NEEDS_BETTER_IMAGE' end verdict from s""")
def _(spark, sf_dir):
    return sc.capture_quality(frame(spark, sf_dir, "capture_metrics")).select(
        "id", "overall_score", F.array_join("reasons", ",").alias("reasons"), "verdict")


@query("crop_quality", "DC-8", ctes("capture_metrics") + """
select id, case when face_count = 0 then 'UNABLE_TO_VERIFY' when (face_count > 1 and not is_document) or least(width, height) < 50 or blur < 25
  or brightness not between 35 and 225 or contrast < 18 then 'POOR' when least(width, height) < 80 or blur < 60 or
  brightness not between 60 and 200 or contrast < 30 then 'ACCEPTABLE' else 'GOOD' end status from capture_metrics""")
def _(spark, sf_dir):
    return sc.crop_quality(frame(spark, sf_dir, "capture_metrics")).select("id", "status")


@query("appearance_levels", "DC-18", ctes("capture_metrics") + """
select id, case (contrast > 45)::int + (glare > 0.08)::int + (brightness > 35)::int when 0 then 'MINIMAL' when 1 then 'MODERATE'
  else 'SIGNIFICANT' end level from capture_metrics""")
def _(spark, sf_dir):
    m = frame(spark, sf_dir, "capture_metrics")
    return m.select("id", sc.appearance_level(F.col("contrast"), F.col("glare"), F.col("brightness")).alias("level"))


@query("forensic_fusion", "DC-13 DC-16 SM-1", ctes("forensic_scores") + f"""
, s as (select *, regexp_matches(lower(coalesce(software, '')), 'adobe|photoshop|gimp|canva|procreate|pixelmator|affinity|paint\\.net|corel|lightroom') flag from forensic_scores)
, c as (select *, {rnd("least(greatest(ela*0.35 + noise*0.25 + copy_move*0.20 + edge*0.15 + case when flag then 65.0 else 0 end*0.05, 0), 100.0)", 1)} composite from s)
select id, composite, case when composite >= 40 then 'FORENSIC_ANOMALIES_DETECTED' else 'NO_SIGNIFICANT_TAMPERING_DETECTED' end verdict,
 concat_ws(',', case when ela >= 40 then 'ELA:' || case when ela >= 65 then 'HIGH' else 'MEDIUM' end end,
  case when noise >= 40 then 'NOISE_RESIDUAL:' || case when noise >= 65 then 'HIGH' else 'MEDIUM' end end,
  case when copy_move >= 40 then 'COPY_MOVE:HIGH' end, case when edge >= 40 then 'EDGE_BOUNDARY:MEDIUM' end,
  case when flag then 'METADATA:HIGH' end) findings from c""")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "forensic_scores")
    s = s.withColumn("software_flag", sc.edited_with(F.col("software"))).withColumn(
        "metadata", F.when(F.col("software_flag"), 65.0).otherwise(0.0))
    return sc.forensic_fusion(s).select("id", "composite", "verdict", F.array_join(F.transform(
        "findings", lambda f: F.concat(f["technique"], F.lit(":"), f["severity"])), ",").alias("findings"))


@query("similarity_outcomes", "DC-12", ctes("face_results") + """
, p(policy, m, b, d) as (values ('sface', 0.68, 0.48, true), ('gabor_lbp', 0.65, 0.5, false), ('linkage', 0.65, 0.5, true), ('matrix', 0.75, 0.5, true))
select screening_id, p.policy, case when similarity_score < b then 'MISMATCH' when d and similarity_score >= m then 'MATCH' else 'BORDERLINE' end outcome
from face_results join p on p.policy = case screening_id % 4 when 0 then 'sface' when 1 then 'gabor_lbp' when 2 then 'linkage' else 'matrix' end""")
def _(spark, sf_dir):
    k = F.col("screening_id") % 4
    rows = frame(spark, sf_dir, "face_results").withColumn("policy", F.when(k == 0, "sface").when(
        k == 1, "gabor_lbp").when(k == 2, "linkage").otherwise("matrix"))
    return sc.similarity_band(rows, "similarity_score", "policy").select("screening_id", "policy", "outcome")


# -- risk -----------------------------------------------------------------------------------------------

_RISK = ctes("risk_cases", "findings", "tamper_findings") + f"""
, v as (select screening_id id, max(case severity when 'CRITICAL' then 75.0 when 'HIGH' then 45.0 else 20.0 end) p,
    bool_or(severity in ('CRITICAL','HIGH')) s from findings where rule_id like 'VIZ%' group by 1)
, r as (select screening_id id, max(case severity when 'CRITICAL' then 85.0 when 'HIGH' then 55.0 else 25.0 end) p,
    bool_or(severity in ('CRITICAL','HIGH')) s from findings where rule_id not like 'VIZ%' group by 1)
, t as (select screening_id id, bool_or(severity in ('CRITICAL','HIGH')) s from tamper_findings group by 1)
, j as (select c.*, cast(case when parsed and failed_checks > 0 then 40 + least(failed_checks * 20, 60) when parsed then 0
     when document_type = 'PASSPORT' then 25 else 0 end as double) mrz, cast(coalesce(v.p, 0) as double) viz, coalesce(tamper_score, 0.0) tamper,
   cast(case when upper(face_state) = 'MISMATCH' then 85 when face_state = 'INCONCLUSIVE' then 35 when face_state = 'INPUT_FAILURE' then 30
     when face_state is null then 0 else 5 end as double) face, cast(coalesce(r.p, 0) as double) rules,
   cast(case when quality_verdict = 'NEEDS_BETTER_IMAGE' then 60 else 0 end as double) quality, cast(case when duplicate then 90 else 0 end as double) reuse,
   (parsed and failed_checks > 0)::int + coalesce(v.s, false)::int + (coalesce(tamper_score, 0) >= 35 and coalesce(t.s, false))::int
     + (coalesce(upper(face_state), '') = 'MISMATCH')::int + duplicate::int + coalesce(r.s, false)::int sev
  from risk_cases c left join v using (id) left join r using (id) left join t using (id))
, sco as (select id, mrz, viz, tamper, face, rules, quality, reuse, cast(sev as int) severe_categories,
   {rnd("least(greatest(mrz*0.22 + viz*0.25 + tamper*0.20 + face*0.18 + rules*0.10 + quality*0.05 + reuse*0.20 + case when sev >= 3 then 25.0 when sev >= 2 then 15.0 else 0.0 end, 0), 100.0)", 1)} risk_score from j)"""


def _risk_inputs(spark, sf_dir):
    cases = frame(spark, sf_dir, "risk_cases").withColumn("failed_names", F.split("failed_names", ","))
    return cases, frame(spark, sf_dir, "zone_findings_feed"), frame(spark, sf_dir, "tamper_findings")


@query("risk_scores", "DC-1 DC-2 AG-12 AG-13 SM-1", _RISK + """
select *, case when risk_score < 30 then 'LOW' when risk_score < 60 then 'MEDIUM' when risk_score < 80 then 'HIGH' else 'CRITICAL' end risk_band from sco""")
def _(spark, sf_dir):
    return sc.risk(*_risk_inputs(spark, sf_dir))


@query("case_outcomes", "DC-3 DC-4 DC-2", _RISK + """
, b as (select sco.*, quality_verdict, is_identity_page, case when risk_score < 30 then 'LOW' when risk_score < 60 then 'MEDIUM' when risk_score < 80 then 'HIGH' else 'CRITICAL' end risk_band
  from sco join risk_cases using (id))
select id, case when id % 41 = 0 then 'FAILED' when quality_verdict <> 'GOOD' then 'QUALITY_REJECTED' when id % 29 = 0 then 'UNSUPPORTED_DOCUMENT'
   when not is_identity_page then 'MANUAL_REVIEW_REQUIRED' when risk_band = 'LOW' then 'COMPLETED' else 'MANUAL_REVIEW_REQUIRED' end status,
 cast(case when id % 41 = 0 then 75 when quality_verdict <> 'GOOD' then 60 when id % 29 = 0 then 80 when not is_identity_page then greatest(risk_score, 75) else risk_score end as double) risk_score,
 case when id % 41 = 0 then 'HIGH' when quality_verdict <> 'GOOD' then 'MEDIUM' when id % 29 = 0 then 'HIGH' when not is_identity_page then 'HIGH' else risk_band end risk_band,
 case when id % 41 = 0 or quality_verdict <> 'GOOD' or id % 29 = 0 then null
  when not is_identity_page then 'Identity Page Not Detected — recapture required. Upload the passport biodata/identity page containing portrait and machine-readable information.'
  when risk_band = 'LOW' then 'Routine Clearance Permitted. Document passes automated integrity checks.'
  when risk_band = 'MEDIUM' then 'Additional Verification Recommended. Minor inconsistencies require routine officer review.'
  when risk_band = 'HIGH' then 'Manual Secondary Verification Required. Significant discrepancies or tampering indicators observed.'
  else 'Escalated Supervisor Intervention Required. Multiple critical integrity or biometric failures detected.' end recommendation from b""")
def _(spark, sf_dir):
    cases, findings, tamper = _risk_inputs(spark, sf_dir)
    scored = sc.risk(cases, findings, tamper).join(cases.select("id", "quality_verdict", "is_identity_page"), "id")
    k = F.col("id")
    out = sc.outcomes(scored).withColumn("g", sc.gate(k % 41 == 0, F.col("quality_verdict"), k % 29 != 0))
    return out.select("id", *[F.coalesce(f"g.{c}", c).alias(c) for c in ("status", "risk_score", "risk_band")],
                      F.when(F.col("g").isNull(), F.col("recommendation")).alias("recommendation"))


_REASONS = _RISK + f"""
, n as (select screening_id, count(*) n from tamper_findings group by 1)
, rs as (select id case_id, 0 step, 0 seq, 'DOCUMENT_PAGE' category, 'CRITICAL' severity, null::double points, 'Identity Page Not Detected' summary
    from j where not is_identity_page
 union all select id, 1, 0, 'MRZ_CHECKSUM', case when not parsed then 'MEDIUM' when composite_failed then 'CRITICAL' else 'HIGH' end,
    mrz * 0.22, case when not parsed then 'MRZ Missing or Unreadable' else 'MRZ Checksum Failure (' || replace(replace(replace(replace(replace(failed_names,
    'document_number', 'Document Number'), 'date_of_birth', 'Date Of Birth'), 'date_of_expiry', 'Date Of Expiry'), 'composite', 'Composite'), ',', ', ') || ')' end
    from j where mrz > 0
 union all select screening_id, 2, seq, 'VIZ_MRZ_CROSS_CHECK', severity, case severity when 'CRITICAL' then 75.0 when 'HIGH' then 45.0 else 20.0 end * 0.25,
    'Field Inconsistency: ' || case field when 'document_number' then 'Document Number' else 'Date Of Expiry' end
    from findings where rule_id like 'VIZ%'
 union all select screening_id, 3, seq, 'FORENSICS', severity, score * (0.20 / n), technique from tamper_findings join n using (screening_id) join j on id = screening_id where tamper >= 35
 union all select id, 4, 0, 'BIOMETRIC', case when face = 85 then 'CRITICAL' else 'MEDIUM' end, face * 0.18,
    case face when 85 then 'Biometric Mismatch' when 35 then 'Biometric Inconclusive' else 'Facial Capture Incomplete' end from j where face >= 30
 union all select id, 4, 0, 'BIOMETRIC', 'INFO', 0.0, 'Appearance Variation: ' || appearance_level from j where face = 5 and appearance_level <> 'MINIMAL'
 union all select id, 5, 0, 'MULTI_IDENTITY', 'CRITICAL', 25.0, 'Multi-Identity Reuse Flagged' from j where duplicate
 union all select screening_id, 6, seq, 'RULES', severity, case severity when 'CRITICAL' then 85.0 when 'HIGH' then 55.0 else 25.0 end * 0.10, rule_id
    from findings where rule_id not like 'VIZ%'
 union all select id, 7, 0, 'QUALITY', 'MEDIUM', 3.0, 'Sub-Optimal Image Quality' from j where quality > 0)
, placed as (select case_id, cast(step as int) step, cast(seq as bigint) seq, category, severity, {rnd('points', 1)} points, summary,
   row_number() over (partition by case_id order by list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity), step, seq) place from rs)"""


@query("ordered_risk_reasons", "TK-5 DC-1 DC-3", _REASONS + " select * from placed")
def _(spark, sf_dir):
    return sc.order_reasons(sc.risk_reasons(*_risk_inputs(spark, sf_dir)))


@query("top_risk_reasons", "TK-10", _REASONS + " select case_id, category, severity, cast(place as int) place from placed where place <= 4")
def _(spark, sf_dir):
    return sc.top_reasons(sc.risk_reasons(*_risk_inputs(spark, sf_dir))).select("case_id", "category", "severity", "place")


@query("reread_reasons", "DC-19", ctes("findings", "tamper_findings", "face_results", "screenings") + """
select id case_id, 'DOCUMENT_PAGE' category, 'CRITICAL' severity, 'Identity Page Not Detected' summary from screenings where document_type = 'PASSPORT_COVER'
union all select screening_id, category, severity, rule_id from findings where severity in ('HIGH','CRITICAL')
union all select screening_id, 'TAMPER_FORENSICS', severity, 'Tampering anomaly: ' || technique from tamper_findings where severity in ('HIGH','CRITICAL')
union all select screening_id, 'BIOMETRIC', 'CRITICAL', case when verification_result = 'MISMATCH' then 'Biometric Mismatch' else 'Biometric Input Incomplete' end
  from face_results where verification_result in ('MISMATCH','INPUT_FAILURE')""")
def _(spark, sf_dir):
    covers = frame(spark, sf_dir, "screenings").filter("document_type = 'PASSPORT_COVER'").select(F.col("id").alias("screening_id"))
    return sc.reread_reasons(frame(spark, sf_dir, "findings"), frame(spark, sf_dir, "tamper_findings"),
                             frame(spark, sf_dir, "face_results"), covers)


@query("extraction_statuses", "DC-6", ctes("visas") + """
, v as (select doc_id, (visa_number is not null)::int + (coalesce(name, surname) is not null)::int + 1 core,
  (visa_number is not null)::int + (name is not null)::int + (sex is not null)::int + (visa_type is not null)::int + (stay_duration is not null)::int total from visas)
select doc_id, case when core >= 2 then 'SUCCESS' when total >= 1 then 'PARTIAL' else 'FAILED' end visa_status,
 case when doc_id % 7 = 0 then case when total >= 1 then 'PARTIAL' else 'FAILED' end when total >= 2 then 'SUCCESS' when total = 1 then 'PARTIAL' else 'FAILED' end reread_status from v""")
def _(spark, sf_dir):
    v = frame(spark, sf_dir, "visas")
    total = aggregates.populated(["visa_number", "name", "sex", "visa_type", "stay_duration"])
    v = v.withColumns({"_holder": F.coalesce("name", "surname"), "_valid": F.coalesce("valid_from", "valid_until")})
    core = aggregates.populated(["visa_number", "_holder", "_valid"])
    return v.select("doc_id", sc.visa_status(core, total).alias("visa_status"),
                    sc.reread_status(total, F.col("doc_id") % 7 != 0).alias("reread_status"))


@query("max_severity_points", "AG-12", ctes("findings") + """
select screening_id, cast(max(case severity when 'CRITICAL' then 85 when 'HIGH' then 55 else 25 end) as double) points from findings group by 1""")
def _(spark, sf_dir):
    return sc.max_points(frame(spark, sf_dir, "findings"), "screening_id", sc.rule_points(F.col("severity")), "points")


@query("severe_category_escalation", "AG-13", ctes("findings") + """
, n as (select screening_id, count(distinct category) filter (severity in ('CRITICAL','HIGH')) severe_categories from findings group by 1)
select *, cast(case when severe_categories >= 3 then 25 when severe_categories >= 2 then 15 else 0 end as double) escalation from n""")
def _(spark, sf_dir):
    return sc.severe_categories(frame(spark, sf_dir, "findings"), "screening_id")
