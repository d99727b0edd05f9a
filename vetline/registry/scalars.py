"""Column functions: text, dates, masks, arithmetic, arrays, digests."""

from pyspark.sql import functions as F

from vetline.feeds import ctes, frame
from vetline.functions import dates, digest, fields, numeric, text
from vetline.operators import sets
from vetline.registry.core import AS_OF, query, rnd


def _sql_list(values):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- text ------------------------------------------------------------------------

_DENULL = """case when trim(txt) = '' or upper(trim(txt)) in ('UNKNOWN','NOT_AVAILABLE','NOT_FOUND','N/A','NONE','NULL')
 then null else trim(txt) end"""


@query("placeholder_to_null", "FP-10", ctes("messy_text") + f"""
select id, {_DENULL} server_value, case when trim(txt) in ('', '—', '-', 'None', 'null', 'undefined') then null
 else trim(txt) end display_value from messy_text""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_text").select(
        "id", text.denull(F.col("txt")).alias("server_value"), text.denull_display(F.col("txt")).alias("display_value"))


def _nested_strip(expr):
    for p in text.LABEL_PREFIXES:
        expr = "regexp_replace(" + expr + ", '" + p.replace("'", "''") + "', '')"
    return expr


@query("normalised_text", "SF-1", ctes("messy_text") + f"""
select id, nullif(trim(regexp_replace({_nested_strip(f"replace(upper({_DENULL}), '<', ' ')")}, '\\s+', ' ', 'g')), '') value
from messy_text""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_text").select("id", text.normalize_text(F.col("txt")).alias("value"))


_TOK = "regexp_extract_all(upper(trim(txt)), '[A-Z]+')"
_LW = {k: _sql_list(v) for k, v in {
    "visa": text.LABEL_WORDS_VISA, "reader": text.LABEL_WORDS_READER, "boiler": text.BOILERPLATE_WORDS,
    "display": text.LABEL_WORDS_DISPLAY}.items()}
_NUM = "regexp_matches(trim(txt), '[0-9]{3,}')"


@query("label_noise_flags", "FP-11", ctes("messy_text") + f"""
, t as (select *, {_TOK} tok from messy_text)
select id,
 case when length(trim(txt)) < 2 then true when {_NUM} then false when len(tok) = 0 then true
   else len(list_filter(tok, lambda x: not list_contains({_LW['visa']}, x))) = 0 end visa,
 case when length(trim(txt)) < 2 then true when {_NUM} then false when len(tok) = 0 then true
   when list_has_any(tok, {_LW['boiler']}) or len(tok) > 3 then true
   else len(list_filter(tok, lambda x: not list_contains({_LW['reader']}, x))) = 0 end reader,
 case when length(trim(txt)) < 2 then true
   when {' or '.join(f"regexp_matches(trim(txt), '{p}')" for p in text.LABEL_PATTERNS_DISPLAY)} then true
   when {_NUM} then false
   when list_contains({_LW['display']}, upper(regexp_replace(trim(txt), '[^A-Za-z]', '', 'g'))) then true
   else len(tok) > 0 and len(list_filter(tok, lambda x: length(x) > 1 and not list_contains({_LW['display']}, x))) = 0
   end display from t""")
def _(spark, sf_dir):
    c = F.col("txt")
    return frame(spark, sf_dir, "messy_text").select(
        "id", *[text.is_label_noise(c, v).alias(v) for v in ("visa", "reader", "display")])


@query("clean_name_words", "SF-7", ctes("messy_text") + f"""
, t as (select id, array_to_string(list_filter(
   string_split(upper(trim(regexp_replace(regexp_replace(regexp_replace(trim(txt),
     '(?i)^(?:SURNAME|NOM|GIVEN|NAMES|PRENOM|PRENOMS|MAT|MATRICULE|NAME|FULL)[\\s:./\\-]+', ''),
     '[^A-Za-z]', ' ', 'g'), '\\s+', ' ', 'g'))), ' '),
   lambda w: length(w) >= 2 and not list_contains({_LW['visa']}, w)
             and (length(w) > 2 or regexp_matches(w, '[AEIOUY]'))), ' ') txt from messy_text)
select id, case when length(txt) < 2 then '' else txt end value from t""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_text").select("id", text.clean_name_tokens(F.col("txt")).alias("value"))


@query("sanitised_filenames", "SF-12", ctes("messy_text") + """
select id, regexp_replace(trim(string_split(path, '/')[-1]), '[^a-zA-Z0-9_.-]', '_', 'g') filename from messy_text""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_text").select("id", text.sanitize_filename(F.col("path")).alias("filename"))


@query("title_labels", "SF-22", ctes("findings") + """
select rule_id, array_to_string(list_transform(string_split(lower(replace(rule_id, '_', ' ')), ' '),
  lambda w: upper(w[1]) || substr(w, 2)), ' ') label, count(*) n from findings group by 1""")
def _(spark, sf_dir):
    f = frame(spark, sf_dir, "findings").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return f.select("rule_id", text.title_label(F.col("rule_id")).alias("label"), "n")


@query("token_set_comparison", "SO-3", ctes("messy_text") + """
, t as (select id, list_distinct(regexp_extract_all(upper(p_name || ' ' || p_type), '[A-Z]+')) a,
  list_distinct(regexp_extract_all(upper(other), '[A-Z]+')) b from messy_text),
 o as (select *, len(list_intersect(a, b)) shared from t)
select id, shared = len(a) and shared = len(b) as same, shared > 0 any_shared,
 cast(round(cast(shared / greatest(len(a), len(b)) as decimal(18,6)), 4) as double) overlap,
 shared / greatest(len(a), len(b)) >= 0.7 enough from o""")
def _(spark, sf_dir):
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.col("other")
    overlap = text.token_overlap(a, b)
    return frame(spark, sf_dir, "messy_text").select(
        "id", text.same_tokens(a, b).alias("same"), text.any_token_shared(a, b).alias("any_shared"),
        numeric.fixed_round(overlap, 4).alias("overlap"), (overlap >= 0.7).alias("enough"))


@query("merged_lines", "SO-2", """
with l as (select doc_id, string_split(text, chr(10)) a, string_split(lang || chr(10) || text || chr(10) || source, chr(10)) b
           from documents),
u as (select doc_id, list_concat(a, b) all_lines from l),
e as (select doc_id, x, min(i) first_at from (select doc_id, unnest(all_lines) x, unnest(range(len(all_lines))) i from u)
      group by doc_id, x)
select doc_id, count(*) n, sha256(string_agg(x, chr(10) order by first_at)) digest from e group by 1""")
def _(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents")
    a = F.split("text", "\n")
    b = F.split(F.concat_ws("\n", "lang", "text", "source"), "\n")
    merged = docs.select("doc_id", sets.merge_lines(a, b).alias("m"))
    return merged.select("doc_id", F.size("m").cast("bigint").alias("n"), F.sha2(F.array_join("m", "\n"), 256).alias("digest"))


# -- masks -------------------------------------------------------------------------

@query("masked_identity", "SF-8 SF-9 SF-10", ctes("passports") + """
, p as (select *, surname || ' ' || given_names || ' AL' nm from passports)
select doc_id,
 case when passport_number is null then 'N/A'
   else substr(passport_number,1,3) || repeat('*', length(passport_number) - 5) || right(passport_number, 2) end number,
 array_to_string(list_transform(string_split(nm, ' '), lambda w: case when length(w) <= 2 then w[1] || '*'
   else w[1] || repeat('*', length(w) - 2) || right(w, 1) end), ' ') masked_name,
 case when regexp_full_match(date_of_birth, '[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}') then substr(date_of_birth,1,4) || '-**-**'
   else '****-**-**' end birth from p""")
def _(spark, sf_dir):
    name = F.concat_ws(" ", "surname", "given_names", F.lit("AL"))
    return frame(spark, sf_dir, "passports").select(
        "doc_id", text.mask_number(F.col("passport_number")).alias("number"),
        text.mask_name(name).alias("masked_name"), text.mask_birth_date(F.col("date_of_birth")).alias("birth"))


@query("masked_export", "SF-11", ctes("visas") + """
, f as (select doc_id, 'name' field, name v from visas union all select doc_id, 'visa_number', visa_number from visas
  union all select doc_id, 'date_of_birth', date_of_birth from visas
  union all select doc_id, 'passport_number', passport_number from visas union all select doc_id, 'sex', sex from visas)
select doc_id, field, case when upper(v) in ('UNKNOWN','NONE','NULL') then v
 when field = 'name' then array_to_string(list_transform(string_split(v, ' '),
    lambda w: w[1] || repeat('*', greatest(length(w) - 1, 1))), ' ')
 when field in ('visa_number','passport_number') then case when length(v) > 3 then substr(v,1,2) ||
    repeat('*', length(v) - 3) || right(v,1) else v[1] || repeat('*', length(v) - 1) end
 when field = 'date_of_birth' then substr(v,1,4) || '-**-**' else v end masked from f""")
def _(spark, sf_dir):
    cols = ["name", "visa_number", "date_of_birth", "passport_number", "sex"]
    long = frame(spark, sf_dir, "visas").unpivot(["doc_id"], cols, "field", "v")
    return long.select("doc_id", "field", text.mask_export(F.col("field"), F.col("v")).alias("masked"))


# -- dates -------------------------------------------------------------------------

def _mon(expr):
    return (f"lpad(cast((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', substr(upper({expr}),1,3)) + 2) / 3 as int)"
            "::varchar, 2, '0')")


def _is_mon(expr):
    return (f"substr(upper({expr}),1,3) in ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC')")


def _known_mon(expr):
    return (f"upper({expr}) in ('JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC','JANUARY',"
            "'FEBRUARY','MARCH','APRIL','JUNE','JULY','AUGUST','SEPTEMBER','OCTOBER','NOVEMBER','DECEMBER')")


def _day(y, m, d):
    return f"strftime(try_cast({y} || '-' || lpad({m},2,'0') || '-' || lpad({d},2,'0') as date), '%Y-%m-%d')"


def _g(col, pattern, i):
    return f"regexp_extract({col}, '{pattern}', {i})"


_NM = "^([0-9]{1,2})\\s+([A-Za-z]+)\\s+([0-9]{4})$"
_ISO = "\\b([0-9]{4})[-/.]([0-9]{2})[-/.]([0-9]{2})\\b"
_TXT = "\\b([0-9]{1,2})[\\s\\-/.]([A-Z]{3,9})[\\s\\-/.]([0-9]{4})\\b"
_DMY = "\\b([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})\\b"


@query("dates_lenient", "SD-1 SD-5", ctes("messy_dates") + f"""
, r as (select id, trim(regexp_replace(upper(trim(txt)),
    '^(?:DOB|DATE OF BIRTH|EXPIRY|EXPIRATION|DATE|VALID FROM|VALID UNTIL)[\\s:.\\-]*', '')) r, txt from messy_dates)
select id, case when txt is null or upper(trim(txt)) in ('', 'UNKNOWN','NOT_AVAILABLE','NOT_FOUND','N/A','NONE') then null
 when regexp_matches(r, '{_ISO}') then {_g('r', _ISO, 1)} || '-' || {_g('r', _ISO, 2)} || '-' || {_g('r', _ISO, 3)}
 when regexp_matches(r, '{_TXT}') and {_is_mon(_g('r', _TXT, 2))} then
   {_g('r', _TXT, 3)} || '-' || {_mon(_g('r', _TXT, 2))} || '-' || lpad({_g('r', _TXT, 1)}, 2, '0')
 when regexp_matches(r, '{_DMY}') then {_g('r', _DMY, 3)} || '-' || lpad({_g('r', _DMY, 2)}, 2, '0') || '-' ||
   lpad({_g('r', _DMY, 1)}, 2, '0')
 when regexp_full_match(r, '[0-9]{{6}}') then case when cast(r[1:2] as int) > 45 then '19' else '20' end || r[1:2] || '-'
   || r[3:4] || '-' || r[5:6] else r end value from r""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_dates").select("id", dates.normalize_date(F.col("txt")).alias("value"))


@query("dates_strict", "SD-2", ctes("messy_dates") + f"""
select id, case when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then strftime(try_cast(t as date), '%Y-%m-%d')
 when regexp_full_match(t, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') or regexp_full_match(t, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}')
   then {_day("regexp_extract(t, '[0-9]{4}$')", "regexp_extract(t, '^[0-9]+[-/]([0-9]+)', 1)", "regexp_extract(t, '^[0-9]+')")}
 when regexp_matches(t, '{_NM}') and {_known_mon(_g('t', _NM, 2))}
   then {_day(_g('t', _NM, 3), _mon(_g('t', _NM, 2)), _g('t', _NM, 1))} end value
from (select id, trim(txt) t from messy_dates)""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_dates").select("id", dates.strict_date(F.col("txt")).alias("value"))


@query("dates_visa", "SD-3", ctes("messy_dates") + f"""
, p as (select id, trim(txt) t, regexp_split_to_array(trim(txt), '[\\s/\\-.]+') a,
  nullif(regexp_extract(txt, '\\b([0-9]{{1,2}}[/\\-\\s][A-Za-z]{{3,9}}[/\\-\\s][0-9]{{4}})\\b', 1), '') e1,
  nullif(regexp_extract(txt, '\\b([0-9]{{1,2}}[/\\-.][0-9]{{1,2}}[/\\-.][0-9]{{4}})\\b', 1), '') e2,
  nullif(regexp_extract(txt, '\\b([0-9]{{4}}[/\\-][0-9]{{2}}[/\\-][0-9]{{2}})\\b', 1), '') e3 from messy_dates)
select id, coalesce(e1, e2, e3) found, case
 when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then {_day('a[1]', 'a[2]', 'a[3]')}
 when regexp_full_match(t, '[0-9]{{1,2}}([-/.])[0-9]{{1,2}}[-/.][0-9]{{4}}') then {_day('a[3]', 'a[2]', 'a[1]')}
 when len(a) = 3 and regexp_full_match(a[1], '[0-9]{{1,2}}') and regexp_full_match(a[3], '[0-9]{{4}}') and {_is_mon('a[2]')}
   then {_day('a[3]', _mon('a[2]'), 'a[1]')} end value from p""")
def _(spark, sf_dir):
    c = F.col("txt")
    return frame(spark, sf_dir, "messy_dates").select("id", dates.extract_visa_date(c).alias("found"),
                                                      dates.visa_date(c).alias("value"))


@query("dates_display", "SD-4 SD-5", ctes("messy_dates") + f"""
, p as (select id, trim(txt) t, regexp_split_to_array(trim(txt), '[/\\-.]') a from messy_dates)
select id, case when regexp_full_match(t, '[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}') then {_day('a[1]', 'a[2]', 'a[3]')}
 when regexp_full_match(t, '[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}') then {_day('a[3]', 'a[2]', 'a[1]')}
 when regexp_matches(t, '{_NM}') and {_known_mon(_g('t', _NM, 2))}
   then {_day(_g('t', _NM, 3), _mon(_g('t', _NM, 2)), _g('t', _NM, 1))}
 when regexp_full_match(t, '[0-9]{{6}}') then {_day("(case when cast(t[1:2] as int) > 50 then '19' else '20' end || t[1:2])",
 't[3:4]', 't[5:6]')} end value from p""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "messy_dates").select("id", dates.display_date(F.col("txt")).alias("value"))


@query("two_digit_year_pivots", "SD-5", """
select cast(c_custkey % 100 as int) yy, count(*) n,
 case when c_custkey % 100 <= 26 then 2000 else 1900 end + cast(c_custkey % 100 as int) birth,
 case when c_custkey % 100 <= 66 then 2000 else 1900 end + cast(c_custkey % 100 as int) expiry,
 case when c_custkey % 100 > 45 then 1900 else 2000 end + cast(c_custkey % 100 as int) comparison,
 case when c_custkey % 100 > 30 then 1900 else 2000 end + cast(c_custkey % 100 as int) evaluation,
 case when c_custkey % 100 > 50 then 1900 else 2000 end + cast(c_custkey % 100 as int) display
from customer group by all""")
def _(spark, sf_dir):
    yy = F.col("yy")
    n = frame(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 100).cast("int").alias("yy")).agg(
        F.count(F.lit(1)).alias("n"))
    now = F.year(F.lit(AS_OF).cast("timestamp_ntz")) % 100
    return n.select("yy", "n", dates.pivot_year(yy, now).alias("birth"), dates.pivot_year(yy, now + 40).alias("expiry"),
                    dates.pivot_year(yy, 45).alias("comparison"), dates.pivot_year(yy, 30).alias("evaluation"),
                    dates.pivot_year(yy, 50).alias("display"))


@query("expired_documents", "SD-6", ctes("passports") + f"""
select doc_id, cast(date_of_expiry as date) < timestamp '{AS_OF}' expired from passports""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "passports").select(
        "doc_id", dates.is_past(F.col("date_of_expiry"), AS_OF).alias("expired"))


# -- arithmetic --------------------------------------------------------------------

@query("capture_quality_points", "SM-2", f"""
select p_partkey id, {rnd('''least(p_size * 9.0 / 300.0, 1.0) * 35.0 + greatest(0.0, 1.0 - (p_partkey % 40) / 100.0 / 0.25) * 25.0
 + least((p_retailprice - 880) / 10.0 / 60.0, 1.0) * 20.0 + greatest(0.0, 1.0 - abs(p_size * 5.0 - 128.0) / 128.0) * 20.0''', 1)} score
from part""")
def _(spark, sf_dir):
    p = frame(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), numeric.quality_points(
        F.col("p_size") * 9.0, (F.col("p_partkey") % 40) / 100.0, (F.col("p_retailprice") - 880) / 10.0,
        F.col("p_size") * 5.0).alias("score"))


_Q, _E, _DI = "l_quantity", "l_extendedprice", "l_discount"


@query("anomaly_scores", "SM-1 SM-4 SM-5", f"""
with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 {rnd("least(greatest((l_extendedprice/100 / greatest(l_quantity*8, 0.01) - 1.5)*20.0 + l_discount*10*3.0, 0.0), 100.0)", 1)} noise,
 {rnd("least(greatest((l_quantity / greatest(l_tax*200, 0.1) - 1.8)*35.0, 0.0), 100.0)", 1)} edge,
 {rnd("least(greatest(l_discount*100*4.0 + l_linenumber*12.0 + l_quantity / greatest(l_tax*100, 0.1)*2.0, 0.0), 100.0)", 1)} ela,
 {rnd("least(greatest(l_linenumber*16.0 + least(l_quantity*1.5, 30.0), 0.0), 100.0)", 1)} clone from lineitem)
select *, {rnd("least(greatest(ela*0.35 + noise*0.25 + clone*0.20 + edge*0.15, 0.0), 100.0)", 1)} composite from s""")
def _(spark, sf_dir):
    li = frame(spark, sf_dir, "lineitem")
    q, x = F.col(_Q), F.col(_E)
    s = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                  numeric.noise_anomaly(x / 100, q * 8, F.col(_DI) * 10).alias("noise"),
                  numeric.edge_anomaly(q, F.col("l_tax") * 200).alias("edge"),
                  numeric.compression_anomaly(F.col(_DI) * 100, F.col("l_linenumber"), q, F.col("l_tax") * 100).alias("ela"),
                  numeric.clone_anomaly(F.col("l_linenumber"), q).alias("clone"))
    return s.withColumn("composite", numeric.weighted_score(
        [(F.col("ela"), 0.35), (F.col("noise"), 0.25), (F.col("clone"), 0.20), (F.col("edge"), 0.15)]))


@query("vector_norms", "SM-3", f"""
select vec_id, {rnd("sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double)*cast(x as double))))", 4)} norm,
 {rnd("list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[])", 4)} self_reverse from embeddings""")
def _(spark, sf_dir):
    v = frame(spark, sf_dir, "embeddings")
    return v.select("vec_id", numeric.fixed_round(numeric.l2_norm(F.col("embedding")), 4).alias("norm"),
                    numeric.cosine(F.col("embedding"), F.reverse("embedding")).alias("self_reverse"))


# -- arrays, maps, digests -----------------------------------------------------------

@query("document_digests", "SA-1 SA-7", """
select doc_id, sha256(text) digest, true well_formed, regexp_full_match(source, '[0-9a-fA-F]{64}') source_is_digest
from documents""")
def _(spark, sf_dir):
    d = digest.sha256_hex(F.col("text"))
    return frame(spark, sf_dir, "documents").select(
        "doc_id", d.alias("digest"), digest.is_digest(d).alias("well_formed"),
        digest.is_digest(F.col("source")).alias("source_is_digest"))


@query("canonical_result_payload", "SF-19", ctes("screenings") + """
select id, concat_ws('|', id, sha256(status), upper(risk_band), trim(checkpoint_id), '1.0.0') payload,
 sha256(concat_ws('|', id, sha256(status), upper(risk_band), trim(checkpoint_id), '1.0.0')) result_hash from screenings""")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "screenings")
    p = digest.canonical_payload(F.col("id").cast("string"), F.upper(F.sha2("status", 256)),
                                 F.concat(F.lit(" "), F.lower("risk_band")), F.col("checkpoint_id"))
    return s.select("id", p.alias("payload"), digest.sha256_hex(p).alias("result_hash"))


@query("parsed_json_column", "SA-5", """
select event_id, cast(json_extract_string(props, '$.k') as int) k from events""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("reason_arrays", "SA-4 SA-6", ctes("screenings") + """
select id, case when document_type = 'PASSPORT_COVER' and risk_band = 'HIGH' then 'DOCUMENT_PAGE; RISK_HIGH'
 when document_type = 'PASSPORT_COVER' then 'DOCUMENT_PAGE' when risk_band = 'HIGH' then 'RISK_HIGH' else '' end reasons
from screenings""")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "screenings")
    base = F.array_compact(F.array(F.when(F.col("risk_band") == "HIGH", "RISK_HIGH")))
    cover = F.col("document_type") == "PASSPORT_COVER"
    item = F.lit("DOCUMENT_PAGE")
    items = sets.prepend_if_absent(base, item, ~cover | F.array_contains(base, item))
    return s.select("id", F.array_join(items, "; ").alias("reasons"))


@query("region_lineage", "SA-8", """
select page_id, sha256(html) || ' -> ' || sha256(url) || ' (IDENTITY_PAGE)' lineage from pages""")
def _(spark, sf_dir):
    return frame(spark, sf_dir, "pages").select("page_id", digest.lineage(
        F.sha2("html", 256), F.sha2("url", 256), F.lit("IDENTITY_PAGE")).alias("lineage"))


@query("populated_field_counts", "AG-22", ctes("visas") + """
select doc_id, cast((name is not null)::int + (sex is not null)::int + (visa_number is not null)::int
 + (visa_type is not null)::int + (stay_duration is not null)::int as int) n from visas""")
def _(spark, sf_dir):
    from vetline.operators.aggregates import populated
    return frame(spark, sf_dir, "visas").select(
        "doc_id", populated(["name", "sex", "visa_number", "visa_type", "stay_duration"]).alias("n"))


@query("canonical_names", "FP-12 FP-13", ctes("visas") + """
select doc_id, coalesce(passport_number, visa_number) document_number,
 coalesce(name, given_names || ' ' || surname) full_name, coalesce(date_of_expiry, valid_until) expiry from visas""")
def _(spark, sf_dir):
    v = frame(spark, sf_dir, "visas")
    return v.select("doc_id", fields.canonical(v.columns, "document_number").alias("document_number"),
                    fields.record_name(v.columns).alias("full_name"),
                    F.coalesce(F.col("date_of_expiry"), fields.canonical(v.columns, "date_of_expiry")).alias("expiry"))
