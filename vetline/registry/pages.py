"""Line-oriented extraction and the machine-readable zone."""

from pyspark.sql import functions as F

from vetline.feeds import ctes, frame
from vetline.functions import fields, mrz, text
from vetline.functions.numeric import fixed_round
from vetline.operators import aggregates
from vetline.plans import extraction as ex
from vetline.registry.core import AS_OF, check_digit_sql, query, rnd
from vetline.registry.scalars import _LW


def _rx(p):
    return p.replace("'", "''")


def _ex(c, p, g=1):
    return f"nullif(regexp_extract({c}, '{_rx(p)}', {g}), '')"


def _has(c, needles):
    return "(" + " or ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def _noise(c, variant="visa"):
    tok = f"regexp_extract_all(upper(trim({c})), '[A-Z]+')"
    all_in = f"len(list_filter({tok}, lambda w: not list_contains({_LW[variant]}, w))) = 0"
    extra = "" if variant == "visa" else f" when list_has_any({tok}, {_LW['boiler']}) or len({tok}) > 3 then true"
    return (f"(case when length(trim({c})) < 2 then true when regexp_matches({c}, '[0-9]{{3,}}') then false "
            f"when len({tok}) = 0 then true{extra} else {all_in} end)")


def _words(c, variant="visa"):
    """Name words before the final noise test."""
    return (f"array_to_string(list_filter(string_split(upper(trim(regexp_replace(regexp_replace(regexp_replace("
            f"trim({c}), '{text.NAME_LABEL_PREFIX}', ''), '[^A-Za-z]', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), "
            f"lambda w: length(w) >= 2 and not list_contains({_LW[variant]}, w) and (length(w) > 2 or "
            f"regexp_matches(w, '[AEIOUY]'))), ' ')")


def _ok(c, variant="visa"):
    return f"case when not {_noise(c, variant)} then {c} end"


_LINES = """
, l0 as (select doc_id, unnest(string_split(text, chr(10))) line,
         unnest(range(len(string_split(text, chr(10))))) line_no from travel_texts)"""


def _name_sql(own, stop, v):
    later = ", ".join(f"case when not {_has(f'u{i}', stop)} then w{v}{i} end" for i in (1, 2, 3))
    return f"coalesce({own}, {later})"


_VISA_SQL = ctes("travel_texts") + _LINES + f"""
, l1 as (select *, trim(line) raw, upper(trim(line)) t, upper(line) u, upper(replace(line, ' ', '')) z,
   {_words('line')} wv0,
   {_words("trim(regexp_replace(upper(trim(line)), '.*(?:SURNAME|NOM)[\\s:./\\-]*', '', 'g'))")} sn0,
   {_words("trim(regexp_replace(upper(trim(line)), '.*(?:GIVEN[\\sA-Z]*|PRENOM[S]?)[\\s:./\\-]*', '', 'g'))")} gn0,
   {_ex('line', '\\b([0-9]{1,2}[/\\-\\s][A-Za-z]{3,9}[/\\-\\s][0-9]{4})\\b')} d1,
   {_ex('line', '\\b([0-9]{1,2}[/\\-.][0-9]{1,2}[/\\-.][0-9]{4})\\b')} d2,
   {_ex('line', '\\b([0-9]{4}[/\\-][0-9]{2}[/\\-][0-9]{2})\\b')} d3 from l0)
, l2 as (select *, {_ok('wv0')} wv, {_ok('sn0')} sn, {_ok('gn0')} gn, coalesce(d1, d2, d3) dt,
   string_split(substr(z, 6), '<<') zp, z like 'V<%' and length(z) >= 20 and len(string_split(substr(z, 6), '<<')) >= 2 zh,
   {_ex('z', ex.ZONE_DATA, 1)} zn, {_ex('z', ex.ZONE_DATA, 2)} znat, {_ex('z', ex.ZONE_DATA, 4)} zsex,
   {_ex('t', ex.DEMOGRAPHIC, 1)} m1, {_ex('t', ex.DEMOGRAPHIC, 2)} m2, {_ex('t', ex.DEMOGRAPHIC, 3)} m3,
   {_ex('t', ex.DEMOGRAPHIC, 4)} m4, {_ex('t', ex.LABELLED_NUMBER)} lab, trim({_ex('t', ex.LOOSE_NUMBER)}) loose,
   {_ex('t', ex.VALIDITY, 1)} v1, replace({_ex('t', ex.VALIDITY, 2)}, '0CT', 'OCT') v2,
   replace({_ex('t', ex.VALIDITY, 3)}, '0CT', 'OCT') v3,
   {_ex("trim(regexp_replace(t, '.*(?:PASSPORT|DOC|PPT|PASSEPORT)[\\s:./#]*(?:NO|NUMBER)?[\\s:./]*', '', 'g'))",
        '\\b([A-Z0-9]{7,10})\\b')} near from l1)
, l3 as (select *, {', '.join(f"lead(wv, {i}) over w wv{i}, lead(u, {i}) over w u{i}" for i in (1, 2, 3))}
   from l2 window w as (partition by doc_id order by line_no))
, c as (select doc_id, line_no,
  case when zh then {_ok("trim(replace(zp[1], '<', ' '))")} end z_surname,
  case when zh then {_ok("trim(replace(zp[2], '<', ' '))")} end z_given,
  case when length(zn) >= 6 then zn end z_num, case when znat = 'IND' then 'INDIAN' else znat end z_nat,
  case zsex when 'M' then 'MALE' when 'F' then 'FEMALE' end z_sex,
  case when {_has('t', ['SURNAME', 'NOM'])} then {_name_sql('sn', ['GIVEN', 'PRENOM', 'SEX', 'PASSPORT', 'VISA'], 'v')} end surname,
  case when {_has('t', ['GIVEN', 'PRENOM'])} then {_name_sql('gn', ['SURNAME', 'NOM', 'SEX', 'PASSPORT', 'VISA'], 'v')} end given_names,
  case when lab is not null then {_ok('lab')} else {_ok('loose')} end visa_number,
  coalesce(v1, {', '.join(f"case when regexp_matches(t, '\\b{v}\\b') then '{v}' end" for v in ex.VISA_TYPES)}) visa_type,
  coalesce(case when regexp_matches(m4, '[0-9]') then {_ok('m4')} end,
    case when {_has('t', ['PASSPORT', 'DOC NO', 'PPT NO', 'PASSEPORT'])} then case when near is not null then
      case when regexp_matches(near, '[0-9]') then {_ok('near')} end
      else list_filter(regexp_extract_all(t, '\\b([A-Z0-9]{{7,10}})\\b', 1),
        lambda w: regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Z]'))[1] end end) passport_number,
  coalesce({_ok("case when m3 in ('INDIAN','IND') then 'INDIAN' else m3 end")},
    case when {_has('t', ['NATIONALITY', 'CITIZENSHIP', 'NATIONALITE'])} then
      case when contains(t, 'IND') then 'INDIAN' else coalesce({', '.join(f"case when contains(t, '{n}') then '{n}' end" for n in ex.VISA_NATIONS[2:])}) end end) nationality,
  coalesce(trim(m2), case when {_has('t', ['BIRTH', 'DOB', 'NAISSANCE'])} then dt end) date_of_birth,
  coalesce(case when m1 in ('M','MALE','I') then 'MALE' when m1 is not null then 'FEMALE' end,
    case when {_has('t', ['SEX', 'GENDER'])} then case when {_ex('t', '\\b(MALE|FEMALE|M|F)\\b')} in ('M','MALE') then 'MALE'
      when {_ex('t', '\\b(MALE|FEMALE|M|F)\\b')} is not null then 'FEMALE' end end) sex,
  coalesce({_ex('v2', '([0-9]{1,2}\\s*[A-Za-z]{3,9}\\s*[0-9]{4})')}, trim(v2),
    case when {_has('t', ['VALID FROM', 'VALIDE DU', 'FROM', 'DU:'])} then dt end) valid_from,
  coalesce({_ex('v3', '([0-9]{1,2}\\s*[A-Za-z]{3,9}\\s*[0-9]{4})')}, trim(v3),
    case when {_has('t', ['VALID UNTIL', 'VALIDE JUSQU', 'UNTIL', 'EXPIRY', 'EXPIRATION'])} then dt end) valid_until,
  case when contains(t, 'MULT') then 'MULTIPLE' when contains(t, 'SINGLE') or regexp_matches(t, '\\b0?1\\s*ENTRY\\b') then 'SINGLE'
    when contains(t, 'DOUBLE') or regexp_matches(t, '\\b0?2\\s*ENTRIES\\b') then 'DOUBLE' end entries,
  {_ex('t', ex.STAY, 1)} || ' ' || {_ex('t', ex.STAY, 2)} stay_duration from l3)
, f as (select doc_id, """ + ", ".join(
    f"coalesce({'arg_min(' + z + ', line_no) filter (' + z + ' is not null), ' if z else ''}"
    f"arg_min({n}, line_no) filter ({n} is not null)) {n}"
    for n, z in [("surname", "z_surname"), ("given_names", "z_given"), ("visa_number", "z_num"), ("visa_type", None),
                 ("passport_number", None), ("nationality", "z_nat"), ("date_of_birth", None), ("sex", "z_sex"),
                 ("valid_from", None), ("valid_until", None), ("entries", None), ("stay_duration", None)]) + """
 from c group by doc_id)
, g as (select *, nullif(trim(concat_ws(' ', given_names, surname)), '') holder_name from f)
select doc_id, """ + ", ".join(f"{_ok(n)} {n}" for n in (
    "surname given_names visa_number visa_type passport_number nationality date_of_birth sex valid_from valid_until "
    "entries stay_duration holder_name").split()) + " from g"


@query("visa_page_fields", "SF-15 SF-16 SF-17 WN-5 WN-6", _VISA_SQL)
def _(spark, sf_dir):
    return ex.visa_fields(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")


_DT = _rx(ex.DATE_TEXT)
_PASS_SQL = ctes("travel_texts") + _LINES + f"""
, l1 as (select *, upper(line) t, {_words('line', 'reader')} wr0,
   {_words("trim(regexp_replace(upper(line), '.*(SURNAME|SUMAME|SURNAM|NOM)[\\s:./]*', '', 'g'))", 'reader')} sn0,
   {_words("trim(regexp_replace(upper(line), '.*(GIVEN[\\sA-Z]*|PRENOM[S]?)[\\s:./]*', '', 'g'))", 'reader')} gn0,
   {_words("trim(regexp_replace(upper(line), '.*(FULL NAME|NAME OF HOLDER)[\\s:./]*', '', 'g'))", 'reader')} fn0,
   {_ex('upper(line)', ex.DOC_NUMBER)} num, regexp_extract_all(line, '{_DT}', 1) ds,
   coalesce({_ex('upper(line)', '\\b(MALE|FEMALE)\\b')}, {_ex('upper(line)', '\\b([MF])\\b')}) sx from l0)
, l2 as (select *, {_ok('wr0', 'reader')} wr, {_ok('sn0', 'reader')} sn, {_ok('gn0', 'reader')} gn, {_ok('fn0', 'reader')} fn from l1)
, l3 as (select *, {', '.join(f"lead(wr, {i}) over w wr{i}, lead(t, {i}) over w u{i}, lead(num, {i}) over w n{i}, lead(ds, {i}) over w ds{i}, lead(sx, {i}) over w sx{i}" for i in (1, 2, 3))}
   from l2 window w as (partition by doc_id order by line_no))
, c as (select doc_id, line_no,
  case when num is not null then case when {_has('t', ['IND', 'PASSPORT', 'NO', 'P '])} or
      len(regexp_split_to_array(trim(t), '\\s+')) <= 4 then num end
    when {_has('t', ex.NUMBER_LABELS)} then coalesce(n1, n2, n3) end document_number,
  string_split(case when {_has('t', ['SURNAME', 'SUMAME', 'SURNAM', 'NOM'])} then {_name_sql('sn', ['GIVEN', 'PRENOM', 'DATE', 'SEX', 'PASSPORT'], 'r')} end, ' ')[1] surname,
  case when {_has('t', ['GIVEN', 'PRENOM'])} then {_name_sql('gn', ['DATE', 'SEX', 'BIRTH', 'PASSPORT', 'IND'], 'r')} end given_names,
  case when {_has('t', ['FULL NAME', 'NAME OF HOLDER'])} then coalesce(case when length(fn) > 3 then fn end,
    {', '.join(f"case when length(wr{i}) > 3 and not {_has(f'u{i}', ['PASSPORT', 'REPUBLIC', 'NATIONALITY'])} then wr{i} end" for i in (1, 2, 3))}) end holder,
  case when {_has('t', ['BIRTH', 'BITH', 'DOB', 'NAISSANCE', 'JANM'])} then coalesce(ds[1], ds1[1], ds2[1], ds3[1]) end birth,
  case when {_has('t', ex.EXPIRY_LABELS)} then coalesce(ds[1], ds3[-1], ds2[-1], ds1[-1]) end expiry,
  case when {_has('t', ['NATIONALITY', 'CITIZENSHIP', 'INDIAN'])} and (contains(t, 'IND') or
    coalesce(contains(u1, 'IND'), false) or coalesce(contains(u2, 'IND'), false) or coalesce(contains(u3, 'IND'), false))
    then 'INDIAN' end nationality,
  case when regexp_matches(t, '\\b(SEX|GENDER|SEXE|SOX)\\b') then
    case when coalesce(sx, sx1, sx2, sx3) in ('M', 'MALE') then 'MALE' when coalesce(sx, sx1, sx2, sx3) is not null then 'FEMALE' end end sex,
  list_filter(ds, lambda d: regexp_extract(d, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1) between '1' and '2017')[1] early,
  list_filter(ds, lambda d: regexp_extract(d, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1) >= '2025')[1] late,
  case when regexp_matches(t, '\\bM\\b') then 'MALE' when regexp_matches(t, '\\bF\\b') then 'FEMALE' else '' end esex from l3)
, f as (select doc_id, """ + ", ".join(
    f"arg_min({n}, line_no) filter ({n} is not null) {n}" for n in
    "document_number surname given_names holder birth expiry nationality sex early late".split()) + """,
  arg_min(esex, line_no) filter (early is not null) esex, min(line_no) filter (surname is not null) ls,
  min(line_no) filter (given_names is not null) lg, min(line_no) filter (holder is not null) lh from c group by doc_id)
select doc_id, document_number, surname, given_names,
  case when surname is not null and given_names is not null and (lh is null or greatest(ls, lg) <= lh)
    then given_names || ' ' || surname else holder end full_name,
  nationality, coalesce(birth, early) date_of_birth, coalesce(expiry, late) date_of_expiry,
  coalesce(sex, case when birth is null then nullif(esex, '') end) sex from f"""


@query("passport_page_fields", "SF-18 SD-9 WN-5 WN-6 WN-11", _PASS_SQL)
def _(spark, sf_dir):
    return ex.passport_fields(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")


@query("adjacent_lines", "JN-6", """
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) line_no, unnest(string_split(text, chr(10))) line
           from documents),
p as (select *, lead(line) over (partition by doc_id order by line_no) nxt from l)
select doc_id, cast(line_no as int) line_no, sha256(line || '|' || nxt) digest from p where nxt is not null""")
def _(spark, sf_dir):
    return ex.adjacent_pairs(frame(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", "line_no", F.sha2(F.concat_ws("|", "first", "second"), 256).alias("digest"))


# -- machine-readable zone -----------------------------------------------------------

def _norm_sql(src, prefix):
    """CTEs from src(doc_id, h, d) to <prefix>norm(header, data)."""
    p = prefix
    clean = "regexp_replace(regexp_replace(upper(trim({c})), '[\\s«»\\-_/]+', '<', 'g'), '[^A-Z0-9<]', '<', 'g')"
    return f"""
, {p}n1 as (select *, {clean.format(c='h')} x, {clean.format(c='d')} y from {src})
, {p}n2 as (select * exclude (x, y), case when instr(x, 'P<') > 0 then substr(x, instr(x, 'P<'))
     when regexp_matches(x, 'P[<0A-Z]') then substr(x, length(regexp_extract(x, '^(.*?)P[<0A-Z]', 1)) + 1) else x end x,
   case when regexp_matches(y, '[A-Z0-9<]{{9}}[0-9]') then substr(y, length(regexp_extract(y, '^(.*?)[A-Z0-9<]{{9}}[0-9]', 1)) + 1)
     else y end y from {p}n1)
, {p}n3 as (select * exclude (x, y), string_split(regexp_replace(regexp_replace(x, '^P<(ND|1ND|TND|LND)', 'P<IND'),
     '<<([A-Z0-9]+)K<', '<<\\1<<', 'g'), '<<') xp,
   case when length(y) >= 44 then y[1:28] || regexp_replace(y[29:42], '[KEXC<]', '<', 'g') || y[43:]
     when length(y) >= 30 then y[1:28] || regexp_replace(y[29:], '[KEXC<]', '<', 'g') else y end y from {p}n2)
, {p}n4 as (select * exclude (xp), case when len(xp) > 2 then xp[1] || '<<' || xp[2] ||
     regexp_replace('<<' || array_to_string(xp[3:], '<<'), '[KEXC<]', '<', 'g') else array_to_string(xp, '<<') end x from {p}n3)
, {p}norm as (select * exclude (x, y), case when length(x) >= 35 then rpad(x[1:44], 44, '<') else x end header,
   case when length(y) >= 35 then rpad(y[1:44], 44, '<') else y end data from {p}n4)"""


_DIG = "translate({}, 'ODQILZS', '0001125')"


def _iso_sql(c, last):
    return (f"case when regexp_full_match({c}, '[0-9]{{6}}') and cast({c}[3:4] as int) between 1 and 12 and "
            f"cast({c}[5:6] as int) between 1 and 31 then cast(cast({c}[1:2] as int) + case when cast({c}[1:2] as int) "
            f"<= {last} then 2000 else 1900 end as varchar) || '-' || {c}[3:4] || '-' || {c}[5:6] end")


def _decode_sql(p):
    return f"""
, {p}s as (select *, case when data[21] in ('M','F') then 21 when data[22] in ('M','F') then 22
     when data[20] in ('M','F') then 20 when data[23] in ('M','F') then 23 else 21 end sp from {p}norm)
, {p}f as (select *, data[1:9] num, data[10] num_c, {_DIG.format('data[14:19]')} dob, {_DIG.format('data[20]')} dob_c,
   {_DIG.format('data[sp+1:sp+6]')} ex, {_DIG.format('data[sp+7]')} ex_c, data[sp+8:sp+21] opt,
   {_DIG.format('substr(data, sp+22, 1)')} opt_c, {_DIG.format('data[44]')} all_c from {p}s)
, {p}g as (select *, {check_digit_sql('num')} e_num, {check_digit_sql('dob')} e_dob, {check_digit_sql('ex')} e_ex,
   case when replace(opt, '<', '') <> '' and regexp_full_match(opt_c, '[0-9]') then {check_digit_sql('opt')} else opt_c end e_opt,
   {check_digit_sql("(num || num_c || dob || dob_c || ex || ex_c || opt || case when opt_c = '' then '0' else opt_c end)")} e_all,
   length(header) = 44 and length(data) = 44 parsed,
   string_split(translate(header[6:44], '0158', 'OISB'), '<<') np from {p}f)
, {p}dec as (select *, parsed and num_c = e_num and dob_c = e_dob and ex_c = e_ex and all_c = e_all all_checks_passed,
   trim(replace(np[1], '<', ' ')) surname, coalesce(trim(replace(np[2], '<', ' ')), '') given_names,
   {_iso_sql('dob', 26)} date_of_birth, {_iso_sql('ex', 66)} date_of_expiry from {p}g)"""


_HDR = "(upper(replace({0}, ' ', '')) like 'P<%' or upper(replace({0}, ' ', '')) like 'P0%' or upper(replace({0}, ' ', '')) like 'V<%')"
_PAIRED = f"""
, o as (select doc_id, case when not {_HDR.format('line_a')} and {_HDR.format('line_b')} then line_b else line_a end h,
   case when not {_HDR.format('line_a')} and {_HDR.format('line_b')} then line_a else line_b end d from mrz_lines)"""
_MRZ = ctes("mrz_lines") + _PAIRED + _norm_sql("o", "") + _decode_sql("")


def _decoded(spark, sf_dir):
    return mrz.decode_td3(frame(spark, sf_dir, "mrz_lines"), "line_a", "line_b", AS_OF)


@query("mrz_normalised_lines", "SF-2 SF-20", _MRZ + " select doc_id, header, data from norm")
def _(spark, sf_dir):
    return _decoded(spark, sf_dir).select("doc_id", "header", "data")


@query("mrz_decoded", "SF-3 SF-4 SF-5 SF-6 SD-5", _MRZ + f"""
select doc_id, parsed, all_checks_passed, case when parsed then replace(header[1:2], '<', '') end document_code,
 case when parsed then case when header[3:5] in ('1ND','TND','LND') then 'IND' else replace(header[3:5], '<', '') end end issuing_country,
 case when parsed then surname end surname, case when parsed then given_names end given_names,
 case when parsed then case when given_names <> '' then trim(given_names || ' ' || surname) else surname end end full_name,
 case when parsed then replace(num, '<', '') end document_number,
 case when parsed then replace(data[11:13], '<', '') end nationality,
 case when parsed then date_of_birth end date_of_birth, case when parsed then date_of_expiry end date_of_expiry,
 case when parsed then case data[sp] when 'M' then 'MALE' when 'F' then 'FEMALE' else 'UNSPECIFIED' end end sex,
 case when parsed then replace(opt, '<', '') end optional_data,
 coalesce(parsed and try_cast(date_of_expiry as date) < timestamp '{AS_OF}', false) is_expired from dec""")
def _(spark, sf_dir):
    return _decoded(spark, sf_dir).drop("line_a", "line_b", "header", "data", "checks")


@query("mrz_failed_checks", "SA-3 SF-6", _MRZ + """
, k as (select doc_id, 'document_number' check_name, num_c observed, e_num expected from dec where parsed
 union all select doc_id, 'date_of_birth', dob_c, e_dob from dec where parsed
 union all select doc_id, 'date_of_expiry', ex_c, e_ex from dec where parsed
 union all select doc_id, 'optional_data', opt_c, e_opt from dec where parsed
 union all select doc_id, 'composite', all_c, e_all from dec where parsed)
select * from k where observed <> expected""")
def _(spark, sf_dir):
    bad = F.map_filter("checks", lambda k, v: ~v["valid"])
    return _decoded(spark, sf_dir).select("doc_id", F.explode(bad).alias("check_name", "c")).select(
        "doc_id", "check_name", "c.observed", "c.expected")


@query("mrz_accuracy", "AG-10", _MRZ + f"""
, k as (select count(*) total, count(*) filter (parsed) parsed_count, cast(sum(case when parsed then (num_c = e_num)::int + (dob_c = e_dob)::int
  + (ex_c = e_ex)::int + (opt_c = e_opt)::int + (all_c = e_all)::int end) as bigint) valid_checks from dec)
select *, {rnd('parsed_count / greatest(total, 1) * 100', 1)} parse_rate,
 {rnd('valid_checks / greatest(parsed_count * 5, 1) * 100', 1)} check_accuracy from k""")
def _(spark, sf_dir):
    return aggregates.mrz_accuracy(_decoded(spark, sf_dir), mrz.CHECKS)


# all pairs of candidate lines, the plain way
_PAIRS = ctes("travel_texts") + _LINES + """
, cand as (select doc_id, line_no, line, upper(replace(line, ' ', '')) z from l0
  where length(replace(line, ' ', '')) >= 15 and (regexp_matches(upper(replace(line, ' ', '')), '^(P<|P0|P«|V<)')
    or length(line) - length(replace(line, '<', '')) >= 2))
, sc as (select *, regexp_matches(z, '^(P<|P0|V<)') hd, (case when regexp_matches(z, '^[PV]<') then 10 else 0 end
  + case when contains(z, '<<') then 5 else 0 end + case when contains(z, 'IND') then 3 else 0 end
  + least(length(z) - length(replace(z, '<', '')), 8)) score from cand)
, pr as (select a.doc_id, a.line_no i, b.line_no j, a.score + b.score score,
   case when not a.hd and b.hd then b.line else a.line end h, case when not a.hd and b.hd then a.line else b.line end d
  from sc a join sc b on a.doc_id = b.doc_id and a.line_no < b.line_no)""" + _norm_sql("pr", "") + _decode_sql("")


@query("mrz_best_earlier_line", "JN-5", _PAIRS + """
, r as (select *, row_number() over (partition by doc_id, j order by all_checks_passed desc, score desc, i) k from dec where parsed)
select doc_id, i first_no, j second_no, all_checks_passed valid, cast(score as int) score from r where k = 1""")
def _(spark, sf_dir):
    lines = ex.line_rows(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")
    return ex.best_earlier_partner(ex.candidate_lines(lines, "doc_id", AS_OF), "doc_id")


@query("mrz_best_pair", "TK-8", _PAIRS + """
, r as (select *, row_number() over (partition by doc_id order by all_checks_passed desc, score desc, i, j) k from dec where parsed)
select doc_id, i first_no, j second_no, all_checks_passed valid, cast(score as int) score from r where k = 1""")
def _(spark, sf_dir):
    lines = ex.line_rows(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")
    return ex.best_pair(ex.candidate_lines(lines, "doc_id", AS_OF), "doc_id")


@query("page_confidence", "AG-16 AG-22 DC-6", _PASS_SQL.replace(
    "select doc_id, document_number, surname", """, n as (select doc_id, count(*) filter (
    length(replace(line, ' ', '')) >= 15 and (regexp_matches(upper(replace(line, ' ', '')), '^(P<|P0|P«|V<)')
    or length(line) - length(replace(line, '<', '')) >= 2)) cands from l0 group by 1)
, fin as (select doc_id, document_number, surname""", 1) + """)
select doc_id, cast(populated as int) populated, case when populated >= 3 and cands >= 2 then 'SUCCESS'
  when populated >= 1 or cands >= 2 then 'PARTIAL' else 'FAILED' end status
from (select fin.*, cands, 2 * (document_number is not null)::int + (surname is not null)::int + (given_names is not null)::int
 + (full_name is not null)::int + (nationality is not null)::int + (date_of_birth is not null)::int
 + (date_of_expiry is not null)::int + (sex is not null)::int populated from fin join n using (doc_id))""")
def _(spark, sf_dir):
    from vetline.plans.screening import reader_status
    pages = frame(spark, sf_dir, "travel_texts")
    fields = ex.passport_fields(pages, "doc_id", "text")
    cands = pages.select("doc_id", ex.candidate_count(F.col("text")).alias("cands"))
    # the number is stored under two names
    n = aggregates.populated([c for c in fields.columns if c != "doc_id"] + ["document_number"])
    return fields.join(cands, "doc_id").select("doc_id", n.alias("populated"), reader_status(
        n, F.col("cands") >= 2).alias("status"))
