"""Logical tables derived from the provided tables.

Each feed is a chain of plain SQL projections over one whole table. The same
text runs in Spark and in the checking engine, so both sides see equal input;
operators and checks share nothing beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _check(parts: list[tuple[str, int]]) -> str:
    """7-3-1 check digit over fixed-width columns, as one SQL expression."""
    terms, i = [], 0
    for col, width in parts:
        for k in range(1, width + 1):
            weight = (7, 3, 1)[i % 3]
            terms.append(f"{weight}*greatest(instr('{MRZ_ALPHABET}', substr({col},{k},1))-1, 0)")
            i += 1
    return "cast((" + "+".join(terms) + ") % 10 as string)"


def _letters(number: str, digits: str) -> str:
    return f"translate(lpad(cast({number} as string),6,'0'),'0123456789','{digits}')"


# name -> (source, [stage, ...]); a stage is a list of (expression, column) added
# to what is there; the last element names the columns kept, None keeps all.
_SPECS: dict[str, tuple[str, list[list[tuple[str, str]]], list[str] | None]] = {}

_SPECS["screenings"] = ("orders", [[
    ("o_orderkey", "id"),
    ("o_orderdate", "created_at"),
    ("o_custkey", "operator_id"),
    ("case when o_orderkey % 11 = 0 then '' else concat('CP-', lpad(cast(o_custkey % 25 as string),2,'0')) end",
     "checkpoint_id"),
    ("case o_orderpriority when '1-URGENT' then 'PASSPORT' when '2-HIGH' then 'PASSPORT' when '3-MEDIUM' then 'VISA' "
     "when '4-NOT SPECIFIED' then 'AADHAAR' else 'PASSPORT_COVER' end", "document_type"),
    ("case when o_orderstatus = 'F' then 'COMPLETED' when o_orderstatus = 'O' then 'MANUAL_REVIEW_REQUIRED' "
     "when o_orderkey % 2 = 0 then 'MANUAL_REVIEW' else 'ESCALATED' end", "status"),
    ("o_totalprice / 5000", "risk_score"),
    ("case when o_orderkey % 97 = 0 then 'UNKNOWN' when o_totalprice < 150000 then 'LOW' "
     "when o_totalprice < 300000 then 'MEDIUM' when o_totalprice < 400000 then 'HIGH' else 'CRITICAL' end",
     "risk_band"),
    ("case when o_orderkey % 13 = 0 then null else o_totalprice / 100 end", "execution_latency_ms"),
]], ["id", "created_at", "operator_id", "checkpoint_id", "document_type", "status", "risk_score", "risk_band",
     "execution_latency_ms"])

_SPECS["users"] = ("customer", [[
    ("c_custkey", "id"),
    ("concat('officer', cast(c_custkey as string))", "username"),
    ("case c_mktsegment when 'BUILDING' then 'OFFICER' when 'AUTOMOBILE' then 'SUPERVISOR' when 'MACHINERY' "
     "then 'ADMIN' when 'HOUSEHOLD' then null else 'Officer' end", "role"),
    ("case when c_acctbal < 0 then ' ' else concat('CP-', lpad(cast(c_nationkey as string),2,'0')) end",
     "checkpoint_id"),
    ("c_acctbal < 9000", "is_active"),
]], ["id", "username", "role", "checkpoint_id", "is_active"])

_SPECS["checkpoints"] = ("nation", [[
    ("concat('CP-', lpad(cast(n_nationkey as string),2,'0'))", "id"),
    ("concat('C', cast(n_nationkey as string))", "code"),
    ("n_name", "name"),
    ("cast(n_regionkey as string)", "location"),
    ("concat('officer', cast(n_nationkey * 3 as string))", "username"),
    ("n_regionkey <> 4", "is_active"),
]], ["id", "code", "name", "location", "username", "is_active"])

_SPECS["findings"] = ("lineitem", [[
    ("l_orderkey", "screening_id"),
    ("cast(round(l_extendedprice * 100) as bigint) * 8 + l_linenumber", "seq"),
    ("case concat(l_returnflag, l_linestatus) when 'AF' then 'VIZ_MRZ_DOC_NUM_MATCH' when 'AO' then "
     "'VIZ_MRZ_DOB_MATCH' when 'NF' then 'DOCUMENT_NOT_EXPIRED' when 'NO' then 'WATCHLIST_MATCH' when 'RF' then "
     "'IDENTITY_PAGE_REQUIRED' else 'VISA_NUMBER_FORMAT' end", "rule_id"),
    ("case concat(l_returnflag, l_linestatus) when 'AF' then 'STANDARDS_COMPLIANCE' when 'AO' then "
     "'STANDARDS_COMPLIANCE' when 'NF' then 'VALIDITY' when 'NO' then 'WATCHLIST' when 'RF' then "
     "'DOCUMENT_PAGE' else 'SYNTAX' end", "category"),
    ("case l_linenumber when 1 then 'CRITICAL' when 2 then 'HIGH' when 3 then 'MEDIUM' when 4 then 'LOW' "
     "else 'INFO' end", "severity"),
    ("case l_linestatus when 'F' then 'document_number' else 'date_of_expiry' end", "field"),
    ("cast(l_partkey as string)", "observed"),
]], ["screening_id", "seq", "rule_id", "category", "severity", "field", "observed"])

_SPECS["tamper_findings"] = ("lineitem", [[
    ("l_orderkey", "screening_id"),
    ("cast(round(l_extendedprice * 100) as bigint) * 8 + l_linenumber", "seq"),
    ("case l_linenumber when 1 then 'ELA' when 2 then 'NOISE_RESIDUAL' when 3 then 'COPY_MOVE' when 4 then "
     "'EDGE_BOUNDARY' else 'METADATA' end", "technique"),
    ("case when l_quantity >= 32 then 'HIGH' when l_quantity >= 20 then 'MEDIUM' else 'LOW' end", "severity"),
    ("l_quantity * 2", "score"),
]], ["screening_id", "seq", "technique", "severity", "score"])

_SPECS["face_results"] = ("orders", [[
    ("o_orderkey", "screening_id"),
    ("o_totalprice / 500000", "similarity_score"),
    ("case when o_orderkey % 5 = 4 then 'NONE' when o_orderkey % 17 = 3 then 'INPUT_FAILURE' when o_totalprice > "
     "340000 then 'VERIFIED MATCH' when o_totalprice < 240000 then 'MISMATCH' else 'INCONCLUSIVE' end",
     "verification_result"),
    ("case when o_orderkey % 4 = 0 then 'MINIMAL' when o_orderkey % 4 = 1 then 'MODERATE' else 'SIGNIFICANT' end",
     "appearance_level"),
]], ["screening_id", "similarity_score", "verification_result", "appearance_level"])

_SPECS["watchlist_raw"] = ("supplier", [[
    # every seventh entry repeats the identifier of the one before it
    ("case when s_suppkey % 3 = 0 then concat(' z', lpad(cast(s_suppkey - (case when s_suppkey % 7 = 0 then 1 else 0 end) as string),4,'0'),"
     "'.', lpad(cast(s_suppkey as string),3,'0'),' ') else concat('Z', lpad(cast(s_suppkey - (case when s_suppkey % 7 = 0 then 1 else 0 end) "
     "as string),7,'0')) end", "document_id"),
    ("concat('  ', lower(s_name), ' ')", "full_name"),
    ("case when s_nationkey < 10 then 'ind' else ' usa ' end", "nationality"),
    ("concat(' reported ', s_name, ' ')", "reason"),
    ("case when s_nationkey < 8 then 'stolen_passport' when s_nationkey < 16 then 'lookout_circular' else "
     "'suspended' end", "risk_category"),
    ("case when s_acctbal < 0 then 'inactive' else 'active' end", "status"),
]], ["document_id", "full_name", "nationality", "reason", "risk_category", "status"])

_SPECS["watchlist"] = ("supplier", [[
    ("concat('Z', lpad(cast(s_suppkey as string),7,'0'))", "document_id"),
    ("s_name", "full_name"),
    ("case when s_nationkey < 8 then 'STOLEN_PASSPORT' when s_nationkey < 16 then 'LOOKOUT_CIRCULAR' else "
     "'SUSPENDED' end", "risk_category"),
    ("case when s_acctbal < 0 then 'INACTIVE' else 'ACTIVE' end", "status"),
]], ["document_id", "full_name", "risk_category", "status"])

_SPECS["audit_source"] = ("events", [[
    ("user_id", "chain_id"), ("event_id", "id"), ("ts", "ts"),
    ("concat('SYSTEM_', upper(event_type))", "actor"), ("event_type", "event_type"), ("props", "payload"),
]], ["chain_id", "id", "ts", "actor", "event_type", "payload"])

# Two readings of one traveller: passport page and visa vignette. Edits by key.
_SPECS["travellers"] = ("customer", [[
    ("c_custkey", "doc_id"),
    (_letters("c_custkey % 900", "AEIORSTLNM"), "surname"),
    (_letters("(c_custkey * 7919) % 1000000", "BARDENIKOS"), "given_names"),
    ("concat('Z', lpad(cast(c_custkey as string),7,'0'))", "doc_no"),
    ("concat(lpad(cast(50 + c_custkey % 50 as string),2,'0'), lpad(cast(1 + c_custkey % 12 as string),2,'0'), "
     "lpad(cast(1 + c_custkey % 28 as string),2,'0'))", "dob6"),
    ("concat(lpad(cast(20 + c_custkey % 15 as string),2,'0'), lpad(cast(1 + c_custkey % 12 as string),2,'0'), "
     "lpad(cast(1 + (c_custkey * 3) % 28 as string),2,'0'))", "exp6"),
    ("case c_custkey % 3 when 0 then 'M' when 1 then 'F' else '<' end", "sex1"),
    ("case when c_custkey % 4 = 0 then concat('PN', lpad(cast(c_custkey as string),12,'0')) else "
     "'<<<<<<<<<<<<<<' end", "opt14"),
], [
    ("rpad(doc_no, 9, '<')", "num9"),
    ("concat('19', substr(dob6,1,2), '-', substr(dob6,3,2), '-', substr(dob6,5,2))", "dob_iso"),
    ("concat('20', substr(exp6,1,2), '-', substr(exp6,3,2), '-', substr(exp6,5,2))", "exp_iso"),
], [
    (_check([("num9", 9)]), "cd_num"), (_check([("dob6", 6)]), "cd_dob"), (_check([("exp6", 6)]), "cd_exp"),
    (_check([("opt14", 14)]), "cd_opt0"),
], [
    ("case when opt14 = '<<<<<<<<<<<<<<' then '<' else cd_opt0 end", "cd_opt"),
], [
    (_check([("num9", 9), ("cd_num", 1), ("dob6", 6), ("cd_dob", 1), ("exp6", 6), ("cd_exp", 1), ("opt14", 14),
             ("cd_opt", 1)]), "cd_all"),
], [
    ("rpad(concat('P<IND', surname, '<<', given_names), 44, '<')", "clean1"),
    ("concat(num9, cd_num, 'IND', dob6, cd_dob, sex1, exp6, cd_exp, opt14, cd_opt, cd_all)", "clean2"),
], [
    # reading noise by key
    ("case c_custkey % 9 when 1 then concat('xx ', replace(clean1, 'P<IND', 'P<1ND')) when 2 then "
     "replace(clean1, '<<<<', '<K<<') when 3 then substr(clean1, 1, 38) when 4 then replace(clean1, '<<<', ' ') "
     "when 5 then lower(clean1) else clean1 end", "mrz1"),
    ("case c_custkey % 10 when 1 then concat(substr(clean2,1,3), '9', substr(clean2,5)) when 2 then "
     "replace(clean2, '<<<<<', '<<KC<') when 3 then substr(clean2, 1, 30) when 4 then "
     "concat(substr(clean2,1,13), replace(substr(clean2,14,6),'1','I'), substr(clean2,20)) when 5 then "
     "concat(substr(clean2,1,43), '0') else clean2 end", "mrz2"),
], [
    ("case when c_custkey % 13 = 5 then mrz2 else mrz1 end", "line_a"),
    ("case when c_custkey % 13 = 5 then mrz1 else mrz2 end", "line_b"),
]], None)

_SPECS["mrz_lines"] = ("travellers", [], ["doc_id", "line_a", "line_b"])

_SPECS["passports"] = ("travellers", [[
    ("case when doc_id % 6 = 1 then null else concat('SURNAME: ', given_names, '  ', surname) end", "name"),
    ("case when doc_id % 7 = 2 then concat(substr(dob_iso,9,2),'/',substr(dob_iso,6,2),'/',substr(dob_iso,1,4)) "
     "else dob_iso end", "date_of_birth"),
    ("case sex1 when 'M' then 'MALE' when 'F' then 'F' else 'UNKNOWN' end", "sex"),
    ("case when doc_id % 2 = 0 then 'IND' else 'INDIAN' end", "nationality"),
    ("case when doc_id % 19 = 7 then null else doc_no end", "passport_number"),
    ("exp_iso", "date_of_expiry"),
]], ["doc_id", "surname", "given_names", "name", "date_of_birth", "sex", "nationality", "passport_number",
     "date_of_expiry"])

_SPECS["visas"] = ("travellers", [[
    ("case when doc_id % 5 = 3 then null else concat(surname, ' ', given_names) end", "name"),
    ("case when doc_id % 8 = 1 then concat(substr(dob_iso,9,2),'-',substr(dob_iso,6,2),'-',substr(dob_iso,1,4)) "
     "when doc_id % 8 = 2 then '1999-01-01' else dob_iso end", "date_of_birth"),
    ("case sex1 when 'M' then 'M' when 'F' then 'FEMALE' else null end", "sex"),
    ("case when doc_id % 12 = 5 then 'FRA' else 'INDIAN' end", "nationality"),
    ("case when doc_id % 10 = 4 then concat('Y', substr(doc_no,2)) when doc_id % 10 = 6 then 'NOT_FOUND' "
     "else doc_no end", "passport_number"),
    ("case when doc_id % 9 = 2 then '2031-02-03' else exp_iso end", "date_of_expiry"),
    ("case doc_id % 7 when 0 then null when 1 then 'AB 12' when 2 then 'V1' else concat('V', doc_no) end",
     "visa_number"),
    ("case doc_id % 5 when 0 then 'TOURIST' when 1 then 'TRANSIT' when 2 then 'BUSINESS' when 3 then null else "
     "'STUDENT' end", "visa_type"),
    ("concat('20', substr(exp6,1,2), '-01-15')", "valid_from"),
    ("case when doc_id % 8 = 5 then concat(substr(exp_iso,9,2), ' MAR ', substr(exp_iso,1,4)) when doc_id % 8 = 6 "
     "then concat(substr(exp_iso,9,2),'.',substr(exp_iso,6,2),'.',substr(exp_iso,1,4)) when doc_id % 8 = 7 then "
     "'31/02/2026' else exp_iso end", "valid_until"),
    ("case doc_id % 4 when 0 then '30 DAYS' when 1 then '365 DAYS' when 2 then '6 MONTHS' else null end",
     "stay_duration"),
    ("case when doc_id % 2 = 0 then 'MULTIPLE' else 'SINGLE' end", "entries"),
]], ["doc_id", "surname", "given_names", "name", "date_of_birth", "sex", "nationality", "passport_number",
     "date_of_expiry", "visa_number", "visa_type", "valid_from", "valid_until", "stay_duration", "entries"])


_SPECS["requests"] = ("lineitem", [[("l_suppkey", "user_id"), ("l_orderkey", "screening_id")]],
                      ["user_id", "screening_id", "l_linenumber"])

# several updates of one case
_SPECS["status_updates"] = ("orders", [[
    ("o_custkey", "case_id"), ("o_orderkey", "seq"),
    ("case o_orderpriority when '1-URGENT' then ' cleared' when '2-HIGH' then 'ESCALATED' when '3-MEDIUM' then "
     "'suspended ' when '5-LOW' then 'MANUAL_REVIEW_REQUIRED' else 'DELETED' end", "status"),
]], ["case_id", "seq", "status"])

_SPECS["extracted_fields"] = ("lineitem", [[
    ("l_orderkey", "screening_id"),
    ("cast(round(l_extendedprice * 100) as bigint) * 8 + l_linenumber", "seq"),
    ("case l_linenumber when 1 then 'surname' when 2 then 'given_names' when 3 then 'document_number' else "
     "'date_of_expiry' end", "field_name"),
    ("cast(l_partkey as string)", "visual_value"), ("l_quantity / 50", "confidence"),
]], ["screening_id", "seq", "field_name", "visual_value", "confidence"])

_SPECS["identity_matches"] = ("customer", [[
    ("c_custkey * 4", "screening_id"), ("concat('Z', lpad(cast(c_custkey as string),7,'0'))", "matched_document_id"),
    ("c_name", "matched_name"), ("c_acctbal / 10000", "similarity"),
]], ["screening_id", "matched_document_id", "matched_name", "similarity"])

_SPECS["case_events"] = ("events", [[
    ("event_id", "screening_id"), ("concat('SYSTEM_', upper(event_type))", "actor"),
]], ["screening_id", "event_id", "ts", "actor", "event_type"])

_SPECS["case_anchors"] = ("part", [[
    ("p_partkey * 3", "screening_id"), ("concat('TX-', cast(p_partkey as string))", "transaction_id"),
    ("case when p_size % 3 = 0 then 'PENDING' else 'COMMITTED' end", "status"),
]], ["screening_id", "transaction_id", "status"])

_SPECS["logins"] = ("events", [[
    ("event_id", "login_id"),
    ("concat('officer', cast(user_id * 2 as string))", "username"),
    ("case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'CP-99' else concat('CP-', "
     "lpad(cast((user_id * 2 + event_id % 3) % 25 as string), 2, '0'), ' ') end", "claimed_checkpoint"),
]], ["login_id", "username", "claimed_checkpoint"])

_SPECS["entity_rows"] = ("lineitem", [[
    ("l_orderkey", "entity"),
    ("case when l_linenumber <= 3 then 'PASSPORT' when l_linenumber <= 5 then 'VISA' else 'VISA_VARIANTS' end",
     "kind"),
]], ["entity", "kind"])

_SPECS["pair_verdicts"] = ("face_results", [[
    ("screening_id % 3 > 0", "same_person"),
    ("case when similarity_score >= 0.68 then 'MATCH' when similarity_score >= 0.48 then 'BORDERLINE' else "
     "'MISMATCH' end", "verdict"),
]], ["screening_id", "same_person", "verdict"])

_SPECS["mutations"] = ("customer", [[
    ("c_custkey", "case_id"),
    ("case c_custkey % 4 when 0 then 'FIELD_TAMPERING' when 1 then 'MRZ_TAMPERING' when 2 then 'DATE_TAMPERING' else "
     "'VISA_TAMPERING' end", "category"),
    ("case c_custkey % 3 when 0 then 'name' when 1 then 'date_of_birth' else 'passport_number' end", "target_field"),
]], ["case_id", "category", "target_field"])


_SPECS["messy_text"] = ("part", [[
    ("p_partkey", "id"),
    ("case p_partkey % 20 when 0 then concat('Name: ', p_name) when 1 then '  unknown ' when 2 then "
     "concat('SURNAME/NOM: ', p_name) when 3 then concat(p_name, '<<', p_type) when 4 then 'n/a' when 5 then '' "
     "when 6 then concat('DOB - ', cast(p_size as string)) when 7 then concat('Visa No: V', cast(p_partkey as string)) "
     "when 8 then 'surname' when 9 then 'GIVEN NAMES / Of holder' when 10 then concat('dk ai ', p_name, ' Of x') "
     "when 11 then 'M' when 12 then 'PASSPORT NO' when 13 then 'A B C' when 14 then concat('Passport ', "
     "cast(10000 + p_partkey as string)) when 15 then ' visa ' when 16 then 'one two three four' when 17 then '—' "
     "when 18 then concat('Nom - ', upper(p_name)) else p_name end", "txt"),
    ("concat('../in/', replace(p_name, ' ', '#'), '(', cast(p_size as string), ').JPG')", "path"),
    ("case when p_partkey % 3 = 0 then concat(upper(p_name), ' ', p_type) when p_partkey % 3 = 1 then "
     "concat(p_type, ', ', p_name) else concat(p_brand, ' x') end", "other"),
]], ["id", "txt", "path", "other", "p_name", "p_type", "p_brand", "p_size"])

_Y, _M, _D = "cast(1960 + c_custkey % 80 as string)", "cast(1 + c_custkey % 12 as string)", "cast(1 + c_custkey % 31 as string)"
_MON = "substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(1 + 3 * (c_custkey % 12) as int), 3)"
_SPECS["messy_dates"] = ("customer", [[
    ("c_custkey", "id"),
    (f"case c_custkey % 16 when 0 then concat({_Y},'-',lpad({_M},2,'0'),'-',lpad({_D},2,'0')) "
     f"when 1 then concat({_D},'/',{_M},'/',{_Y}) when 2 then concat({_D},'-',{_M},'-',{_Y}) "
     f"when 3 then concat({_D},' ',lower({_MON}),' ',{_Y}) when 4 then concat({_D},'-',{_MON},'-',{_Y}) "
     f"when 5 then concat('DOB: ',{_D},'.',{_M},'.',{_Y}) when 6 then concat(substr({_Y},3,2),lpad({_M},2,'0'),"
     f"lpad({_D},2,'0')) when 7 then 'not_found' when 8 then concat({_D},'  ',case c_custkey % 12 when 0 then "
     f"'January' when 1 then 'February' when 2 then 'March' when 3 then 'April' when 4 then 'May' when 5 then 'June' "
     f"when 6 then 'July' when 7 then 'August' when 8 then 'Sept' when 9 then 'October' when 10 then 'November' else "
     f"'December' end,' ',{_Y}) when 9 then concat({_Y},'/',lpad({_M},2,'0'),'/',lpad({_D},2,'0')) "
     f"when 10 then concat('Valid until ',{_Y},'.',lpad({_M},2,'0'),'.',lpad({_D},2,'0')) when 11 then 'soon' "
     f"when 12 then null when 13 then concat('issued ',{_D},' ',{_MON},' ',{_Y},' or ',{_Y},'-01-01') "
     f"when 14 then concat({_Y},'-',{_M},'-',{_D}) else concat({_D},'.',{_M},'.',{_Y}) end", "txt"),
]], ["id", "txt"])


_NLS = "chr(10)"
_DMY_DOB = "concat(substr(dob_iso,9,2),'/',substr(dob_iso,6,2),'/',substr(dob_iso,1,4))"
_MON_OF = "substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(3 * cast(substr({0},6,2) as int) - 2 as int), 3)"
_DOB_TXT = f"concat(substr(dob_iso,9,2),' ',{_MON_OF.format('dob_iso')},' ',substr(dob_iso,1,4))"
_EXP_TXT = f"concat(substr(exp_iso,9,2),' ',{_MON_OF.format('exp_iso')},' ',substr(exp_iso,1,4))"
_PASSPORT_PAGE = (
    f"concat_ws({_NLS}, 'REPUBLIC OF INDIA', "
    "case doc_id % 5 when 0 then concat('PASSPORT NO. ', doc_no) when 1 then 'Passport No / Code' else concat('P IND ', doc_no) end, "
    "case when doc_id % 5 = 1 then concat('P IND ', doc_no) else 'Type P' end, "
    "case when doc_id % 3 = 0 then concat('Surname: ', surname) else 'Surname / Nom' end, "
    "case when doc_id % 3 = 0 then 'Page 2' else surname end, 'Given Names / Prenoms', "
    "case when doc_id % 7 = 0 then '12345' else given_names end, "
    "case when doc_id % 6 = 5 then concat('Full name: ', given_names, ' ', surname, ' AL') else 'Nationality' end, "
    "case when doc_id % 11 = 4 then 'x' else 'INDIAN' end, 'Sex / Sexe', "
    "case sex1 when 'M' then 'M' when 'F' then 'FEMALE' else '-' end, "
    f"case doc_id % 4 when 0 then concat('Date of Birth ', {_DMY_DOB}) when 1 then 'Date of Birth' else 'issued' end, "
    f"case when doc_id % 4 = 3 then {_DOB_TXT} else {_DMY_DOB} end, "
    "case when doc_id % 9 = 8 then 'dates' else 'Date of Issue / Date of Expiry' end, "
    "concat('01/02/2016 ', substr(exp_iso,9,2), '/', substr(exp_iso,6,2), '/', substr(exp_iso,1,4)), "
    "case when doc_id % 8 = 3 then concat('P<IND', given_names, '<<', surname, '<<<<<') else 'signature' end, mrz1, "
    "case when doc_id % 10 = 7 then replace(clean2, '0', 'K') else 'holder' end, mrz2)")
_VISA_PAGE = (
    f"concat_ws({_NLS}, 'REPUBLIC VISA / VIGNETTE', "
    "case doc_id % 5 when 0 then concat('VISA NO: V', substr(doc_no,2)) when 1 then concat('No AB ', substr(doc_no,2,7)) "
    "when 2 then 'VISA NUMBER CATEGORY' else 'sticker' end, "
    f"case doc_id % 4 when 0 then concat('TOURIST ', {_DOB_TXT}, ' ', {_EXP_TXT}) when 1 then 'CONFERENCE' else 'Type BUSINESS' end, "
    "case doc_id % 3 when 0 then 'MULTIPLE ENTRIES' when 1 then '01 ENTRY' else '02 ENTRIES' end, "
    "case when doc_id % 2 = 0 then 'Duration of stay 90 DAYS' else 'STAY' end, "
    "case when doc_id % 3 = 1 then concat('MAT /NOM: ', surname) else 'SURNAME / NOM' end, "
    "case when doc_id % 6 = 2 then 'GIVEN' else surname end, "
    "case when doc_id % 7 < 4 then concat('GIVEN NAMES: ', given_names) else 'PRENOM' end, "
    "case when doc_id % 7 < 4 then 'x' else lower(given_names) end, "
    f"case when doc_id % 4 = 2 then concat(case sex1 when 'M' then 'M ' when 'F' then 'F ' else '' end, {_DOB_TXT}, ' INDIAN ', doc_no) "
    f"else concat('Date of birth ', {_DMY_DOB}) end, "
    "case when doc_id % 4 = 3 then concat('PASSPORT NO. ', doc_no) else 'PASSEPORT' end, "
    "case when doc_id % 3 = 2 then 'SEX FEMALE' else 'SEX -' end, 'NATIONALITY: IND', "
    "concat('Valid from ', substr(exp_iso,9,2), '-', substr(exp_iso,6,2), '-2020'), concat('Valid until ', exp_iso), "
    "case when doc_id % 9 < 3 then rpad(concat('V<IND', surname, '<<', given_names), 36, '<') else 'remarks' end, "
    "case when doc_id % 9 < 3 then concat(rpad(doc_no,9,'7'), '4IND', dob6, '1', sex1, exp6, '5') else '' end)")
_OTHER_PAGE = (
    "case cast(floor(doc_id / 4) as bigint) % 12 when 0 then concat('GOVT', chr(10), 'UIDAI 1234 5678 9012') "
    "when 1 then concat('INCOME TAX DEPARTMENT', chr(10), 'ABCDE1234F') when 2 then concat('Father', chr(10), 'QWERT1234Z') "
    "when 3 then concat('Driving Licence', chr(10), 'DL NO 12') when 4 then concat('Voter card', chr(10), 'ABC1234567') "
    "when 5 then concat('Student ID', chr(10), 'Roll no 4') when 6 then concat('National Identity Card', chr(10), 'nr 1') "
    "when 7 then concat('PASSPORT', chr(10), 'REPUBLIC OF INDIA', chr(10), 'front cover') when 8 then 'short' "
    "when 9 then concat('Republic of India', chr(10), 'P IND', chr(10), 'Surname', chr(10), 'Date of birth') "
    "when 10 then concat('Passport ', doc_no, chr(10), 'Nationality') else concat('a long unrelated letter', chr(10), 'kind regards') end")
_SPECS["travel_texts"] = ("travellers", [[
    ("case doc_id % 4 when 2 then 'VISA' when 3 then 'OTHER' else 'PASSPORT' end", "kind"),
    (f"case doc_id % 4 when 2 then {_VISA_PAGE} when 3 then {_OTHER_PAGE} else {_PASSPORT_PAGE} end", "text"),
]], ["doc_id", "kind", "text"])


_SPECS["capture_metrics"] = ("part", [[
    ("p_partkey", "id"), ("p_size * 9.0", "blur"), ("(p_partkey % 45) / 100.0", "glare"),
    ("(p_retailprice - 870) / 10.0", "contrast"), ("p_size * 5.2", "brightness"),
    ("100 + (p_partkey * 37) % 900", "width"), ("90 + (p_partkey * 53) % 700", "height"),
    ("cast(p_partkey % 4 as int)", "face_count"), ("p_partkey % 3 = 0", "is_document"),
]], ["id", "blur", "glare", "contrast", "brightness", "width", "height", "face_count", "is_document"])

_SPECS["forensic_scores"] = ("orders", [[
    ("o_orderkey", "id"), ("o_totalprice / 5000", "ela"), ("(o_orderkey * 7) % 101 * 1.0", "noise"),
    ("(o_custkey * 13) % 97 * 1.0", "copy_move"), ("(o_orderkey * 3) % 89 * 1.0", "edge"),
    ("case when o_orderkey % 6 = 0 then 'Adobe Photoshop 2' when o_orderkey % 6 = 1 then 'Paint.NET' when "
     "o_orderkey % 6 = 2 then null else 'Scanner' end", "software"),
]], ["id", "ela", "noise", "copy_move", "edge", "software"])

_SPECS["risk_cases"] = ("orders", [[
    ("o_orderkey", "id"),
    ("case when o_orderpriority = '3-MEDIUM' then 'VISA' else 'PASSPORT' end", "document_type"),
    ("o_orderkey % 4 > 0", "parsed"),
    ("cast(case when o_orderkey % 4 > 0 then (o_orderkey % 7) % 4 else 0 end as int)", "failed_checks"),
    ("o_orderkey % 2 = 0", "composite_failed"),
    ("case when o_orderkey % 3 = 0 then null else o_totalprice / 6000 end", "tamper_score"),
    ("case o_orderkey % 6 when 0 then 'MATCH' when 1 then 'mismatch' when 2 then 'INCONCLUSIVE' when 3 then "
     "'INPUT_FAILURE' when 4 then null else 'VERIFIED_MATCH' end", "face_state"),
    ("case when o_orderkey % 9 = 5 then 'SIGNIFICANT' else 'MINIMAL' end", "appearance_level"),
    ("o_orderkey % 37 = 0", "duplicate"),
    ("case when o_orderkey % 10 = 3 then 'NEEDS_BETTER_IMAGE' when o_orderkey % 10 = 4 then 'REJECTED' else 'GOOD' end",
     "quality_verdict"),
    ("o_orderkey % 23 > 0", "is_identity_page"),
], [
    ("case failed_checks when 0 then '' when 1 then '' when 2 then 'document_number,' else 'document_number,date_of_birth,' end",
     "first_names"),
], [
    ("case when failed_checks = 0 then '' when composite_failed then concat(first_names, 'composite') else "
     "concat(first_names, 'date_of_expiry') end", "failed_names"),
]], ["id", "document_type", "parsed", "failed_checks", "composite_failed", "tamper_score", "face_state",
     "appearance_level", "duplicate", "quality_verdict", "is_identity_page", "failed_names"])

_SPECS["zone_findings_feed"] = ("findings", [[("rule_id like 'VIZ%'", "is_zone")]], None)

_SPECS["grid_cells"] = ("lineitem", [[("l_suppkey", "item"), ("l_extendedprice / 100", "variance")]],
                        ["item", "variance", "l_orderkey", "l_partkey", "l_linenumber"])

_SPECS["displacements"] = ("lineitem", [[
    ("l_orderkey", "item"), ("l_quantity * 2 - 50", "dx"), ("l_linenumber * 4.0 - 14", "dy")]], ["item", "dx", "dy"])

_SPECS["tokens"] = ("lineitem", [[
    ("l_orderkey", "page"), ("cast(l_linenumber / 4 as int)", "line_num_"),
    ("cast(floor(l_linenumber / 4.0) as int)", "line_num"), ("1", "block_num"), ("1", "par_num"),
    ("cast(l_partkey as int)", "x"), ("cast(l_suppkey + 40 * l_linenumber as int)", "y"),
    ("cast(10 + l_quantity as int)", "w"), ("12 + l_linenumber", "h"),
    ("l_quantity * 2", "conf"), ("concat(l_returnflag, cast(l_partkey as string))", "text"),
    ("cast(round(l_extendedprice * 100) as bigint)", "tie"),
]], ["page", "block_num", "par_num", "line_num", "x", "y", "w", "h", "conf", "text", "tie"])

_SPECS["eval_cases"] = ("orders", [[
    ("o_custkey", "parent"), ("concat('P', cast(o_custkey % 400 as string))", "person_id"),
    ("case when o_orderpriority < '3' then 'PASSPORT' else 'VISA' end", "document_type"),
    ("case o_orderkey % 4 when 0 then 'REFERENCE' when 1 then 'VARIANT' when 2 then 'MUTATION' else 'DUPLICATE' end", "role"),
    ("case o_orderkey % 3 when 0 then 'SAME' when 1 then 'CROSS' else null end", "pair_kind"),
    ("case when o_totalprice > 300000 then 'MATCH' when o_totalprice > 150000 then 'BORDERLINE' else 'MISMATCH' end", "pair_result"),
    ("o_orderkey % 5", "mismatched_fields"), ("o_orderkey % 6 = 1", "zone_failed"), ("o_orderkey % 2", "zone_discrepancies"),
    ("o_totalprice / 5000", "tamper_score"),
    ("case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'UNABLE_TO_VERIFY' else null end", "status"),
    ("o_orderkey % 8 < 3", "anchored"), ("o_orderkey % 8 > 1", "verified"),
]], ["parent", "person_id", "document_type", "role", "pair_kind", "pair_result", "mismatched_fields", "zone_failed",
     "zone_discrepancies", "tamper_score", "status", "anchored", "verified"])

_SPECS["regions"] = ("part", [[
    ("p_partkey", "id"),
    ("concat(case when p_partkey % 5 = 0 then 'media_' else '' end, replace(p_name, ' ', '_'), case when p_partkey % 3 = 0 "
     "then concat(' (', cast(p_partkey % 4 as string), ')') else '' end, '.jpg')", "filename"),
    ("case when p_partkey % 7 = 0 then 'VISA_VARIANT' else 'IDENTITY_PAGE' end", "role"),
]], ["id", "filename", "role"])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided or derived table as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    source, stages, keep = _SPECS[name]
    df = frame(spark, sf_dir, source)
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} as {n}" for e, n in stage if e != n])
    return df.select(*keep) if keep else df


def _sql(name: str) -> str:
    if name in TABLES:
        return f"select * from {name}"
    source, stages, keep = _SPECS[name]
    text = source if source in TABLES else f"({_sql(source)})"
    text = f"select * from {text}"
    for stage in stages:
        cols = ", ".join(f"{e} as {n}" for e, n in stage if e != n)
        text = f"select *, {cols} from ({text})"
    if keep:
        text = f"select {', '.join(keep)} from ({text})"
    return text


def ctes(*names: str) -> str:
    """The named feeds as leading common table expressions."""
    return "with " + ", ".join(f"{n} as materialized ({_sql(n)})" for n in names)


def register(name: str, source: str, stages: list[list[tuple[str, str]]], keep: list[str] | None) -> None:
    """Add a derived table."""
    assert name not in _SPECS and name not in TABLES
    _SPECS[name] = (source, stages, keep)
