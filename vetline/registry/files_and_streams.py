"""Files, stored tables and streams. Files are written from the given tables first and read back."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline import schemas
from vetline.feeds import ctes, frame

from vetline.registry.audit import _WITH_CHAIN
from vetline.registry.core import ORACLES, query
from vetline.session import scratch_path, stored
from vetline.sources import files, tables
from vetline.streaming import operators as st

FOLDERS = 1000


def _manifest(spark, sf_dir):
    s = frame(spark, sf_dir, "screenings")
    return s.select(
        F.concat(F.lit("CASE-"), F.col("id").cast("string")).alias("case_id"), F.lit("x, \"y\"").alias("description"),
        "document_type", F.col("status").alias("category"), F.col("risk_band").alias("expected_risk"),
        F.lit("NONE").alias("tamper_type"), F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".jpg")).alias("doc_path"),
        F.lit("s.jpg").alias("selfie_path"), F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("image_id"),
        F.col("risk_score").alias("not_in_manifest"))


@query("manifest_round_trip", "IO-1 IO-6", ctes("screenings") + """
select 'CASE-' || id case_id, id || '.jpg' image_id, document_type, status category, risk_band expected_risk, 'NONE' tamper_type,
 'a/' || id || '.jpg' doc_path, 's.jpg' selfie_path, 'x, "y"' description from screenings""")
def _(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    tables.write_manifest(_manifest(spark, sf_dir), path)
    return files.read_manifest(spark, path)


@query("nested_records", "IO-2 IO-7", """
select '1.0' version, 'DOC-' || doc_id internal_id, 'PERSON-' || source person_id, sha256(text) sha256_hash, lang = 'en' has_mrz,
 'AVAILABLE' surname from documents""")
def _(spark, sf_dir):
    path = scratch_path(spark, "records")
    rec = F.struct(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("internal_id"),
        F.concat(F.lit("PERSON-"), "source").alias("person_id"), F.lit("PASSPORT").alias("document_type"),
        F.sha2("text", 256).alias("sha256_hash"), (F.col("lang") == "en").alias("has_mrz"),
        F.struct(F.lit("AVAILABLE").alias("surname")).alias("field_availability"))
    tables.write_json(frame(spark, sf_dir, "documents").select(
        F.lit("1.0").alias("version"), F.lit(1).alias("total_records"), F.array(rec).alias("records")), path)
    r = files.read_records(spark, path, multi_line=False)
    return r.select("version", "internal_id", "person_id", "sha256_hash", "has_mrz",
                    F.col("field_availability").getItem("surname").alias("surname"))


@query("rule_catalogue_counts", "IO-3", ctes("findings") + """
select rule_id, category, min(severity) severity, count(*) n from findings group by 1, 2""")
def _(spark, sf_dir):
    path = scratch_path(spark, "rules")
    f = frame(spark, sf_dir, "findings")
    rules = f.groupBy("rule_id", "category").agg(F.min("severity").alias("severity"))
    tables.write_json(rules.select(F.lit("PASSPORT").alias("document_type"), F.array(
        F.struct("rule_id", "category", "severity")).alias("rules")), path)
    catalogue = files.read_rules(spark, path, multi_line=False).select("rule_id", "category", "severity")
    return f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).join(catalogue, "rule_id").select(
        "rule_id", "category", "severity", "n")


@query("file_inventory", "IO-4", """
select 'p' || page_id || '.html' filename, 'in/' || page_id % 7 || '/p' || page_id || '.html' "path", octet_length(encode(html)) length, sha256(html) sha256 from pages""")
def _(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.lit("in/"), (k % 7).cast("string"), F.lit("/p"), k.cast("string"), F.lit(".html"))
    return files.digests(frame(spark, sf_dir, "pages").select(path.alias("path"), F.encode("html", "UTF-8").alias("content")))


@query("stored_file_inventory", "IO-4", """
select page_id, octet_length(encode(html || chr(10))) length, sha256(html || chr(10)) sha256, min(page_id) over (partition by html) first_page from pages""")
def _(spark, sf_dir):
    """The pages as files, one a page, found and hashed by the reader of files."""
    path = scratch_path(spark, "files")
    name = F.concat_ws("/", F.pmod("page_id", F.lit(FOLDERS)), F.concat("page_id", F.lit(".txt")))
    line = F.encode(F.concat(F.coalesce("html", F.lit("")), F.lit("\n")), "UTF-8")
    files.write_files(frame(spark, sf_dir, "pages").repartition("page_id").select(name.alias("name"), line.alias("content")), path)
    # two readers follow: the files are read once
    found = stored(files.chunked_inventory(spark, [path], ["txt"]).select(
        F.regexp_extract("filename", r"^(-?\d+)\.txt$", 1).cast("long").alias("page_id"), "length", "sha256"), "inventory")
    first = found.groupBy("sha256").agg(F.min("page_id").alias("first_page"))
    return found.join(first, "sha256").select("page_id", "length", "sha256", "first_page")


@query("file_admission", "IO-10 SF-12", """
select page_id, case when page_id % 8 = 0 then 'EMPTY' when page_id % 5 = 4 then 'EXTENSION' when page_id % 7 = 3 then 'CONTENT' end refused,
 case when page_id % 8 = 0 or page_id % 5 = 4 or page_id % 7 = 3 then null when page_id % 3 = 0 then 'image/jpeg' when page_id % 3 = 1 then 'image/png'
 else 'image/webp' end media_type from pages""")
def _(spark, sf_dir):
    k = F.col("page_id")
    magic = F.when(k % 7 == 3, "00").when(k % 3 == 0, files.JPEG_MAGIC).when(k % 3 == 1, files.PNG_MAGIC).otherwise(
        files.RIFF_MAGIC + "00000000" + files.WEBP_MARK)
    pages = frame(spark, sf_dir, "pages").select(
        "page_id", F.when(k % 8 == 0, F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(magic), F.encode("html", "UTF-8"))).alias("content"),
        F.concat(F.lit("in/../p "), k.cast("string"), F.when(k % 5 == 4, ".pdf").when(k % 5 == 3, ".JPG").otherwise(".png")).alias("filename"))
    return files.admit(pages).select("page_id", "refused", "media_type")


@query("typed_table_scan", "IO-5", ctes("watchlist") + """
select document_id, full_name, risk_category, status, cast(null as varchar) nationality from watchlist""")
def _(spark, sf_dir):
    base = scratch_path(spark, "tables")
    frame(spark, sf_dir, "watchlist").write.parquet(f"{base}/reference_watchlist")
    return tables.load(spark, base, "reference_watchlist").select(
        "document_id", "full_name", "risk_category", "status", "nationality")


def _older(schema):
    """The columns that files of an older version hold: all but the last."""
    return schema.fields[:-1]


# one value per type, and the text it has after the round trip, in SQL of both engines
_VALUES = {"integer": "c_custkey", "bigint": "c_custkey", "string": "'{n} ' || c_custkey", "double": "c_custkey * 0.5D",
           "boolean": "c_custkey % 2 = 0", "timestamp": "null"}
_TEXTS = {"integer": "cast(c_custkey as varchar)", "string": "'{n} ' || c_custkey", "double": "cast(c_custkey as varchar)",
          "boolean": "cast(1 - c_custkey % 2 as varchar)"}


def _texts(schema):
    return ", ".join(_TEXTS[f.dataType.typeName()].format(n=f.name) for f in _older(schema) if f.dataType.typeName() in _TEXTS)


@query("typed_table_round_trip", "IO-5", " union all ".join(
    f"select '{name}' table_name, concat_ws('|', {_texts(schema)}) body from customer" for name, schema in schemas.TABLES.items()))
def _(spark, sf_dir):
    base = scratch_path(spark, "typed")
    out = []
    for name, schema in schemas.TABLES.items():
        values = [f"cast({_VALUES[f.dataType.typeName()].format(n=f.name)} as {f.dataType.simpleString()}) as `{f.name}`" for f in _older(schema)]
        frame(spark, sf_dir, "customer").selectExpr(*values).write.parquet(f"{base}/{name}")
        kinds = {f.name: f.dataType.typeName() for f in schema.fields}
        text = [(F.col(c) * 2).cast("bigint").cast("string") if k == "double" else F.col(c).cast("int").cast("string") if k == "boolean"
                else F.col(c).cast("string") for c, k in kinds.items()]
        out.append(tables.load(spark, base, name).select(F.lit(name).alias("table_name"), F.concat_ws("|", *text).alias("body")))
    return reduce(DataFrame.unionByName, out)


@query("stored_case_tables", "IO-8", ctes("screenings", "forensic_scores") + """
select id screening_id, 'screenings' section, cast(date_trunc('year', created_at) as date) period, status detail from screenings
union all select id, 'tamper_findings', cast(date_trunc('year', created_at) as date), 'ELA' from forensic_scores join screenings using (id) where ela >= 40
union all select id, 'tamper_findings', cast(date_trunc('year', created_at) as date), 'NOISE_RESIDUAL' from forensic_scores join screenings using (id) where noise >= 40""")
def _(spark, sf_dir):
    base = scratch_path(spark, "cases")
    f = frame(spark, sf_dir, "forensic_scores")

    def one(name, column):
        return F.when(F.col(column) >= 40, F.struct(F.lit(name).alias("technique"), F.col(column).alias("score")))
    wide = frame(spark, sf_dir, "screenings").join(f.select("id", F.array_compact(F.array(
        one("ELA", "ela"), one("NOISE_RESIDUAL", "noise"))).alias("tamper_findings")), "id")
    # two batches, the second sent twice
    half = F.col("id") % 2 == 0
    for batch, part in (("even", wide.filter(half)), ("odd", wide.filter(~half)), ("odd", wide.filter(~half))):
        tables.write_screenings(part, base, batch, period="year")
    parent = tables.read_screenings(spark, base).select(
        F.col("id").alias("screening_id"), F.lit("screenings").alias("section"), "period", F.col("status").alias("detail"))
    child = tables.read_screenings(spark, base, "tamper_findings").select(
        "screening_id", F.lit("tamper_findings").alias("section"), "period", F.col("technique").alias("detail"))
    return parent.unionByName(child)


@query("evolved_rows", "IO-11 SO-1", ctes("screenings") + """
select id, status, 'GOOD' quality_status, cast(null as varchar) provider from screenings
union all select id, 'NEW', 'POOR', 'sface' from screenings""")
def _(spark, sf_dir):
    s = frame(spark, sf_dir, "screenings")
    target = schemas._schema("id bigint, status string, quality_status string, provider string")
    old = schemas.evolve(s.select("id", "status"), target)
    new = s.select(F.lit("sface").alias("provider"), "id", F.lit("POOR").alias("quality_status"), F.lit("NEW").alias("status"))
    return old.unionByName(schemas.evolve(new, target))


# -- streams ------------------------------------------------------------------------------

def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # the glob meets a table that is one file as well as one that is a folder of part files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def _audit_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain_id"), F.col("event_id").alias("id"), "ts",
        F.concat(F.lit("SYSTEM_"), F.upper("event_type")).alias("actor"), "event_type", F.col("props").alias("payload"))


@query("throttle_stream", "ST-1", ORACLES["throttle_accepted_only"])
def _(spark, sf_dir):
    s = _stream(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return st.throttle_stream(s, "user_id", "event_id", "ts", 3, 6 * 3600, scratch_path(spark, "throttle"),
                              scratch_path(spark, "throttle-ckpt")).select("user_id", "event_id", "accepted")


@query("audit_chain_stream", "ST-2", _WITH_CHAIN + " select chain_id, id, payload_hash, previous_hash, event_hash from chain")
def _(spark, sf_dir):
    return st.chain_stream(_audit_stream(spark, sf_dir), scratch_path(spark, "chain"), scratch_path(spark, "chain-ckpt")).select(
        "chain_id", "id", "payload_hash", "previous_hash", "event_hash")


@query("anchor_stream", "ST-3 IO-9", """
with keyed as (select case when event_id % 11 = 3 then null else user_id end user_id, event_id from events)
select user_id, min(event_id) event_id, 1 n from keyed group by 1""")
def _(spark, sf_dir):
    """Some keys are null. Files come one by one, so of a table of several files the earliest file wins; its rows are in order of event_id."""
    keyed = F.when(F.col("event_id") % 11 != 3, F.col("user_id")).alias("user_id")
    s = _stream(spark, sf_dir, "events").select(keyed, "event_id", "ts")
    registered = st.anchor_stream(s, "user_id", scratch_path(spark, "anchors"), scratch_path(spark, "anchors-ckpt"), ["event_id"])
    return registered.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).cast("int").alias("n"))


@query("watchlist_stream", "ST-4 JN-1", ctes("watchlist") + """
select c_custkey doc_id, document_id document_number, full_name listed_name, risk_category
from customer join watchlist on document_id = 'Z' || lpad(cast(c_custkey as varchar), 7, '0')""")
def _(spark, sf_dir):
    docs = _stream(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.concat(F.lit("z "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("number"))
    hits = st.watch_stream(docs, frame(spark, sf_dir, "watchlist"), "number")
    return st.run_to_table(hits, scratch_path(spark, "watch"), scratch_path(spark, "watch-ckpt")).select(
        "doc_id", "document_number", "listed_name", "risk_category")



