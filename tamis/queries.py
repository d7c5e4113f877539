"""Registered queries of the inspection engine, each over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from . import planted
from .functions import validators
from .operators import bands, detect, labels, lexicons, names, profiler
from .operators.literals import literals_in
from .operators.once import once
from .operators.verdict import COVERAGE_NOTE, inspect, profiles_long
from .plans.default_rules import DEFAULT_RULES as RULES
from .plans.rules import Node, Profile
from .sources import extract, formats
from .sources.files import inspect_files, read_verdicts, verdict_json
from .sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NAME = RULES.detector("person_name")
GATE = extract.ExtractOptions(max_bytes=4096, max_file_bytes=3000, window=1000)


def _query(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _detectors(*ids: str):
    return replace(RULES, detectors=tuple(d for d in RULES.detectors if d.id in ids))


# --- gates ---


@_query("SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit FROM documents")
def digit_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", detect.has_digit(F.col("text")).alias("has_digit"))


@_query("SELECT doc_id, contains(text, '@') AS at_sign, contains(text, 'http') AS http, (contains(text, 'AKIA') OR contains(text, 'token')) AS key_cue FROM documents")
def literal_prefilter(spark, sf_dir):
    found = literals_in(F.col("text"), ("@", "http", "AKIA", "token"))
    has = lambda *w: F.arrays_overlap("found", F.array(*map(F.lit, w)))
    return _docs(spark, sf_dir).select("doc_id", found.alias("found")).select("doc_id", has("@").alias("at_sign"), has("http").alias("http"), has("AKIA", "token").alias("key_cue"))


_KEYWORDS = [(d.id, d.keywords) for d in RULES.detectors if d.keywords]


@_query("SELECT doc_id, " + ", ".join(f"{sql._anywhere('lower(text)', [k.lower() for k in ks])} AS {i}" for i, ks in _KEYWORDS) + " FROM documents")
def keyword_anywhere(spark, sf_dir):
    found = literals_in(F.lower("text"), [k.lower() for _, ks in _KEYWORDS for k in ks])
    has = lambda ks: F.arrays_overlap("found", F.array(*[F.lit(k.lower()) for k in ks]))
    return _docs(spark, sf_dir).select("doc_id", found.alias("found")).select("doc_id", *[has(ks).alias(i) for i, ks in _KEYWORDS])


_GATED = [d for d in RULES.detectors if d.best_effort]


@_query("SELECT doc_id, " + ", ".join(f"({sql.guard(d)}) AS {d.id}" for d in _GATED) + " FROM documents")
def best_effort_gate(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", *[detect.guard(d, text, F.lower(text), detect.has_digit(text)).alias(d.id) for d in _GATED])


# --- matches ---

for _id in [d.id for d in RULES.detectors if d.kind == "regex"]:

    def _matches(spark, sf_dir, _id=_id):
        return detect.matches_long(planted.documents(spark, sf_dir), _detectors(_id))

    _matches.__name__ = f"matches_{_id}"
    _query(planted.over(sql.matches_long(RULES, [_id])))(_matches)


@_query(sql.matches_long(RULES))
def matches_all(spark, sf_dir):
    return detect.matches_long(_docs(spark, sf_dir), RULES)


@_query(planted.over(sql.matches_near(RULES)))
def matches_near_keywords(spark, sf_dir):
    """Keywords and matches as rows, joined by document and bucket of the window."""
    return bands.matches_near_keywords(planted.documents(spark, sf_dir), RULES).select("doc_id", "detector", "ord", "start", "near_keyword")


@_query(f"SELECT detector, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(DISTINCT doc_id) AS n_docs FROM ({sql.matches_long(RULES)}) GROUP BY detector")
def match_counts(spark, sf_dir):
    rows = detect.matches_long(_docs(spark, sf_dir), RULES)
    return rows.groupBy("detector").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.countDistinct("doc_id").alias("n_docs"))


@_query("SELECT doc_id, len(m)::BIGINT AS n, array_to_string(m[1:3], '|') AS samples FROM (SELECT doc_id, list_slice(regexp_extract_all(text, '[A-Za-z]+ing'), 1, 64) AS m FROM documents)")
def match_cap(spark, sf_dir):
    m = detect.all_matches(F.col("text"), "[A-Za-z]+ing")
    return _docs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("bigint").alias("n"), F.array_join(F.slice("m", 1, detect.SAMPLES), "|").alias("samples"))


#: What turns of conversations are given: an address or an identifier in every third.
_TURN_ENDS = [" Reach me at agent{}@example.org.", " Card 4111 1111 1111 1111, ref {}."]


def _turns(spark, sf_dir) -> DataFrame:
    end = F.when(F.col("conv_id") % 3 == 0, F.replace(F.lit(_TURN_ENDS[0]), F.lit("{}"), F.col("conv_id").cast("string")))
    end = end.when(F.col("conv_id") % 3 == 1, F.replace(F.lit(_TURN_ENDS[1]), F.lit("{}"), F.col("turn").cast("string"))).otherwise("")
    return _docs(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.concat("text", end).alias("text"))


_TURNS_SQL = f"(SELECT conv_id, turn, text || CASE conv_id % 3 WHEN 0 THEN replace({sql.q(_TURN_ENDS[0])}, '{{}}', conv_id::VARCHAR) WHEN 1 THEN replace({sql.q(_TURN_ENDS[1])}, '{{}}', turn::VARCHAR) ELSE '' END AS text FROM conversations)"


@_query("SELECT conv_id, turn, detector, ord, start, value, valid FROM (" + sql.matches_long(RULES).replace("doc_id", "conv_id, turn").replace("FROM documents", f"FROM {_TURNS_SQL}") + ")")
def conversation_matches(spark, sf_dir):
    rows = detect.matches_long(_turns(spark, sf_dir), RULES)
    return rows.select("doc_id.conv_id", "doc_id.turn", "detector", "ord", "start", "value", "valid")


# --- validators, over identifiers made from keys ---


# An identifier is told as parts, from which both sides are made: a text, ("pad", n, factor): the last n digits of the
# key times the factor, or ("letter", factor, alphabet).
_AZ, _VIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHJKLMNPRSTUVWXYZ0123456789X"
_HALF_VIN = [("letter", f, _VIN) for f in (1, 3, 7, 11, 13, 17, 19, 23)]
_IDENTIFIERS = {
    "luhn_check": ["4", ("pad", 15, 7_919_777_777)],
    "iban_mod97": ["GB", ("pad", 2, 17), "WEST", ("pad", 14, 1_234_577)],
    "aba_checksum": [("pad", 9, 48_611)],
    "vin_check": [*_HALF_VIN, ("letter", 29, "0123456789X"), *_HALF_VIN],
    "ssn_check": [("pad", 3, 37), "-", ("pad", 2, 13), "-", ("pad", 4, 7)],
    "ein_prefix": [("pad", 2, 1), "-", ("pad", 7, 31)],
    "npi_check": ["1", ("pad", 9, 7_919)],
    "dea_check": [("letter", 5, _AZ), ("letter", 3, _AZ + "9"), ("pad", 7, 104_729)],
    "itin_check": ["9", ("pad", 2, 3), "-", ("pad", 2, 7), "-", ("pad", 4, 11)],
    "sin_check": [("pad", 3, 11), " ", ("pad", 3, 13), " ", ("pad", 3, 17)],
    "nir_check": [("pad", 15, 98_765_432_1)],
    "de_tax_check": [("pad", 11, 86_028_157)],
    "es_dni_check": [("pad", 8, 15_485_863), ("letter", 1, validators.DNI_LETTERS)],
    "bsn_check": [("pad", 9, 15_485_867)],
}


def _column(part: str | tuple) -> Column:
    key = F.col("o_orderkey")
    if isinstance(part, str):
        return F.lit(part)
    if part[0] == "pad":
        return F.lpad((key * part[2] % 10 ** part[1]).cast("string"), part[1], "0")
    return F.substr(F.lit(part[2]), (key * part[1] % len(part[2]) + 1).cast("int"), F.lit(1))


def _sql(part: str | tuple) -> str:
    if isinstance(part, str):
        return sql.q(part)
    if part[0] == "pad":
        return f"lpad((o_orderkey * {part[2]} % {10 ** part[1]})::VARCHAR, {part[1]}, '0')"
    return f"substr('{part[2]}', (o_orderkey * {part[1]} % {len(part[2])} + 1)::INTEGER, 1)"


def _validator(name: str):
    def run(spark, sf_dir):
        value = F.concat(*map(_column, _IDENTIFIERS[name]))
        orders = _docs(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
        return orders.select("o_orderkey", "value", validators.run(name, F.col("value")).alias("valid"))

    run.__name__ = f"validator_{name}"
    return run


for _name, _parts in _IDENTIFIERS.items():
    _value = " || ".join(map(_sql, _parts))
    _query(f"SELECT o_orderkey, value, coalesce({sql.VALIDATORS[_name]('value')}, false) AS valid FROM (SELECT o_orderkey, {_value} AS value FROM orders)")(_validator(_name))


# --- scoring ---


@_query(sql.findings(RULES) + " SELECT * FROM findings")
def findings(spark, sf_dir):
    return detect.findings_long(_docs(spark, sf_dir), RULES)


@_query(sql.findings(RULES) + " SELECT detector, count(*) AS n, count(*) FILTER (fired) AS n_fired, max(confidence) AS best FROM findings GROUP BY detector")
def finding_counts(spark, sf_dir):
    rows = detect.findings_long(_docs(spark, sf_dir), RULES)
    return rows.groupBy("detector").agg(F.count("*").alias("n"), F.count_if("fired").alias("n_fired"), F.max("confidence").alias("best"))


# --- names ---


@_query(f"WITH {sql.TOKENS} SELECT doc_id, ord, token, start, capital FROM tokens")
def name_tokens(spark, sf_dir):
    return names.name_tokens(_docs(spark, sf_dir)).select("doc_id", "ord", "token", "start", "capital")


@_query(f"WITH {sql.RUNS} SELECT doc_id, ord, token, run::BIGINT AS run, place::BIGINT AS place FROM runs")
def name_runs(spark, sf_dir):
    runs = names.name_runs(names.name_tokens(_docs(spark, sf_dir)))
    return runs.select("doc_id", "ord", "token", F.col("run").cast("bigint").alias("run"), F.col("place").cast("bigint").alias("place"))


@_query(planted.over(f"WITH {sql.spans(RULES)} SELECT * FROM spans"))
def name_spans(spark, sf_dir):
    return names.name_spans(planted.documents(spark, sf_dir), NAME, RULES.confidence)


@_query(planted.over(f"WITH {sql.spans(RULES)} SELECT detector, count(*) AS n_docs, sum(raw_count)::BIGINT AS n_spans FROM name_docs GROUP BY detector"))
def name_docs(spark, sf_dir):
    fired = names.name_spans(planted.documents(spark, sf_dir), NAME, RULES.confidence).where("fired")
    return fired.groupBy(F.lit(NAME.id).alias("detector")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_spans"))


# --- word lists as tables, drawn from the corpus ---

_WORDS_SQL = "(SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) AS word FROM documents) GROUP BY word)"
_EVIDENCE_SQL = f"SELECT word FROM {_WORDS_SQL} WHERE length(word) % 3 < 2 AND n < 40"


def _corpus_evidence(docs: DataFrame) -> DataFrame:
    """Words of the texts by their length for names, and those of 40 documents or more for common words."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word"))
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    # A condition on the word alone would move beneath the counts, and each list would count the words of all texts anew.
    words = once(words, {"kind": F.when(F.col("n") >= 40, "common").when(F.length("word") % 3 == 0, "given").when(F.length("word") % 3 == 1, "surname")})
    of = lambda kind: words.where(F.col("kind") == kind)
    return lexicons.evidence_table(of("given"), of("surname"), of("common"))


@_query(planted.over(_EVIDENCE_SQL))
def corpus_evidence(spark, sf_dir):
    return _corpus_evidence(planted.documents(spark, sf_dir))


@_query(planted.over(f"WITH evidence AS ({_EVIDENCE_SQL}), {sql.spans(RULES, 'SELECT word FROM evidence')} SELECT * FROM spans"))
def corpus_name_spans(spark, sf_dir):
    """Names by lists of thousands of words, joined as a table."""
    docs = planted.documents(spark, sf_dir)
    return names.name_spans(docs, NAME, RULES.confidence, evidence=_corpus_evidence(docs))


# --- profiles and verdicts ---


@_query(planted.over(sql.findings(RULES) + " SELECT * FROM findings"))
def planted_findings(spark, sf_dir):
    return detect.findings_long(planted.documents(spark, sf_dir), RULES)


@_query(planted.over(sql.profiles(RULES) + " SELECT doc_id, profile_id, verdict_on_match, confidence, ['ALLOW', 'ESCALATE', 'BLOCK'][severity + 1] AS disposition FROM profiles"))
def planted_profiles(spark, sf_dir):
    return profiles_long(planted.documents(spark, sf_dir), RULES)


@_query(planted.over(sql.verdicts(RULES) + " SELECT doc_id, verdict, profiles, bytes_seen FROM verdicts"))
def planted_verdict(spark, sf_dir):
    """With labels in some texts, which raise the verdict."""
    found = F.array_join(F.array_sort(F.col("profiles.profile_id")), ",")
    return inspect(planted.documents(spark, sf_dir), RULES).select("doc_id", "verdict", found.alias("profiles"), "bytes_seen")


@_query(planted.over(sql.findings(RULES) + " SELECT doc_id, string_agg(detector || ':' || raw_count || ':' || validated_count || ':' || confidence, ',' ORDER BY confidence DESC, detector) AS detectors FROM findings WHERE fired GROUP BY doc_id"))
def fired_detectors(spark, sf_dir):
    """The fired detectors of each document in their order."""
    told = F.transform("detectors", lambda x: F.concat_ws(":", x["id"], x["raw_count"], x["validated_count"], x["confidence"]))
    return inspect(planted.documents(spark, sf_dir), RULES).where(F.size("detectors") > 0).select("doc_id", F.array_join(told, ",").alias("detectors"))


@_query(planted.over(sql.verdicts(RULES) + " SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ALLOW' ELSE 'ESCALATE' END WHEN doc_id % 3 = 0 AND verdict = 'ALLOW' THEN 'ESCALATE' ELSE verdict END AS verdict, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unsupported: none' ELSE 'cannot be read' END WHEN doc_id % 3 = 0 AND verdict = 'ALLOW' THEN " + sql.q(COVERAGE_NOTE) + " END AS note FROM verdicts"))
def coverage_verdict(spark, sf_dir):
    """Documents of which only a part was seen, and documents without a text."""
    docs = planted.documents(spark, sf_dir)
    error = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 2 == 0, "unsupported: none").otherwise("cannot be read"))
    docs = docs.withColumns({"part": F.col("doc_id") % 3 == 0, "error": error})
    return inspect(docs, RULES, partial="part", error="error").select("doc_id", "verdict", "note")

_DISPOSITION = "['ALLOW', 'ESCALATE', 'BLOCK'][severity + 1]"


@_query(sql.profiles(RULES) + f" SELECT doc_id, profile_id, verdict_on_match, confidence, {_DISPOSITION} AS disposition FROM profiles")
def profiles(spark, sf_dir):
    return profiles_long(_docs(spark, sf_dir), RULES)


@_query(sql.profiles(RULES) + " SELECT profile_id, count(*) AS n, max(confidence) AS best FROM profiles GROUP BY profile_id")
def profile_counts(spark, sf_dir):
    return profiles_long(_docs(spark, sf_dir), RULES).groupBy("profile_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def _verdicts(spark, sf_dir) -> DataFrame:
    return inspect(_docs(spark, sf_dir), RULES)


@_query(sql.verdicts(RULES) + " SELECT doc_id, verdict, profiles, bytes_seen FROM verdicts")
def verdict(spark, sf_dir):
    found = F.array_join(F.array_sort(F.col("profiles.profile_id")), ",")
    return _verdicts(spark, sf_dir).select("doc_id", "verdict", found.alias("profiles"), "bytes_seen")


@_query(sql.verdicts(RULES) + " SELECT v AS verdict, count(verdict) AS n, (count(verdict) * 10000 // sum(count(verdict)) OVER ())::BIGINT AS share, place::BIGINT AS place FROM (SELECT unnest(['ALLOW', 'ESCALATE', 'BLOCK']) AS v, unnest([0, 1, 2]) AS place) LEFT JOIN verdicts ON v = verdict GROUP BY v, place")
def verdict_counts(spark, sf_dir):
    return profiler.verdict_counts(_verdicts(spark, sf_dir))


@_query(sql.verdicts(RULES) + " SELECT lang, verdict, count(*) AS n, max(bytes_seen) AS largest FROM verdicts GROUP BY lang, verdict")
def verdict_by_lang(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("lang", "verdict").agg(F.count("*").alias("n"), F.max("bytes_seen").alias("largest"))


@_query(f"SELECT doc_id, marker_id, label FROM ({sql.labels(RULES).replace('FROM documents', 'FROM marked')})".replace("SELECT doc_id, marker_id, label FROM (", "WITH marked AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' TOP SECRET' WHEN 1 THEN ' Top Secret, Highly Confidential' ELSE '' END AS text FROM documents) SELECT doc_id, marker_id, label FROM (", 1))
def body_labels(spark, sf_dir):
    added = F.when(F.col("doc_id") % 5 == 0, " TOP SECRET").when(F.col("doc_id") % 5 == 1, " Top Secret, Highly Confidential").otherwise("")
    docs = _docs(spark, sf_dir).select("doc_id", F.concat("text", added).alias("text"))
    return docs.select("doc_id", F.explode(labels.body_labels(F.col("text"), RULES)).alias("x")).select("doc_id", "x.marker_id", "x.label")


# --- extraction ---

_STRIP = r"regexp_replace(regexp_replace(html, '<[^<>]*', ' ', 'g'), '>', '', 'g')"
_DECODE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@_query(f"SELECT page_id, {_DECODE.format(_STRIP)} AS text FROM pages")
def strip_markup(spark, sf_dir):
    return _docs(spark, sf_dir, "pages").select("page_id", extract.strip_markup(F.col("html")).alias("text"))


@_query(f"SELECT page_id, {_DECODE.format('html')} AS html FROM pages")
def entity_decode(spark, sf_dir):
    return _docs(spark, sf_dir, "pages").select("page_id", extract.decode_entities(F.col("html")).alias("html"))


@_query(f"SELECT doc_id, CASE WHEN strlen(t) > {GATE.max_file_bytes} THEN left(t, {GATE.window}) || {sql.q(extract.GAP)} || right(t, {GATE.window}) ELSE t END AS seen, strlen(t) > {GATE.max_file_bytes} AS partial FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS t FROM documents)")
def size_gate(spark, sf_dir):
    ascii_text = F.regexp_replace("text", "[^\\x01-\\x7f]", "?").cast("binary")
    docs = _docs(spark, sf_dir).select("doc_id", ascii_text.alias("t"))
    return docs.select("doc_id", extract.head_tail(F.col("t"), GATE).cast("string").alias("seen"), (F.octet_length("t") > GATE.max_file_bytes).alias("partial"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'encrypted' ELSE 'plaintext' END AS kind FROM documents")
def format_magic(spark, sf_dir):
    head = F.when(F.col("doc_id") % 4 == 0, F.lit(b"%PDF-1.7 ")).when(F.col("doc_id") % 4 == 1, F.lit(b"PK\x03\x04")).when(F.col("doc_id") % 4 == 2, F.lit(b"\xd0\xcf\x11\xe0")).otherwise(F.lit(b""))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))
    return docs.select("doc_id", formats.magic(F.col("content")).alias("kind"))


# --- files ---

_FILE_KIND = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {sql.q(k)}" for i, k in enumerate(planted.KINDS)) + " END"
_FILE_VERDICT = "CASE WHEN doc_id % 10 = 2 THEN 'BLOCK' ELSE verdict END"


@_query(planted.over_files(sql.verdicts(RULES) + f" SELECT doc_id, {_FILE_KIND} AS file_type, {_FILE_VERDICT} AS verdict, profiles, bytes_seen, (doc_id % 10 = 2)::INTEGER AS n_metadata FROM verdicts"))
def file_verdicts(spark, sf_dir):
    """From the bytes of plain, Office and PDF files to their verdicts."""
    verdicts = inspect_files(planted.files(spark, sf_dir), RULES)
    found = F.array_join(F.array_sort(F.col("profiles.profile_id")), ",")
    labelled = F.size(F.filter("labels", lambda x: x["source"] == "metadata"))
    return verdicts.select("doc_id", "file_type", "verdict", found.alias("profiles"), "bytes_seen", labelled.alias("n_metadata"))


@_query(planted.over_files(f"SELECT doc_id, {_FILE_KIND} AS file_type, md5(text) AS text_md5, false AS partial FROM documents"))
def file_texts(spark, sf_dir):
    """What extraction finds in the same files."""
    texts = extract.extracted(planted.files(spark, sf_dir), RULES)
    return texts.select("doc_id", "file_type", F.md5(F.col("text").cast("binary")).alias("text_md5"), "partial")


_XML = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PART_ROWS = [
    (1, 0, "word/document.xml", f"'<w:document><w:t>' || {_XML} || '</w:t></w:document>'", "true"),
    (2, 0, "docProps/custom.xml", sql.q(planted.PROPERTY), "doc_id % 10 = 2"),
    (2, 1, "xl/sharedStrings.xml", f"'<t>' || {_XML} || '</t>'", "doc_id % 10 = 2"),
    (2, 0, "xl/sharedStrings.xml", f"'<t>' || {_XML} || '</t>'", "doc_id % 10 <> 2"),
    (4, 0, "ppt/slides/slide1.xml", f"'<a:t>' || {_XML} || '</a:t>'", "true"),
]


@_query(planted.over(" UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {sql.q(n)} AS part, md5({x}) AS xml_md5, false AS cut FROM documents WHERE doc_id % 5 = {k} AND {w}" for k, i, n, x, w in _PART_ROWS)))
def office_parts(spark, sf_dir):
    """The parts of the Office files, from the table function in a lateral join."""
    extract.office_parts(spark)
    files = planted.files(spark, sf_dir).withColumn("file_type", formats.file_type(F.col("content")))
    rows = spark.sql("SELECT f.doc_id, p.* FROM {files} f, LATERAL office_parts(f.content, f.file_type) p", files=files)
    return rows.select("doc_id", "ord", "part", F.md5(F.col("xml").cast("binary")).alias("xml_md5"), "cut")


_STORED = f"SELECT doc_id, {_FILE_KIND} AS file_type, {_FILE_VERDICT} AS verdict, bytes_seen FROM verdicts"


@_query(planted.over_files(sql.verdicts(RULES) + f" SELECT file_type, verdict, count(*) AS n, sum(bytes_seen)::BIGINT AS total FROM ({_STORED}) GROUP BY file_type, verdict"))
def stored_verdicts(spark, sf_dir):
    """A report on verdicts that were put into JSON texts and read again."""
    stored = verdict_json(inspect_files(planted.files(spark, sf_dir), RULES))
    verdicts = read_verdicts(stored, more="doc_id bigint")
    return verdicts.groupBy("file_type", "verdict").agg(F.count("*").alias("n"), F.sum("bytes_seen").alias("total"))


@_query("SELECT count(*) AS n, sum(strlen(text))::BIGINT AS total, count(*) AS n_measured FROM documents")
def measured(spark, sf_dir):
    """How many of the verdicts have a measured time; the times themselves differ from run to run."""
    verdicts = inspect(_docs(spark, sf_dir), RULES, micros=True)
    return verdicts.agg(F.count("*").alias("n"), F.sum("bytes_seen").alias("total"), F.count_if(F.col("micros") >= 0).alias("n_measured"))


_EXPECTED = "CASE WHEN doc_id % 39 IN (0, 10, 32) THEN 'BLOCK' WHEN doc_id % 39 IN (36, 37) THEN 'ESCALATE' ELSE 'ALLOW' END"


@_query(planted.over(sql.verdicts(RULES) + f""", expected AS (
    SELECT CASE WHEN doc_id % 50 = 49 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, {_EXPECTED} AS verdict, CASE WHEN doc_id % 39 IN (0, 10) THEN 'US_PII' WHEN doc_id % 39 = 32 THEN 'PHI_HIPAA' END AS profile FROM documents WHERE doc_id % 50 <> 48
), both_sides AS (
    SELECT coalesce(v.doc_id, e.doc_id) AS doc_id, v.verdict, e.verdict AS expected_verdict,
           CASE WHEN e.profile IS NOT NULL AND NOT list_contains(string_split(coalesce(v.profiles, ''), ','), e.profile) THEN e.profile ELSE '' END AS missing,
           array_to_string(list_filter(string_split(coalesce(v.profiles, ''), ','), lambda p: p <> '' AND p <> coalesce(e.profile, '')), ',') AS extra
    FROM verdicts v FULL OUTER JOIN expected e USING (doc_id)
) SELECT *, CASE WHEN verdict IS NULL THEN 'absent' WHEN expected_verdict IS NULL THEN 'unexpected' WHEN verdict <> expected_verdict THEN 'differs' WHEN missing <> '' THEN 'missing' ELSE 'ok' END AS status FROM both_sides"""))
def expectations(spark, sf_dir):
    """Verdicts held against what the planted lines should give; some are expected of no document, some of none."""
    docs = planted.documents(spark, sf_dir)
    must = F.when(F.expr("doc_id % 39 in (0, 10)"), F.array(F.lit("US_PII"))).when(F.expr("doc_id % 39 = 32"), F.array(F.lit("PHI_HIPAA"))).otherwise(F.array().cast("array<string>"))
    key = F.when(F.expr("doc_id % 50 = 49"), F.col("doc_id") + 10000000).otherwise(F.col("doc_id"))
    expected = docs.where("doc_id % 50 <> 48").select(key.alias("doc_id"), F.expr(_EXPECTED).alias("verdict"), must.alias("profiles"))
    report = profiler.expectation_report(inspect(docs, RULES), expected, "doc_id")
    joined = {c: F.array_join(c, ",") for c in ("missing", "extra")}
    return report.withColumns(joined)


# --- reports ---


@_query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_type(spark, sf_dir):
    return profiler.type_counts(_docs(spark, sf_dir), "source")


@_query("WITH v AS (SELECT list_sort(list(n_chars)) AS l FROM documents WHERE n_chars IS NOT NULL) SELECT q, l[floor((len(l) - 1) * q)::BIGINT + 1] AS value FROM v, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q)")
def floor_percentiles(spark, sf_dir):
    return profiler.floor_percentiles(_docs(spark, sf_dir), "n_chars")


@_query("SELECT count(n_chars) AS n, sum(n_chars)::BIGINT AS total, (sum(n_chars) // count(n_chars))::BIGINT AS mean, max(n_chars) AS max FROM documents")
def size_summary(spark, sf_dir):
    return profiler.size_summary(_docs(spark, sf_dir), "n_chars")


@_query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def topk_largest(spark, sf_dir):
    return profiler.top_k(_docs(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id", 10)


# --- rules ---


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(sql.q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


@_query("SELECT word FROM (SELECT word FROM " + _values([(w,) for w in sorted(NAME.dictionary.given_names)]) + " g(word) UNION SELECT word FROM " + _values([(w,) for w in sorted(NAME.dictionary.surnames)]) + " s(word) EXCEPT SELECT word FROM " + _values([(w,) for w in sorted(NAME.dictionary.common_words)]) + " c(word))")
def lexicon_evidence(spark, sf_dir):
    words = NAME.dictionary
    table = lambda values: spark.createDataFrame([(w,) for w in sorted(values)], "word string")
    return table(words.given_names).union(table(words.surnames)).distinct().join(table(words.common_words), "word", "left_anti")


@_query("SELECT compat, count(*) AS n FROM " + _values([(d.id, d.compat) for d in RULES.detectors]) + " d(id, compat) GROUP BY compat")
def compat_report(spark, sf_dir):
    return profiler.compat_report(spark, RULES)


_BROKEN = replace(RULES, profiles=(*RULES.profiles, Profile("DRAFT", Node("or", of=(Node("detector", "email"), Node("detector", "retired_detector"))))))
_REFERENCES = [(p.id, r) for p in _BROKEN.profiles for r in sorted(p.match.references())]


@_query("SELECT profile_id, detector FROM " + _values(_REFERENCES) + " r(profile_id, detector) ANTI JOIN " + _values([(d.id,) for d in RULES.detectors]) + " d(detector) USING (detector)")
def unresolved_references(spark, sf_dir):
    return profiler.unresolved_references(spark, _BROKEN)
