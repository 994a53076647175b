"""Queries over lines, lineage, profiles, the lookup, the intake and the readings, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.jobs import exports
from rollcall.jobs import oracles as O
from rollcall.jobs.catalog import merged, query
from rollcall.jobs.views import view
from rollcall.operators import intake, lineage, lookup, people_index, profile, readings, screen
from rollcall.sources import lines as L
from rollcall.sources import tables, versions
from rollcall.sources.specs import BRIDGE, CONTACTS, GIGS, MEDIA_EXTENSIONS
from rollcall.streaming import stream

STEP = O.STEP
#: Lines in each file that a query writes for itself: many files, and files that have several splits.
FILE_LINES, LONG_FILE = 5000, 4_000_000

O.CTES += [
    ("parsed", r"""SELECT line_no, line, len(f) AS found, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
        FROM (SELECT line_no, line, regexp_extract_all(line || ',', '("(?:[^"]|"")*"|[^,"]*),', 1) AS f FROM raw_lines)"""),
    ("turned", "SELECT *, CASE WHEN found = 5 THEN f[3] END AS after FROM parsed WHERE line_no > 1"),
    ("scr", r"""SELECT line_no, line, f, found, after, CASE WHEN regexp_replace(line, '[,"\s]', '', 'g') = '' THEN 'blank_row'
        WHEN line = 'Name,Phone Number,City,Verified,Projects Completed' THEN 'repeated_header' WHEN found <> 5 THEN 'wrong_column_count' WHEN NOT regexp_matches(f[2], '\p{Nd}') THEN 'column_shift' ELSE 'staged' END AS verdict FROM turned"""),
    ("shifts", r"SELECT line_no, CASE WHEN regexp_matches(after, '\p{Nd}') THEN after END AS recovered FROM scr WHERE verdict = 'column_shift'"),
    ("shift_dupes", "SELECT s.line_no, s.recovered, (SELECT min(x.line_no) FROM scr x WHERE x.verdict = 'staged' AND lower(trim(x.f[2])) = lower(trim(s.recovered))) AS earlier_line FROM shifts s WHERE s.recovered IS NOT NULL"),
    ("line_issues", "SELECT 'contacts' AS source_file, line_no AS row_number, verdict AS issue_type, CASE WHEN verdict = 'column_shift' THEN 'Phone Number' END AS column_name, line AS raw_value, CASE WHEN verdict = 'column_shift' THEN 'flagged' ELSE 'skipped' END AS severity FROM scr WHERE verdict <> 'staged'"),
    ("phones", "SELECT primary_phone AS phone_key, person_id, full_name, source_origin, row_number() OVER (PARTITION BY primary_phone ORDER BY person_id) AS i FROM people WHERE primary_phone IS NOT NULL"),
    ("emails", "SELECT primary_email AS email_key, person_id, full_name, source_origin, row_number() OVER (PARTITION BY primary_email ORDER BY person_id) AS i FROM people WHERE primary_email IS NOT NULL"),
    ("checked", f"""SELECT n.*, CASE WHEN p.person_id IS NOT NULL THEN 'phone' WHEN e.person_id IS NOT NULL THEN 'email' END AS matched_on, coalesce(p.person_id, e.person_id) AS person_id,
          CASE WHEN p.person_id IS NOT NULL THEN p.full_name ELSE e.full_name END AS full_name, CASE WHEN phone IS NULL AND email IS NULL THEN 'rejected' WHEN coalesce(p.person_id, e.person_id) IS NULL THEN 'new' ELSE 'duplicate' END AS status,
          CASE WHEN phone IS NULL AND email IS NULL THEN 'neither phone nor email' WHEN n.phone_key IS NULL AND n.email_key IS NULL THEN 'no usable key' END AS note
        FROM (SELECT *, {O.phone("phone")} AS phone_key, {O.email("email")} AS email_key FROM incoming) n
        LEFT JOIN phones p ON p.phone_key = n.phone_key AND p.i = 1 LEFT JOIN emails e ON e.email_key = n.email_key AND e.i = 1"""),
    ("val", f"""SELECT *, CASE WHEN clean_name = '' THEN 'name_missing' WHEN length(clean_name) > 200 THEN 'name_too_long' WHEN typed_phone = '' THEN 'phone_missing' WHEN phone_key IS NULL THEN 'phone_too_short'
          WHEN original_filename = '' THEN 'file_missing' WHEN extension IS NULL THEN 'type_not_accepted' WHEN byte_size <= 0 THEN 'file_empty' WHEN byte_size > 26214400 THEN 'file_too_large' END AS reason
        FROM (SELECT *, {O.case_of(MEDIA_EXTENSIONS, 'media')} AS extension FROM (SELECT *, trim(name) AS clean_name, trim(phone) AS typed_phone, {O.phone("phone")} AS phone_key, lower(trim(split_part(content_type, ';', 1))) AS media, CASE WHEN capture_mode IN ('record', 'upload') THEN capture_mode ELSE 'upload' END AS mode FROM submissions))"""),
    ("acc", "SELECT v.*, p.person_id AS known FROM val v LEFT JOIN phones p ON p.phone_key = v.phone_key AND p.i = 1 WHERE v.reason IS NULL"),
    ("made", f"SELECT {4 * STEP} + row_number() OVER (ORDER BY created_seq, submission_id NULLS FIRST, phone_key) AS person_id, clean_name AS full_name, phone_key AS primary_phone, 'audio_app' AS source_origin, typed_phone AS raw_value FROM (SELECT *, row_number() OVER (PARTITION BY phone_key ORDER BY created_seq, submission_id NULLS FIRST) AS i FROM acc WHERE known IS NULL) WHERE i = 1"),
    ("att", "SELECT a.*, coalesce(a.known, m.person_id) AS person_id FROM acc a LEFT JOIN made m ON m.primary_phone = a.phone_key AND a.known IS NULL"),
    ("rd0", r"""SELECT *, CASE WHEN json_valid(probe_json) THEN CAST(probe_json AS JSON) END AS j FROM readings"""),
    ("rd1", r"""SELECT submission_id, byte_size, file_exists, decode_log, loudness_log, levels_log, json_extract_string(j, '$.streams[0].sample_rate') AS rate, json_extract_string(j, '$.streams[0].bit_rate') AS sbit, json_extract_string(j, '$.format.bit_rate') AS cbit,
          json_extract_string(j, '$.format.duration') AS dur, coalesce(file_exists AND json_extract(j, '$.streams[0]') IS NOT NULL, false) AS usable, substr(levels_log, instr(levels_log, 'Overall') + 7) AS overall, instr(levels_log, 'Overall') > 0 AS has_overall FROM rd0"""),
    ("rd2", rf"""SELECT submission_id, file_exists, usable, CASE WHEN file_exists THEN byte_size ELSE 0 END AS byte_size, sbit, cbit, CASE WHEN usable THEN {O.whole("rate")} END AS sample_rate_hz, CASE WHEN usable THEN {O.decimal("dur")} END AS declared_seconds,
          CASE WHEN usable THEN list_last(list_filter(list_transform(string_split(decode_log, 'time=')[2:], lambda p: try_cast(split_part(split_part(p, ' ', 1), ':', 1) AS DOUBLE) * 3600 + try_cast(split_part(split_part(p, ' ', 1), ':', 2) AS DOUBLE) * 60 + try_cast(split_part(split_part(p, ' ', 1), ':', 3) AS DOUBLE)), lambda s: s IS NOT NULL)) END AS decoded_seconds,
          CASE WHEN usable THEN try_cast(list_last(list_filter(list_transform(string_split(loudness_log, 'I:')[2:], lambda p: string_split_regex(trim(p), ' +')), lambda w: starts_with(w[2], 'LUFS')))[1] AS DOUBLE) END AS loudness_lufs,
          CASE WHEN usable AND has_overall AND contains(overall, 'RMS level dB:') THEN try_cast(split_part(trim(split_part(overall, 'RMS level dB:', 2)), ' ', 1) AS DOUBLE) END AS rms_level_db,
          CASE WHEN usable AND has_overall AND contains(overall, 'RMS through dB:') THEN try_cast(split_part(trim(split_part(overall, 'RMS through dB:', 2)), ' ', 1) AS DOUBLE) END AS rms_trough_db FROM rd1"""),
    ("rd3", rf"""SELECT *, CASE WHEN NOT usable THEN NULL WHEN sbit IS NOT NULL THEN CAST(floor({O.decimal("sbit")}) AS BIGINT) WHEN cbit IS NOT NULL THEN CAST(floor({O.decimal("cbit")}) AS BIGINT) WHEN duration_seconds > 0 THEN CAST(floor(byte_size * 8 / duration_seconds) AS BIGINT) END AS bitrate_bps,
          usable AND sbit IS NULL AND cbit IS NULL AND coalesce(duration_seconds > 0, false) AS bitrate_is_derived,
          CASE WHEN rms_level_db IS NOT NULL AND rms_trough_db IS NOT NULL AND rms_level_db <> '-inf'::DOUBLE THEN rms_level_db - CASE WHEN rms_trough_db = '-inf'::DOUBLE THEN -120.0::DOUBLE ELSE rms_trough_db END END AS noise_snr_db
        FROM (SELECT *, coalesce(declared_seconds, decoded_seconds) AS duration_seconds FROM rd2)"""),
    ("rd", """SELECT *, CASE WHEN NOT usable THEN NULL WHEN sbit IS NULL AND cbit IS NOT NULL THEN 'container' WHEN bitrate_is_derived THEN 'derived' END AS bitrate_note, CASE WHEN noise_snr_db >= 40 THEN 'clean' WHEN noise_snr_db >= 15 THEN 'fair' WHEN noise_snr_db IS NOT NULL THEN 'noisy' END AS quality_estimate,
          CASE WHEN NOT file_exists THEN 'file does not exist' WHEN NOT usable THEN 'no audio stream' ELSE nullif(array_to_string(list_filter([CASE WHEN sample_rate_hz IS NULL THEN 'no sample rate' END, CASE WHEN duration_seconds IS NULL THEN 'no duration' END, CASE WHEN bitrate_bps IS NULL THEN 'no bitrate' END,
            CASE WHEN loudness_lufs IS NULL THEN 'no loudness' END, CASE WHEN rms_level_db IS NULL THEN 'no level' END], lambda p: p IS NOT NULL), '; '), '') END AS problems FROM rd3"""),
]


# ---- lines and screening --------------------------------------------------------------


def written_lines(spark, rows, lines_a_file):
    """(line_no, at, value) as text files of ``part``s below a new folder, each in the order of its lines; their names are in that order too.

    A file is written by one task, which sorts its lines: ``lines_a_file`` bounds what that takes.
    """
    path = tables.scratch(spark, "lines")
    rows = rows.withColumn("part", F.lpad(F.floor((F.col("line_no") - 1) / lines_a_file).cast("string"), 12, "0"))
    rows.repartition("part").sortWithinPartitions("part", "line_no", "at").select("part", "value").write.partitionBy("part").text(path)
    return path


def read_from_lines(spark, rows, lines_a_file, read):
    """What ``read`` makes of the files' lines, in at least some dozen splits; the files are removed when it is written."""
    path, name = written_lines(spark, rows, lines_a_file), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    size = rows.agg(F.sum(F.length("value") + 1)).first()[0] or 0
    spark.conf.set(name, str(min(max(size // 16, 4096), 128 << 20)))
    try:
        return tables.durable(read(L.numbered_lines(spark, path)))
    finally:
        spark.conf.set(name, before)
        tables.removed(spark, path)


def raw_lines(spark, sf_dir):
    return view(spark, sf_dir, "raw_lines").select("line_no", F.lit(0).alias("at"), F.col("line").alias("value"))


def part_of(file):
    return F.regexp_extract(file, r"part=(\d+)", 1).cast("long")


@query(f"SELECT (line_no - 1) // {LONG_FILE} AS part, (line_no - 1) % {LONG_FILE} + 1 AS line_no, line FROM raw_lines")
def i01_physical_lines(spark, sf_dir):
    """Files of several splits."""
    return read_from_lines(spark, raw_lines(spark, sf_dir), LONG_FILE, lambda lines: lines.select(part_of(F.col("file")).alias("part"), "line_no", "line"))


@query(f"SELECT (line_no - 1) // {FILE_LINES} AS part, line = 'Name,Phone Number,City,Verified,Projects Completed' AS header_ok FROM raw_lines WHERE (line_no - 1) % {FILE_LINES} = 0")
def i02_header(spark, sf_dir):
    return read_from_lines(spark, raw_lines(spark, sf_dir), FILE_LINES, lambda lines: L.header_mismatches(lines, CONTACTS).select(part_of(F.col("file")).alias("part"), "header_ok"))


_FIELDS = ", ".join(f"coalesce(f[{i}], '') AS {name}" for i, name in enumerate(CONTACTS.columns, 1))


@query(f"SELECT (line_no - 1) // {LONG_FILE} AS part, (line_no - 1) % {LONG_FILE} + 1 AS line_no, {_FIELDS} FROM parsed")
def i03_fields(spark, sf_dir):
    def read(lines):
        rows = L.stitched(lines).withColumn("f", F.array(F.struct(L.cells(F.col("line")).alias("f"))))
        rows = rows.select("file", "line_no", F.inline("f")).withColumn("f", L.first_fields(F.col("f"), 5))
        return rows.select(part_of(F.col("file")).alias("part"), "line_no", *[F.col("f")[i].alias(name) for i, name in enumerate(CONTACTS.columns)])

    return read_from_lines(spark, raw_lines(spark, sf_dir), LONG_FILE, read)


#: Characters that a field may go on for in the planted files.
_SHORT_FIELD = 2000
O.CTES += [("quoted_rows", "SELECT *, CAST(sum(high) OVER (PARTITION BY part ORDER BY k) AS BIGINT) AS line_no FROM (SELECT *, k // 4000000 AS part FROM quoted)")]


@query("SELECT part, line_no, first, second, unclosed, CASE WHEN unclosed THEN 1 ELSE 2 END AS cells FROM quoted_rows")
def i15_quoted_records(spark, sf_dir):
    """Records with inch marks, quotes in the middle, doubled quotes at ends, line breaks, and quotes that never close."""

    def read(lines):
        rows = L.stitched(lines, field_limit=_SHORT_FIELD).select("file", "line_no", "unclosed", F.inline(F.array(F.struct(L.cells(F.col("line")).alias("c")))))
        return rows.select(part_of(F.col("file")).alias("part"), "line_no", F.col("c")[0].alias("first"), F.get("c", F.lit(1)).alias("second"), "unclosed", F.size("c").alias("cells"))

    planted = view(spark, sf_dir, "quoted").select((F.col("k") + 1).alias("line_no"), F.lit(0).alias("at"), F.col("text").alias("value"))
    return read_from_lines(spark, planted, 4_000_000, read)


# What ends a line besides LF and CR.
_ENDS = "[chr(11), chr(12), chr(28), chr(29), chr(30), chr(133), chr(8232), chr(8233), chr(13)]"
O.CTES += [("ended", f"SELECT k, text, CASE WHEN k % 3 = 0 THEN {_ENDS}[CAST(1 + k // 3 % 9 AS INT)] END AS e FROM (SELECT k, first || ' ' || CAST(k AS VARCHAR) AS text FROM quoted WHERE high = 1)")]


@query(
    """SELECT line_no - (CASE WHEN half = 0 AND e IS NOT NULL THEN 1 ELSE 0 END) AS line_no, CASE WHEN half = 1 THEN 'and ' || text WHEN e IS NULL OR e = chr(13) THEN text ELSE text || e END AS line
    FROM (SELECT *, CAST(sum(CASE WHEN e IS NULL THEN 1 ELSE 2 END) OVER (ORDER BY k) AS BIGINT) AS line_no FROM ended), (VALUES (0), (1)) v(half) WHERE half = 0 OR e IS NOT NULL"""
)
def i16_line_ends(spark, sf_dir):
    """Lines that end with VT, FF, FS, GS, RS, NEL, LS, PS or CR, numbered on from file to file."""
    ends = F.array(*[F.lit(c) for c in (*L.OTHER_ENDS, "\r")])
    rows = view(spark, sf_dir, "quoted").where("high = 1").select("k", F.concat("first", F.lit(" "), F.col("k").cast("string")).alias("text"))
    value = F.when(F.col("k") % 3 == 0, F.concat("text", F.element_at(ends, (F.floor(F.col("k") / 3) % 9 + 1).cast("int")), F.lit("and "), "text")).otherwise(F.col("text"))
    planted = rows.select((F.col("k") + 1).alias("line_no"), F.lit(0).alias("at"), value.alias("value"))
    found = read_from_lines(spark, planted, LONG_FILE, lambda lines: lines.select("file", "line_no", "line"))
    return L.source_wide(found, found).select("line_no", "line")


def screened(spark, sf_dir):
    return screen.screened(view(spark, sf_dir, "raw_lines"), CONTACTS)


@query("SELECT line_no, line FROM scr WHERE verdict = 'blank_row'")
def i04_blank_row(spark, sf_dir):
    return screened(spark, sf_dir).where("verdict = 'blank_row'").select("line_no", "line")


@query("SELECT line_no, line FROM scr WHERE verdict = 'repeated_header'")
def i05_repeated_header(spark, sf_dir):
    return screened(spark, sf_dir).where("verdict = 'repeated_header'").select("line_no", "line")


@query("SELECT line_no, CAST(5 AS BIGINT) AS expected, found FROM scr WHERE verdict = 'wrong_column_count'")
def i06_column_count(spark, sf_dir):
    return screened(spark, sf_dir).where("verdict = 'wrong_column_count'").select("line_no", F.lit(5).cast("long").alias("expected"), F.col("found").cast("long").alias("found"))


@query("SELECT line_no, f[2] AS key_value FROM scr WHERE verdict = 'column_shift'")
def i07_key_shape(spark, sf_dir):
    return screened(spark, sf_dir).where("verdict = 'column_shift'").select("line_no", F.col("fields")[1].alias("key_value"))


@query("SELECT line_no, recovered FROM shifts")
def i08_repair_probe(spark, sf_dir):
    return screened(spark, sf_dir).where("verdict = 'column_shift'").select("line_no", "recovered")


@query("SELECT line_no, recovered, earlier_line FROM shift_dupes WHERE earlier_line < line_no")
def i09_recovered_key(spark, sf_dir):
    return screen.shift_duplicates(screened(spark, sf_dir), CONTACTS).drop("file")


@query("SELECT line_no, verdict FROM scr")
def i10_verdict(spark, sf_dir):
    return screened(spark, sf_dir).select("line_no", "verdict")


@query("SELECT s AS source_file, count(*) AS read, count(*) FILTER (WHERE verdict = 'staged') AS loaded, count(*) FILTER (WHERE verdict <> 'staged') AS skipped FROM scr, (VALUES ('contacts'), ('TOTAL')) v(s) GROUP BY s")
def i11_load_summary(spark, sf_dir):
    return screen.load_summary(screened(spark, sf_dir), "contacts")


@query("SELECT severity, issue_type, count(*) AS n FROM line_issues GROUP BY ALL")
def i12_issue_counts(spark, sf_dir):
    return screen.issue_counts(screen.issues(screened(spark, sf_dir), CONTACTS))


@query("SELECT *, 'ingest' AS phase FROM line_issues UNION ALL SELECT *, 'merge' FROM merge_issues")
def i13_idempotent_write(spark, sf_dir):
    path = tables.scratch(spark, "issues")
    ingest, merge = screen.issues(screened(spark, sf_dir), CONTACTS).drop("file"), merged(spark, sf_dir).issues()
    tables.write_phase(ingest, path, "ingest")
    tables.write_phase(merge, path, "merge")
    tables.write_phase(ingest, path, "ingest")  # a rerun replaces its own rows only
    out = tables.durable(spark.read.parquet(path).drop("action_taken"))
    tables.removed(spark, path)
    return out


O.CTES += [
    ("people_p", "SELECT * REPLACE (CASE WHEN person_id % 50 = 7 THEN 'gross' ELSE ctc_source_unit END AS ctc_source_unit, CASE WHEN person_id % 60 = 11 THEN 'daily' ELSE rate_period END AS rate_period, CASE WHEN person_id % 70 = 13 THEN NULL ELSE source_origin END AS source_origin) FROM people"),
    ("people_v", "SELECT * FROM people_p UNION ALL SELECT * FROM people_p WHERE person_id % 80 = 17"),
    ("links_p", "SELECT CASE WHEN source_row_number % 75 = 9 THEN -person_id ELSE person_id END AS person_id, source_file, source_row_number, CASE WHEN source_row_number % 40 = 3 THEN 'guess' WHEN source_row_number % 40 = 4 THEN NULL ELSE match_method END AS match_method FROM links"),
    ("links_v", "SELECT * FROM links_p UNION ALL SELECT * FROM links_p WHERE source_row_number % 90 = 5"),
    ("skills_v", "SELECT * FROM skill_rows UNION ALL SELECT * FROM skill_rows WHERE person_id % 33 = 1 UNION ALL SELECT -person_id, skill FROM skill_rows WHERE person_id % 44 = 3"),
    ("issues_v", "SELECT CASE WHEN row_number % 25 = 4 THEN 'fatal' ELSE severity END AS severity FROM merge_issues"),
]


@query(
    """SELECT 'person.ctc_source_unit' AS rule, count(*) AS n FROM people_v WHERE ctc_source_unit NOT IN ('lpa', 'absolute') UNION ALL SELECT 'person.rate_period', count(*) FROM people_v WHERE rate_period NOT IN ('hourly', 'monthly')
    UNION ALL SELECT 'person.source_origin', count(*) FROM people_v WHERE source_origin IS NULL OR source_origin NOT IN ('csv_merge', 'audio_app') UNION ALL SELECT 'link.match_method', count(*) FROM links_v WHERE match_method IS NULL OR match_method NOT IN ('seed', 'exact_phone', 'exact_email')
    UNION ALL SELECT 'link.row_unique', count(*) FROM (SELECT 1 FROM links_v GROUP BY source_file, source_row_number HAVING count(*) > 1) UNION ALL SELECT 'link.person_exists', count(*) FROM links_v WHERE person_id NOT IN (SELECT person_id FROM people_v)
    UNION ALL SELECT 'skill.unique', count(*) FROM (SELECT 1 FROM skills_v GROUP BY person_id, skill HAVING count(*) > 1) UNION ALL SELECT 'skill.person_exists', count(*) FROM skills_v WHERE person_id NOT IN (SELECT person_id FROM people_v)
    UNION ALL SELECT 'issue.severity', count(*) FROM issues_v WHERE severity NOT IN ('skipped', 'flagged', 'repaired') UNION ALL SELECT 'person.id_unique', count(*) FROM (SELECT 1 FROM people_v GROUP BY person_id HAVING count(*) > 1)"""
)
def i14_integrity(spark, sf_dir):
    """Over tables in which some rows of each kind are spoilt."""
    m, c = merged(spark, sf_dir).settled(), F.col
    people, links, skills, issues = tables.durable(m.people()), m.links(), m.skills(), m.issues()
    people = people.withColumns({"ctc_source_unit": F.when(c("person_id") % 50 == 7, "gross").otherwise(c("ctc_source_unit")), "rate_period": F.when(c("person_id") % 60 == 11, "daily").otherwise(c("rate_period")), "source_origin": F.when(c("person_id") % 70 != 13, c("source_origin"))})
    people = people.unionByName(people.where("person_id % 80 = 17"))
    row = c("source_row_number")
    links = links.withColumns({"person_id": F.when(row % 75 == 9, -c("person_id")).otherwise(c("person_id")), "match_method": F.when(row % 40 == 3, "guess").when(row % 40 != 4, c("match_method"))})
    links = links.unionByName(links.where("source_row_number % 90 = 5"))
    skills = skills.unionByName(skills.where("person_id % 33 = 1")).unionByName(skills.where("person_id % 44 = 3").withColumn("person_id", -c("person_id")))
    return tables.violations(people, skills, links, issues.withColumn("severity", F.when(c("row_number") % 25 == 4, "fatal").otherwise(c("severity"))))


# ---- lineage ------------------------------------------------------------------------------


def _cells(source: str, columns: str) -> str:
    names = [c.strip() for c in columns.split(",")]
    return " UNION ALL ".join(f"SELECT l.person_id, l.source_file, l.source_row_number, l.match_method, '{c}' AS column_name, s.{c} AS value FROM links l JOIN {source} s ON l.source_file = '{source}' AND s.line_no = l.source_row_number" for c in names)


@query(_cells("bridge", "full_name, email, phone, city, experience, ctc, applied_date, skills") + " UNION ALL " + _cells("gigs", "email, full_name, rate, city, status, skills") + " UNION ALL " + _cells("contacts", "full_name, phone, city, verified, projects"))
def r01_source_cells(spark, sf_dir):
    return lineage.source_cells(merged(spark, sf_dir).links(), {n: view(spark, sf_dir, n) for n in ("bridge", "gigs", "contacts")})


@query("SELECT p.*, (SELECT string_agg(skill, ' | ' ORDER BY skill) FROM skill_rows s WHERE s.person_id = p.person_id) AS skills FROM people p")
def r02_canonical_record(spark, sf_dir):
    m = merged(spark, sf_dir)
    return lineage.canonical(m.people(), m.skills())


@query("SELECT lower(full_name) AS name, count(*) AS people FROM seeded WHERE full_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def r03_shared_names(spark, sf_dir):
    return lineage.shared_names(merged(spark, sf_dir).people())


@query("SELECT lower(s.full_name) AS name, s.person_id, n.people FROM seeded s JOIN (SELECT lower(full_name) AS name, count(*) AS people FROM seeded WHERE full_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1) n ON n.name = lower(s.full_name)")
def r08_namesakes(spark, sf_dir):
    return lineage.namesakes(merged(spark, sf_dir).settled().everyone())


@query("SELECT person_id, full_name FROM seeded WHERE lower(full_name) = 'lookalike 7'")
def r09_find_person(spark, sf_dir):
    return lineage.find_person(merged(spark, sf_dir).people(), name="  LOOKALIKE 7 ")


@query("SELECT person_id, count(*) AS source_rows FROM links GROUP BY 1")
def r04_source_rows(spark, sf_dir):
    return merged(spark, sf_dir).links().groupBy("person_id").agg(F.count("*").alias("source_rows"))


@query("SELECT source_file, count(*) AS people FROM links WHERE match_method = 'seed' GROUP BY 1")
def r05_people_by_source(spark, sf_dir):
    return merged(spark, sf_dir).links().where("match_method = 'seed'").groupBy("source_file").agg(F.count("*").alias("people"))


@query("SELECT person_id, ctc_raw, ctc_source_unit, ctc_annual_inr FROM seeded WHERE ctc_annual_inr IS NOT NULL ORDER BY person_id LIMIT 20")
def r06_raw_beside_parsed(spark, sf_dir):
    return merged(spark, sf_dir).people().where("ctc_annual_inr is not null").orderBy("person_id").limit(20).select("person_id", "ctc_raw", "ctc_source_unit", "ctc_annual_inr")


O.CTES += [
    ("rows_s", " UNION ALL ".join(f"SELECT '{n}' AS source_file, line_no AS source_row_number FROM {n}" for n in ("bridge", "gigs", "contacts"))),
    ("links_r", "SELECT source_file, source_row_number FROM links WHERE source_row_number % 30 <> 7 UNION ALL SELECT source_file, source_row_number + 1000000000000 FROM links WHERE source_row_number % 40 = 1 UNION ALL SELECT source_file, source_row_number FROM links WHERE source_row_number % 55 = 8"),
]


@query(
    """SELECT 'rows_without_link' AS what, count(*) AS n FROM rows_s r WHERE NOT EXISTS (SELECT 1 FROM links_r l WHERE l.source_file = r.source_file AND l.source_row_number = r.source_row_number)
    UNION ALL SELECT 'links_without_row', count(*) FROM links_r l WHERE NOT EXISTS (SELECT 1 FROM rows_s r WHERE l.source_file = r.source_file AND l.source_row_number = r.source_row_number)
    UNION ALL SELECT 'rows_linked_twice', count(*) FROM (SELECT 1 FROM links_r GROUP BY source_file, source_row_number HAVING count(*) > 1) UNION ALL SELECT 'links', count(*) FROM links_r"""
)
def r07_link_completeness(spark, sf_dir):
    """Over links of which some are lost, some lead nowhere and some are doubled."""
    links = merged(spark, sf_dir).settled().links()
    spoilt = links.where("source_row_number % 30 <> 7").unionByName(links.where("source_row_number % 40 = 1").withColumn("source_row_number", F.col("source_row_number") + 1_000_000_000_000))
    spoilt = spoilt.unionByName(links.where("source_row_number % 55 = 8"))
    staged = None
    for n in ("bridge", "gigs", "contacts"):
        one = view(spark, sf_dir, n).select(F.lit(n).alias("source_file"), "line_no")
        staged = one if staged is None else staged.unionByName(one)
    return lineage.completeness(spoilt, staged)


# ---- profiles -------------------------------------------------------------------------------


@query(r"SELECT source_file, regexp_replace(phone, '\p{Nd}{10}$', '#') AS shape, count(*) AS n FROM (SELECT 'bridge' AS source_file, phone FROM bridge UNION ALL SELECT 'contacts', phone FROM contacts) GROUP BY ALL")
def p01_phone_shapes(spark, sf_dir):
    return profile.phone_shapes(view(spark, sf_dir, "bridge"), view(spark, sf_dir, "contacts"))


@query("SELECT city_norm, count(DISTINCT city) AS spellings, count(DISTINCT city) FILTER (WHERE city <> trim(city)) AS padded, count(*) AS n FROM (SELECT city, city_norm FROM b UNION ALL SELECT city, city_norm FROM g UNION ALL SELECT city, city_norm FROM c) WHERE city_norm IS NOT NULL GROUP BY 1")
def p02_city_spellings(spark, sf_dir):
    return profile.city_spellings(merged(spark, sf_dir))


@query("SELECT 'status' AS column_name, status AS raw, status_norm AS value, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'verified', verified, CAST(verified_norm AS VARCHAR), count(*) FROM c GROUP BY ALL")
def p03_flag_census(spark, sf_dir):
    return profile.flag_census(merged(spark, sf_dir))


@query("SELECT ctc_unit AS unit, count(*) AS n, min(ctc_amount) AS least, max(ctc_amount) AS most, count(*) FILTER (WHERE ctc_amount NOT BETWEEN 100000 AND 10000000) AS implausible FROM b WHERE ctc_unit IS NOT NULL GROUP BY 1")
def p04_ctc_units(spark, sf_dir):
    return profile.ctc_units(merged(spark, sf_dir))


@query("SELECT rate_period AS period, count(*) AS n, min(rate_amount) AS least, max(rate_amount) AS most, count(*) FILTER (WHERE contains(lower(rate), 'k')) AS in_thousands FROM g WHERE rate_period IS NOT NULL GROUP BY 1")
def p05_rate_periods(spark, sf_dir):
    return profile.rate_periods(merged(spark, sf_dir))


@query("SELECT date_layout AS layout, count(*) AS n, count(date_other) AS ambiguous, count(DISTINCT applied_date) FILTER (WHERE date_other IS NOT NULL) AS ambiguous_values FROM b WHERE date_layout IS NOT NULL GROUP BY 1")
def p06_date_layouts(spark, sf_dir):
    return profile.date_layouts(merged(spark, sf_dir))


@query(
    """SELECT 'email raw' AS what, count(*) AS n FROM g WHERE email <> '' AND email IN (SELECT email FROM b) UNION ALL SELECT 'email normalised', count(*) FROM g WHERE email_key IN (SELECT email_key FROM b WHERE email_key IS NOT NULL)
    UNION ALL SELECT 'phone raw', count(*) FROM c WHERE phone <> '' AND phone IN (SELECT phone FROM b) UNION ALL SELECT 'phone normalised', count(*) FROM c WHERE phone_key IN (SELECT phone_key FROM b WHERE phone_key IS NOT NULL)"""
)
def p07_key_coverage(spark, sf_dir):
    return profile.key_coverage(merged(spark, sf_dir))


_SKILLS = "coalesce((SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM (SELECT {} AS s FROM (SELECT unnest(string_split({}, ',')) AS raw))), '')".format(O.skill("raw"), "{}")


@query(f"SELECT own = kept AS agree, count(*) AS n FROM (SELECT {_SKILLS.format('x.own')} AS own, {_SKILLS.format('x.kept')} AS kept FROM (SELECT g2.skills AS own, gr.skills AS kept FROM g2 JOIN groups gr USING (person_id) WHERE NOT g2.orphan) x) GROUP BY 1")
def p08_skill_agreement(spark, sf_dir):
    return profile.skill_agreement(merged(spark, sf_dir))


@query("SELECT by_phone, by_email, count(*) AS n FROM (SELECT phone_key IS NOT NULL AND count(*) OVER (PARTITION BY phone_key) > 1 AS by_phone, email_key IS NOT NULL AND count(*) OVER (PARTITION BY email_key) > 1 AS by_email FROM b) WHERE by_phone OR by_email GROUP BY ALL")
def p09_duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(merged(spark, sf_dir))


@query("SELECT 'phone' AS kind, primary_phone AS key, count(*) AS people FROM seeded WHERE primary_phone IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'email', primary_email, count(*) FROM seeded WHERE primary_email IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def p10_shared_keys(spark, sf_dir):
    return profile.shared_keys(merged(spark, sf_dir).people())


@query(f"SELECT skill, count(DISTINCT trim(raw)) AS spellings, count(*) AS n FROM (SELECT raw, {O.skill('raw')} AS skill FROM (SELECT unnest(string_split(skills, ',')) AS raw FROM bridge UNION ALL SELECT unnest(string_split(skills, ',')) FROM gigs)) WHERE skill IS NOT NULL GROUP BY 1")
def p11_skill_spellings(spark, sf_dir):
    return profile.skill_spellings(view(spark, sf_dir, "bridge"), view(spark, sf_dir, "gigs"))


# ---- lookup ---------------------------------------------------------------------------------

#: Roots of the indexes that this process has published, by application, folder and age of its tables.
_INDEXES: dict[tuple, str] = {}


def index_root(spark, sf_dir):
    """Where the people of ``sf_dir`` are published as an index: made once in an application, and again if a table has changed; it lies in the shared folder like a checkpoint."""
    age = [system.getFileStatus(at).getModificationTime() for system, at in (tables.file_system(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "part"))]
    key = (spark.sparkContext.applicationId, sf_dir, *age)
    if key not in _INDEXES or not tables.exists(spark, _INDEXES[key]):
        root = tables.scratch(spark, "people")
        everyone = merged(spark, sf_dir).everyone().select("person_id", "full_name", "primary_phone", "primary_email", F.lit("csv_merge").alias("source_origin"))
        people_index.write_index(tables.durable(everyone), root)
        _INDEXES[key] = root
    return _INDEXES[key]


def opened_index(spark, sf_dir):
    return people_index.newest_index(spark, index_root(spark, sf_dir))


def checked(spark, sf_dir):
    index = opened_index(spark, sf_dir)
    return lookup.looked_up_in(view(spark, sf_dir, "incoming"), index.table("by_phone"), index.table("by_email"))


@query("SELECT row_no, matched_on, person_id FROM checked")
def d01_lookup(spark, sf_dir):
    return checked(spark, sf_dir).select("row_no", "matched_on", F.col("person.person_id").alias("person_id"))


@query("SELECT row_no, note FROM checked WHERE note IS NOT NULL")
def d02_no_usable_key(spark, sf_dir):
    return checked(spark, sf_dir).where("note is not null").select("row_no", "note")


@query("SELECT row_no, status, name, phone, email, matched_on FROM checked")
def d03_branch(spark, sf_dir):
    rows = checked(spark, sf_dir).select("row_no", "status", "name", "phone", "email", "matched_on")
    return rows.where("status = 'duplicate'").unionByName(rows.where("status <> 'duplicate'"))


@query(
    """SELECT checked, duplicates, new, rejected, CASE WHEN duplicates > 0 THEN duplicates || ' of ' || checked || ' incoming rows already exist in the database.' ELSE 'No duplicates. All ' || checked || ' rows are new people.' END AS alert
    FROM (SELECT count(*) FILTER (WHERE status <> 'rejected') AS checked, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'new') AS new FROM checked)"""
)
def d04_batch_alert(spark, sf_dir):
    return lookup.alert(checked(spark, sf_dir))


@query("SELECT row_no, name, phone AS submitted_phone, nullif(email, '') AS submitted_email, matched_on, person_id, full_name FROM checked WHERE status = 'duplicate'")
def d05_collisions(spark, sf_dir):
    return lookup.collisions(checked(spark, sf_dir))


@query("SELECT row_no, status, CASE WHEN status = 'duplicate' THEN matched_on || ' -> #' || person_id || ' ' || coalesce(full_name, '') ELSE coalesce(note, 'not in database') END AS expected FROM checked")
def d06_expected_outcome(spark, sf_dir):
    return lookup.outcome(checked(spark, sf_dir))


# ---- intake -----------------------------------------------------------------------------------


def taken(spark, sf_dir):
    lowest = opened_index(spark, sf_dir).table("by_phone").select("phone_key", F.col("by_phone.person_id").alias("known"))
    return intake.attach(view(spark, sf_dir, "submissions"), merged(spark, sf_dir).everyone(), lowest=lowest)


@query("SELECT submission_id, reason FROM val")
def a01_validate(spark, sf_dir):
    return intake.validated(view(spark, sf_dir, "submissions")).select("submission_id", "reason")


@query("SELECT submission_id, media, extension FROM val")
def a02_extension(spark, sf_dir):
    return intake.validated(view(spark, sf_dir, "submissions")).select("submission_id", "media", "extension")


@query("SELECT submission_id, mode FROM val")
def a03_capture_mode(spark, sf_dir):
    return intake.validated(view(spark, sf_dir, "submissions")).select("submission_id", "mode")


def attached_and_made(spark, sf_dir):
    """The same without what tells of several holders of a phone: the people themselves aren't read."""
    lowest = opened_index(spark, sf_dir).table("by_phone").select("phone_key", F.col("by_phone.person_id").alias("known"))
    return intake.attach_known(intake.validated(view(spark, sf_dir, "submissions")).where("reason is null"), lowest)


@query("SELECT submission_id, phone_key, person_id FROM att")
def a04_attach(spark, sf_dir):
    return attached_and_made(spark, sf_dir)[0].select("submission_id", "phone_key", "person_id")


@query("SELECT a.submission_id, a.phone_key, a.typed_phone AS raw_value, p.holders, p.ids FROM att a JOIN (SELECT phone_key, count(*) AS holders, string_agg(CAST(person_id AS VARCHAR), '|' ORDER BY person_id) FILTER (WHERE i <= 10) || CASE WHEN count(*) > 10 THEN '|and ' || (count(*) - 10) || ' more' ELSE '' END AS ids FROM phones GROUP BY 1 HAVING count(*) > 1) p USING (phone_key)")
def a05_ambiguous_phone(spark, sf_dir):
    return taken(spark, sf_dir).ambiguous()


@query("SELECT phone_key, person_id FROM phones WHERE phone_key IN (SELECT phone_key FROM acc) AND phone_key IN (SELECT phone_key FROM phones WHERE i = 2)")
def a09_phone_holders(spark, sf_dir):
    return taken(spark, sf_dir).holders


@query("SELECT * FROM made")
def a06_new_people(spark, sf_dir):
    return attached_and_made(spark, sf_dir)[1]


@query("SELECT person_id, primary_phone AS phone_key, raw_value, 'person_created_from_audio_submission' AS issue_type FROM made")
def a07_created_issues(spark, sf_dir):
    return taken(spark, sf_dir).created()


@query(
    """SELECT a.submission_id, a.created_seq, a.person_id, w.full_name, rd.sample_rate_hz / 1000 AS khz, CAST(floor(rd.bitrate_bps / 1000) AS BIGINT) AS kbps, CASE WHEN a.typed_phone <> a.phone_key THEN a.phone_key END AS matched_as, CASE WHEN w.source_origin = 'audio_app' THEN 'new' ELSE 'known' END AS origin
    FROM att a JOIN (SELECT person_id, full_name, source_origin FROM people UNION ALL SELECT person_id, full_name, source_origin FROM made) w USING (person_id) LEFT JOIN rd USING (submission_id)"""
)
def a08_listing(spark, sf_dir):
    people, (attached, made) = merged(spark, sf_dir).everyone().withColumn("source_origin", F.lit("csv_merge")), attached_and_made(spark, sf_dir)
    columns = ["person_id", "full_name", "source_origin"]
    return intake.listing(attached, people.select(*columns).unionByName(made.select(*columns)), readings.measured(view(spark, sf_dir, "readings")))


# ---- readings ------------------------------------------------------------------------------------


def measured(*columns):
    def run(spark, sf_dir):
        return readings.measured(view(spark, sf_dir, "readings")).select("submission_id", *columns)

    return run


for _name, _columns in {
    "b01_probe": ("usable", "byte_size", "sample_rate_hz", "declared_seconds"),
    "b02_decoded_duration": ("decoded_seconds",),
    "b03_loudness": ("loudness_lufs",),
    "b04_levels": ("rms_level_db", "rms_trough_db"),
    "b05_noise": ("noise_snr_db", "quality_estimate"),
    "b06_bitrate": ("bitrate_bps", "bitrate_is_derived", "bitrate_note"),
    "b07_problems": ("problems",),
    "b08_metadata": ("byte_size", "duration_seconds", "sample_rate_hz", "bitrate_bps", "bitrate_is_derived", "bitrate_note", "loudness_lufs", "rms_level_db", "noise_snr_db", "quality_estimate", "problems"),
}.items():
    _run = measured(*_columns)
    _run.__name__ = _name
    query(f"SELECT submission_id, {', '.join(_columns)} FROM rd")(_run)


# ---- streams -------------------------------------------------------------------------------------


def landed(spark, rows, by, runs=3, files=2):
    """``rows`` written as files in a new shared folder, in runs one after the other in the order of ``by``; the folder, and one around it for results."""
    folder = tables.scratch(spark, "stream")
    _, *bounds = rows.approxQuantile(by, [i / runs for i in range(runs)], 0.001)
    place = sum((F.col(by) >= b).cast("int") for b in bounds)
    for i in range(runs):
        rows.where(place == i).repartition(files, by).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in", folder


def read_back(spark, folder, name, *columns):
    """A result of a stream, written once more so that its folder can go."""
    out = tables.durable(spark.read.parquet(f"{folder}/{name}").select(*columns))
    tables.removed(spark, folder)
    return out


@query("SELECT row_no, name, phone, email, status, matched_on, person_id, note FROM checked")
def s01_incoming_stream(spark, sf_dir):
    source, folder = landed(spark, view(spark, sf_dir, "incoming"), "row_no")
    rows = stream.arriving(spark, source, spark.read.parquet(source).schema)
    stream.check_incoming(rows, index_root(spark, sf_dir), f"{folder}/out", f"{folder}/progress")
    return read_back(spark, folder, "out", "row_no", "name", "phone", "email", "status", "matched_on", "person_id", "note")


@query("SELECT CASE WHEN created_seq % 97 <> 3 THEN created_seq END AS submission_id, phone_key, person_id FROM att")
def s02_submission_stream(spark, sf_dir):
    """Every tenth submission is sent again, an hour or forty days later; every seventh is dated forty days back; some have no id."""
    day = 86_400
    rows = view(spark, sf_dir, "submissions").withColumn("id", F.col("created_seq"))
    at = F.lit(1_700_000_000) + F.col("created_seq") - F.when(F.col("id") % 7 == 3, 40 * day).otherwise(0)
    rows = rows.withColumn("submission_id", F.when(F.col("id") % 97 != 3, F.col("id"))).withColumn("created_at", F.timestamp_seconds(at))
    again = rows.where("id % 10 = 0").withColumn("created_at", F.col("created_at") + F.expr(f"make_dt_interval(0, 0, 0, CASE WHEN id % 20 = 0 THEN 3600 ELSE {40 * day} END)"))
    top = rows.agg(F.max("created_seq")).first()[0]
    rows, late = rows.withColumn("arrives", F.col("id")), again.withColumn("arrives", F.col("id") + F.lit(top))  # when the first are long there
    lost = rows.where("submission_id is null and id % 2 = 0")  # a row without an id, sent again as it was
    source, folder = landed(spark, rows.unionByName(late.where("submission_id is not null")).unionByName(lost.withColumn("arrives", F.col("id"))).drop("id"), "arrives")
    stream.take_submissions(stream.arriving(spark, source, spark.read.parquet(source).schema), index_root(spark, sf_dir), folder, f"{folder}/progress")
    return read_back(spark, folder, "attached", "submission_id", "phone_key", "person_id")


# ---- exports of several files ----------------------------------------------------------------------

EXPORT_FILES = 4
_EXPORTS = {"bridge": (BRIDGE, "contains(email, '@')"), "gigs": (GIGS, "contains(email, '@')"), "contacts": (CONTACTS, r"regexp_matches(phone, '\p{Nd}')")}


def written_exports(spark, sf_dir):
    """Folder by export: files whose cities break over lines, with blank lines, short ones with inch marks and (gigs) rotated records in between."""
    folder, out = tables.scratch(spark, "exports"), {}
    for name, (spec, _) in _EXPORTS.items():
        rows = view(spark, sf_dir, name).withColumn("k", F.col("line_no") - 2).withColumn("part", (F.col("k") % EXPORT_FILES).cast("int"))
        csv = lambda *columns: F.to_csv(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(columns)]), {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
        broken = F.when(F.col("k") % 3 == 0, F.replace("city", F.lit(" "), F.lit("\n"))).otherwise(F.col("city"))
        plain = [F.col(c) for c in spec.columns]
        lines = [F.struct(F.lit(0).alias("at"), csv(*[broken if c == "city" else F.col(c) for c in spec.columns]).alias("value")), F.struct(F.lit(1).alias("at"), F.when(F.col("k") % 50 == 10, "," * (len(plain) - 1)).alias("value"))]
        if name == "gigs":
            lines.append(F.struct(F.lit(2).alias("at"), F.when((F.col("k") % 70 == 20) & F.contains("email", F.lit("@")), csv(plain[-1], *plain[:-1])).alias("value")))
        lines.append(F.struct(F.lit(3).alias("at"), F.when(F.col("k") % 90 == 33, '5" Road,6" x 7" yard').alias("value")))
        body = rows.select("part", "k", F.inline(F.array(*lines))).where("value is not null")
        head = spark.range(EXPORT_FILES).select(F.col("id").cast("int").alias("part"), F.lit(-1).cast("long").alias("k"), F.lit(0).alias("at"), F.lit(",".join(spec.header)).alias("value"))
        out[name] = f"{folder}/{name}"
        body.unionByName(head).repartition("part").sortWithinPartitions("part", "k", "at").select("part", "value").write.partitionBy("part").text(out[name])
    return out


def _export_views():
    """The views as the exports hold them: numbered through the files, without what isn't staged."""
    found = []
    for name, (spec, good) in _EXPORTS.items():
        rotated = "k % 70 = 20 AND contains(email, '@')" if name == "gigs" else "false"
        found += [
            (f"{name}_lines", f"SELECT *, line_no - 2 AS k, (line_no - 2) % {EXPORT_FILES} AS part, 1 + CASE WHEN (line_no - 2) % 3 = 0 THEN length(city) - length(replace(city, ' ', '')) ELSE 0 END AS high FROM {name}_view"),
            (f"{name}_more", f"SELECT *, CASE WHEN k % 50 = 10 THEN 1 ELSE 0 END AS blank, CASE WHEN {rotated} THEN 1 ELSE 0 END AS turned, CASE WHEN k % 90 = 33 THEN 1 ELSE 0 END AS inch FROM {name}_lines"),
            (f"{name}_placed", f"SELECT *, 1 + sum(high) OVER w + sum(blank + turned + inch) OVER w - blank - turned - inch AS file_line FROM {name}_more WINDOW w AS (PARTITION BY part ORDER BY k)"),
            (f"{name}_files", f"SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT part, 1 + sum(high + blank + turned + inch) AS n FROM {name}_more GROUP BY part)"),
            (name, f"SELECT CAST(before + file_line AS BIGINT) AS line_no, {', '.join(spec.columns)}, part, CAST(file_line AS BIGINT) AS file_line FROM {name}_placed JOIN {name}_files USING (part) WHERE {good}"),
        ]
    return found


_PEOPLE = "person_id, full_name, primary_phone, primary_email, city, experience_years, ctc_annual_inr, applied_date, rate_amount, rate_period, status, verified, projects_completed"
_PLACES = " UNION ALL ".join(f"SELECT '{n}' AS source_file, line_no AS source_row_number, part, file_line FROM {n}" for n in _EXPORTS)


@query(
    f"""SELECT {_PEOPLE}, source_file, part, file_line, source_rows FROM people JOIN (SELECT person_id, source_file, part, file_line FROM links JOIN ({_PLACES}) USING (source_file, source_row_number) WHERE match_method = 'seed') USING (person_id)
    JOIN (SELECT person_id, count(*) AS source_rows FROM links GROUP BY 1) USING (person_id)""",
    _export_views(),
)
def w01_rebuild(spark, sf_dir):
    """W1 from files to people, each with the place of the record that it was made of."""
    built = rebuilt(spark, sf_dir)
    links = built.merged.links()
    seeds = links.where("match_method = 'seed'").join(built.places(), ["source_file", "source_row_number"]).select("person_id", "source_file", part_of(F.col("file")).alias("part"), "file_line")
    rows = links.groupBy("person_id").agg(F.count("*").alias("source_rows"))
    return built.merged.people().join(seeds, "person_id").join(rows, "person_id").select(*[c.strip() for c in _PEOPLE.split(",")], "source_file", "part", "file_line", "source_rows")


def rebuilt(spark, sf_dir):
    """The rebuild of written exports; all that it holds is written when it comes back, so the files go."""
    written = written_exports(spark, sf_dir)
    built = exports.rebuild(spark, **written)
    for path in written.values():
        tables.removed(spark, path)
    return built


_ISSUES = " UNION ALL ".join(
    f"""SELECT '{n}' AS source_file, part, CAST(file_line AS BIGINT) AS row_number, 'column_shift' AS issue_type, CAST(NULL AS BIGINT) AS earlier_line FROM {n}_placed WHERE NOT ({good})
    UNION ALL SELECT '{n}', part, CAST(file_line + 1 AS BIGINT), 'blank_row', NULL FROM {n}_placed WHERE blank = 1
    UNION ALL SELECT '{n}', part, CAST(file_line + blank + turned + 1 AS BIGINT), 'wrong_column_count', NULL FROM {n}_placed WHERE inch = 1"""
    for n, (_, good) in _EXPORTS.items()
)


_TURNED = """UNION ALL SELECT 'gigs', p.part, CAST(p.file_line + p.blank + 1 AS BIGINT), 'column_shift', (SELECT min(g.file_line) FROM gigs g WHERE g.part = p.part AND lower(trim(g.email)) = lower(trim(p.email))) FROM gigs_placed p WHERE p.turned = 1"""


@query(f"{_ISSUES} {_TURNED}", _export_views())
def w02_rebuild_issues(spark, sf_dir):
    """What the rebuild set aside, file by file, read back from the written issues; keys repeat within a file only."""
    built = rebuilt(spark, sf_dir)
    path = tables.scratch(spark, "rebuild")
    built.write_issues(path)
    earlier = F.regexp_extract("action_taken", r"repeat line (\d+)", 1).try_cast("long")
    out = tables.durable(spark.read.parquet(path).where("phase = 'ingest'").select("source_file", part_of(F.col("file")).alias("part"), "row_number", "issue_type", earlier.alias("earlier_line")))
    tables.removed(spark, path)
    return out


_SUMS = {"people": "person_id", "links": "source_row_number", "skills": "person_id", "candidates": "source_b_row", "issues_merge": "row_number", "staged_bridge": "line_no", "staged_gigs": "line_no", "staged_contacts": "line_no"}
_HELD = {"people": "people", "links": "links", "skills": "skill_rows", "candidates": "alike", "issues_merge": "merge_issues", "staged_bridge": "bridge", "staged_gigs": "gigs", "staged_contacts": "contacts"}


@query(
    " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, CAST(sum({column} % 1000003) AS BIGINT) AS ids FROM {_HELD[name]}" for name, column in _SUMS.items()) + f" UNION ALL SELECT 'issues_ingest', count(*), CAST(sum(row_number % 1000003) AS BIGINT) FROM ({_ISSUES} {_TURNED})",
    _export_views(),
)
def w03_published(spark, sf_dir):
    """All tables of the rebuild as readers of the newest version have them, after a second run and one that was killed between two tables."""
    built, root = rebuilt(spark, sf_dir), tables.scratch(spark, "published")
    built.publish(root)
    built.publish_merge(root)  # a merge alone: ingestion's tables stay
    try:
        versions.publish(spark, root, {"people": versions.as_parquet(built.merged.people().limit(0)), "links": lambda path: 1 / 0})
    except ZeroDivisionError:
        pass
    out = None
    for name, column in (*_SUMS.items(), ("issues_ingest", "row_number")):
        one = versions.published(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.col(column) % 1000003).alias("ids"))
        out = one if out is None else out.unionByName(one)
    out = tables.durable(out)
    tables.removed(spark, root)
    return out
