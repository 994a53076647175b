"""DuckDB SQL that states what each query must return, on its own terms."""

from __future__ import annotations

from rollcall.jobs.views import duckdb_ctes
from rollcall.sources.specs import CITY_ALIASES, MEDIA_EXTENSIONS, SKILL_NAMES

STEP = 1 << 40


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"


def phone(x: str) -> str:
    digits = rf"regexp_replace({x}, '[^\p{{Nd}}]', '', 'g')"
    return f"CASE WHEN length({digits}) >= 10 THEN right({digits}, 10) END"


def fold(x: str) -> str:
    """Case folding of the letters that the views hold."""
    return f"lower(replace(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'), 'ſ', 's'))"


def email(x: str) -> str:
    return f"nullif({fold(strip(x))}, '')"


def title(x: str) -> str:
    words = rf"list_aggregate(list_transform(regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce({words}, '') END"  # no words make an empty text


def known(table: str, x: str, otherwise: str) -> str:
    return f"CASE WHEN {collapse(x)} <> '' THEN coalesce((SELECT shown FROM {table} WHERE raw = lower({collapse(x)})), {otherwise}) END"


def case_of(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def city(x: str) -> str:
    return f"CASE WHEN {collapse(x)} <> '' THEN coalesce({case_of(CITY_ALIASES, f'lower({collapse(x)})')}, {title(collapse(x))}) END"


def skill(x: str) -> str:
    return f"CASE WHEN {collapse(x)} <> '' THEN coalesce({case_of(SKILL_NAMES, f'lower({collapse(x)})')}, {collapse(x)}) END"


def status(x: str) -> str:
    key = f"lower({collapse(x)})"
    return f"CASE WHEN {key} IN ('active', 'inactive', 'paused') THEN {key} END"


def verified(x: str) -> str:
    key = f"lower({collapse(x)})"
    return f"CASE WHEN {key} IN ('y', 'yes') THEN true WHEN {key} IN ('n', 'no') THEN false END"


def decimal(x: str) -> str:
    return rf"CASE WHEN regexp_matches({strip(x)}, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN try_cast({strip(x)} AS DOUBLE) END"


def whole(x: str) -> str:
    return rf"CASE WHEN regexp_matches({strip(x)}, '^[+-]?\d+$') THEN try_cast({strip(x)} AS BIGINT) END"


def ctc_amount(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN CAST(round_even(({decimal(x)}) * 100000, 0) AS BIGINT) ELSE {whole(x)} END"


def ctc_unit(x: str) -> str:
    return f"CASE WHEN ({ctc_amount(x)}) IS NOT NULL THEN CASE WHEN contains({x}, '.') THEN 'lpa' ELSE 'absolute' END END"


def _rate(x: str) -> str:
    """(digits, thousands, per) of a rate that reads as one, else NULL."""
    side = lambda i: strip(f"split_part({x}, '/', {i})")
    digits = strip(f"CASE WHEN lower(right({side(1)}, 1)) = 'k' THEN left({side(1)}, -1) ELSE {side(1)} END")
    return f"CASE WHEN len(string_split({x}, '/')) = 2 AND lower({side(2)}) IN ('hr', 'month') AND regexp_full_match({digits}, '[0-9]+([.][0-9]+)?') THEN {{'n': CAST({digits} AS DOUBLE), 'k': lower(right({side(1)}, 1)) = 'k', 'per': lower({side(2)})}} END"


def rate_amount(x: str) -> str:
    return f"({_rate(x)}).n * CASE WHEN ({_rate(x)}).k THEN 1000 ELSE 1 END"


def rate_period(x: str) -> str:
    return f"CASE ({_rate(x)}).per WHEN 'hr' THEN 'hourly' WHEN 'month' THEN 'monthly' END"


def _dates(x: str) -> list[tuple[str, str, str | None]]:
    read = lambda shape, form: f"CASE WHEN regexp_matches({collapse(x)}, '{shape}') THEN CAST(try_strptime({collapse(x)}, '{form}') AS DATE) END"
    shapes = {"iso": r"^\d{4}-\d{1,2}-\d{1,2}$", "dash": r"^\d{1,2}-\d{1,2}-\d{4}$", "slash": r"^\d{1,2}/\d{1,2}/\d{4}$", "textual": r"^\d{1,2} [A-Za-z]{3} \d{4}$"}
    forms = {"iso": ("%Y-%m-%d", None), "dash": ("%d-%m-%Y", "%m-%d-%Y"), "slash": ("%m/%d/%Y", "%d/%m/%Y"), "textual": ("%d %b %Y", None)}
    return [(k, read(shapes[k], a), read(shapes[k], b) if b else None) for k, (a, b) in forms.items()]


def date_value(x: str) -> str:
    return f"coalesce({', '.join(v for _, v, _ in _dates(x))})"


def date_layout(x: str) -> str:
    return "CASE " + " ".join(f"WHEN ({v}) IS NOT NULL THEN '{k}'" for k, v, _ in _dates(x)) + " END"


def date_other(x: str) -> str:
    inner = " ".join(f"WHEN ({v}) IS NOT NULL AND ({o}) <> ({v}) THEN ({o})" for _, v, o in _dates(x) if o)
    return f"CASE {inner} END"


def name_key(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {fold(strip(x))} END"


CTES = [
    *duckdb_ctes(),
    ("b", f"""SELECT *, coalesce(phone_key, 'row-' || CAST(line_no AS VARCHAR)) AS group_key FROM (
        SELECT *, {phone("phone")} AS phone_key, {email("email")} AS email_key, {city("city")} AS city_norm, {decimal("experience")} AS experience_years, {ctc_amount("ctc")} AS ctc_amount, {ctc_unit("ctc")} AS ctc_unit,
          {date_value("applied_date")} AS date_value, {date_layout("applied_date")} AS date_layout, {date_other("applied_date")} AS date_other FROM bridge)"""),
    ("g", f"SELECT *, {email('email')} AS email_key, {city('city')} AS city_norm, {rate_amount('rate')} AS rate_amount, {rate_period('rate')} AS rate_period, {status('status')} AS status_norm, {name_key('full_name')} AS name_key FROM gigs"),
    ("c", f"SELECT *, {phone('phone')} AS phone_key, {city('city')} AS city_norm, {verified('verified')} AS verified_norm, {whole('projects')} AS projects_norm, {name_key('full_name')} AS name_key FROM contacts"),
    ("firsts", "SELECT group_key, count(*) AS lines, min(line_no) AS first_line FROM b GROUP BY group_key"),
    ("names", "SELECT group_key, full_name FROM (SELECT group_key, full_name, row_number() OVER (PARTITION BY group_key ORDER BY length(full_name) DESC, full_name) AS i FROM b WHERE full_name <> '') WHERE i = 1"),
    ("mails", "SELECT group_key, email_key FROM (SELECT group_key, email_key, row_number() OVER (PARTITION BY group_key ORDER BY length(email_key), email_key) AS i FROM b WHERE email_key IS NOT NULL) WHERE i = 1"),
    ("groups", f"""SELECT {STEP} + f.first_line AS person_id, f.group_key, f.lines, f.first_line, n.full_name, m.email_key AS primary_email, b.phone_key, b.city, b.city_norm, b.experience_years, b.ctc, b.ctc_amount, b.ctc_unit, b.applied_date, b.date_value, b.skills
        FROM firsts f JOIN b ON b.line_no = f.first_line LEFT JOIN names n ON n.group_key = f.group_key LEFT JOIN mails m ON m.group_key = f.group_key"""),
    ("held", "SELECT DISTINCT b.email_key, gr.person_id, b.email_key = gr.primary_email AS is_primary FROM b JOIN groups gr USING (group_key) WHERE b.email_key IS NOT NULL"),
    ("mail_index", "SELECT email_key, coalesce(max(person_id) FILTER (WHERE is_primary), min(person_id)) AS person_id FROM held GROUP BY email_key"),
    ("g2", f"SELECT g.*, i.person_id IS NULL AS orphan, coalesce(i.person_id, {2 * STEP} + g.line_no) AS person_id FROM g LEFT JOIN mail_index i ON g.email_key = i.email_key"),
    ("c2", f"SELECT c.*, gr.person_id IS NULL AS orphan, coalesce(gr.person_id, {3 * STEP} + c.line_no) AS person_id FROM c LEFT JOIN groups gr ON c.phone_key = gr.phone_key"),
    ("gfold", "SELECT person_id, rate AS rate_raw, rate_amount, rate_period, status_norm AS status FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY line_no DESC) AS i FROM g2) WHERE i = 1"),
    ("cfold", "SELECT person_id, verified_norm AS verified, projects_norm AS projects_completed FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY line_no DESC) AS i FROM c2) WHERE i = 1"),
    ("seeded", """SELECT person_id, full_name, phone_key AS primary_phone, primary_email, city_norm AS city, city AS city_raw, experience_years, ctc_amount AS ctc_annual_inr, ctc AS ctc_raw, ctc_unit AS ctc_source_unit, date_value AS applied_date, applied_date AS applied_date_raw FROM groups
        UNION ALL SELECT person_id, full_name, NULL, email_key, city_norm, city, NULL, NULL, NULL, NULL, NULL, NULL FROM g2 WHERE orphan
        UNION ALL SELECT person_id, full_name, phone_key, NULL, city_norm, city, NULL, NULL, NULL, NULL, NULL, NULL FROM c2 WHERE orphan"""),
    ("people", "SELECT s.*, gf.rate_raw, gf.rate_amount, gf.rate_period, gf.status, cf.verified, cf.projects_completed, 'csv_merge' AS source_origin FROM seeded s LEFT JOIN gfold gf USING (person_id) LEFT JOIN cfold cf USING (person_id)"),
    ("links", """SELECT gr.person_id, 'bridge' AS source_file, b.line_no AS source_row_number, CASE WHEN b.line_no = gr.first_line THEN 'seed' ELSE 'exact_phone' END AS match_method FROM b JOIN groups gr USING (group_key)
        UNION ALL SELECT person_id, 'gigs', line_no, CASE WHEN orphan THEN 'seed' ELSE 'exact_email' END FROM g2
        UNION ALL SELECT person_id, 'contacts', line_no, CASE WHEN orphan THEN 'seed' ELSE 'exact_phone' END FROM c2"""),
    ("skill_cells", "SELECT person_id, unnest(string_split(skills, ',')) AS s FROM groups UNION ALL SELECT person_id, unnest(string_split(skills, ',')) FROM g2"),
    ("skill_rows", f"SELECT DISTINCT person_id, skill FROM (SELECT person_id, {skill('s')} AS skill FROM skill_cells) WHERE skill IS NOT NULL"),
    ("conflicts", """SELECT a.person_id, a.source_file, a.line_no, a.column_name, a.city, a.city_norm, gr.city_norm AS kept_city FROM
        (SELECT person_id, 'gigs' AS source_file, line_no, 'location' AS column_name, city, city_norm FROM g2 WHERE NOT orphan UNION ALL SELECT person_id, 'contacts', line_no, 'City', city, city_norm FROM c2 WHERE NOT orphan) a
        JOIN groups gr USING (person_id) WHERE a.city_norm <> gr.city_norm"""),
    ("unparsed", f"""SELECT source_file, line_no, column_name, raw_value FROM (
          SELECT 'bridge' AS source_file, first_line AS line_no, 'Current CTC' AS column_name, ctc AS raw_value, ctc_amount IS NULL AS gone FROM groups
          UNION ALL SELECT 'bridge', first_line, 'Applied Date', applied_date, date_value IS NULL FROM groups
          UNION ALL SELECT 'gigs', line_no, 'rate', rate, rate_amount IS NULL FROM g2 UNION ALL SELECT 'gigs', line_no, 'status', status, status_norm IS NULL FROM g2
          UNION ALL SELECT 'contacts', line_no, 'Verified', verified, verified_norm IS NULL FROM c2) WHERE gone AND {strip("raw_value")} <> ''"""),
    ("alike", """SELECT g2.full_name AS name, 'gigs' AS source_a_file, g2.line_no AS source_a_row, 'contacts' AS source_b_file, f.source_b_row, 'unresolved' AS resolution
        FROM g2 JOIN (SELECT name_key, min(line_no) AS source_b_row FROM c2 WHERE orphan AND name_key IS NOT NULL GROUP BY name_key) f USING (name_key) WHERE g2.orphan"""),
    ("dupe_lines", "SELECT gr.first_line, b.line_no, b.full_name, b.email_key, row_number() OVER (PARTITION BY gr.first_line ORDER BY b.line_no) AS i FROM groups gr JOIN b USING (group_key) WHERE gr.lines > 1"),
    ("dupes", """SELECT first_line, lines, full_name AS kept_name, primary_email AS kept_email, shown || CASE WHEN lines > 10 THEN ' | and ' || (lines - 10) || ' more' ELSE '' END AS raw_value, names, emails
        FROM groups JOIN (SELECT first_line, string_agg('line ' || CAST(line_no AS VARCHAR) || ': ' || full_name, ' | ' ORDER BY line_no) FILTER (WHERE i <= 10) AS shown, count(DISTINCT full_name) AS names, count(DISTINCT email_key) AS emails FROM dupe_lines GROUP BY 1) USING (first_line)"""),
    ("merge_issues", """SELECT 'bridge' AS source_file, first_line AS row_number, 'duplicate_person_merged' AS issue_type, NULL AS column_name, raw_value, 'flagged' AS severity FROM dupes
        UNION ALL SELECT source_file, line_no, 'city_conflict_across_sources', column_name, city, 'flagged' FROM conflicts
        UNION ALL SELECT source_file, line_no, 'unparsed_value', column_name, raw_value, 'flagged' FROM unparsed
        UNION ALL SELECT 'gigs', source_a_row, 'name_only_match_not_merged', 'worker_name', name, 'flagged' FROM alike"""),
]

SQL: dict[str, str] = {}
#: Queries whose SQL uses other views of these names than :data:`CTES` has, and views before them.
INSTEAD: dict[str, list[tuple[str, str]]] = {}


def state(name: str, select: str, instead: list[tuple[str, str]] | None = None) -> None:
    SQL[name] = select
    if instead is not None:
        INSTEAD[name] = instead


def steps(instead: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The steps with some views replaced by others, each where the first of that name stood."""
    names = {name for name, _ in instead}
    views = {name for name, _ in duckdb_ctes()}
    base = [(name + "_view" if name in names else name, text) for name, text in CTES if name in views]
    return [*base, *instead, *[(name, text) for name, text in CTES if name not in views]]


def oracle_sql() -> dict[str, str]:
    """Each query's SQL with the views and steps that it may use."""
    head = lambda ctes: "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in ctes)
    return {name: f"{head(steps(INSTEAD[name]) if name in INSTEAD else CTES)}\n{select}" for name, select in SQL.items()}
