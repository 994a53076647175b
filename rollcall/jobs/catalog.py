"""Every operator as a query over the views, beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import normalise as N
from rollcall.jobs import oracles as O
from rollcall.jobs.views import view
from rollcall.operators.resolve import Resolved, dense_ids, resolve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(sql: str | None, instead: list[tuple[str, str]] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of its result."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            O.state(f.__name__, sql, instead)
        return f

    return register


def merged(spark: SparkSession, sf_dir: str) -> Resolved:
    return resolve(*(view(spark, sf_dir, name) for name in ("bridge", "gigs", "contacts")))


# ---- normalisers -------------------------------------------------------------------


def _over(name: str, source: str, **columns: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select("line_no", *[make().alias(k) for k, make in columns.items()])

    run.__name__ = name
    return run


c = F.col
query(f"SELECT line_no, {O.phone('phone')} AS phone_key FROM bridge")(_over("n01_phone_key", "bridge", phone_key=lambda: N.phone_key(c("phone"))))
query(f"SELECT line_no, {O.email('email')} AS email_key FROM gigs")(_over("n02_email_key", "gigs", email_key=lambda: N.email_key(c("email"))))
query(f"SELECT line_no, {O.city('city')} AS city_norm FROM bridge")(_over("n03_city", "bridge", city_norm=lambda: N.city(c("city"))))
query(f"SELECT line_no, {O.title('full_name')} AS titled FROM contacts")(_over("n04_title_case", "contacts", titled=lambda: N.title_case(c("full_name"))))
query(f"SELECT line_no, {O.skill('skills')} AS skill FROM gigs")(_over("n05_skill", "gigs", skill=lambda: N.skill(c("skills"))))
query(
    f"""SELECT line_no, coalesce(string_agg(s, '|' ORDER BY pos), '') AS skill_list, count(s) AS skills FROM (
        SELECT line_no, s, min(i) AS pos FROM (SELECT line_no, i, {O.skill("raw")} AS s FROM (SELECT line_no, unnest(string_split(skills, ',')) AS raw, generate_subscripts(string_split(skills, ','), 1) AS i FROM bridge)) GROUP BY line_no, s)
        GROUP BY line_no"""
)(_over("n06_split_skills", "bridge", skill_list=lambda: F.array_join(N.skills(c("skills")), "|"), skills=lambda: F.size(N.skills(c("skills"))).cast("long")))
query(f"SELECT line_no, {O.status('status')} AS status_norm FROM gigs")(_over("n07_status", "gigs", status_norm=lambda: N.status(c("status"))))
query(f"SELECT line_no, {O.verified('verified')} AS verified_norm FROM contacts")(_over("n08_verified", "contacts", verified_norm=lambda: N.verified(c("verified"))))
query(f"SELECT line_no, {O.ctc_amount('ctc')} AS amount_inr, {O.ctc_unit('ctc')} AS unit FROM bridge")(_over("n09_ctc", "bridge", amount_inr=lambda: N.ctc(c("ctc"))["amount_inr"], unit=lambda: N.ctc(c("ctc"))["unit"]))
query(f"SELECT line_no, {O.rate_amount('rate')} AS amount, {O.rate_period('rate')} AS period FROM gigs")(_over("n10_rate", "gigs", amount=lambda: N.rate(c("rate"))["amount"], period=lambda: N.rate(c("rate"))["period"]))
query(f"SELECT line_no, {O.date_value('applied_date')} AS value, {O.date_layout('applied_date')} AS layout FROM bridge")(_over("n11_date", "bridge", value=lambda: N.applied_date(c("applied_date"))["value"], layout=lambda: N.applied_date(c("applied_date"))["layout"]))
query(f"SELECT line_no, ({O.date_other('applied_date')}) IS NOT NULL AS ambiguous, {O.date_other('applied_date')} AS alternative FROM bridge")(
    _over("n12_ambiguous_date", "bridge", ambiguous=lambda: N.applied_date(c("applied_date"))["ambiguous"], alternative=lambda: N.applied_date(c("applied_date"))["alternative"])
)
query(f"SELECT b.line_no, {O.decimal('experience')} AS experience_years, {O.whole('ctc')} AS whole_ctc FROM bridge b")(_over("n13_plain_numbers", "bridge", experience_years=lambda: N.plain_number(c("experience")), whole_ctc=lambda: N.plain_whole(c("ctc"))))
query(f"SELECT line_no, {O.name_key('full_name')} AS name_key FROM gigs")(_over("n14_name_key", "gigs", name_key=lambda: N.name_key(c("full_name"))))


# ---- resolution ----------------------------------------------------------------------


@query("SELECT group_key, lines, first_line FROM groups")
def m01_bridge_groups(spark, sf_dir):
    return merged(spark, sf_dir).groups.select("group_key", "lines", "first_line")


@query("SELECT person_id, full_name FROM groups")
def m02_canonical_name(spark, sf_dir):
    return merged(spark, sf_dir).groups.select("person_id", "full_name")


@query("SELECT person_id, primary_email FROM groups")
def m03_primary_email(spark, sf_dir):
    return merged(spark, sf_dir).groups.select("person_id", "primary_email")


@query(
    f"SELECT person_id, phone_key, city_norm AS city, city AS city_raw, experience_years, ctc_amount, ctc_unit, date_value, (SELECT coalesce(string_agg(DISTINCT s, '|' ORDER BY s), '') FROM (SELECT {O.skill('raw')} AS s FROM (SELECT unnest(string_split(skills, ',')) AS raw))) AS skill_list FROM groups"
)
def m04_first_line_fields(spark, sf_dir):
    g = merged(spark, sf_dir).groups
    return g.select("person_id", "phone_key", c("city_norm").alias("city"), c("city").alias("city_raw"), "experience_years", c("ctc_parsed.amount_inr").alias("ctc_amount"), c("ctc_parsed.unit").alias("ctc_unit"), c("date_parsed.value").alias("date_value"), F.array_join(F.sort_array("skill_list"), "|").alias("skill_list"))


@query("SELECT first_line, lines, kept_name, kept_email, raw_value, names, emails FROM dupes")
def m05_merged_duplicates(spark, sf_dir):
    return merged(spark, sf_dir).merged_duplicates()


@query("SELECT first_line, line_no, full_name, email_key FROM dupe_lines")
def m21_merged_members(spark, sf_dir):
    return merged(spark, sf_dir).merged_members()


@query("SELECT email_key, person_id FROM mail_index")
def m06_email_index(spark, sf_dir):
    return merged(spark, sf_dir).index


@query("SELECT line_no, person_id, orphan FROM g2")
def m07_attach_by_email(spark, sf_dir):
    return merged(spark, sf_dir).gigs.select("line_no", "person_id", "orphan")


@query("SELECT line_no, person_id, orphan FROM c2")
def m08_attach_by_phone(spark, sf_dir):
    return merged(spark, sf_dir).contacts.select("line_no", "person_id", "orphan")


@query("SELECT * FROM gfold")
def m09_fold_gigs(spark, sf_dir):
    return merged(spark, sf_dir).fold_gigs()


@query("SELECT * FROM cfold")
def m10_fold_contacts(spark, sf_dir):
    return merged(spark, sf_dir).fold_contacts()


@query(f"SELECT person_id, full_name, primary_phone, primary_email, city, city_raw FROM seeded WHERE person_id >= {2 * O.STEP}")
def m11_orphan_people(spark, sf_dir):
    return merged(spark, sf_dir).orphans()


@query("SELECT *, 1.0::DOUBLE AS match_confidence FROM links")
def m12_links(spark, sf_dir):
    return merged(spark, sf_dir).links()


@query("SELECT * FROM skill_rows")
def m13_person_skills(spark, sf_dir):
    return merged(spark, sf_dir).skills()


@query("SELECT * FROM conflicts")
def m14_city_conflicts(spark, sf_dir):
    return merged(spark, sf_dir).city_conflicts()


@query("SELECT * FROM unparsed")
def m15_unparsed_values(spark, sf_dir):
    return merged(spark, sf_dir).unparsed()


@query("SELECT * FROM alike")
def m16_lookalikes(spark, sf_dir):
    return merged(spark, sf_dir).lookalikes()


@query("SELECT * FROM merge_issues WHERE issue_type = 'name_only_match_not_merged'")
def m17_lookalike_issues(spark, sf_dir):
    return merged(spark, sf_dir).issues().where("issue_type = 'name_only_match_not_merged'").drop("action_taken")


@query("SELECT p.*, coalesce(l.n, 0) AS source_rows FROM people p LEFT JOIN (SELECT person_id, count(*) AS n FROM links GROUP BY 1) l USING (person_id)")
def m18_people(spark, sf_dir):
    m = merged(spark, sf_dir).settled()
    rows = m.links().groupBy("person_id").agg(F.count("*").alias("n"))
    return m.people().join(rows, "person_id", "left").withColumn("source_rows", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


@query("SELECT person_id, row_number() OVER (ORDER BY person_id) AS dense_id FROM seeded")
def m19_person_ids(spark, sf_dir):
    return dense_ids(merged(spark, sf_dir).people().select("person_id"))


@query(
    """SELECT 'people' AS what, count(*) AS n FROM people UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'review_candidates', count(*) FROM alike
    UNION ALL SELECT 'skills', count(*) FROM skill_rows UNION ALL SELECT 'issue:' || issue_type, count(*) FROM merge_issues GROUP BY 1"""
)
def m20_merge_summary(spark, sf_dir):
    return merged(spark, sf_dir).settled().summary()
