"""Contact-shaped views over the driver's tables.

Those tables hold no messy contacts, so the views derive some by integer
arithmetic.  The text is SQL that Spark and DuckDB read alike, written once; what
is done with the views is written for each engine on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "part", "lineitem", "events")


def _pick(number: str, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices))
    return f"CASE ({number}) % {len(choices)} {whens} END"


_TEXT = "CAST({} AS STRING)"


def _text(number: str) -> str:
    return _TEXT.format(number)


def _two(number: str) -> str:
    return f"lpad({_text(number)}, 2, '0')"


_FIRST = lambda p: _pick(p, "Rohit", "Isha", "Deepak", "Tanvi", "Arjun", "Meera", "Nikhil")
_LAST = lambda p: _pick(p, "Verma", "Chopra", "Nair", "Gupta", "Mehta", "Iyer", "Bhatia", "Reddy", "Kapoor", "Das", "Rao")
_CITY = lambda k: _pick(k, "Bangalore", "bengaluru ", "GURGAON", "gurugram ", "Noida ", "  new  delhi", "navi-mumbai", "", "Pune", "Delhi NCR")
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 1 + 3 * CAST(k % 12 AS INT), 3)"
_DAY, _M = "1 + k % 31", "1 + k % 12"

#: name -> SQL with {table} for the driver's tables; a view may use the ones before it.
VIEWS = {
    "bridge": f"""
        SELECT k + 2 AS line_no,
          CASE WHEN k % 20 = 19 THEN 'R. ' || {_LAST("p")} WHEN k % 33 = 8 THEN '' ELSE {_FIRST("p")} || ' ' || {_LAST("p")} || ' ' || {_text("p")} END AS full_name,
          CASE WHEN k % 29 = 3 THEN ' ' WHEN k % 40 = 39 THEN 'alt.user' || {_text("p")} || '@mail.example.org' WHEN k % 31 = 4 THEN 'user' || {_text("p - 1")} || '@mail.example.org'
               WHEN k % 4 = 1 THEN 'USER' || {_text("p")} || '@MAIL.EXAMPLE.ORG' ELSE 'user' || {_text("p")} || '@mail.example.org' END AS email,
          CASE WHEN k % 23 = 7 THEN '' WHEN k % 37 = 5 THEN '12345' ELSE {_pick("k", "0", "+91-", "")} || {_text("9000000000 + p")} END AS phone,
          {_CITY("n")} AS city,
          {_pick("k", "4.2", "7", "abc", "", "12", "0.5")} AS experience,
          CASE WHEN k % 37 = 11 THEN 'negotiable' WHEN k % 41 = 2 THEN '' WHEN k % 2 = 0 THEN {_text("200000 + k * 7")} ELSE {_text("2 + k % 9")} || '.' || {_text("k % 10")} END AS ctc,
          CASE k % 6 WHEN 0 THEN '2026-' || {_two(_M)} || '-' || {_two(_DAY)} WHEN 1 THEN {_two(_DAY)} || '-' || {_two(_M)} || '-2026' WHEN 2 THEN {_two(_M)} || '/' || {_two(_DAY)} || '/2026'
               WHEN 3 THEN {_text(_DAY)} || ' ' || {_MONTH} || ' 2026' WHEN 4 THEN 'soon' ELSE '' END AS applied_date,
          {_pick("k", "n8n, LangChain, REST APIs", "python, SQL , sql", "Docker,, Foo Bar", "", "web  scraping,Zapier")} AS skills
        FROM (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n, CASE WHEN c_custkey % 20 = 19 THEN c_custkey - 1 ELSE c_custkey END AS p FROM {{customer}})""",
    "gigs": f"""
        SELECT k + 2 AS line_no,
          CASE WHEN k % 97 = 5 THEN '' WHEN k % 7 = 3 THEN {_pick("k", "gig", "gig", "Straße", "STRASSE", "ſtrasse")} || {_text("k % 400")} || '@other.example' WHEN k % 3 = 0 THEN ' USER' || {_text("p")} || '@mail.example.org' ELSE 'user' || {_text("p")} || '@mail.example.org ' END AS email,
          CASE WHEN k % 53 = 1 THEN '' WHEN k % 7 = 3 THEN {_pick("k", "LOOKALIKE ", "Lookalike ")} || {_text("k % 50")} ELSE {_FIRST("p")} || ' ' || {_LAST("p")} END AS full_name,
          CASE WHEN k % 19 = 4 THEN 'per day' WHEN k % 29 = 6 THEN '' WHEN k % 2 = 0 THEN {_text("300 + k % 1000")} || '/hr' ELSE {_text("15 + k % 30")} || 'K / month' END AS rate,
          {_CITY("k")} AS city,
          CASE WHEN k % 13 = 6 THEN 'on leave' WHEN s = 'F' THEN 'ACTIVE' WHEN s = 'O' THEN ' Inactive' ELSE 'paused' END AS status,
          {_pick("k", "n8n, web scraping", "mysql,React", "fastapi", "")} AS skills
        FROM (SELECT o_orderkey AS k, o_custkey AS p, o_orderstatus AS s FROM {{orders}})""",
    "contacts": f"""
        SELECT k + 2 AS line_no,
          CASE WHEN k % 43 = 2 THEN '' WHEN k % 41 = 3 THEN '  ' ELSE 'Lookalike ' || {_text("k % 50")} END AS full_name,
          CASE WHEN k % 59 = 3 THEN 'none' WHEN k % 13 = 9 THEN {_text("9000000000 + k - 1")} ELSE {_pick("k", "", "91", "+91-")} || {_text("9000000000 + k")} END AS phone,
          {_CITY("k + 1")} AS city,
          {_pick("z", "Y", "yes", "No", "N", " Yes", "maybe", "")} AS verified,
          CASE WHEN k % 11 = 4 THEN 'n/a' ELSE {_text("z")} END AS projects
        FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS z FROM {{part}})""",
    "raw_lines": """
        SELECT 1 AS line_no, 'Name,Phone Number,City,Verified,Projects Completed' AS line
        UNION ALL
        SELECT k + 2, CASE k % 50 WHEN 10 THEN ',,, ,' WHEN 20 THEN 'Name,Phone Number,City,Verified,Projects Completed' WHEN 30 THEN 'Short,' || t WHEN 40 THEN 'Long,' || t || ',"a, b",Yes,3,extra'
            WHEN 45 THEN '3,Name,' || u || ',Pune,Yes' WHEN 46 THEN '4,Nobody,' || w || ',Pune,No' WHEN 47 THEN '5,Nobody,none,Pune,No' ELSE 'Person ' || CAST(k AS STRING) || ',' || t || ',"Noida, ""UP"" east",Yes,' || CAST(k % 7 AS STRING) END
        FROM (SELECT c_custkey AS k, CAST(9000000000 + c_custkey AS STRING) AS t, CAST(9000000000 + c_custkey - 3 AS STRING) AS u, CAST(9000000000 + c_custkey + 3 AS STRING) AS w FROM {customer})""",
    "quoted": f'''
        SELECT k, t AS text, a AS first, b AS second, h AS high, k % 1000 = 500 AND k + 300 < top AS unclosed FROM (
          SELECT k, top, CASE s WHEN -1 THEN '"Stray ' || n || ',x' WHEN 0 THEN '5" Road ' || n || ',a' WHEN 1 THEN 'b,6" x 7" yard ' || n WHEN 2 THEN '"c ""' || n || '""",d' WHEN 3 THEN 'e,"one ' || n || '{{lf}}two"'
              WHEN 4 THEN '"f"tail"x",' || n WHEN 5 THEN 'g"",""' || n WHEN 6 THEN '"h{{lf}}' || n || '","i"' WHEN 7 THEN '"j, ' || n || '",l' WHEN 8 THEN ',' ELSE 'm ' || n || ',n' END AS t,
            CASE s WHEN -1 THEN 'Stray ' || n || ',x' WHEN 0 THEN '5" Road ' || n WHEN 1 THEN 'b' WHEN 2 THEN 'c "' || n || '"' WHEN 3 THEN 'e' WHEN 4 THEN 'ftail"x"' WHEN 5 THEN 'g""' WHEN 6 THEN 'h{{lf}}' || n WHEN 7 THEN 'j, ' || n WHEN 8 THEN '' ELSE 'm ' || n END AS a,
            CASE s WHEN -1 THEN NULL WHEN 0 THEN 'a' WHEN 1 THEN '6" x 7" yard ' || n WHEN 2 THEN 'd' WHEN 3 THEN 'one ' || n || '{{lf}}two' WHEN 4 THEN n WHEN 5 THEN n WHEN 6 THEN 'i' WHEN 7 THEN 'l' WHEN 8 THEN '' ELSE 'n' END AS b, CASE WHEN s IN (3, 6) THEN 2 ELSE 1 END AS h
          FROM (SELECT o_orderkey AS k, {_text("o_orderkey")} AS n, top, CASE WHEN o_orderkey % 1000 = 500 AND o_orderkey + 300 < top THEN -1 WHEN o_orderkey % 1000 BETWEEN 501 AND 800 THEN 9 ELSE o_orderkey % 10 END AS s FROM {{orders}}, (SELECT max(o_orderkey) AS top FROM {{orders}})))''',
    "incoming": f"""
        SELECT k AS row_no, 'Incoming ' || {_text("k % 100")} AS name,
          CASE WHEN k % 25 = 24 THEN NULL WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'bad' WHEN k % 3 = 0 THEN 'USER' || {_text("s * 3")} || '@mail.example.org' ELSE 'gig' || {_text("s * 7 + 3")} || '@other.example' END AS email,
          CASE WHEN k % 25 = 24 THEN NULL WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '123' ELSE '+91 ' || {_text("9000000000 + q")} END AS phone
        FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS q, l_suppkey AS s FROM {{lineitem}})""",
    "submissions": f"""
        SELECT CASE WHEN k % 53 = 11 THEN k - 1 WHEN k % 61 = 7 THEN NULL ELSE k END AS submission_id,
          CASE WHEN k % 31 = 5 THEN '  ' WHEN k % 37 = 6 THEN repeat('x', 201) ELSE ' Speaker ' || {_text("u")} || ' ' END AS name,
          CASE WHEN k % 29 = 4 THEN '' WHEN k % 23 = 3 THEN '123' ELSE {_pick("k", "0", "+91-", "")} || {_text("9000000000 + u * 11 + k - k % 4")} END AS phone,
          {_pick("k", "record", "upload", "fax")} AS capture_mode,
          CASE e WHEN 'click' THEN 'audio/webm;codecs=opus' WHEN 'view' THEN 'Audio/MPEG ' WHEN 'signup' THEN 'audio/x-wav' WHEN 'purchase' THEN 'audio/mp4' ELSE 'text/plain' END AS content_type,
          CASE WHEN k % 17 = 0 THEN 0 WHEN k % 19 = 0 THEN 26214401 ELSE 1000 + k * 13 END AS byte_size,
          CASE WHEN k % 41 = 7 THEN '' ELSE 'clip' || {_text("k")} END AS original_filename,
          k AS created_seq
        FROM (SELECT event_id AS k, user_id AS u, event_type AS e FROM {{events}})""",
    "readings": f"""
        SELECT k AS submission_id, 1000 + k * 13 AS byte_size, k % 47 <> 9 AS file_exists,
          CASE k % 8 WHEN 0 THEN '{{{{"streams":[{{{{"sample_rate":"48000","bit_rate":"128000"}}}}],"format":{{{{"duration":"' || {_text("1 + k % 90")} || '.5","bit_rate":"132000"}}}}}}}}'
               WHEN 1 THEN '{{{{"streams":[{{{{"sample_rate":"44100"}}}}],"format":{{{{"bit_rate":"81446.7","duration":"' || {_text("k % 7")} || '"}}}}}}}}'
               WHEN 2 THEN '{{{{"streams":[],"format":{{{{}}}}}}}}' WHEN 3 THEN 'not json' WHEN 4 THEN '{{{{"streams":[{{{{"sample_rate":"48000"}}}}],"format":{{{{}}}}}}}}'
               ELSE '{{{{"streams":[{{{{}}}}],"format":{{{{"duration":"' || {_text("2 + k % 5")} || '"}}}}}}}}' END AS probe_json,
          CASE WHEN k % 3 = 0 THEN 'nothing' ELSE 'size=1 time=00:00:00.50 x size=2 time=00:0' || {_text("k % 10")} || ':0' || {_text("k % 7")} || '.25 done' END AS decode_log,
          CASE k % 5 WHEN 0 THEN 'I:  -30.5 LUFS then I:  -' || {_text("10 + k % 40")} || '.5 LUFS' WHEN 1 THEN 'I: -inf LUFS' WHEN 2 THEN 'I: 1.2.3 LUFS' WHEN 3 THEN '' ELSE 'I:   ' || {_text("k % 9")} || ' LUFS' END AS loudness_log,
          CASE k % 6 WHEN 0 THEN 'Channel RMS level dB: -1.0 RMS through dB: -2.0' WHEN 1 THEN 'RMS level dB: -3.0 Overall RMS level dB: -20.0 RMS through dB: -inf' WHEN 2 THEN 'Overall RMS level dB: -inf RMS through dB: -inf'
               WHEN 3 THEN 'Overall RMS through dB: -50.0' ELSE 'RMS level dB: -3.0 Overall RMS level dB: -' || {_text("10 + k % 30")} || '.5 RMS through dB: -' || {_text("20 + k % 60")} || '.0 Overall RMS level dB: -1.0' END AS levels_log
        FROM (SELECT event_id AS k FROM {{events}})""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(lf="\n", **{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duckdb_ctes() -> list[tuple[str, str]]:
    return [(name, text.format(lf="\n", **{t: t for t in TABLES})) for name, text in VIEWS.items()]
