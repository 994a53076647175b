from pyspark.sql import functions as F

from rollcall.operators import intake, lookup, readings

R = "submission_id long, byte_size long, file_exists boolean, probe_json string, decode_log string, loudness_log string, levels_log string"


def measured(spark, probe, size=30580, decode="", loud="", levels="", exists=True):
    return readings.measured(spark.createDataFrame([(1, size, exists, probe, decode, loud, levels)], R)).collect()[0]


def test_bitrate(spark):
    both = measured(spark, '{"streams":[{"sample_rate":"48000","bit_rate":"128000"}],"format":{"bit_rate":"132000"}}')
    assert (both.bitrate_bps, both.bitrate_is_derived, both.bitrate_note) == (128000, False, None)
    one = measured(spark, '{"streams":[{}],"format":{"bit_rate":"81446"}}')
    assert (one.bitrate_bps, one.bitrate_note) == (81446, "container")
    none = measured(spark, '{"streams":[{}],"format":{"duration":"3.008"}}')
    assert (none.bitrate_bps, none.bitrate_is_derived) == (int(30580 * 8 / 3.008), True)
    assert measured(spark, '{"streams":[{}],"format":{"duration":"0"}}').bitrate_bps is None


def test_levels_come_from_overall(spark):
    r = measured(spark, '{"streams":[{"sample_rate":"1"}]}', levels="RMS level dB: -1.0 Overall RMS level dB: -20.0 RMS through dB: -70.0", loud="I: -9.0 LUFS I:  -21.8 LUFS", decode="time=00:00:01.00 time=01:02:03.50")
    assert (r.rms_level_db, r.noise_snr_db, r.quality_estimate, r.loudness_lufs, r.duration_seconds) == (-20.0, 50.0, "clean", -21.8, 3723.5)
    assert measured(spark, '{"streams":[{}]}', levels="Overall RMS level dB: -24.0 RMS through dB: -inf").noise_snr_db == 96.0
    assert measured(spark, '{"streams":[{}]}', levels="Overall RMS level dB: -inf RMS through dB: -inf").noise_snr_db is None


def test_unusable(spark):
    assert measured(spark, "not json").problems == "no audio stream" and measured(spark, None).problems == "no audio stream"
    gone = measured(spark, "{}", exists=False)
    assert (gone.problems, gone.byte_size) == ("file does not exist", 0)


def test_validation_and_new_people(spark):
    s = "submission_id long, name string, phone string, capture_mode string, content_type string, byte_size long, original_filename string, created_seq long"
    ok = lambda i, phone, name="Asha": (i, name, phone, "record", "audio/webm;codecs=opus", 10, "a", i)
    rows = [ok(1, "+91-9000000001"), ok(2, "09000000007", "New One"), ok(3, "9000000007", "Later"), ok(4, "123"), (5, " ", None, "fax", "text/plain", 0, None, 5), (6, "x" * 201, "9000000001", "fax", "audio/wav", 1, "a", 6), (7, "A", "9000000001", "fax", "audio/WAV", 26214401, "a", 7), (8, "A", "9000000002", "fax", " Audio/Wav", 26214400, "a", 8)]
    people = spark.createDataFrame([(1, "P", "9000000001", "csv_merge"), (2, "Q", "9000000002", "csv_merge"), (3, "R", "9000000002", "csv_merge")], "person_id long, full_name string, primary_phone string, source_origin string")
    df = spark.createDataFrame(rows, s)
    reason = {r.submission_id: r.reason for r in intake.validated(df).collect()}
    assert reason == {1: None, 2: None, 3: None, 4: "phone_too_short", 5: "name_missing", 6: "name_too_long", 7: "file_too_large", 8: None}
    got = intake.attach(df, people)
    made = got.made.collect()
    assert [(r.full_name, r.primary_phone) for r in made] == [("New One", "9000000007")]
    assert {r.submission_id: r.person_id for r in got.attached.collect()} == {1: 1, 2: made[0].person_id, 3: made[0].person_id, 8: 2}
    assert [(r.submission_id, r.holders, r.ids) for r in got.ambiguous().collect()] == [(8, 2, "2|3")]


def test_lookup(spark):
    people = spark.createDataFrame([(5, "P", "9000000001", "p@x", "csv_merge"), (2, "Q", None, "q@x", "csv_merge"), (1, "Q2", None, "q@x", "csv_merge")], "person_id long, full_name string, primary_phone string, primary_email string, source_origin string")
    rows = [(1, "a", "Q@x", "0 9000000001"), (2, "b", " q@X ", "123"), (3, "c", "", ""), (4, "d", "z@x", None)]
    got = lookup.looked_up(spark.createDataFrame(rows, "row_no long, name string, email string, phone string"), people)
    assert {r.row_no: (r.matched_on, r.person and r.person.person_id, r.note) for r in got.collect()} == {1: ("phone", 5, None), 2: ("email", 1, None), 3: (None, None, "no usable key"), 4: (None, None, None)}
    a = lookup.alert(got).collect()[0]
    assert (a.checked, a.duplicates, a.new, a.alert) == (4, 2, 2, "2 of 4 incoming rows already exist in the database.")
    assert lookup.alert(got.where(F.lit(False))).collect()[0].alert == "No duplicates. All 0 rows are new people."


def test_odd_tokens_of_the_tools(spark):
    r = measured(spark, '{"streams":[{}]}', levels="Overall\nRMS level dB:-7.25 x\nRMS through dB:\tnone RMS through dB: -1", loud="I: -9.0 LUFS I: -3 LU I: x", decode="time=00:01:02.5 y time=N/A time=1:2 time=")
    assert (r.decoded_seconds, r.loudness_lufs, r.rms_level_db, r.rms_trough_db) == (62.5, -9.0, -7.25, None)
    r = measured(spark, '{"streams":[{}]}', levels="RMS level dB: -1 Overall", loud="I: x LUFS", decode="no stamp")
    assert (r.decoded_seconds, r.loudness_lufs, r.rms_level_db) == (None, None, None)
