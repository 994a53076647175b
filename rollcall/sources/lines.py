"""Exports as raw physical lines, numbered without a global sort, and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.sources.specs import ExportSpec
from rollcall.sources.tables import durable


# What ends a line besides LF, CR and CRLF, and how many characters a field may have.
OTHER_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FIELD_LIMIT = 131_072
#: Characters of a record of several lines from which on its lines are set aside one by one.
RECORD_LIMIT = 16 * FIELD_LIMIT


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, block, line_no (header = 1), line, eol of every text file below ``path``; a byte-order mark goes.

    Spark cuts files at line feeds; what else ends a line (CR, VT, FF, FS, GS, RS, NEL, LS, PS)
    cuts these pieces once more, before ids that rise within a split give each line's place in it.
    The splits' counts (one row each) add up to the place in the file; lines are
    not shuffled.  ``eol`` is the CR or LF that ended the line; the other ends
    belong to the line's text.  A file that knows no line feed is one piece, cut in one task.
    """
    whole = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
    several = F.split("value", rf"(?<=[{OTHER_ENDS}])|(?<=\r)(?!\z)", -1)
    pieces = F.when(F.col("value").rlike(rf"[{OTHER_ENDS}]|\r(?!\z)"), several).otherwise(F.array("value"))
    cut = whole.select("file", "block", "size", F.size(pieces).alias("of"), F.posexplode(pieces).alias("at", "piece"))
    rows = cut.withColumn("m", F.monotonically_increasing_id()).withColumn("last", F.col("at") + 1 == F.col("of"))
    carriage = F.endswith("piece", F.lit("\r"))
    rows = rows.withColumn("line", F.when(carriage, F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece")))
    rows = rows.withColumn("eol", F.concat(F.when(carriage, "\r").otherwise(""), F.when(F.col("last"), "\n").otherwise("")))
    size = F.octet_length("piece") + F.when(F.col("last"), 1).otherwise(0)
    splits = rows.groupBy("file", "block").agg(F.min("m").alias("low"), F.count("*").alias("n"), F.sum(size).alias("bytes"), F.first("size").alias("size"))
    files = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(files.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Every piece counts a line feed; the last of a file may lack it (a mark of three bytes may be gone already).
    bare = (F.first("size").over(files) - F.sum("bytes").over(files)).isin(-1, 2)
    splits = splits.select("file", "block", "low", before.alias("before"), F.sum("n").over(files).alias("lines"), bare.alias("bare"))
    placed = rows.drop("size").join(F.broadcast(splits), ["file", "block"]).withColumn("line_no", F.col("before") + F.col("m") - F.col("low") + 1)
    ends = F.col("bare") & (F.col("line_no") == F.col("lines"))
    placed = placed.where(~(ends & (F.col("at") > 0) & (F.col("piece") == "")))
    clean = F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return placed.select("file", "block", "line_no", clean.alias("line"), F.when(ends, F.when(carriage, "\r").otherwise("")).otherwise(F.col("eol")).alias("eol"))


# ---- quotes ------------------------------------------------------------------------------------
#
# A reader is at the start of a field, in a bare field, in a quoted one, or behind a quote in a quoted one
# (a second quote makes it a literal one, a comma ends the field, anything else makes the rest
# bare).  In a bare field a quote is a letter like others.  Only a quoted field goes on over the
# end of a line, so a line maps two states, outside and inside, to two.

START, BARE, QUOTED, BEHIND = 0, 1, 2, 3
#: Inside since before the line, and never outside so far.
STILL, STILL_BEHIND = 4, 5
#: Before the first piece: what a quote makes of it is where the reading starts.
FROM_OUTSIDE, FROM_INSIDE = 6, 7
_QUOTE = {START: QUOTED, BARE: BARE, QUOTED: BEHIND, BEHIND: QUOTED, STILL: STILL_BEHIND, STILL_BEHIND: STILL, FROM_OUTSIDE: START, FROM_INSIDE: STILL}


def _after_quote(state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_QUOTE[i]) for i in range(len(_QUOTE))]), state + 1)


def _after_piece(state: Column, piece: Column) -> Column:
    """The state after text without quotes."""
    return F.when(state.isin(QUOTED, STILL) | (piece == ""), state).when(F.endswith(piece, F.lit(",")), START).otherwise(BARE)


#: Text of a quoted field up to its closing quote; a whole field: quoted, with what may follow the quote, or bare; the length up to which lines are told by patterns (longer ones could make them deep).
_CLOSED = r'[^"]*+(?:""[^"]*+)*+'
_WHOLE, _SHORT = rf'(?:"{_CLOSED}"[^,]*+|[^",][^,]*+|)', 2000


def line_map(line: Column) -> Column:
    """(a, b, still): whether a reader that comes to the line outside (a) or inside (b) a quoted field leaves it inside, and whether it is still the same field.

    From outside a line of whole fields is left outside, from inside one that closes the field and goes on with
    whole ones: short lines are told by these patterns, others piece by piece.
    """
    still = line.rlike(rf"\A{_CLOSED}\z")
    open_after = lambda begin: (~line.rlike(rf"\A{begin}(?:,{_WHOLE})*+\z"))
    told = F.struct(open_after(_WHOLE).cast("int").alias("a"), (still | open_after(f'{_CLOSED}"[^,]*+')).cast("int").alias("b"), still.alias("still"))
    return F.when(F.length(line) <= _SHORT, told).otherwise(_line_map_by_pieces(line))


def _line_map_by_pieces(line: Column) -> Column:
    def step(states: Column, piece: Column) -> Column:
        return F.struct(*[_after_piece(_after_quote(states[n]), piece).alias(n) for n in ("a", "b")])

    ends = F.aggregate(F.split(line, '"', -1), F.struct(F.lit(FROM_OUTSIDE).alias("a"), F.lit(FROM_INSIDE).alias("b")), step)
    inside = lambda c: c.isin(QUOTED, STILL).cast("int")
    told = lambda a, b, still: F.struct(a.alias("a"), b.alias("b"), still.alias("still"))
    return F.when(~F.contains(line, F.lit('"')), told(F.lit(0), F.lit(1), F.lit(True))).otherwise(F.transform(F.array(ends), lambda e: told(inside(e["a"]), inside(e["b"]), e["b"] == STILL))[0])


def _states_after(rows: DataFrame, window, a: str, b: str) -> DataFrame:
    """``rows`` with after0 and after1: what the maps (a, b) so far, one after the other, make of outside and inside.

    A map is constant, the identity or a swap: what counts is the last constant one and the swaps since.
    """
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("swaps", F.sum(F.when((F.col(a) == 1) & (F.col(b) == 0), 1).otherwise(0)).over(running) % 2)
    out = out.withColumn("since", F.last(F.when(F.col(a) == F.col(b), F.col(a).bitwiseXOR(F.col("swaps"))), ignorenulls=True).over(running))
    return out.withColumns({f"after{i}": F.coalesce("since", F.lit(i)).bitwiseXOR(F.col("swaps")).cast("int") for i in (0, 1)}).drop("swaps", "since")


def spans(lines: DataFrame, field_limit: int = FIELD_LIMIT, record_limit: int = RECORD_LIMIT) -> DataFrame:
    """File, line_no, start, unclosed, long of each line that shares its record with others or leaves a quote open.

    Narrow rows only: places, lengths and maps, by split; from split to split one row each.  Lines that keep
    a field open for more than ``field_limit`` characters (a strict reader breaks off there) belong
    to no field: they are read from outside, and what was open before them is ``unclosed``.
    The state that lines leave behind then no longer depends on where splits are.
    """
    told = lines.select("file", "block", "line_no", (F.length("line") + F.length("eol")).alias("size"), F.inline(F.array(line_map(F.col("line")))))
    own, files = Window.partitionBy("file", "block").orderBy("line_no"), Window.partitionBy("file").orderBy("block")
    ahead, behind = files.rowsBetween(Window.unboundedPreceding, -1), files.rowsBetween(1, Window.unboundedFollowing)
    still = F.when(F.col("still"), F.col("size")).otherwise(0)
    told = told.withColumn("run", F.sum((~F.col("still")).cast("long")).over(own))
    told = durable(told.withColumn("run_size", F.sum(still).over(Window.partitionBy("file", "block", "run"))))
    first, last = F.min(F.when(F.col("run") == 0, F.col("run_size"))), F.max_by("run_size", "line_no")
    splits = told.groupBy("file", "block").agg(F.max("run").alias("runs"), F.coalesce(first, F.lit(0)).alias("head"), last.alias("tail"))
    whole = F.col("runs") == 0
    full = F.when(whole, F.col("head")).otherwise(0)
    splits = splits.withColumn("sum", F.sum(full).over(files.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.last(F.when(~whole, F.col("tail") - F.col("sum")), ignorenulls=True).over(ahead)
    right = F.first(F.when(~whole, F.col("head") + F.col("sum")), ignorenulls=True).over(behind)
    total = F.sum(full).over(Window.partitionBy("file"))
    splits = splits.withColumns({"left": F.coalesce(left, F.lit(0)) + F.col("sum") - full, "right": F.coalesce(right, total) - F.col("sum")})
    reach = F.col("run_size") + F.when(F.col("run") == 0, F.col("left")).otherwise(0) + F.when(F.col("run") == F.col("runs"), F.col("right")).otherwise(0)
    rows = told.join(splits.select("file", "block", "runs", "left", "right"), ["file", "block"]).withColumn("endless", F.col("still") & (reach > field_limit))
    rows = rows.withColumns({c: F.when(F.col("endless"), 0).otherwise(F.col(c)) for c in ("a", "b")}).drop("runs", "left", "right", "run", "run_size", "still")
    rows = _states_after(rows, own, "a", "b").withColumns({f"before{i}": F.lag(f"after{i}", 1, i).over(own) for i in (0, 1)})
    rows = durable(rows.withColumn("then_endless", F.lead("endless").over(own)).drop("a", "b"))
    ends = rows.groupBy("file", "block").agg(F.max_by(F.struct("after0", "after1"), "line_no").alias("f"), F.min_by("endless", "line_no").alias("opens_endless"))
    ends = _states_after(ends.select("file", "block", "opens_endless", F.col("f.after0").alias("a"), F.col("f.after1").alias("b")), files, "a", "b")
    ends = ends.select("file", "block", F.lag("after0", 1, 0).over(files).alias("entry"), F.lead("opens_endless", 1, False).over(files).alias("next_endless"))
    of = lambda name: F.when(F.col("entry") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    marked = rows.join(ends, ["file", "block"]).withColumns({"inside": F.when(F.col("endless"), 0).otherwise(of("before")), "open": of("after"), "then_endless": F.coalesce("then_endless", "next_endless")})
    begins = F.when(F.col("inside") == 0, F.col("line_no"))
    marked = marked.select("file", "block", "line_no", "size", "inside", "open", "then_endless", F.max(begins).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    starts = marked.groupBy("file", "block").agg(F.max("start").alias("s")).select("file", "block", F.max("s").over(ahead).alias("carried"))
    marked = marked.where("inside = 1 or open = 1").join(starts, ["file", "block"]).withColumn("start", F.coalesce("start", "carried"))
    records = marked.groupBy("file", "start").agg((F.sum("size") > record_limit).alias("long"), F.max(F.struct("line_no", ((F.col("open") == 1) & F.col("then_endless")).alias("u"))).alias("end"))
    return durable(marked.select("file", "line_no", "start").join(records.select("file", "start", "long", F.col("end.u").alias("unclosed")), ["file", "start"]))


def stitched(lines: DataFrame, field_limit: int = FIELD_LIMIT, record_limit: int = RECORD_LIMIT) -> DataFrame:
    """I03, multi-line records: file, line_no (the record's last line), line (the whole span), unclosed.

    Records are those of a standard reader: a quote opens a field only at its
    beginning.  A field that stays open at the end of a file ends there.  One that would go on for more than ``field_limit``
    characters ends its record where it began, as ``unclosed``, and the next line is
    read on its own; records of more than ``record_limit`` characters are left as their
    lines, each ``unclosed``.  So only bounded spans are gathered; other lines are not shuffled
    but where the spans are too many to be sent to them.
    """
    if "eol" not in lines.columns:
        lines = lines.withColumn("eol", F.lit("\n"))
    if "block" not in lines.columns:
        lines = lines.withColumn("block", F.lit(0).cast("long"))
    found = spans(lines, field_limit, record_limit)
    alone = lines.join(found.where("not long"), ["file", "line_no"], "left_anti").select("file", "line_no", "line")
    alone = alone.join(found.where("long").select("file", "line_no", F.lit(True).alias("unclosed")), ["file", "line_no"], "left").withColumn("unclosed", F.coalesce("unclosed", F.lit(False)))
    rows = lines.select("file", "line_no", F.concat("line", "eol").alias("line")).join(found.where("not long"), ["file", "line_no"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    joined = rows.groupBy("file", "start", "unclosed").agg(F.max("line_no").alias("line_no"), text.alias("line"))
    ended = line_map(F.col("line"))["a"] == 0
    joined = joined.withColumn("line", F.when(ended | F.col("unclosed"), F.regexp_replace("line", r"[\r\n]+\z", "")).otherwise(F.col("line")))
    return alone.unionByName(joined.select("file", "line_no", "line", "unclosed"))


#: A field whose quotes, if any, enclose it and are doubled inside; short records of such fields are cut by a pattern.
_PLAIN = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


def cells(line: Column) -> Column:
    """All fields of a record, verbatim; quotes that enclose a field go, doubled ones in it become one."""

    def step(so_far: Column, piece: Column) -> Column:
        state = _after_quote(so_far["state"])
        now = F.when(so_far["state"].isin(BARE, BEHIND), F.concat(so_far["now"], F.lit('"'))).otherwise(so_far["now"])
        parts = F.when(state == QUOTED, F.array(piece)).otherwise(F.split(piece, ",", -1))
        parts = F.concat(F.array(F.concat(now, parts[0])), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
        return F.struct(_after_piece(state, piece).alias("state"), F.concat(so_far["done"], F.slice(parts, 1, F.size(parts) - 1)).alias("done"), F.element_at(parts, -1).alias("now"))

    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(f"({_PLAIN}),"), F.lit(1))
    inner = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), inner(x)).otherwise(x))
    start = F.struct(F.lit(FROM_OUTSIDE).alias("state"), F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    quoted = F.aggregate(F.split(line, '"', -1), start, step, lambda x: F.concat(x["done"], F.array(x["now"])))
    regular = (F.length(line) <= _SHORT) & line.rlike(rf"\A{_PLAIN}(?:,{_PLAIN})*+\z")
    return F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1)).when(regular, plain).otherwise(quoted)


def fields(line: Column, n: int) -> Column:
    """The first n fields of a record as verbatim text; what is missing is ''."""
    return F.transform(F.array(cells(line)), lambda found: first_fields(found, n))[0]


def first_fields(found: Column, n: int) -> Column:
    """The first n of the fields that :func:`cells` found."""
    return F.array(*[F.coalesce(F.get(found, F.lit(i)), F.lit("")) for i in range(n)])


def width(line: Column) -> Column:
    """How many fields a record has."""
    return F.size(cells(line))


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """file: every file below ``path``, empty ones too (scans leave those out): the names that Spark lists for a scan."""
    return spark.createDataFrame([(name,) for name in spark.read.text(path).inputFiles()], "file string")


def header_mismatches(lines: DataFrame, spec: ExportSpec, files: DataFrame | None = None) -> DataFrame:
    """Of each file whether its first line is the spec's header; of ``files`` an empty one has no header."""
    first = lines.where("line_no = 1")
    same = cells(F.col("line")) == F.array(*map(F.lit, spec.header))
    found = first.select("file", same.alias("header_ok"))
    if files is None:
        return found
    bare = lambda file: F.regexp_replace(file, "^([a-z0-9]+):/+", "$1:/")  # one file has one or three slashes, by who names it
    known = found.select(bare(F.col("file")).alias("at"), "header_ok")
    return files.join(known, bare(F.col("file")) == F.col("at"), "left").select("file", F.coalesce("header_ok", F.lit(False)).alias("header_ok"))


def source_wide(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of the files of ``lines`` with file_line, and line_no counted on from file to file, in the order of their names.

    What is merged from several files keeps one order, and one number a row; files meet as one row each, and
    are broadcast: few files don't make few tasks.
    """
    ends = lines.groupBy("file").agg(F.max("line_no").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ends.select("file", before.alias("before"))), "file").withColumn("file_line", F.col("line_no")).withColumn("line_no", F.col("before") + F.col("file_line")).drop("before")


def check_headers(lines: DataFrame, spec: ExportSpec, files: DataFrame | None = None) -> None:
    """I02 as a hard error: no file, an empty one (among ``files``), or one whose header isn't the spec's."""
    found = header_mismatches(lines, spec, files).groupBy("header_ok").agg(F.count("*").alias("n"), F.min("file").alias("example")).collect()
    if not found:
        raise ValueError(f"{spec.name}: no lines")
    for r in found:
        if not r.header_ok:
            raise ValueError(f"{spec.name}: {r.n} files empty or with another header, {r.example} among them")
