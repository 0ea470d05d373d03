"""Records of delimited files, whatever lines and splits they span.

Files are read line by line, so that Spark splits them. A line is a function of one bit: given
whether it starts inside quotes, does it end inside? Four such functions exist, and they compose;
within a split and over the splits of a file, window functions compose them into the state that
every line starts in. Only the few lines that share a record with others are then brought together.

A quote opens a cell right after a delimiter or a line break, is doubled within one, and closes it
before a delimiter or line break (blanks may stand between); any other quote is text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personae.operators.scale import materialize

DELIMITERS = [",", "\t", "|", ";"]
# lines that are looked at for the header, and characters that one record may have
HEAD = 100
LONGEST = 32 << 20


@dataclass
class Grammar:
    """Patterns for one delimiter, for Java; possessive, so that cells of any length fit the stack."""

    sep: str
    end: str = r"\z"

    @property
    def close(self) -> str:
        return rf'(?= *(?:{re.escape(self.sep)}|\r?{self.end}))'

    @property
    def body(self) -> str:
        return rf'(?:[^"]++|""|"(?! *(?:{re.escape(self.sep)}|\r?{self.end})))*+'

    @property
    def cell(self) -> str:
        """A delimiter and the cell that follows it, in group 1."""
        return rf'{re.escape(self.sep)}("{self.body}"{self.close} *|[^{re.escape(self.sep)}]*+)'

    def opens(self, line: Column) -> Column:
        """A line that starts outside quotes ends inside."""
        sep = re.escape(self.sep)
        closed = rf'(?s)(^|{sep})"{self.body}"{self.close}'
        return F.regexp_replace(line, closed, "$1").rlike(f'(^|{sep})"')

    def stays(self, line: Column) -> Column:
        """A line that starts inside quotes ends inside."""
        closes = rf'(?s)\A{self.body}"{self.close}'
        return ~line.rlike(closes) | self.opens(F.regexp_replace(line, closes, ""))

    def cells(self, record: Column) -> Column:
        found = F.regexp_extract_all(
            F.concat(F.lit(self.sep), record), F.lit("(?s)" + self.cell), F.lit(1)
        )
        return F.transform(found, unquoted)


def unquoted(cell: Column) -> Column:
    inner = F.rtrim(cell)
    inner = F.replace(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def header_cells(lines: list[str]) -> tuple[str, list[str]]:
    """Delimiter and cells of the first record that is not empty.

    The delimiter is the one that occurs most often outside quotes.
    """
    text = "\n".join(lines).removeprefix("﻿").lstrip("\r\n")
    plain = re.sub(r'"(?:[^"]++|"")*+"', lambda m: "x" * len(m.group()), text)
    record = text[: plain.index("\n")] if "\n" in plain else text
    if record.count('"') % 2:  # never closed: the first line alone
        record = text.split("\n", 1)[0]
    record = record.removesuffix("\r")
    counted = plain[: len(record)]
    grammar = Grammar(max(DELIMITERS, key=counted.count), r"\Z")
    cells = re.findall(grammar.cell, grammar.sep + record, re.S)
    return grammar.sep, [
        c.rstrip(" ")[1:-1].replace('""', '"') if c.startswith('"') else c for c in cells
    ]


def compose(df: DataFrame, within: list[str], order: str) -> DataFrame:
    """Add ``s0`` and ``s1``: the state each row starts in if the first starts in 0 or 1.

    ``f0`` and ``f1`` are the states a row ends in. After the last row that ends in one state
    whatever it started in, only the rows that swap states count.
    """
    rows = Window.partitionBy(*within).orderBy(order)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")
    fixed = F.when(
        F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("state"), F.col("_swaps").alias("at"))
    )
    last = F.last(fixed, ignorenulls=True).over(before)
    summed = df.withColumn("_swaps", F.sum(swap).over(upto)).withColumn("_last", last)
    swaps = F.coalesce(F.max("_swaps").over(before), F.lit(0))  # it never falls
    summed = summed.withColumn("_before", swaps)

    def state(first: int) -> Column:
        start = F.coalesce("_last.state", F.lit(first))
        return (start + F.col("_before") - F.coalesce("_last.at", F.lit(0))) % 2

    return summed.withColumns(
        {"s0": state(0).cast("int"), "s1": state(1).cast("int")}
    ).drop("_swaps", "_last", "_before")


def _ends(start: str) -> Column:
    return F.when(F.col(start) == 0, F.col("f0")).otherwise(F.col("f1"))


@dataclass
class Records:
    """``rows``: file, block, pos, record; consecutive ``pos`` in each (file, block).

    ``rejects``: file, line (from 1), raw, reason, kept (the record is also in ``rows``).
    """

    headers: list[str]
    sep: str
    rows: DataFrame
    rejects: DataFrame


def scan(spark: SparkSession, path: str, longest: int = LONGEST) -> Records | None:
    """Records of a file, or of a folder of files with the same header; None if there is none.

    The first record of each file that is not empty is its header; empty lines are skipped.
    Lines end with a line feed, before which a carriage return belongs to the line break, or with
    a carriage return where the first line has one elsewhere. Line breaks in cells are kept.
    """
    line_sep = "\n"
    head = [r.value for r in spark.read.text(path, lineSep=line_sep).take(HEAD)]
    first = next((h for h in head if h.strip("﻿\r")), None)
    if first is None:
        return None
    if "\r" in re.sub(r'"(?:[^"]++|"")*+"', "", first).removesuffix("\r"):
        line_sep = "\r"
        head = [r.value for r in spark.read.text(path, lineSep=line_sep).take(HEAD)]
    sep, headers = header_cells(head)
    grammar = Grammar(sep)

    value = F.make_valid_utf8("value")
    plain = ~F.col("line").contains('"')
    lines = spark.read.text(path, lineSep=line_sep).select(
        value.alias("line"), F.is_valid_utf8("value").alias("valid"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    ).withColumns({
        "f0": F.when(plain, 0).otherwise(grammar.opens(F.col("line")).cast("int")),
        "f1": F.when(plain, 1).otherwise(grammar.stays(F.col("line")).cast("int")),
        "blank": F.col("line").isin("", "\r"), "size": F.length("line"),
    })
    lines = materialize(lines, "csv-lines")
    place = F.struct("block", "pos")
    header = materialize(
        lines.where(~F.col("blank")).groupBy("file").agg(F.min(place).alias("at"))
        .select("at.pos"), "csv-headers",
    )
    opened, blank = lines.agg(
        F.coalesce(F.max("f0"), F.lit(0)), F.coalesce(F.bool_or("blank"), F.lit(False))
    ).first()
    whole = lines.where(~F.col("blank"))
    names = ["file", "block", "pos", "line", "valid"]
    rejects = whole.where("NOT valid").select("pos", F.lit("bad_encoding").alias("reason"),
                                              F.lit(True).alias("kept"))
    if opened:
        parts = _shared_records(lines)
        sizes = parts.groupBy("rec").agg(
            F.sum("size").alias("size"), F.max(F.col("last")).alias("closed")
        )
        bad = sizes.where(~F.col("closed") | (F.col("size") > longest)).select(
            "rec", F.when(F.col("closed"), "record_too_long").otherwise("unclosed_quote")
            .alias("reason"),
        )
        bad = materialize(bad, "csv-bad-records")
        rejects = rejects.join(
            parts.join(bad, "rec", "left_semi").select("pos"), "pos", "left_anti"
        ).unionByName(
            parts.join(bad, "rec").select("pos", "reason", F.lit(False).alias("kept"))
        )
        pieces = lines.join(parts.join(bad, "rec", "left_anti").select("pos", "rec"), "pos")
        joined = pieces.groupBy("file", "rec").agg(
            F.array_sort(F.collect_list(F.struct("block", "pos", "line"))).alias("l"),
            F.bool_and("valid").alias("valid"),
        ).select(
            "file", F.col("l")[0]["block"].alias("block"), F.col("rec").alias("pos"),
            F.array_join(F.transform("l", lambda x: x["line"]), line_sep).alias("line"), "valid",
        )
        whole = whole.join(parts.select("pos"), "pos", "left_anti").select(*names).unionByName(
            joined
        )
    rows = whole.join(header, "pos", "left_anti").select(
        "file", "block", "pos", F.regexp_replace("line", r"\r\z", "").alias("record")
    )
    if opened or blank:
        # positions have gaps: number the records of each split anew
        rows = rows.repartition("file", "block").sortWithinPartitions("file", "block", "pos")
        rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return Records(headers, sep, rows, _numbered(lines, rejects))


def _shared_records(lines: DataFrame) -> DataFrame:
    """(pos, size, rec, last) of the lines that share a record; ``rec`` is the first line's pos."""
    split = ["file", "block"]
    states = materialize(
        compose(lines.select(*split, "pos", "size", "f0", "f1"), split, "pos"), "csv-states"
    )
    whole = states.select(
        *split, "pos", _ends("s0").alias("e0"), _ends("s1").alias("e1")
    ).groupBy(*split).agg(F.max_by(F.struct("e0", "e1"), "pos").alias("e"))
    # one row for each split
    starts = compose(
        whole.select(*split, F.col("e.e0").alias("f0"), F.col("e.e1").alias("f1")), ["file"], "block"
    ).select(*split, F.col("s0").alias("first"))
    known = states.join(starts, split).withColumn(
        "start", F.when(F.col("first") == 0, F.col("s0")).otherwise(F.col("s1"))
    ).withColumn("end", _ends("start"))
    parts = materialize(
        known.where("start = 1 OR end = 1").select(*split, "pos", "size", "start", "end"),
        "csv-parts",
    )
    opener = F.when(F.col("start") == 0, F.col("pos"))
    in_split = Window.partitionBy(*split).orderBy("pos")
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy(*split).agg(F.max_by(opener, F.when(F.col("start") == 0, F.col("pos")))
                                        .alias("open")).select(
        *split, F.last("open", ignorenulls=True).over(over).alias("carried")
    )
    own = parts.withColumn("own", F.last(opener, ignorenulls=True).over(in_split))
    return materialize(
        own.join(carried, split).select(
            "pos", "size", F.coalesce("own", "carried").alias("rec"),
            (F.col("end") == 0).alias("last"),
        ), "csv-shared",
    )


def _numbered(lines: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rejected lines with their text and their number in the file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("pos").alias("first")
    ).select(
        "file", "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"),
    )
    found = lines.select("file", "block", "pos", F.col("line").alias("raw")).join(rejects, "pos")
    return found.join(splits, ["file", "block"]).select(
        "file", (F.col("pos") + F.col("shift")).alias("line"), "raw", "reason", "kept"
    )
