"""Deletes that follow the foreign keys, as markers: small tables of the ids that are gone.

``mark_deleted`` finds what a delete takes with it and stores ids only. ``live`` applies the
markers to a table where it is read: rows that are gone, or belong to such a row, are filtered,
and links to them are cleared, with one join for each foreign key and none of a table with
itself. Markers of several deletes are united by ``merge_markers``; a table is compacted by
writing what ``live`` returns, after which its markers can go.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personae.operators.scale import HOT_ROWS, fits_broadcast, materialize, skew_join

Tables = dict[str, DataFrame]
# parent table -> (id, direct) of its deleted rows; those not direct went with a parent of theirs
Markers = dict[str, DataFrame]


class Link(NamedTuple):
    child: str
    column: str
    parent: str
    cascade: bool  # the child's row goes too; else its link is cleared


LINKS = [
    Link("creators", "import_id", "import_history", True),
    Link("creators", "duplicate_of_creator_id", "creators", False),
    Link("creators", "identity_cache_id", "identity_cache", False),
    Link("processing_logs", "creator_id", "creators", True),
    Link("profile_snapshots", "creator_id", "creators", True),
    Link("export_history", "import_id", "import_history", False),
    Link("identity_cache_keys", "identity_cache_id", "identity_cache", True),
    Link("manual_overrides", "identity_cache_id", "identity_cache", True),
]


def _row_id(df: DataFrame) -> list[str]:
    """What salts the rows of a table: its id, or all columns where it has none."""
    return ["id"] if "id" in df.columns else df.columns


def _without(df: DataFrame, column: str, ids: DataFrame, hot_rows: int) -> DataFrame:
    """Rows whose ``column`` is none of the ids. Few ids are sent to the rows."""
    gone = ids.select(F.col("id").alias(column))
    if fits_broadcast(ids):
        return df.join(F.broadcast(gone), column, "left_anti").select(*df.columns)
    return skew_join(df, gone, [column], _row_id(df), "left_anti", hot_rows).select(*df.columns)


def _cleared(df: DataFrame, column: str, ids: DataFrame, hot_rows: int) -> DataFrame:
    """``column`` is null where it is one of the ids."""
    gone = ids.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
    if fits_broadcast(ids):
        flagged = df.join(F.broadcast(gone), column, "left")
    else:
        flagged = skew_join(df, gone, [column], _row_id(df), "left", hot_rows)
    link = F.when(F.col("_gone").isNull(), F.col(column))
    return flagged.withColumn(column, link).select(*df.columns)


def mark_deleted(
    tables: Tables, parent: str, ids: DataFrame, hot_rows: int = HOT_ROWS, direct: bool = True
) -> Markers:
    """Markers of a delete of ``ids`` (``id``) from a table, and of what belongs to them.

    Only tables that others point at need markers of their own; of these, ids and links are read.
    """
    gone = ids.select("id").where("id IS NOT NULL").distinct()
    gone = gone.withColumn("direct", F.lit(direct))
    markers = {parent: materialize(gone, f"deleted-{parent}")}
    parents = {link.parent for link in LINKS}
    for link in LINKS:
        if link.parent == parent and link.cascade and link.child in parents & tables.keys():
            child = tables[link.child].select("id", link.column)
            there = markers[parent].select(F.col("id").alias(link.column))
            if fits_broadcast(there):
                found = child.join(F.broadcast(there), link.column, "left_semi")
            else:
                found = skew_join(child, there, [link.column], "id", "left_semi", hot_rows)
            more = mark_deleted(tables, link.child, found, hot_rows, direct=False)
            markers = merge_markers(markers, more)
    return markers


def merge_markers(*deletes: Markers) -> Markers:
    names = {name for markers in deletes for name in markers}
    out = {}
    for name in sorted(names):
        found = [markers[name] for markers in deletes if name in markers]
        if len(found) == 1:
            out[name] = found[0]
            continue
        merged = reduce(DataFrame.union, found).groupBy("id").agg(F.max("direct").alias("direct"))
        out[name] = materialize(merged, f"deleted-{name}")
    return out


def live(
    name: str, table: DataFrame, markers: Markers, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows of a table that are left, without links to rows that are not."""
    if name in markers:
        # the others are found by their parents, whose ids are fewer
        table = _without(table, "id", markers[name].where("direct").select("id"), hot_rows)
    for link in LINKS:
        if link.child != name or link.parent not in markers or link.column not in table.columns:
            continue
        step = _without if link.cascade else _cleared
        table = step(table, link.column, markers[link.parent].select("id"), hot_rows)
    return table


def _delete(tables: Tables, parent: str, ids: DataFrame, hot_rows: int) -> Tables:
    markers = mark_deleted(tables, parent, ids, hot_rows)
    return {name: live(name, table, markers, hot_rows) for name, table in tables.items()}


def delete_imports(tables: Tables, import_ids: DataFrame, hot_rows: int = HOT_ROWS) -> Tables:
    """Delete imports (``id`` column) with everything that belongs to them.

    Reads and returns import_history, creators, processing_logs, profile_snapshots and
    export_history; absent tables are skipped, others returned as they are.
    """
    return _delete(tables, "import_history", import_ids, hot_rows)


def delete_identities(tables: Tables, identity_ids: DataFrame,
                      hot_rows: int = HOT_ROWS) -> Tables:
    """Delete cached identities; keys and overrides go, records lose the link."""
    return _delete(tables, "identity_cache", identity_ids, hot_rows)
