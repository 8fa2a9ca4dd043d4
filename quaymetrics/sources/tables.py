"""The eight input tables: reading, writing, load checks, and the scoped view the reports work on."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.timeops import TimeLike, as_datetime, day_lit, ts
from .schema import (
    JSON_NUMBER, LAYOUT_DAY, LAYOUT_SESSION, LAYOUT_TIME, LEG_JSON, LEG_NUMBERS, PARSED, PREFIX, SCHEMAS, STEP_FIELDS,
    parsed, step_json,
)


@dataclass(frozen=True)
class Tables:
    bi_eq: DataFrame
    bi_eq_ignition: DataFrame
    bi_eq_login: DataFrame
    bi_eq_breaktime: DataFrame
    bi_eq_travel: DataFrame
    bi_eq_tran: DataFrame
    bi_job_hist: DataFrame
    bi_oee_tml_value: DataFrame


@dataclass(frozen=True)
class Scope:
    """Which terminal, equipment type and unit a report answers for. None means every one present."""

    tml_id: str | None = None
    eq_type: str | None = None
    eq_no: str | None = None

    @property
    def single_key(self) -> bool:
        return self.tml_id is not None and self.eq_type is not None

    @property
    def narrow(self) -> bool:
        """Whether a report answers for a single key or unit, as one call of the original does."""
        return self.eq_no is not None or self.single_key


def load(spark: SparkSession, root: str) -> Tables:
    """Read `<root>/<table>` parquet folders with the declared schemas, laid out and parsed by save() or not."""
    return Tables(**{name: _read(spark, root, name) for name in SCHEMAS})


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    stored = spark.read.parquet(f"{root}/{name}").schema
    columns = [part.strip() for part in re.split(r",(?![^(]*\))", SCHEMAS[name])]
    for i, column in enumerate(columns):
        kind = PARSED.get(name, {}).get(column.split()[0])
        if kind and not isinstance(stored[column.split()[0]].dataType, StringType):
            columns[i] = f"{column.split()[0]} {kind}"
    if LAYOUT_DAY in stored.fieldNames():
        columns.append(f"{LAYOUT_DAY} date")
    return spark.read.schema(", ".join(columns)).parquet(f"{root}/{name}")


def _layout(name: str) -> tuple[Column, str] | None:
    """The layout day of a table's rows, and the column that orders them within a unit."""
    if name in LAYOUT_SESSION:
        on, off = LAYOUT_SESSION[name]
        # the last day that a session touches; none while it is open
        return F.when(F.col(off).isNotNull(), F.greatest(F.to_date(on), F.to_date(off))), on
    if name == "bi_eq_travel":
        begun, ended = F.col("bi_ev_trv_stime"), F.col("bi_ev_trv_etime")
        # no day for a trip that ends before it starts: reports look at those whatever their days
        return F.when(begun <= ended, F.to_date(begun)), "bi_ev_trv_stime"
    if name in LAYOUT_TIME:
        return F.to_date(LAYOUT_TIME[name]), LAYOUT_TIME[name]
    return None


def _as_stored(name: str, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """A table with JSON parsed and its layout day, the columns of its folders and those that it is sorted by."""
    prefix = PREFIX[name]
    tml = f"{prefix}_tml_id"
    for column, kind in PARSED.get(name, {}).items():
        empty = F.array().cast(kind) if kind.startswith("array") else F.from_json(F.lit("{}"), kind)
        # unreadable text stays apart from no text
        df = df.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(parsed(df, column, kind), empty)))
    layout = _layout(name)
    if layout is None:
        return df, [], []
    day, time = layout
    return df.withColumn(LAYOUT_DAY, day), [tml, LAYOUT_DAY], [tml, LAYOUT_DAY, f"{prefix}_eq_type", f"{prefix}_eq_no", time]


def _written(df: DataFrame, folders: list[str], order: list[str], path: str, mode: str) -> None:
    # by folder; adaptive execution splits large folders over several writers and merges small ones
    rows = df.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*order)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def save(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    """Write the tables: facts and sessions by terminal and day, so that a report on some days opens only those folders,
    sorted by unit and time, so that one on a unit skips most row groups; JSON arrays parsed, so that no report does."""
    for field in fields(tables):
        df, folders, order = _as_stored(field.name, getattr(tables, field.name))
        path = f"{root}/{field.name}"
        if folders:
            _written(df, folders, order, path, mode)
        else:
            df.write.mode(mode).parquet(path)


def add(tables: Tables, root: str) -> None:
    """Add the facts and sessions of some days to saved tables, without touching the folders of other days.

    Facts: a terminal's day that comes again replaces what was there, so a load can be repeated; trips that end before they
    start have no day and are added to the others of that kind. Sessions: a row replaces the one of its unit and start, so a
    session that was open moves from the open folder to that of its last day. Units and settings are not touched.
    """
    for name in LAYOUT_TIME:
        df, folders, order = _as_stored(name, getattr(tables, name))
        there = _read(df.sparkSession, root, name)
        undated = F.col(LAYOUT_DAY).isNull()
        kept = df.where(undated).unionByName(there.where(undated).select(*df.columns)).distinct()
        _written(df.where(~undated).unionByName(kept), folders, order, f"{root}/{name}", "overwrite")
    for name in LAYOUT_SESSION:
        _add_sessions(name, getattr(tables, name), root)


def _add_sessions(name: str, given: DataFrame, root: str) -> None:
    df, folders, order = _as_stored(name, given)
    spark = df.sparkSession
    key = [f"{PREFIX[name]}_{c}" for c in ("tml_id", "eq_type", "eq_no")] + [LAYOUT_SESSION[name][0]]
    there = _read(spark, root, name)
    touched = df.select(*folders).distinct()
    same = [there[c].eqNullSafe(touched[c]) for c in folders]
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("_folder")
    # the folders that get rows, and the open one, which may lose some to any of them
    around = there.select("*", folder).join(touched, same, "left_semi")
    around = around.unionByName(there.where(F.col(LAYOUT_DAY).isNull()).select("*", folder)).distinct()
    stays = around.join(df, [around[c].eqNullSafe(df[c]) for c in key], "left_anti").select(*df.columns)
    rows = stays.unionByName(df)
    # few rows come here, one a folder: those that no row is left for are not overwritten, but deleted
    left = rows.select(*folders).distinct()
    before = around.select(*folders, "_folder").distinct()
    emptied = before.join(left, [before[c].eqNullSafe(left[c]) for c in folders], "left_anti").collect()
    _written(rows, folders, order, f"{root}/{name}", "overwrite")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for row in emptied:
        path = hadoop.Path(spark._jvm.java.net.URI(row["_folder"]))
        path.getFileSystem(conf).delete(path, True)
    spark.catalog.refreshByPath(f"{root}/{name}")


def scoped(tables: Tables, name: str, scope: Scope, *where: Column) -> DataFrame:
    """Rows of one table for a scope, with the table prefix dropped from the column names.

    The key equality of the single-key call never matches NULL, so NULL keys are left out here too.
    """
    df: DataFrame = getattr(tables, name)
    prefix = PREFIX[name]
    for key in ("tml_id", "eq_type", "eq_no"):
        column = f"{prefix}_{key}"
        if column not in df.columns:
            continue
        wanted = getattr(scope, key)
        df = df.where(F.col(column).isNotNull() if wanted is None else F.col(column) == wanted)
    for condition in where:
        df = df.where(condition)
    return df.select(*[F.col(c).alias(c[len(prefix) + 1 :] if c.startswith(prefix) else c) for c in df.columns])


def sorted_rows(df: DataFrame, scope: Scope, *columns: str) -> DataFrame:
    """Rows in order for a single key or unit. Over all of them rows are in order within each partition only: one order
    of all keys' detail rows is of no use to anybody and costs a sort of everything."""
    return df.orderBy(*columns) if scope.narrow else df.sortWithinPartitions(*columns)


def facts(tables: Tables, name: str, scope: Scope, start: TimeLike, end: TimeLike, *where: Column) -> DataFrame:
    """Scoped facts completed in [start, end]; opens only those day folders when the table is laid out by day."""
    conditions = [F.col(LAYOUT_TIME[name]).between(ts(start), ts(end)), *where]
    if LAYOUT_DAY in getattr(tables, name).columns:
        conditions.append(F.col(LAYOUT_DAY).between(day_lit(as_datetime(start).date()), day_lit(as_datetime(end).date())))
    return scoped(tables, name, scope, *conditions)


def trips(tables: Tables, scope: Scope, start: TimeLike, end: TimeLike) -> DataFrame:
    """Scoped trips that start and end inside [start, end].

    A trip lies in the folder of its start, which then lies between the two days; corrupt ones, ending before they
    start, lie in a folder without a day.
    """
    conditions = [F.col("bi_ev_trv_stime") >= ts(start), F.col("bi_ev_trv_etime") <= ts(end)]
    if LAYOUT_DAY in tables.bi_eq_travel.columns:
        day = F.col(LAYOUT_DAY)
        inside = day.between(day_lit(as_datetime(start).date()), day_lit(as_datetime(end).date()))
        conditions.append(inside | day.isNull())
    return scoped(tables, "bi_eq_travel", scope, *conditions)


def sessions(tables: Tables, name: str, scope: Scope, first: date | None = None) -> DataFrame:
    """Unit, on_time and off_time of a session table; from a day on if one is given, open ones included."""
    on, off = LAYOUT_SESSION[name]
    conditions = []
    if first is not None and LAYOUT_DAY in getattr(tables, name).columns:
        conditions.append((F.col(LAYOUT_DAY) >= day_lit(first)) | F.col(LAYOUT_DAY).isNull())
    cut = len(PREFIX[name]) + 1
    rows = scoped(tables, name, scope, *conditions)
    return rows.select("tml_id", "eq_type", "eq_no", F.col(on[cut:]).alias("on_time"), F.col(off[cut:]).alias("off_time"))


def load_checks(tables: Tables) -> DataFrame:
    """Counts of rows the reports would silently lose or the original would refuse, one row per check.

    For tables with JSON as text: to be run before save() parses it.
    """

    def broken(df: DataFrame, column: str, schema: str, check: str) -> DataFrame:
        text = F.col(column)
        bad = text.isNotNull() & (~F.ltrim(text).startswith("[") | F.from_json(text, schema).isNull())
        return df.agg(F.count_if(bad).alias("rows")).select(F.lit(check).alias("check"), "rows")

    def odd_numbers(df: DataFrame, column: str, fields: tuple[str, ...], check: str) -> DataFrame:
        """Rows with a field that is no number or out of range."""
        texts = F.from_json(F.col(column), f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")

        def odd(item: Column) -> Column:
            wrong = [item[f].isNotNull() & item[f].try_cast(JSON_NUMBER).isNull() for f in fields]
            return F.coalesce(reduce(or_, wrong), F.lit(False))

        return df.agg(F.count_if(F.coalesce(F.exists(texts, odd), F.lit(False))).alias("rows")).select(F.lit(check).alias("check"), "rows")

    numbers = tuple(name for name, kind in STEP_FIELDS.values() if kind == JSON_NUMBER)
    steps = step_json(*STEP_FIELDS)
    travel = tables.bi_eq_travel
    backwards = travel.agg(F.count_if(F.col("bi_ev_trv_etime") < F.col("bi_ev_trv_stime")).alias("rows"))
    return (
        broken(tables.bi_job_hist, "bi_jh_job_cycle_step", steps, "job_cycle_step is not a JSON array")
        .unionByName(broken(tables.bi_job_hist, "bi_jh_trv_with_eta", LEG_JSON, "trv_with_eta is not a JSON array"))
        .unionByName(broken(tables.bi_eq_tran, "bi_et_event_step", steps, "event_step is not a JSON array"))
        .unionByName(odd_numbers(tables.bi_job_hist, "bi_jh_job_cycle_step", numbers, "job_cycle_step has what is no number"))
        .unionByName(odd_numbers(tables.bi_job_hist, "bi_jh_trv_with_eta", LEG_NUMBERS, "trv_with_eta has what is no number"))
        .unionByName(odd_numbers(tables.bi_eq_tran, "bi_et_event_step", numbers, "event_step has what is no number"))
        .unionByName(backwards.select(F.lit("travel ends before it starts").alias("check"), "rows"))
    )
