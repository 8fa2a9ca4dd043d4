"""Declared types (DDL) of the eight tables. JSON columns may be text or parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KEYS = "{0}_tml_id string, {0}_eq_type string, {0}_eq_no string"


def _table(prefix: str, columns: str) -> str:
    named = ", ".join(f"{prefix}_{column.strip()}" for column in columns.split(";"))
    return f"{_KEYS.format(prefix)}, {named}"


SCHEMAS: dict[str, str] = {
    "bi_eq": _table("bi_eq", "remove_flag string"),
    "bi_eq_ignition": _table("bi_eg", "ign_on_time timestamp_ntz; ign_off_time timestamp_ntz"),
    "bi_eq_login": _table("bi_el", "log_in_time timestamp_ntz; log_out_time timestamp_ntz"),
    "bi_eq_breaktime": _table("bi_eb", "brk_start_time timestamp_ntz; brk_end_time timestamp_ntz"),
    "bi_eq_travel": _table(
        "bi_ev", "trv_stime timestamp_ntz; trv_etime timestamp_ntz; dist decimal(20,6); fuel decimal(20,6)"
    ),
    "bi_eq_tran": _table(
        "bi_et", "last_job_cmpl_time timestamp_ntz; trv_dist decimal(20,6); fuel decimal(20,6); event_step string"
    ),
    "bi_job_hist": _table(
        "bi_jh",
        "job_id string; job_type string; job_fetching_time timestamp_ntz; job_cmpl_time timestamp_ntz;"
        "job_cycle_step string; trv_with_eta string; cntr_attr string; cntr_no string; from_eq_no string;"
        "to_eq_no string; user_id string; from_loc string; to_loc string; eq_tran_id string; fuel decimal(20,6)",
    ),
    "bi_oee_tml_value": (
        "bi_ov_tml_id string, bi_ov_tml_gp string, bi_ov_eq_type string, bi_ov_value_type string, "
        "bi_ov_value string, bi_ov_value_seq int"
    ),
}

# Column prefix of each table.
PREFIX = {
    "bi_eq": "bi_eq",
    "bi_eq_ignition": "bi_eg",
    "bi_eq_login": "bi_el",
    "bi_eq_breaktime": "bi_eb",
    "bi_eq_travel": "bi_ev",
    "bi_eq_tran": "bi_et",
    "bi_job_hist": "bi_jh",
    "bi_oee_tml_value": "bi_ov",
}

# The day each row is laid out by on disk (see tables.save): a time column, or for what has a start and an end, both.
LAYOUT_TIME = {
    "bi_job_hist": "bi_jh_job_cmpl_time",
    "bi_eq_tran": "bi_et_last_job_cmpl_time",
    "bi_eq_travel": "bi_ev_trv_stime",
}
LAYOUT_SESSION = {
    "bi_eq_ignition": ("bi_eg_ign_on_time", "bi_eg_ign_off_time"),
    "bi_eq_login": ("bi_el_log_in_time", "bi_el_log_out_time"),
    "bi_eq_breaktime": ("bi_eb_brk_start_time", "bi_eb_brk_end_time"),
}
LAYOUT_DAY = "layout_day"

# Numbers in JSON have no declared scale: wide enough that reading them does not round before the reports do.
JSON_NUMBER = "decimal(38,18)"

# JSON field and type behind each step column.
STEP_FIELDS = {
    "interval_sec": ("intervalSec", JSON_NUMBER),
    "activity_type": ("activityType", "string"),
    "step_dist": ("trvDistance", JSON_NUMBER),
    "laden_status": ("ladenStatus", "string"),
}


def step_json(*columns: str) -> str:
    """Array type with just the fields behind these step columns; the parser skips all others."""
    fields = ",".join(f"{name}:{kind}" for name, kind in (STEP_FIELDS[c] for c in columns))
    return f"array<struct<{fields}>>"


LEG_NUMBERS = ("etaDistance", "ataDistance", "etaTimeSec", "ataTimeSec")
LEG_JSON = f"array<struct<fromStep:string,toStep:string,{','.join(f'{n}:{JSON_NUMBER}' for n in LEG_NUMBERS)}>>"
CONTAINER_JSON = "struct<cntrIso:string>"

# JSON columns that save() stores parsed. Reports take text as well.
PARSED = {
    "bi_job_hist": {
        "bi_jh_job_cycle_step": step_json(*STEP_FIELDS), "bi_jh_trv_with_eta": LEG_JSON, "bi_jh_cntr_attr": CONTAINER_JSON,
    },
    "bi_eq_tran": {"bi_et_event_step": step_json(*STEP_FIELDS)},
}


def parsed(df: DataFrame, column: str, kind: str) -> Column:
    """A JSON column of that type: text is parsed, what is stored parsed is taken as it is."""
    text = isinstance(df.schema[column].dataType, StringType)
    return F.from_json(F.col(column), kind) if text else F.col(column)
