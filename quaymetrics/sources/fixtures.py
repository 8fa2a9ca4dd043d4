"""The eight tables derived from the generic `events` table, so that reports can run on the given test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SETTINGS
from .tables import Tables

# Settings in sequence order and their base values in minutes.
BASE_MINUTES = {
    "SCH_DOWN": 60.0,
    "USCH_DOWN": 45.5,
    "TML_CLOSE": 120.0,
    "OFFLINE_OPR_DELAY": 30.0,
    "TOS_FAILURE_ONLINE": 15.0,
    "ONLINE_DOWN": 10.0,
    "OTHER_IDLE": 5.0,
}
assert list(BASE_MINUTES) == list(SETTINGS)


def derive(spark: SparkSession, sf_dir: str) -> Tables:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = _base(events)
    return Tables(
        bi_eq=_equipment(base),
        bi_eq_ignition=_ignition(base),
        bi_eq_login=_login(base),
        bi_eq_breaktime=_breaktime(base),
        bi_eq_travel=_travel(base),
        bi_eq_tran=_transactions(base),
        bi_job_hist=_jobs(base),
        bi_oee_tml_value=_config(base),
    )


def _div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / n).cast("bigint")


def _at(seconds: Column) -> Column:
    return F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _base(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    kind = F.pmod(_div(user, 2), F.lit(3))
    return events.select(
        F.when(user % 2 == 0, "T1").otherwise("T2").alias("tml"),
        F.when(kind == 0, "YT").when(kind == 1, "YC").otherwise("QC").alias("type"),
        F.concat(F.lit("E"), F.lpad(user.cast("string"), 6, "0")).alias("unit"),
        "event_id",
        "user_id",
        "ts",
        "value",
        F.floor(F.col("value") * 60).cast("bigint").alias("secs"),
    )


def _keys(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{k}") for c, k in (("tml", "tml_id"), ("type", "eq_type"), ("unit", "eq_no"))]


def _equipment(base: DataFrame) -> DataFrame:
    last = F.col("user_id") % 10
    flag = F.when(last == 4, "Y").when(last != 2, "N")
    return base.select("tml", "type", "unit", "user_id").distinct().select(*_keys("bi_eq"), flag.alias("bi_eq_remove_flag"))


def _ignition(base: DataFrame) -> DataFrame:
    off = F.when(F.col("event_id") % 23 != 0, _at(F.col("secs")))
    return base.select(*_keys("bi_eg"), F.col("ts").alias("bi_eg_ign_on_time"), off.alias("bi_eg_ign_off_time"))


def _login(base: DataFrame) -> DataFrame:
    event, secs = F.col("event_id"), F.col("secs")
    third = event % 3 == 0
    nine = _at(_div(secs * 9, 10))
    out = F.when(event % 29 != 0, F.when(third, _at(_div(secs * 4, 10))).otherwise(nine))
    pair = lambda a, b: F.struct(a.alias("i"), b.alias("o"))
    first = pair(_at(_div(secs, 20)), out)
    logins = F.when(third, F.array(first, pair(_at(_div(secs * 5, 10)), nine))).otherwise(F.array(first))
    rows = base.where(event % 5 != 0).select(*_keys("bi_el"), F.explode(logins).alias("l"))
    return rows.select(
        "bi_el_tml_id",
        "bi_el_eq_type",
        "bi_el_eq_no",
        F.col("l.i").alias("bi_el_log_in_time"),
        F.col("l.o").alias("bi_el_log_out_time"),
    )


def _breaktime(base: DataFrame) -> DataFrame:
    secs = F.col("secs")
    end = F.when(F.col("event_id") % 17 != 0, _at(_div(secs * 5, 10)))
    return base.where(F.col("event_id") % 4 == 1).select(
        *_keys("bi_eb"), _at(_div(secs * 2, 10)).alias("bi_eb_brk_start_time"), end.alias("bi_eb_brk_end_time")
    )


def _decimal(x: Column) -> Column:
    return x.cast("decimal(20,6)")


def _travel(base: DataFrame) -> DataFrame:
    value = F.col("value")
    return base.where(F.col("event_id") % 4 != 3).select(
        *_keys("bi_ev"),
        F.col("ts").alias("bi_ev_trv_stime"),
        _at(_div(F.col("secs"), 4)).alias("bi_ev_trv_etime"),
        _decimal(F.round(value * 10, 1)).alias("bi_ev_dist"),
        _decimal(F.when(F.col("event_id") % 19 != 0, F.round(value, 2))).alias("bi_ev_fuel"),
    )


def _dist(n: Column, i: Column) -> Column:
    return (n * 7 + i * 13) % 600 + F.when((n + i) % 2 == 0, 0.5).otherwise(0.0)


def _items(count: Column, item) -> Column:
    """JSON text of an array with items 1..count."""
    made = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(count, F.lit(1))), item)
    return F.when(count >= 1, F.to_json(made, {"ignoreNullFields": "false"})).otherwise("[]")


def _laden(n: Column, i: Column) -> Column:
    return F.when((n + i) % 2 == 0, "L").otherwise("U")


def _transactions(base: DataFrame) -> DataFrame:
    event, value = F.col("event_id"), F.col("value")

    def step(i: Column) -> Column:
        return F.struct(_dist(event, i).alias("trvDistance"), _laden(event, i).alias("ladenStatus"))

    return base.where(event % 3 != 2).select(
        *_keys("bi_et"),
        _at(F.col("secs")).alias("bi_et_last_job_cmpl_time"),
        _decimal(F.round(value * 8, 1)).alias("bi_et_trv_dist"),
        _decimal(F.round(value, 2)).alias("bi_et_fuel"),
        F.when(event % 8 != 0, _items(event % 4, step)).alias("bi_et_event_step"),
    )


def _jobs(base: DataFrame) -> DataFrame:
    k, secs, n = F.col("k"), F.col("secs"), F.col("n")
    jobs = base.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    jobs = jobs.withColumn("n", F.col("event_id") * 3 + k)

    def numbered(letter: str, value: Column) -> Column:
        return F.concat(F.lit(letter), value.cast("string"))

    def step(i: Column) -> Column:
        kind = (n + i) % 3
        return F.struct(
            ((n * 7 + i * 13) % 600).alias("intervalSec"),
            F.when(kind == 0, "Waiting").when(kind == 1, "Working").alias("activityType"),
            _dist(n, i).alias("trvDistance"),
            _laden(n, i).alias("ladenStatus"),
        )

    def leg(i: Column) -> Column:
        return F.struct(
            numbered("S", i).alias("fromStep"),
            numbered("S", i + 1).alias("toStep"),
            _dist(n, i).alias("etaDistance"),
            (_dist(n, i) + (n + i) % 5).alias("ataDistance"),
            ((n * 3 + i) % 400).alias("etaTimeSec"),
            ((n * 5 + i) % 400).alias("ataTimeSec"),
        )

    kind, iso = n % 5, n % 3
    return jobs.select(
        *_keys("bi_jh"),
        F.when(n % 7 != 0, numbered("J", n)).alias("bi_jh_job_id"),
        F.when(kind == 0, "LD").when(kind == 1, "DS").when(kind == 2, "MI").when(kind == 3, "MO").alias("bi_jh_job_type"),
        _at(_div(secs * (k * 3 - 2), 10)).alias("bi_jh_job_fetching_time"),
        _at(_div(secs * k * 3, 10)).alias("bi_jh_job_cmpl_time"),
        F.when(n % 8 != 0, _items(n % 4, step)).alias("bi_jh_job_cycle_step"),
        F.when(n % 5 != 0, _items(n % 3, leg)).alias("bi_jh_trv_with_eta"),
        F.when(n % 11 == 0, F.lit(None).cast("string"))
        .when(n % 13 == 0, "{}")
        .when(iso == 0, '{"cntrIso":"22G1"}')
        .when(iso == 1, '{"cntrIso":"45G1"}')
        .otherwise('{"cntrIso":"L5G1"}')
        .alias("bi_jh_cntr_attr"),
        numbered("C", n % 997).alias("bi_jh_cntr_no"),
        numbered("Q", n % 9).alias("bi_jh_from_eq_no"),
        numbered("R", n % 9).alias("bi_jh_to_eq_no"),
        numbered("U", n % 40).alias("bi_jh_user_id"),
        numbered("F", n % 12).alias("bi_jh_from_loc"),
        numbered("G", n % 12).alias("bi_jh_to_loc"),
        numbered("X", F.col("event_id")).alias("bi_jh_eq_tran_id"),
        _decimal(F.round(F.col("value") / 3, 2)).alias("bi_jh_fuel"),
    )


def _config(base: DataFrame) -> DataFrame:
    """Settings per terminal, type and group; the values follow how many events the terminal and type have."""
    settings = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(minutes).alias("minutes"), F.lit(seq).alias("seq"))
            for seq, (name, minutes) in enumerate(BASE_MINUTES.items(), start=1)
        ]
    )
    groups = F.array(*[F.struct(F.lit(g).alias("gp"), F.lit(plus).alias("plus")) for g, plus in (("G1", 0), ("G2", 1))])
    rows = (
        base.groupBy("tml", "type")
        .agg((F.count("*") % 10).alias("extra"))
        .withColumn("g", F.explode(groups))
        .withColumn("s", F.explode(settings))
        .where((F.col("type") != "QC") | (F.col("s.name") != "OTHER_IDLE"))
    )
    value = F.col("s.minutes") + F.col("extra") + F.col("g.plus")
    return rows.select(
        F.col("tml").alias("bi_ov_tml_id"),
        F.col("g.gp").alias("bi_ov_tml_gp"),
        F.col("type").alias("bi_ov_eq_type"),
        F.col("s.name").alias("bi_ov_value_type"),
        F.format_string("%.1f", value).alias("bi_ov_value"),
        F.col("s.seq").alias("bi_ov_value_seq"),
    )
