"""Suspected infection, SIRS, organ dysfunction, ventilation, shock, and sepsis labels.

Thresholds and column names come as frozen dataclasses; every function is a lazy plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import any_of, hours_between, mean_arterial, part, systolic
from tidemark.operators.outliers import bounded
from tidemark.operators.tables import backbone_join, earliest, first_rows, highest
from tidemark.operators.temporal import asof_join, band_join, fill_forward, lookback
from tidemark.plans.statistics import compare_runs
from tidemark.sources.stages import Stages, load_run


@dataclass(frozen=True)
class Columns:
    key: str = "EncounterEpicCsn"
    ts: str = "Event_DateTime"
    kind: str = "Type"
    group: str = "Event_Grouper"
    name: str = "Event_Name"
    number: str = "NumericValue"
    text: str = "Value"


@dataclass(frozen=True)
class Infection:
    antibiotic: str = "IV Antibiotics - First"
    culture: str = "Blood Culture Order"
    lactate: str = "Lactate"
    page: str = "Code Sepsis Page"
    flag: str = "Suspected Infection"
    flag_text: str = "Yes"
    culture_before: float = 72
    culture_after: float = 24
    lactate_hours: float = 6


#: The look-back features (group, aggregate, hours).
FEATURES: dict[str, tuple[str, str, float]] = {
    "last_temp_8h": ("Temperature", "last", 8), "last_pulse_8h": ("Pulse", "last", 8), "last_resp_8h": ("Respirations", "last", 8),
    "last_sbp_8h": ("Systolic Blood Pressure", "last", 8), "last_map_8h": ("Arterial Blood Pressure Mean", "last", 8), "last_wbc_12h": ("WBC", "last", 12),
    "last_creatinine_12h": ("Creatinine", "last", 12), "last_egfr_12h": ("eGFR", "last", 12), "last_bilirubin_12h": ("Bilirubin", "last", 12),
    "last_lactate_6h": ("Lactate", "last", 6), "last_platelets_24h": ("Platelets", "last", 24), "last_inr_12h": ("INR", "last", 12),
    "last_aptt_24h": ("APTT", "last", 24), "last_gcs_12h": ("Glasgow Coma Score", "last", 12),
    "last_vasopressin_24h": ("Vasopressin", "last", 24), "last_phenylephrine_24h": ("Phenylephrine", "last", 24),
    "last_norepinephrine_24h": ("Norepinephrine", "last", 24), "last_epinephrine_24h": ("Epinephrine", "last", 24),
}


#: A variant of the features over the extremes of a day, and of 15 minutes for pressures.
DAY_FEATURES: dict[str, tuple[str, str, float]] = {
    "max_temp_24h": ("Temperature", "max", 24), "min_temp_24h": ("Temperature", "min", 24), "max_pulse_24h": ("Pulse", "max", 24),
    "max_resp_24h": ("Respirations", "max", 24), "max_sbp_15m": ("Systolic Blood Pressure", "max", 0.25), "max_map_15m": ("Arterial Blood Pressure Mean", "max", 0.25),
    "max_wbc_24h": ("WBC", "max", 24), "min_wbc_24h": ("WBC", "min", 24), "max_creatinine_24h": ("Creatinine", "max", 24), "max_egfr_24h": ("eGFR", "max", 24),
    "max_bilirubin_24h": ("Bilirubin", "max", 24), "max_lactate_24h": ("Lactate", "max", 24), "max_platelets_24h": ("Platelets", "max", 24), "max_inr_24h": ("INR", "max", 24),
    "max_aptt_24h": ("APTT", "max", 24), "max_gcs_24h": ("Glasgow Coma Score", "max", 24), "max_vasopressin_24h": ("Vasopressin", "max", 24),
    "max_phenylephrine_24h": ("Phenylephrine", "max", 24), "max_norepinephrine_24h": ("Norepinephrine", "max", 24), "max_epinephrine_24h": ("Epinephrine", "max", 24),
}

#: Hours for which a value of the group is carried to later nulls.
EXPIRY = {"Pulse": 8.0, "Blood Pressure": 8.0, "Respirations": 8.0, "Temperature": 8.0, "WBC": 12.0}


@dataclass(frozen=True)
class Scenario:
    """One named set of thresholds."""

    name: str = "default"
    columns: Columns = field(default_factory=Columns)
    infection: Infection = field(default_factory=Infection)
    features: Mapping[str, tuple[str, str, float]] = field(default_factory=lambda: dict(FEATURES))
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    null_mode: str = "as_zero"
    sirs_hours: float = 24
    organ_hours: float = 48
    shock_hours: float = 48

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def nearest_pairs(a: DataFrame, b: DataFrame, key: str, at: str, bt: str, before: float, after: float) -> DataFrame:
    """Per key the earliest pair of an `a` and its nearest `b` in [a - before, a + after]: key, a_time, b_time, infect_time."""
    cols = [key, at]
    late = asof_join(a.select(*cols), b.select(key, bt), [key], at, bt, [], forward=True, hours=after)
    soon = asof_join(a.select(*cols), b.select(key, bt), [key], at, bt, [], hours=before)
    pairs = late.union(soon).distinct().where(F.col(f"r_{bt}").isNotNull()).select(key, F.col(at).alias("a_time"), F.col(f"r_{bt}").alias("b_time"))
    pairs = pairs.withColumn("infect_time", F.least("a_time", "b_time"))
    return pairs.groupBy(key).agg(F.min(F.struct("infect_time", "a_time", "b_time")).alias("p")).select(key, "p.a_time", "p.b_time", "p.infect_time")


#: How each kind of suspicion is named in the long table, and in the wide one.
SUSPICIONS = {"IV+Culture": "antibiotic_culture", "LACTATE+CULTURE": "lactate_culture", "CODE_SEPSIS_ORDER": "sepsis_diagnosis_code", "FLOWSHEET_SUSPECTED_INFECTION": "suspected_infection_flowsheet"}


def infections(events: DataFrame, s: Scenario) -> DataFrame:
    """Long table: key, criterion (which time it is), infect_dt, suspicion_infection_type.

    A pair (antibiotic and culture, lactate and culture) gives a row for either time, as bands around
    both count later; pages and flags give one each.
    """
    c, i = s.columns, s.infection
    slice_ = lambda cond, name: events.where(cond).select(c.key, F.col(c.ts).alias(name)).where(F.col(name).isNotNull())
    culture = slice_(F.col(c.group) == i.culture, "culture_dt")
    abx = nearest_pairs(slice_(F.col(c.kind) == i.antibiotic, "iv_dt"), culture, c.key, "iv_dt", "culture_dt", i.culture_before, i.culture_after)
    abx = abx.select(c.key, F.col("a_time").alias("iv_dt"), F.col("b_time").alias("culture_dt"))
    near = band_join(culture, slice_(F.col(c.group) == i.lactate, "lactate_dt"), [c.key], "culture_dt", "lactate_dt", i.lactate_hours, i.lactate_hours)
    first = F.min(F.struct(F.least("culture_dt", "lactate_dt").alias("t"), "culture_dt", "lactate_dt")).alias("p")
    lac = near.groupBy(c.key).agg(first).select(c.key, "p.culture_dt", "p.lactate_dt")
    page = slice_(F.col(c.group) == i.page, "first_ev_time_codesepsis")
    flag = slice_((F.col(c.group) == i.flag) & (F.col(c.text) == i.flag_text), "first_ev_time_flowsheet")
    out = None
    for df, name in zip((abx, lac, page, flag), SUSPICIONS, strict=True):
        times = [x for x in df.columns if x != c.key]
        x = df.unpivot([c.key], times, "criterion", "infect_dt").withColumn("suspicion_infection_type", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def infections_wide(long: DataFrame, key: str) -> DataFrame:
    """Per key: infection_time (earliest), first_ev_type (what it came from) and infection_ev_type (all that were met, joined by `__`)."""
    named = F.create_map(*[F.lit(x) for kv in SUSPICIONS.items() for x in kv])
    met = long.select(key, "infect_dt", F.element_at(named, F.col("suspicion_infection_type")).alias("_e"))
    return met.groupBy(key).agg(
        F.min("infect_dt").alias("infection_time"), F.min_by("_e", F.struct("infect_dt", "_e")).alias("first_ev_type"),
        F.array_join(F.sort_array(F.collect_set("_e")), "__").alias("infection_ev_type"),
    )


def infections_by_band(a: DataFrame, b: DataFrame, key: str, at: str, bt: str, before: float, after: float) -> DataFrame:
    """Per key the earliest of all times of pairs whose `a` lies in [b - before, b + after]."""
    pairs = band_join(b.select(key, bt), a.select(key, at), [key], bt, at, before, after)
    return pairs.groupBy(key).agg(F.min(F.least(at, bt)).alias("infect_time"))


def pressures(events: DataFrame, c: Columns, pressure: str = "Blood Pressure", missing: float = 0.1) -> DataFrame:
    """(key, time, group, number) of all events that count for features, blood pressures as systolic and mean ones.

    Systolic ones come from the text if more than `missing` of the pressure rows lack a number, else from
    the number. A mean that can't be read stays as a null, which hides earlier ones; other nulls go.
    """
    cols = (c.key, c.ts, c.group, c.number)
    bp = events.where(F.col(c.group) == pressure)
    share = bp.agg((F.count_if(F.col(c.number).isNull()) / F.count("*") > missing).alias("_text"))  # one row
    sys = bp.crossJoin(F.broadcast(share)).withColumn(c.number, F.when(F.col("_text"), systolic(F.col(c.text))).otherwise(F.col(c.number)))
    sys = sys.where(F.col(c.number).isNotNull()).withColumn(c.group, F.lit("Systolic Blood Pressure"))
    mean = bp.withColumn(c.number, mean_arterial(F.col(c.text))).withColumn(c.group, F.lit("Arterial Blood Pressure Mean"))
    rest = events.where(F.col(c.number).isNotNull() & ~F.col(c.group).eqNullSafe(pressure))
    return rest.select(*cols).unionByName(sys.select(*cols)).unionByName(mean.select(*cols))


def number_from_pressure(events: DataFrame, c: Columns, kind: str = "Flowsheet", pressure: str = "Blood Pressure") -> DataFrame:
    """The events with the first number of a pressure's text ("120/80") as its number; text that doesn't parse makes it null."""
    is_text = (F.col(c.kind) == kind) & (F.col(c.group) == pressure) & F.col(c.text).isNotNull()
    return events.withColumn(c.number, F.when(is_text, part(F.col(c.text), "/", 1).try_cast("long").cast("double")).otherwise(F.col(c.number)))


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def sirs(agg: DataFrame, temp="last_temp_8h", pulse="last_pulse_8h", resp="last_resp_8h", wbc="last_wbc_12h", low=96.8, high=100.4, hr=90, rr=20, wbc_low=4, wbc_high=12) -> DataFrame:
    """Four flags (null: 0) and their sum."""
    f = {
        "Temp_Abnormal_Flag": _flag((F.col(temp) < low) | (F.col(temp) > high)), "HR_High_Flag": _flag(F.col(pulse) > hr),
        "Resp_Rate_High_Flag": _flag(F.col(resp) > rr), "WBC_Abnormal_Flag": _flag((F.col(wbc) < wbc_low) | (F.col(wbc) > wbc_high)),
    }
    out = agg.withColumns(f)
    return out.withColumn("sirs_score", sum((F.col(n) for n in f), F.lit(0)))


def sirs_carried(df: DataFrame, key: str, ts: str, flags: Sequence[str]) -> DataFrame:
    """Event-level flags carried forward within the key, 0 before the first."""
    for f in flags:
        df = fill_forward(df, [key], ts, f, "_x").withColumn(f, F.coalesce("_x", F.lit(0))).drop("_x")
    return df


def organ_dysfunction(agg: DataFrame) -> DataFrame:
    """Five flags against thresholds and baselines, and their sum; a null flag counts 0."""
    c, base = F.col, lambda n: F.col(f"Baseline_{n}")
    coag = (c("last_inr_12h") > 1.5) | (c("last_aptt_24h") > 60)
    plate = (base("Platelets").isNull() & (c("last_platelets_24h") < 100)) | ((c("last_platelets_24h") < 100) & (c("last_platelets_24h") < 0.5 * base("Platelets")) & (base("Platelets") > 100))
    hepatic = (base("Bilirubin").isNull() & (c("last_bilirubin_12h") > 2)) | ((c("last_bilirubin_12h") > 2) & (c("last_bilirubin_12h") > 2 * base("Bilirubin")))
    renal = (base("Creatinine").isNull() & (c("last_creatinine_12h") > 2)) | (c("last_creatinine_12h") > 2 * base("Creatinine")) | (c("last_egfr_12h") < 0.5 * base("eGFR"))
    f = {
        "cardiovascular_dysfunction": _flag(c("last_lactate_6h") > 2), "coagulation_dysfunction": _flag(F.coalesce(coag, F.lit(False)) | F.coalesce(plate, F.lit(False))),
        "hepatic_dysfunction": _flag(hepatic), "renal_dysfunction": _flag(renal), "neurological_dysfunction": (c("last_gcs_12h") < 15).cast("int"),
    }
    out = agg.withColumns(f)
    return out.withColumn("organ_dysfunction_total", sum((F.coalesce(n, F.lit(0)) for n in f), F.lit(0)))


SHOCK_FLAGS = ("sbp90_flag", "sbpdelta40_flag", "map65_flag", "lactate4_flag", "vasopressor_flag", "septic_shock_flag")


def septic_shock(agg: DataFrame, null_mode: str = "as_zero") -> DataFrame:
    """Shock flags (null where their input is null) and their OR, by the null mode of `any_of`."""
    c = F.col
    bit = lambda x: F.when(x, 1).when(~x, 0)
    drugs = [c(f"last_{d}_24h") for d in ("vasopressin", "phenylephrine", "norepinephrine", "epinephrine")]
    f = {
        "sbp90_flag": bit((c("last_sbp_8h") < 90) & c("Baseline_SBP").isNull()), "sbpdelta40_flag": bit(c("Baseline_SBP") - c("last_sbp_8h") > 40),
        "map65_flag": bit(c("last_map_8h") < 65), "lactate4_flag": bit(c("last_lactate_6h") > 4),
        "vasopressor_flag": any_of([bit(d > 0) for d in drugs], "as_zero"),
    }
    out = agg.withColumns(f)
    return out.withColumn("septic_shock_flag", F.coalesce(any_of([c(n) for n in f], null_mode), F.lit(0)))


@dataclass(frozen=True)
class Ventilation:
    onoff: str = "Vent On/Off"
    on_status: tuple[str, ...] = ("On Going Hospital Vent", "Initial", "$ On Going Hospital Vent")
    off_status: tuple[str, ...] = ("Standby",)
    home_status: str = "$ Home Vent Used"
    on_doc: str = "Vent On Documentation"
    off_doc: str = "Vent Off Documentation"
    pao2: str = "PAO2"
    fio2: str = "FIO2"
    mechanical: str = "O2 Delivery Mechanical Ventilation"
    mechanical_status: tuple[str, ...] = ("ventilator", "mechanical ventilator", "CPAP", "NPPV/NIV")
    low_support: tuple[str, ...] = ("O2 Delivery Nasal Cannula", "O2 Delivery Room Air", "O2 Delivery Simple Face Mask")
    dependent_codes: tuple[str, ...] = ("Z99.11", "Z93.0")
    pf_limit: float = 200
    pf_hours: float = 2


def pf_pairs(events: DataFrame, c: Columns, v: Ventilation) -> DataFrame:
    """Each PaO2 with every FiO2 less than `pf_hours` away: key, times, name, pf_ratio, PF_Ratio_Flag (1 or null).

    A FiO2 of 0 divides as floating point does: an infinite ratio with the sign of the PaO2, and NaN, which
    counts as more than any limit, for a PaO2 of 0.
    """
    p = events.where(F.col(c.group) == v.pao2).select(c.key, F.col(c.ts).alias("p_t"), F.col(c.name).alias("p_name"), F.col(c.number).alias("pao2"))
    q = events.where(F.col(c.group) == v.fio2).select(c.key, F.col(c.ts).alias("f_t"), F.col(c.number).alias("fio2"))
    near = band_join(p, q, [c.key], "p_t", "f_t", v.pf_hours, v.pf_hours).where(F.abs(hours_between("p_t", "f_t")) < v.pf_hours)
    share = F.col("fio2") / 100
    ratio = F.when(share == 0, F.col("pao2") * F.pow(share, F.lit(-1.0))).otherwise(F.try_divide(F.col("pao2"), share))
    return near.withColumn("pf_ratio", ratio).withColumn("PF_Ratio_Flag", F.when(F.col("pf_ratio") < v.pf_limit, 1))


def vent_dependent(events: DataFrame, c: Columns, v: Ventilation) -> DataFrame:
    """Keys with a dependency code, or with a ventilator from home."""
    home = (F.col(c.group) == v.onoff) & (F.col(c.text) == v.home_status)
    return events.where(F.col(c.text).isin(*v.dependent_codes) | home).select(c.key).distinct()


def pulmonary(events: DataFrame, c: Columns = Columns(), v: Ventilation = Ventilation()) -> DataFrame:
    """All events with on flags (1 or null), end flag (0 or null) and the pulmonary flag, which an end sets to 0.

    Keys that depend on a ventilator are left out. A PaO2 with several FiO2 near it has a row for each.
    """
    df = events.join(vent_dependent(events, c, v), c.key, "left_anti")
    pf = pf_pairs(df, c, v).select(c.key, F.col("p_t").alias(c.ts), F.col("p_name").alias(c.name), "pf_ratio", "PF_Ratio_Flag")
    df = df.join(pf, [c.key, c.ts, c.name], "left")
    g, t = F.col(c.group), F.col(c.text)
    df = df.withColumns({
        "vent_onoff_flag": F.when((g == v.onoff) & t.isin(*v.on_status), 1), "vent_doc_flag": F.when(g == v.on_doc, 1),
        "o2_vent_flag": F.when((g == v.mechanical) & t.isin(*v.mechanical_status), 1),
    })
    end = (g == v.off_doc) | g.isin(*v.low_support) | ((g == v.onoff) & (t.isNull() | t.isin(*v.off_status))) | (F.col("pf_ratio") > v.pf_limit)
    df = df.withColumn("vent_end_flag", F.when(end, 0))
    return df.withColumn("pulmonary_dysfunction_flag", F.coalesce("vent_end_flag", "vent_onoff_flag", "vent_doc_flag", "PF_Ratio_Flag", "o2_vent_flag"))


def latest_status(timeline: DataFrame, events: DataFrame, c: Columns, on: str, off: str, oxygen: str) -> DataFrame:
    """key, time, status_time, status: for each instant the ventilator status last documented (`off` before any) and, as a row of its own, the oxygen one if there is one."""
    t = timeline.select(c.key, c.ts).distinct()
    last = lambda *groups: asof_join(t, events.where(F.col(c.group).isin(*groups)).select(c.key, F.col(c.ts).alias("status_time"), F.col(c.group).alias("status")), [c.key], c.ts, "status_time", ["status"])
    vent, o2 = last(on, off).withColumn("r_status", F.coalesce("r_status", F.lit(off))), last(oxygen).where("r_status is not null")
    return vent.union(o2).distinct().select(c.key, c.ts, F.col("r_status_time").alias("status_time"), F.col("r_status").alias("status"))


def dysfunction_by_status(status: Column, on: Sequence[str]) -> Column:
    """1 if the latest status is one of those that mean support, else 0 (null: 0)."""
    return F.when(status.isin(*on), 1).otherwise(0)


def sepsis_labels(infect: DataFrame, sirs_df: DataFrame, organ: DataFrame, shock: DataFrame, key: str, ts: str, s: Scenario, pulmonary_df: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables sepsis1, sepsis2, sepsis3: infection time, matching event and the earlier of both."""
    inf = infect.select(key, "infect_dt").distinct()
    hit = lambda base, df, cond, h: band_join(base, df.where(cond), [key], "infect_dt", ts, h, h)
    one = hit(inf, sirs_df.select(key, ts, "sirs_score"), "sirs_score >= 2", s.sirs_hours).withColumn("earliest_sepsis1_instance", F.least("infect_dt", ts))
    two = hit(inf, organ.select(key, ts, "organ_dysfunction_total"), "organ_dysfunction_total >= 1", s.organ_hours)
    if pulmonary_df is not None:
        lung = hit(inf, pulmonary_df.select(key, ts, "pulmonary_dysfunction_flag"), "pulmonary_dysfunction_flag >= 1", s.organ_hours)
        two = backbone_join(two, lung, [key, "infect_dt"], "", "_pulmonarydys").withColumn("earliest_sepsis2_instance", F.least("infect_dt", ts, f"{ts}_pulmonarydys"))
    else:
        two = two.withColumn("earliest_sepsis2_instance", F.least("infect_dt", ts))
    return {"sepsis1": one, "sepsis2": two, "sepsis3": sepsis3(two, shock, key, ts, s)}


def sepsis3(two: DataFrame, shock: DataFrame, key: str, ts: str, s: Scenario) -> DataFrame:
    """The infections of table sepsis2 with shock near them."""
    near = shock.select(key, ts, "septic_shock_flag").where("septic_shock_flag >= 1")
    pairs = band_join(two.select(key, "infect_dt").distinct(), near, [key], "infect_dt", ts, s.shock_hours, s.shock_hours)
    return pairs.withColumn("earliest_sepsis3_instance", F.least("infect_dt", ts))


def stacked(labels: Mapping[str, DataFrame], key: str) -> DataFrame:
    """key, score 1 to 3, first instant of each label."""
    out = None
    for k in (1, 2, 3):
        x = labels[f"sepsis{k}"].groupBy(key).agg(F.min(f"earliest_sepsis{k}_instance").alias("instant")).select(key, F.lit(k).alias("score"), "instant")
        out = x if out is None else out.union(x)
    return out


def poa(first: str, arrival: str, hours: float, score: Column | None = None) -> Column:
    """POA if the first instant is within `hours` after arrival, else (also without either time) NPOA, with the severity."""
    label = F.when(hours_between(arrival, first) <= hours, "POA").otherwise("NPOA")
    return label if score is None else F.concat(label, F.lit("-"), score.cast("string"))


#: The stage tables of a run, in order.
STAGES = ("events", "bounded", "infect_long", "agg", "sirs", "organdysfunction", "septicshock", "o2vent", "sepsis1", "sepsis2", "sepsis3")
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def run(spark: SparkSession, events: DataFrame, encounters: DataFrame, s: Scenario = Scenario(), keep: Keep = lambda _, make: make()) -> dict[str, DataFrame]:
    """All stage tables of a scenario, each from those before it: lazy until written, unless `keep` (a `Stages`) writes them."""
    c, out = s.columns, {}

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        out[name] = keep(name, make)
        return out[name]

    base = encounters.select(c.key, *[n for n in encounters.columns if n.startswith("Baseline_")])
    raw = stage("events", lambda: events)
    ev = stage("bounded", lambda: raw.withColumn(c.number, bounded(c.group, c.number, s.bounds)) if s.bounds else raw)
    infect = stage("infect_long", lambda: infections(ev, s))
    agg = stage("agg", lambda: lookback(ev, pressures(ev, c), c.key, c.ts, c.group, c.number, s.features))
    flags = stage("sirs", lambda: sirs(agg))
    organ = stage("organdysfunction", lambda: organ_dysfunction(agg.join(base, c.key, "left")))
    shock = stage("septicshock", lambda: septic_shock(organ, s.null_mode).select(*agg.columns, *[n for n in organ.columns if n.startswith("Baseline_")], *SHOCK_FLAGS))
    lung = stage("o2vent", lambda: pulmonary(ev, c))
    labels = sepsis_labels(infect, flags, organ, shock, c.key, c.ts, s, lung)
    stage("sepsis1", lambda: labels["sepsis1"])
    two = stage("sepsis2", lambda: labels["sepsis2"])
    stage("sepsis3", lambda: sepsis3(two, shock, c.key, c.ts, s))
    return out


def run_scenario(spark: SparkSession, events: DataFrame, encounters: DataFrame, s: Scenario, root: str, resume: bool = False, after: Scenario | None = None) -> list[str]:
    """Every stage table under root/table/scenario=name, written once and read back by the next; the stages that ran.

    `events` is read once. `resume` goes on with a run of the same thresholds that broke off. `after` is a complete
    run of the same tables: if only hours of the labels differ, the stages before the labels are written from its tables.
    """
    stages, keep = Stages(spark, root, s.name, s.as_json(), STAGES, resume), None
    if after and replace(s, name=after.name, sirs_hours=after.sirs_hours, organ_hours=after.organ_hours, shock_hours=after.shock_hours) == after:
        same = load_run(spark, root, after.name, [t for t in STAGES if not t.startswith("sepsis")])
        keep = lambda name, make: stages(name, (lambda: same[name]) if name in same else make)
    run(spark, events, encounters, s, keep or stages)
    return stages.made


Stored = str | tuple[str, str] | Mapping[str, DataFrame]


def resolve(spark: SparkSession, ref: Stored, root: str, tables: Sequence[str]) -> Mapping[str, DataFrame]:
    """The tables of a scenario given as they are, by name in the manifest of `root`, or as (another root, name)."""
    if isinstance(ref, Mapping):
        return ref
    folder, name = (root, ref) if isinstance(ref, str) else ref
    return load_run(spark, folder, name, tables)


def compare_scenarios(spark: SparkSession, a: Stored, b: Stored, root: str, key: str = Columns.key) -> dict[str, DataFrame]:
    """Two scenarios' labels compared: overlap of keys, and agreement of the first and of the highest score."""
    names = ("sepsis1", "sepsis2", "sepsis3")
    both = [severities(stacked(resolve(spark, x, root, names), key), key) for x in (a, b)]
    return compare_runs(*both, key, ["sepsis_score", "sepsis_score_at_max"])


def run_and_compare(spark: SparkSession, events: DataFrame, encounters: DataFrame, a: Scenario, b: Scenario, root: str) -> dict[str, DataFrame]:
    """Both scenarios run and stored, then compared."""
    run_scenario(spark, events, encounters, a, root)
    run_scenario(spark, events, encounters, b, root, after=a)
    return compare_scenarios(spark, a.name, b.name, root, a.columns.key)


def severities(stack: DataFrame, key: str) -> DataFrame:
    """Per key: first instant and its highest score, and the highest score and its first instant (`_at_max`)."""
    first = earliest(stack, [key], "score", "instant").withColumnsRenamed({"first_time": "first_sepsis_instant", "first_score": "sepsis_score"})
    most = highest(stack, [key], "score", "instant").withColumnsRenamed({"max_score": "sepsis_score_at_max", "max_time": "first_sepsis_instant_at_max"})
    return first.join(most, key)


def sofa_worst(band: DataFrame, key: str, organ: str, points: str, least: int = 2) -> DataFrame:
    """Worst points of each organ, summed per key; keys with at least `least`."""
    worst = band.groupBy(key, organ).agg(F.max(points).alias("p"))
    return worst.groupBy(key).agg(F.sum("p").alias("sofa")).where(F.col("sofa") >= least)


def first_organ(df: DataFrame, key: str, organ: str, ts: str, action: str) -> DataFrame:
    """First failed organ, its time, and the hours to the first action."""
    f = first_rows(df, [key], [F.col(ts), F.col(organ)]).select(key, F.col(organ).alias("first_organ"), F.col(ts).alias("first_time"), action)
    return f.withColumn("lag_hours", hours_between("first_time", action))
