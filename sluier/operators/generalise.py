"""Generalisation: what may stay in the text becomes coarser. All edits of a text are made in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.functions.checks import date_triplet, icd_normalise
from sluier.operators.entity_types import RARE_CODES

TREATMENT_DATES = ("admission_date", "discharge_date", "exam_date")
OLDEST_AGE = 90
# Switch keys of the configuration; all default to true.
SWITCHES = ("gen_birthdate", "gen_postcode", "gen_age", "gen_treatment_dates", "gen_flag_rare_icd")
_LEAD = r"(?iU)\s+op\s+$"
#: Characters before a date in which ` op ` is sought.
LEAD = 20

GENERAL = "struct<start:int,end:int,original:string,entity_type:string,new_type:string,new:string,rare:boolean>"


def read_switches(config: DataFrame) -> DataFrame:
    """(key, enabled) of all switches from config (key, value): 1, true, yes, on in any case; missing means true."""
    known = config.sparkSession.createDataFrame([(k,) for k in SWITCHES], "key string")
    on = F.lower(F.trim("value")).isin("1", "true", "yes", "on")
    return known.join(config.select("key", "value"), "key", "left").select("key", F.coalesce(on, F.lit(True)).alias("enabled"))


def birth_year(value: Column) -> Column:
    return date_triplet(value)["year"].cast("string")


def short_postcode(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) >= 2, F.substring(digits, 1, 2))


def coarse_age(value: Column) -> Column:
    """90+ from 90 on; null below."""
    word = F.when(F.lower(value).contains("jarige"), "jarige").otherwise("jaar")
    return F.when(F.regexp_extract(value, r"(\d{1,3})", 1).try_cast("int") >= OLDEST_AGE, F.concat(F.lit(f"{OLDEST_AGE}+ "), word))


def month_of(value: Column) -> Column:
    return S.let(date_triplet(value), lambda d: F.when(d.isNotNull(), F.format_string("%04d-%02d", d["year"], d["month"])))


def is_rare(value: Column) -> Column:
    return icd_normalise(value).isin(*RARE_CODES)


def edits_of(text: Column, spans: Column, on: set[str]) -> Column:
    """What becomes of each span: (s, start, end, new, new_type); new is null if it stays as it is.

    ` op ` before a treatment date goes and ` in ` comes; the span then begins where that blank was. The steps are chained
    transforms, so a date is parsed once however many fields need it.
    """
    before = S.stretches(text, F.transform(spans, lambda s: F.struct(F.greatest(s["start"] - LEAD, F.lit(0)).alias("start"), s["start"].alias("end"))))

    def looked_at(s: Column, i: Column, led: Column) -> Column:
        kind = s["entity_type"]
        treated = kind.isin(*TREATMENT_DATES) & F.lit("gen_treatment_dates" in on)
        new = F.when(treated, month_of(s["original"]))
        if "gen_birthdate" in on:
            new = new.when(kind == "birthdate", birth_year(s["original"]))
        if "gen_postcode" in on:
            new = new.when(kind == "postcode_pc6", short_postcode(s["original"]))
        if "gen_age" in on:
            new = new.when(kind == "age", coarse_age(s["original"]))
        lead = F.when(treated, F.regexp_extract(F.get(led, i), _LEAD, 0)).otherwise("")
        return F.struct(s.alias("s"), new.alias("form"), lead.alias("lead"))

    def edit(x: Column) -> Column:
        s, led = x["s"], x["form"].isNotNull() & (x["lead"] != "")
        new_type = F.when(x["form"].isNotNull() & (s["entity_type"] == "birthdate"), "birth_year").when(x["form"].isNotNull() & (s["entity_type"] == "postcode_pc6"), "postcode_pc2").otherwise(s["entity_type"])
        return F.struct(
            s.alias("s"),
            F.when(led, s["start"] - F.length(x["lead"])).otherwise(s["start"]).alias("start"),
            s["end"].alias("end"),
            F.when(led, F.concat(F.lit(" in "), x["form"])).otherwise(x["form"]).alias("new"),
            new_type.alias("new_type"),
        )

    return F.transform(S.let(before, lambda led: F.transform(spans, lambda s, i: looked_at(s, i, led))), edit)


def generalise(docs: DataFrame, spans: str = "spans", switches: dict[str, bool] | None = None) -> DataFrame:
    """docs (text, spans in the order of the text) with general_text and general_spans: the spans at their new places, with type, generalized_to and rare flag.

    Edits that cross each other leave the text as it is and are told in the column general_error.
    """
    on = {k for k in SWITCHES if (switches or {}).get(k, True)}
    text = F.col("text")
    changes = lambda edited: F.array_sort(F.transform(F.filter(edited, lambda x: x["new"].isNotNull()), lambda x: F.struct(x["start"], x["end"], x["new"])))

    def placed(x: Column, edits: Column, start: Column) -> Column:
        changed = x["new"].isNotNull() & (F.size(edits) > 0)
        rare = (x["s"]["entity_type"] == "icd10_code") & is_rare(x["s"]["original"]) if "gen_flag_rare_icd" in on else F.lit(False)
        length = F.when(changed, F.length(x["new"])).otherwise(x["s"]["end"] - x["s"]["start"])
        return F.struct(
            start.alias("start"),
            (start + length).alias("end"),
            x["s"]["original"].alias("original"),
            F.when(changed, x["new_type"]).otherwise(x["s"]["entity_type"]).alias("entity_type"),
            x["s"]["confidence"].alias("confidence"),
            x["s"]["layer"].alias("layer"),
            F.when(changed, x["new"]).alias("generalized_to"),
            F.coalesce(rare, F.lit(False)).alias("rare_icd_review"),
        )

    def whole(x: Column) -> Column:
        safe = F.when(S.crossing(x["edits"]), S.none(S.EDIT)).otherwise(x["edits"])
        starts = lambda edits: F.transform(x["edited"], lambda e: F.when(e["new"].isNotNull() & (F.size(edits) > 0), e["start"]).otherwise(e["s"]["start"]))
        return S.let(
            safe,
            lambda edits: F.struct(
                S.let(S.moved(starts(edits), edits), lambda to: F.array_sort(F.transform(x["edited"], lambda e, i: placed(e, edits, F.get(to, i))))).alias("spans"),
                S.rewrite(text, edits).alias("text"),
                F.when(F.size(edits) < F.size(x["edits"]), "crossing edits").alias("error"),
            ),
        )

    both = S.let(edits_of(text, F.col(spans), on), lambda edited: F.struct(edited.alias("edited"), changes(edited).alias("edits")))
    rows = docs.withColumn("__g", S.let(both, whole))
    return rows.withColumns({"general_spans": F.col("__g.spans"), "general_text": F.col("__g.text"), "general_error": F.col("__g.error")}).drop("__g")
