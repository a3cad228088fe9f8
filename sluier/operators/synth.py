"""Synthetic dossiers: segments to labelled text, placeholders, seeded values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.operators.generalise import birth_year, coarse_age, month_of, short_postcode
from sluier.session import materialise

# Other names of types in placeholders.
ALIASES = {"PERSON": "name", "PER": "name", "GPE": "location", "LOC": "location", "POSTCODE": "postcode_pc6", "ZIP": "postcode_pc6", "DOB": "birthdate"}
PLACEHOLDER = r"\{\{[A-Za-z0-9_]+(?::[^{}]*)?\}\}"
FIRST_NAMES, LAST_NAMES = "Anna Bram Carla Daan Eva Femke Gijs Hanna".split(), "Jansen Bakker Visser Smit Mulder Meijer Bos Vos".split()
STREETS, TOWNS = "Dorpsstraat Kerkweg Stationslaan Molenpad Marktplein".split(), "Utrecht Zwolle Breda Assen Delft".split()
CODES = "I21.4 J44 E11.9 G71.0 K35 E75.2 C50.1 F84.2".split()


def segments_to_gold(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """segments (doc_id, seq, text, entity_type or null) -> docs (doc_id, text), gold (doc_id, start, end, text, entity_type)."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    gold = placed.filter("entity_type is not null").select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text", "entity_type")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    return segments.groupBy("doc_id").agg(F.array_join(parts, "").alias("text")), gold


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _digits(number: Column, n: int) -> Column:
    return F.lpad(F.pmod(number, F.lit(10**n)).cast("string"), n, "0")


def bsn_of(number: Column) -> Column:
    """A valid BSN: eight digits and the ninth that makes the sum divide by 11; where that would be 10, the eighth is lowered or raised by one."""
    def ninth(eight: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.substring(eight, i + 1, 1).cast("int") * (9 - i) for i in range(8)]) % 11

    first = F.concat(F.lit("1"), _digits(number, 7))
    last = F.substring(first, 8, 1).cast("int")
    other = F.concat(F.substring(first, 1, 7), F.when(last > 0, last - 1).otherwise(1).cast("string"))
    eight = F.when(ninth(first) == 10, other).otherwise(first)
    return F.concat(eight, ninth(eight).cast("string"))


def iban_of(number: Column) -> Column:
    """A valid IBAN of a bank that doesn't exist."""
    account = F.pmod(number, F.lit(10**10))
    rest = ((F.lit(111023200000000000) + account) % 97 * 1000000 + 232100) % 97  # BANK, account, NL00 as digits
    return F.concat(F.lit("NL"), _digits(98 - rest, 2), F.lit("BANK"), _digits(account, 10))


def _date(number: Column, first_year: int, years: int) -> Column:
    parts = (F.pmod(number, F.lit(28)) + 1, F.pmod(F.shiftright(number, 8), F.lit(12)) + 1, F.pmod(F.shiftright(number, 16), F.lit(years)) + first_year)
    return F.concat_ws("-", *(p.cast("string") for p in parts))


VALUES: dict[str, Callable[[Column], Column]] = {
    "bsn": bsn_of,
    "iban": iban_of,
    "phone": lambda x: F.concat(F.lit("06-"), (F.pmod(x, F.lit(90_000_000)) + 10_000_000).cast("string")),
    "email": lambda x: F.concat(F.lit("persoon"), _digits(x, 5), F.lit("@voorbeeld.example")),
    "postcode_pc6": lambda x: F.concat((F.pmod(x, F.lit(9000)) + 1000).cast("string"), F.lit(" "), F.char(F.pmod(x, F.lit(26)) + 65), F.char(F.pmod(F.shiftright(x, 7), F.lit(26)) + 65)),
    "birthdate": lambda x: _date(x, 1920, 90),
    "admission_date": lambda x: _date(x, 2020, 5),
    "discharge_date": lambda x: _date(x, 2020, 5),
    "exam_date": lambda x: _date(x, 2020, 5),
    "mrn": lambda x: F.concat(F.lit("MRN "), _digits(x, 8)),
    "epd_id": lambda x: F.concat(F.lit("EPD-"), _digits(x, 9)),
    "kenteken": lambda x: F.concat(F.lit("AB-"), _digits(x, 3), F.lit("-C")),
    "age": lambda x: F.concat(F.pmod(x, F.lit(105)).cast("string"), F.lit(" jaar")),
    "icd10_code": lambda x: _pick(CODES, x),
    "project": lambda x: F.concat(F.lit("PRJ-"), _digits(x, 4)),
    "address": lambda x: F.concat(_pick(STREETS, x), F.lit(" "), (F.pmod(F.shiftright(x, 9), F.lit(200)) + 1).cast("string")),
    "name": lambda x: F.concat_ws(" ", _pick(FIRST_NAMES, x), _pick(LAST_NAMES, F.shiftright(x, 11))),
    "location": lambda x: _pick(TOWNS, x),
    "org": lambda x: F.concat(F.lit("Kliniek "), _pick(TOWNS, x)),
}
# Types for which a value given in a placeholder is used as it is.
GIVEN = ("age", "icd10_code", "name", "location", "org", "address", "birthdate", "admission_date", "discharge_date", "exam_date", "postcode_pc6", "project")


def synthetic_value(entity_type: Column, seed: Column) -> Column:
    """A fictional value of a type; equal seeds give equal values. Null for types that have none."""
    number = F.shiftrightunsigned(F.xxhash64(seed, entity_type), 2)
    out = None
    for kind, make in VALUES.items():
        out = F.when(entity_type == kind, make(number)) if out is None else out.when(entity_type == kind, make(number))
    return out


def render_placeholders(templates: DataFrame, seed: int) -> DataFrame:
    """templates (doc_id, text with {{TYPE}} or {{TYPE:value}}) -> doc_id, text, gold (array of start, end, text, entity_type), error.

    An unknown type stays as plain text of its value or name; braces that are left over are an error.
    """
    found = S.scan(F.col("text"), PLACEHOLDER)
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def filled(s: Column, i: Column) -> Column:
        inner = F.substring(s["text"], F.lit(3), F.length(s["text"]) - 4)
        raw, given = F.upper(F.regexp_extract(inner, "^([^:]*)", 1)), F.regexp_extract(inner, "^[^:]*:(.*)$", 1)
        kind = F.coalesce(F.try_element_at(names, raw), F.lower(raw))
        made = synthetic_value(kind, F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string")))
        new = F.when((given != "") & (kind.isin(*GIVEN) | made.isNull()), given).otherwise(F.coalesce(made, inner))
        return F.struct(s["start"], s["end"], new.alias("new"), F.when(made.isNotNull(), kind).alias("kind"))

    rows = templates.withColumn("__e", F.transform(found, filled))
    edits = F.transform("__e", lambda e: F.struct(e["start"], e["end"], e["new"]))
    known = F.filter("__e", lambda e: e["kind"].isNotNull())
    label = lambda start, e: F.struct(start.alias("start"), (start + F.length(e["new"])).alias("end"), e["new"].alias("text"), e["kind"].alias("entity_type"))
    placed = S.let(known, lambda some: S.let(S.moved(F.transform(some, lambda e: e["start"]), F.col("__edits")), lambda to: F.transform(some, lambda e, i: label(F.get(to, i), e))))
    rows = rows.withColumn("__edits", edits).withColumn("gold", placed).withColumn("text", S.rewrite(F.col("text"), F.col("__edits")))
    return rows.withColumn("error", F.when(F.contains("text", F.lit("{{")) | F.contains("text", F.lit("}}")), "braces left over")).drop("__e", "__edits")


def expected_generalisation(entity_type: Column, value: Column) -> Column:
    """The form that a label's text should take; null if it stays."""
    return (
        F.when(entity_type == "birthdate", birth_year(value))
        .when(entity_type == "postcode_pc6", short_postcode(value))
        .when(entity_type == "age", coarse_age(value))
        .when(entity_type.isin("admission_date", "discharge_date", "exam_date"), month_of(value))
    )


def scenario_mix(spark: SparkSession, n: int, adversarial: float, normal: list[str], hard: list[str]) -> DataFrame:
    """(i, difficulty, scenario): first the normal records, then ceil(n * adversarial) adversarial ones; scenarios take turns."""
    rows = spark.range(n).withColumn("first_hard", F.lit(n) - F.ceil(F.lit(n * adversarial)))
    is_hard = F.col("id") >= F.col("first_hard")
    scenario = F.when(is_hard, _pick(hard, F.col("id") - F.col("first_hard"))).otherwise(_pick(normal, F.col("id")))
    return rows.select(F.col("id").alias("i"), F.when(is_hard, "adversarial").otherwise("normal").alias("difficulty"), scenario.alias("scenario"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i: 0, 1, ... in the order given. Ranges are sorted each for itself; only their sizes, one number each, are summed in one place."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    # The upper bits of the id tell the partition, the lower ones the place in it.
    placed = materialise(dealt.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn("i", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def difficulty_subset(records: DataFrame, difficulty: str) -> DataFrame:
    return records.filter(F.col("difficulty") == difficulty)
