"""Prompt templates: assembling, overrides, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.operators.entity_types import ENTITY_TYPES

# The placeholder and the two modes.
PLACEHOLDER, MODES = "{input}", ("one_way", "two_way")


def assemble_prompt(docs: DataFrame, templates: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """docs (template_id, text) with prompt and error: each placeholder of the template becomes the text.

    An unknown template, an empty template text and one without placeholder are errors. Up to max_rows templates are broadcast.
    """
    side = templates.select(F.col("id").alias("template_id"), "prompt_tekst")
    side = F.broadcast(side) if templates.limit(max_rows + 1).count() <= max_rows else side
    rows = docs.join(side, "template_id", "left")
    template = F.trim(F.coalesce("prompt_tekst", F.lit("")))
    error = F.when(F.col("prompt_tekst").isNull(), "unknown template").when(template == "", "empty template").when(~F.contains("prompt_tekst", F.lit(PLACEHOLDER)), "no placeholder")
    rows = rows.withColumn("error", error)
    return rows.withColumn("prompt", F.when(F.col("error").isNull(), F.replace("prompt_tekst", F.lit(PLACEHOLDER), F.col("text")))).drop("prompt_tekst")


def fill_lenient(template: Column, text: Column) -> Column:
    """For previews: without placeholder the text follows after a blank line; an empty template is the text."""
    return F.when(F.trim(F.coalesce(template, F.lit(""))) == "", text).when(F.contains(template, F.lit(PLACEHOLDER)), F.replace(template, F.lit(PLACEHOLDER), text)).otherwise(F.concat(template, F.lit("\n\n"), text))


def parse_overrides(raw: Column) -> Column:
    """JSON object type -> mode as a map; null where it is no object."""
    return F.from_json(raw, "map<string,string>")


def bad_overrides(overrides: Column) -> Column:
    """Entries whose key is no entity type or whose value is no mode."""
    known = [t for t, *_ in ENTITY_TYPES]
    return F.filter(F.map_entries(overrides), lambda e: ~e["key"].isin(known) | ~e["value"].isin(*MODES) | e["value"].isNull())


def validate_templates(templates: DataFrame) -> DataFrame:
    """templates with errors (array of text, empty if valid)."""
    overrides = parse_overrides(F.col("mode_overrides"))
    two_way = (F.col("default_mode") == "two_way") | F.exists(F.map_values(overrides), lambda v: v == "two_way")
    found = F.regexp_extract_all("prompt_tekst", F.lit(r"\{[A-Za-z_][A-Za-z0-9_]*\}"), F.lit(0))
    filled = F.trim(F.coalesce("prompt_tekst", F.lit(""))) != ""
    checks = [
        (F.coalesce(two_way, F.lit(False)) & (F.trim(F.coalesce("two_way_justification", F.lit(""))) == ""), "two_way without justification"),
        (filled & (F.size(F.filter(found, lambda x: x == PLACEHOLDER)) != 1), "not exactly one placeholder"),
        (filled & F.exists(found, lambda x: x != PLACEHOLDER), "foreign placeholder"),
        (F.col("max_tokens") <= 0, "max_tokens not positive"),
        (F.col("mode_overrides").isNotNull() & (overrides.isNull() | (F.size(bad_overrides(overrides)) > 0)), "bad override"),
    ]
    return templates.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks))))


def ordered_templates(templates: DataFrame) -> DataFrame:
    return templates.orderBy("sort_order", "id")


def provider_gate(requests: DataFrame, templates: DataFrame, provider: str = "anthropic") -> DataFrame:
    """requests (template_id) with rejected: why a request is refused, else null."""
    side = templates.select(F.col("id").alias("template_id"), "llm_provider", F.lit(True).alias("__known"))
    rows = requests.join(F.broadcast(side) if templates.limit(100_001).count() <= 100_000 else side, "template_id", "left")
    why = F.when(F.col("__known").isNull(), "unknown template").when(F.lower(F.coalesce("llm_provider", F.lit(""))) != provider, "unsupported provider")
    return rows.withColumn("rejected", why).drop("__known", "llm_provider")
