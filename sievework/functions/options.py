"""Options and feature flags from JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Options that only a first run may set.
STRUCTURAL = ("resolution", "archi", "ae_dims", "e_dims", "d_dims", "d_mask_dims", "head_name")


def read(text: Column) -> Column:
    """A JSON object as a map from names to texts; null where it is none."""
    return F.from_json(text, "map<string,string>")


def coerced(value):
    """A value as options take it: texts that say so become booleans, whole or other numbers."""
    if not isinstance(value, str):
        return value
    low = value.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    try:
        return float(low) if "." in low or "e" in low else int(low)
    except ValueError:
        return value


def typed(text: Column) -> Column:
    """(kind, value) of an option's text, many rows at once: kind is boolean, int, double or string,
    and the value is written in one way for each kind."""
    low = F.lower(F.trim(text))
    whole, number = F.rlike(low, F.lit(r"^[+-]?\d+$")), F.rlike(low, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"))
    kind = F.when(low.isin("true", "false"), "boolean").when(whole, "int").when(number, "double").otherwise("string")
    value = F.when(low.isin("true", "false"), low).when(whole, F.try_to_number(low, F.lit("S" + "9" * 30)).cast("string"))
    value = value.when(number, low.cast("double").cast("string")).otherwise(text)
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(value, text).alias("value")))


def overlaid(defaults: Column, given: Column, first_run: Column, structural: tuple[str, ...] = STRUCTURAL) -> Column:
    """merged() for maps of texts, many rows at once: the defaults overlaid with what is given, without
    structural options unless it is a first run; lr_dropout is y or n where a boolean is given."""
    plain = F.transform_values(given, lambda k, v: F.when((k == "lr_dropout") & F.lower(F.trim(v)).isin("true", "false"), F.when(F.lower(F.trim(v)) == "true", "y").otherwise("n")).otherwise(typed(v)["value"]))
    used = F.map_filter(plain, lambda k, v: first_run | ~k.isin(*structural))
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(used, k))
    return F.when(used.isNull(), defaults).otherwise(F.map_concat(kept, used))


def merged(defaults: dict, given: dict, first_run: bool, structural: tuple[str, ...] = STRUCTURAL) -> dict:
    """defaults overlaid with what is given, without structural options unless it is a first run."""
    out = dict(defaults)
    for name, value in given.items():
        if first_run or name not in structural:
            value = coerced(value)
            out[name] = ("y" if value else "n") if name == "lr_dropout" and isinstance(value, bool) else value
    return out


def flags(defaults: dict[str, dict], given: dict | None, version: int = 1) -> tuple[dict[str, dict], list[str]]:
    """Feature flags and warnings. Unknown sections' keys are ignored, texts become booleans, and a
    newer schema turns everything off."""
    off = {section: dict(keys) for section, keys in defaults.items()}
    if not isinstance(given, dict):
        return off, []
    newer = given.get("schema_version", version)
    if isinstance(newer, int) and newer > version:
        return off, [f"schema {newer} is newer than {version}: all flags stay off"]
    for section, keys in off.items():
        own = given.get(section)
        for name in keys:
            if isinstance(own, dict) and name in own:
                value = coerced(own[name])
                keys[name] = bool(value) if isinstance(keys[name], bool) else value
    return off, []


def option(options: Column, defaults: Column, name: str, value) -> Column:
    """The option's value, else its default, else the given one."""
    return F.coalesce(F.try_element_at(options, F.lit(name)), F.try_element_at(defaults, F.lit(name)), F.lit(value))
