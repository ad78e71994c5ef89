"""Reading cluster specs: raw form texts (S1) and shared links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetwright import schema
from fleetwright.functions.columns import derive
from fleetwright.functions.numbers import at_least, num_text, or_else, parse_number

RAW_SCHEMA = T.StructType(
    [T.StructField("cluster_id", T.LongType(), False)]
    + [T.StructField(name, T.StringType()) for name in (
        *schema.NUMBER_DEFAULTS, *schema.FLAG_DEFAULTS, *schema.TEXT_DEFAULTS)]
)

# Smallest accepted value, and fallbacks where zero means "not given".
FLOORS = {"nodes": 1.0, "cpn": 1.0, "rpn": 1.0, "min_ec": 1.0, "min_em": 1.0,
          "master_ram": 1.0, "master_cores": 1.0, "os_cr": 0.0}
ZERO_FALLBACKS = {"mf": 0.6, "sf": 0.5, "num_jobs": 2.0}

# Link parameters and the spec fields they carry.
LINK_FIELDS = {"n": "nodes", "c": "cpn", "r": "rpn", "m": "deploy_mode", "w": "workload"}


def load_specs(spark, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Raw spec table from files, every field as text under an explicit schema."""
    options = {"header": "true", **options} if fmt == "csv" else options
    return spark.read.schema(RAW_SCHEMA).format(fmt).options(**options).load(path)


def read_specs(raw: DataFrame) -> DataFrame:
    """Typed specs from form texts."""
    columns = {}
    for name in schema.NUMBER_DEFAULTS:
        whole = f"regexp_extract({name}, '^\\\\s*[+-]?[0-9]+', 0)"
        value = parse_number(whole if name == "num_jobs" else name)
        if name in FLOORS:
            value = at_least(FLOORS[name], value)
        if name in ZERO_FALLBACKS:
            value = or_else(value, f"{ZERO_FALLBACKS[name]}D")
        columns[name] = value
    for name in schema.FLAG_DEFAULTS:
        columns[name] = f"coalesce(lower(trim({name})) = 'true', false)"
    for name, default in schema.TEXT_DEFAULTS.items():
        columns[name] = f"coalesce(nullif({name}, ''), '{default}')"
    return derive(raw, {name: expr for name, expr in columns.items() if name in raw.columns})


def decode_share_links(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Spec fields carried by a link; an absent or empty parameter keeps the base value."""
    columns = {}
    for key, field in LINK_FIELDS.items():
        # Taken from the text as it stands: a blank or brace elsewhere in the link does not matter.
        query = f"regexp_extract(substring_index({url_col}, '#', 1), '[?&]{key}=([^&]*)', 1)"
        given = f"try_url_decode(nullif({query}, ''))"
        if field in schema.NUMBER_DEFAULTS:
            number = at_least(1, parse_number(given))
            columns[field] = f"IF({given} IS NULL, CAST({field} AS DOUBLE), {number})"
        else:
            columns[field] = f"coalesce({given}, {field})"
    return derive(df, columns)


def encode_share_links(df: DataFrame, base_col: str = "base_url") -> DataFrame:
    """S3: link with the five shared fields; an earlier query string is dropped."""
    pairs = [
        f"'{key}=', url_encode({num_text(field) if field in schema.NUMBER_DEFAULTS else field})"
        for key, field in LINK_FIELDS.items()]
    query = ", '&', ".join(pairs)
    return derive(df, {"share_url": f"concat(substring_index({base_col}, '?', 1), '?', {query})"})
