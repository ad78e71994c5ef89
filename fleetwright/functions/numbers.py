"""Number rules of the reference model as SQL expression texts.

Operators state their formulas as SQL text and hand them to Spark in one call per layer,
which keeps them readable and spares a driver round trip per operator sign.
"""

from __future__ import annotations

# Longest numeric prefix of a text, as a lenient number reader takes it.
NUMBER_PREFIX = r"^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def half_up(x: str) -> str:
    """Nearest whole number, ties towards plus infinity (also for negatives).

    The fraction `x - floor(x)` is exact, unlike `floor(x + 0.5)`.
    """
    return f"CAST(floor({x}) + IF(({x}) - floor({x}) >= 0.5D, 1, 0) AS DOUBLE)"


def one_decimal(x: str) -> str:
    return f"{half_up(f'({x}) * 10')} / 10"


def floor_d(x: str) -> str:
    return f"CAST(floor({x}) AS DOUBLE)"


def ceil_d(x: str) -> str:
    return f"CAST(ceil({x}) AS DOUBLE)"


def at_least(low: float, x: str) -> str:
    return f"greatest({float(low)}D, {x})"


def nonzero(x: str) -> str:
    """A hand-set zero gives no quotient (floors apply) instead of failing the job."""
    return f"nullif({x}, 0D)"


def or_else(x: str, fallback: str) -> str:
    """`x`, or the fallback when it is null or zero."""
    return f"coalesce(nullif({x}, 0D), {fallback})"


def job_count(num_jobs: str = "num_jobs") -> str:
    """Jobs of a plan: the whole part of the number typed in, 2 for zero, at least 1."""
    whole = f"CAST(CAST({num_jobs} AS BIGINT) AS DOUBLE)"
    return f"greatest(1D, coalesce(nullif({whole}, 0D), 2D))"


def percent(part: str, whole: str) -> str:
    """Whole percent of `whole`, 0 when there is nothing to divide by."""
    return f"IF({whole} > 0, {half_up(f'({part}) / ({whole}) * 100')}, 0D)"


def parse_number(text: str) -> str:
    """Numeric prefix of a text; blank or unreadable gives 0."""
    return f"coalesce(try_cast(regexp_extract({text}, '{NUMBER_PREFIX}', 1) AS DOUBLE), 0D)"


def num_text(x: str) -> str:
    """Whole numbers without a fraction, others in shortest form."""
    return f"IF(({x}) = floor({x}), CAST(CAST({x} AS BIGINT) AS STRING), CAST({x} AS STRING))"


def fixed_text(x: str, digits: int) -> str:
    """Text with a fixed number of decimals, rounded on the exact binary value, ties up.

    A binary fraction lies exactly between two decimals only when x * 2**(digits+1) is
    whole; `format_number` rounds every other value by its exact binary expansion.
    """
    scaled, ten = f"({x}) * {2 ** (digits + 1)}", 10 ** digits
    value = f"IF({scaled} = floor({scaled}), {half_up(f'({x}) * {ten}')} / {ten}, {x})"
    return f"replace(format_number({value}, {digits}), ',', '')"


def overhead_mb(heap_gb: str, mode: str = "round") -> str:
    """Off-heap megabytes for a heap: a tenth of it, at least 384.

    The cluster-wide figure takes the ceiling; job, reservation and driver figures round.
    """
    tenth = f"{heap_gb} * 1024 * 0.1D"
    return f"greatest(384D, {ceil_d(tenth) if mode == 'ceil' else half_up(tenth)})"


def pyspark_mb(flag: str = "pyspark") -> str:
    return f"IF({flag}, 1024D, 0D)"
