"""Text rules for property files and names, as SQL expression texts."""

from __future__ import annotations

from fleetwright.functions.numbers import num_text

# Key widths in generated property files.
CLUSTER_KEY_WIDTH = 45
JOB_KEY_WIDTH = 42


def quote(text: str) -> str:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def say(template: str, **texts: str) -> str:
    """Concatenation from a template: `{name}` inserts an expression.

    A name not given in `texts` is a number column and is written without needless decimals.
    """
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            parts.append(texts.get(piece) or num_text(piece))
        elif piece:
            parts.append(quote(piece))
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def pad_end(text: str, width: int) -> str:
    """Pad with blanks up to `width`; longer texts stay whole (rpad would cut them)."""
    return f"concat({text}, repeat(' ', greatest(0, {width} - length({text}))))"


def slug(name: str) -> str:
    return f"lower(regexp_replace({name}, '\\\\s+', '-'))"


def job_name(job_idx: str = "job_idx") -> str:
    return f"concat('Job ', {job_idx} + 1)"


def reservation_name(columns: list[str]) -> str:
    """The name given to a reservation, else one from its number, which removals do not change."""
    number = "coalesce(res_no, res_idx + 1)" if "res_no" in columns else "res_idx + 1"
    default = f"concat('Reserved Job ', {number})"
    return f"coalesce(nullif(trim(name), ''), {default})" if "name" in columns else default
