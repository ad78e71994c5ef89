"""Utilisation bands under the five policies of the reference model."""

from __future__ import annotations

# Policy -> (critical above, warning above, under below or None).
POLICIES = {
    "standard": (95, 80, 50),
    "fleet": (95, 80, 50),
    "report": (90, 80, None),
    "master": (90, 70, None),
    "capacity": (95, 80, 40),
}


def band(policy: str, *percents: str) -> str:
    """Worst band over the percentages; "under" only when every percentage is low."""
    critical, warning, under = POLICIES[policy]
    worst = f"greatest({', '.join(percents)})" if len(percents) > 1 else percents[0]
    low = f" WHEN {worst} < {under} THEN 'under'" if under is not None else ""
    return (f"CASE WHEN {worst} > {critical} THEN 'critical' WHEN {worst} > {warning}"
            f" THEN 'warning'{low} ELSE 'optimal' END")


def policy_rows() -> list[tuple[str, float | None, bool, str]]:
    """The policies as rows (policy, low, above, band): a band begins at `low`, or above it; null is the lowest."""
    out = []
    for policy, (critical, warning, under) in POLICIES.items():
        out += [(policy, None, False, "optimal" if under is None else "under"),
                *([] if under is None else [(policy, float(under), False, "optimal")]),
                (policy, float(warning), True, "warning"), (policy, float(critical), True, "critical")]
    return out
