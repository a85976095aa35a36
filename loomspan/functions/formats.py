"""Numbers as people read them."""

from __future__ import annotations

from collections.abc import Mapping

# Units of sizes, 1024 of one to the next.
UNITS = ("B", "KB", "MB", "GB", "TB")


def size(n_bytes: int | None) -> str:
    """Bytes in the largest unit of which there is one, with two decimals; unknown for None."""
    if n_bytes is None:
        return "unknown"
    value, unit = float(n_bytes), 0
    while value >= 1024 and unit < len(UNITS) - 1:
        value, unit = value / 1024, unit + 1
    return f"{value:.2f}{UNITS[unit]}"


def seconds(value: float) -> str:
    """Whole seconds as HH:MM:SS; below zero counts as zero."""
    n = int(max(0.0, value))
    return f"{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}"


def number(value: float | None, decimals: int = 4) -> str:
    """A number with fixed decimals; N/A for none."""
    return "N/A" if value is None else f"{value:.{decimals}f}"


def timing(label: str, seconds_by_stage: Mapping[str, float]) -> str:
    """One line of stage times."""
    return f"[timing] {label} " + " ".join(f"{k.removesuffix('_seconds')}={v:.2f}s" for k, v in seconds_by_stage.items())
