"""Numbers and lists as text, with a decimal comma."""

from __future__ import annotations

import math

MINUS, NONE = "−", "—"
_RAISED = str.maketrans("0123456789-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻")


def number(x: float, digits: int = 2) -> str:
    """A number to fixed decimals; what rounds to nothing has no sign."""
    x = float(x)
    if not math.isfinite(x):
        return NONE
    shown = f"{abs(x):.{digits}f}".replace(".", ",")
    return MINUS + shown if x < 0 and abs(x) >= 0.5 * 10.0**-digits else shown


def signed(x: float, digits: int = 2) -> str:
    shown = number(x, digits)
    return f"+{shown}" if x > 0 and any(c in "123456789" for c in shown) else shown


def percent(x: float, digits: int = 1) -> str:
    return f"{number(x, digits)} %"


def scientific(x: float) -> str:
    """One decimal and a raised exponent of ten."""
    if not math.isfinite(x) or x == 0:
        return "0"
    e = math.floor(math.log10(abs(x)))
    return f"{number(x / 10.0**e, 1)}·10{str(e).translate(_RAISED)}"


def counted(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n <= 1 else many or one + 's'}"


def listed(names: list[str], most: int = 4, total: int | None = None) -> str:
    """a, b et c; beyond ``most`` names the number of others."""
    if not names:
        return "aucune"
    total = len(names) if total is None else total
    if total > most:
        shown = names[:most]
        others = total - len(shown)
        return f"{', '.join(shown)} et {others} {'autre' if others == 1 else 'autres'}"
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} et {names[-1]}"
