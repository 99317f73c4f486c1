"""The text that a model is given of what memory found, within a budget of characters."""

from __future__ import annotations

BUDGET, HEAD = 2000, "[Memory]"


def clip(text: str | None, limit: int = 180) -> str:
    value = (text or "").strip().replace("\n", " ")
    return value if len(value) <= limit else value[: limit - 1].rstrip() + "…"


def pack(cards: list[tuple[str, str, str]], budget: int = BUDGET) -> tuple[str, int]:
    """(text, cards left out) of cards (title, summary, use now): everything if it fits; else without what to use now; else
    with short summaries; else with fewer cards, one at least."""
    some = cards[:3]
    join = lambda lines: "\n".join([HEAD, *lines])
    full = [line for k, (title, summary, use) in enumerate(some, 1) for line in (f"{k}. {title}: {summary}", f"   Use now: {use}")]
    plain = [f"{k}. {title}: {summary}" for k, (title, summary, _) in enumerate(some, 1)]
    short = [f"{k}. {title}: {clip(summary, 80)}" for k, (title, summary, _) in enumerate(some, 1)]
    for lines in (full, plain):
        if len(join(lines)) <= budget:
            return join(lines), 0
    while len(short) > 1 and len(join(short)) > budget:
        short.pop()
    return join(short), len(some) - len(short)
