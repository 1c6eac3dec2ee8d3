"""The order in which sweeps are worth their time, as command lines."""

from __future__ import annotations


def stages(documents: str, log: str, out: str, tiers: list[str], extra: tuple[str, ...] = ()) -> list[tuple[str, list[str]]]:
    """Titles and arguments of all stages, the most telling first.

    First the ratio grid of every tier (least first), since a curve needs all its points; the
    least tier also takes every axis. Then the thread axis where inputs are large enough to
    split, the two greatest tiers. Last the other axes at the second tier. A report follows
    each part. Sweeps resume, so a programme that was stopped is just run again.
    """
    sweep = lambda tier, *more: ["sweep", documents, log, "--tier", tier, *extra, *more]
    report = ("report", ["analyze", log, "--out", out])
    found = [(f"{tier}: grid", sweep(tier)) for tier in tiers]
    found.insert(1, (f"{tiers[0]}: one axis at a time", sweep(tiers[0], "--ofat")))
    found.append(report)
    for tier in tiers[1:][-2:]:
        found += [(f"{tier}: threads", sweep(tier, "--ofat", "--axes", "threads")), report]
    if len(tiers) > 1:
        found += [(f"{tiers[1]}: one axis at a time", sweep(tiers[1], "--ofat")), report]
    return found
