"""The figures an answer may use, in order: what changed, what accounts for most of it, and
what looks important but is not."""

from __future__ import annotations

from pyspark.sql import DataFrame

FACT_SCHEMA = (
    "position int, section string, rank int, dimension string, segment string, contribution_pp double,"
    " own_pct_change double, share_of_total_before double, text string"
)


def facts(analysis, scope: str = "") -> DataFrame:
    """The fact table. Every section is a handful of rows by definition, so they are put
    together locally."""
    rows: list[tuple] = []

    def add(section, text, slice_=None, rank=1):
        figures = (None,) * 5 if slice_ is None else (
            slice_["dimension"], slice_["segment"], slice_["contribution_pp"],
            slice_["own_pct_change"], slice_["share_of_total_before"],
        )
        rows.append((len(rows) + 1, section, rank, *figures, text))

    a = analysis
    verb = "fell" if a.delta < 0 else "rose"
    add(
        "total",
        f"{a.metric} {verb} from {a.total_before:,.2f} in {a.period_before} to {a.total_after:,.2f} in"
        f" {a.period_after}, a change of {a.delta:,.2f} ({a.pct_change:+.1f}%)",
    )
    if scope:
        add("scope", f"only rows with {scope}")
    for s in a.headline().collect():
        add(
            "headline",
            f"{s['segment']} ({s['dimension']}): {s['contribution_pp']:+.2f} percentage points of the"
            f" {a.pct_change:+.1f}% change; its own change was {s['own_pct_change']:+.1f}% and it made up"
            f" {s['share_of_total_before']:.1f}% of the starting total",
            s,
        )
    if a.crossed:
        for rank, s in enumerate(a.ranked(n=3).collect()[1:], 1):
            add("supporting", f"{s['segment']}: {s['contribution_pp']:+.2f} pp (own change {s['own_pct_change']:+.1f}%)", s, rank)
    for rank, s in enumerate(a.top_contributors(3).collect(), 1):
        add("alternative_view", f"by {s['dimension']}: {s['segment']} {s['contribution_pp']:+.2f} pp; overlaps with the headline", s, rank)
    for s in a.decoys(1).collect():
        add(
            "decoy",
            f"{s['segment']} moved {s['own_pct_change']:+.1f}% on its own but accounts for only"
            f" {s['contribution_pp']:+.2f} pp of the {a.pct_change:+.1f}% change: it was"
            f" {s['share_of_total_before']:.1f}% of the starting {a.metric}",
            s,
        )
    for rank, c in enumerate((c for c in a.checks if not c.passed), 1):
        add("failed_check", f"{c.name}: {c.detail}", rank=rank)
    return a._raw.sparkSession.createDataFrame(rows, FACT_SCHEMA)


def facts_text(analysis, scope: str = "") -> str:
    """The fact table as text, against which the figures of an answer can be traced."""
    return "\n".join(r["text"] for r in facts(analysis, scope).orderBy("position").collect())
