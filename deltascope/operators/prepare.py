"""Making a raw table ready for analysis, with every step on record."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, functions as F

from deltascope.functions.text import as_text, coerce_numeric, quoted
from deltascope.functions.time import parse_dates
from deltascope.operators.duplicates import count_duplicates, deduplicate
from deltascope.operators.profile import ColumnProfile, TableProfile, profile
from deltascope.sources.materialize import materialize
from deltascope.sources.sinks import write_snapshot


@dataclass(frozen=True)
class CleaningAction:
    kind: str
    description: str
    rows_affected: int = 0
    reversible: bool = True


@dataclass
class PreparedData:
    frame: DataFrame
    actions: list[CleaningAction] = field(default_factory=list)
    rows_before: int = 0
    rows_after: int = 0

    @property
    def rows_removed(self) -> int:
        return self.rows_before - self.rows_after

    @cached_property
    def profile(self) -> TableProfile:
        """Profile of the prepared table; a job of its own, run when asked for."""
        return profile(self.frame)

    @property
    def quality_issues(self) -> list[str]:
        return [text for _, text in quality_issues(self.profile, self.rows_removed)]

    def actions_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(
            [(i, a.kind, a.description, a.rows_affected, a.reversible) for i, a in enumerate(self.actions, 1)],
            "position int, kind string, description string, rows_affected bigint, reversible boolean",
        )


def quality_issues(prof: TableProfile, rows_removed: int = 0) -> list[tuple[str, str]]:
    """Everything a person should see, whether or not cleaning dealt with it. Stricter than
    the profile's warnings: any null counts, not only a column that is mostly null."""
    surplus = [("duplicates", f"{rows_removed:,} duplicate rows removed")] if rows_removed else []
    return surplus + [issue for c in prof.columns for issue in _column_issues(c)]


MISSTORED = {"numeric_as_string": "numbers stored as text", "date_as_string": "dates stored as text", "empty": "no values"}


def _column_issues(c: ColumnProfile):
    if c.null_count:
        yield "missing", f"'{c.name}': {c.null_count:,} missing values, {c.null_pct}% of the rows"
    if c.semantic_type in MISSTORED:
        yield "stored_as", f"'{c.name}': {MISSTORED[c.semantic_type]}"


def conversions(df: DataFrame, prof: TableProfile) -> dict[str, tuple[str, Column]]:
    """What each column stored as the wrong type becomes: `(type, expression)`."""
    parsers = {"numeric_as_string": ("numbers", coerce_numeric), "date_as_string": ("dates", parse_dates)}
    return {
        c.name: (parsers[c.semantic_type][0], parsers[c.semantic_type][1](as_text(df, c.name)))
        for c in prof.columns
        if c.semantic_type in parsers and c.name in df.columns
    }


def prepare(
    df: DataFrame, prof: TableProfile | None = None, drop_duplicate_rows: bool = True, snapshot: str | None = None
) -> PreparedData:
    """Parse text that holds numbers or dates, drop empty columns, then drop repeated rows.

    The source is read once for the profile, unless that is given, and once to be parsed. The
    parsed table is written, to `snapshot` if that is given, and what could not be parsed is
    counted on the way; repeated rows are looked for in what was written.
    """
    # the copies that matter are those left after parsing, so the raw ones are not counted
    prof = profile(df, duplicates=not drop_duplicate_rows) if prof is None else prof
    actions, parsed = [], conversions(df, prof)
    names = {name: f"_parsed{i}" for i, name in enumerate(parsed)}
    # conversions are worked out first, under names of their own, so that counting what
    # failed and writing what did not use the same values
    worked = df.select("*", *[column.alias(names[name]) for name, (_, column) in parsed.items()])
    seen = Observation()
    if parsed:
        worked = worked.observe(seen, *[
            F.count_if(F.col(names[name]).isNull() & F.col(quoted(name)).isNotNull()).alias(names[name]) for name in parsed
        ])
    keep = []
    for c in prof.columns:
        if c.name not in df.columns:
            continue
        if c.semantic_type == "empty":
            actions.append((prof.names.index(c.name), CleaningAction("drop_column", f"Dropped '{c.name}', which holds no value")))
            continue
        if c.name in parsed:
            keep.append(F.col(names[c.name]).alias(c.name))
        else:
            keep.append(F.col(quoted(c.name)))
    known = {c.name for c in prof.columns}
    keep += [F.col(quoted(c)) for c in df.columns if c not in known]
    frame, removed = worked.select(*keep), 0
    frame = materialize(frame, "prepared") if snapshot is None else write_snapshot(frame, snapshot)
    failures = seen.get if parsed else {}
    parses = []
    for name, (target, _) in parsed.items():
        text = f"Read the text in '{name}' as {target}"
        if failures[names[name]]:
            text += f"; {failures[names[name]]:,} value(s) did not parse and are now missing"
        parses.append((prof.names.index(name), CleaningAction(f"parse_{target}", text, prof.n_rows)))
    # as the columns stand in the table
    actions = [a for _, a in sorted([*actions, *parses], key=lambda a: a[0])]
    if drop_duplicate_rows:
        frame, removed = deduplicate(frame)
        if removed:
            actions.append(
                CleaningAction("drop_duplicates", f"Removed {removed:,} repeated row(s)", removed, reversible=False)
            )
        else:
            actions.append(CleaningAction("drop_duplicates", "No row is repeated"))
    else:
        repeated = prof.duplicate_rows if prof.duplicate_rows is not None else count_duplicates(df)
        if repeated:
            actions.append(
                CleaningAction("keep_duplicates", f"Kept {repeated:,} repeated row(s), which totals count more than once")
            )
    return PreparedData(frame, actions, prof.n_rows, prof.n_rows - removed)
