"""Results as text for people: the last step, on collected rows."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame


def csv_text(df: DataFrame, notes: dict[str, object] | None = None, order: list | None = None) -> str:
    """CSV with notes as comment lines at its head."""
    out = io.StringIO()
    for k, v in (notes or {}).items():
        out.write(f"# {k}: {v}\n")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    rows = df.orderBy(*order) if order else df
    writer.writerows(["" if x is None else x for x in row] for row in rows.toLocalIterator())
    return out.getvalue()


def heading(title: str, df: DataFrame) -> str:
    """A heading that says how many rows follow."""
    return f"## {title}\n\nTotal records: {df.count()}\n"


def save_csv(df: DataFrame, path: str, notes: dict[str, object] | None = None, order: list | None = None) -> None:
    """The CSV text of a result as one file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(csv_text(df, notes, order))


def markdown_table(df: DataFrame, order: list | None = None, limit: int | None = None) -> str:
    """A table in the order given; with a limit, the first rows and a note of how many there are."""
    rows = df.orderBy(*order) if order else df
    shown = rows.limit(limit).collect() if limit is not None else rows.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("N/A" if x is None else str(x) for x in row) + " |" for row in shown]
    if limit is not None and (total := df.count()) > len(shown):
        lines.append(f"\n_({len(shown)} of {total} rows)_")
    return "\n".join(lines) + "\n"


def report_tree(sections: dict[str, dict[str, str | None]], folder: str) -> list[str]:
    """Writes each part of each section to a file of its own and all of them to one; empty parts are skipped. Returns the paths."""
    paths, whole = [], []
    for number, (section, parts) in enumerate(sections.items(), 1):
        kept = {name: text for name, text in parts.items() if text and text.strip()}
        if not kept:
            continue
        os.makedirs(f"{folder}/{number}_{section}", exist_ok=True)
        whole.append(f"## {number}. {section}\n")
        for name, text in kept.items():
            path = f"{folder}/{number}_{section}/{name}.md"
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            paths.append(path)
            whole.append(f"### {name}\n\n{text}\n")
    if whole:
        paths.append(f"{folder}/complete_report.md")
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write("\n".join(whole))
    return paths


def append_log(path: str, *lines: str) -> None:
    """Adds lines to a log; line feeds inside a line become blanks."""
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(line.replace("\n", " ") + "\n" for line in lines)
