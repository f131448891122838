"""Reports: a summary as Markdown."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines of the report; %d and %.3f stand for figures of the summary.
LINES = "# Evaluation Report\n\n## Dataset\nSize: %d\n\n## Safety\nAccuracy: %.3f\n\n## Assessment\nMean MAE: %.3f\n\n## Routing\nAccuracy: %.3f\n\n## Advisor Response Quality\nAverage Score: %.2f/10\n"
FIGURES = ("dataset_size", "safety_accuracy", "mean_mae", "routing_accuracy", "average_score")


def markdown() -> Column:
    """The report text of a summary row (K6)."""
    return F.format_string(LINES, *FIGURES)


def write_markdown(summary: DataFrame, path: str) -> None:
    """The report of a one-row summary as a file; folders are made as needed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(summary.select(markdown().alias("m")).first()["m"], encoding="utf-8")
