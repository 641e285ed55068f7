"""Validation of pages and plans: one projection gives all errors of a row, each with its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ["x0", "y0", "x1", "y1"]

# Types of slots and operations.
SLOT_TYPES = "section_banner section_ribbon product_slot toc_entry toc_title page_number running_header decoration keep_page_raw".split()
OPERATION_TYPES = "keep_page erase_rect remove_text remove_paths insert_text insert_image draw_rect draw_line".split()


def errors(checks: list[tuple[str, str, Column]]) -> Column:
    """Array of (path, message) of the checks that fail; a check that is null fails."""
    rows = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, message, ok in checks]
    return F.filter(F.array(*rows), lambda e: e.isNotNull())


def box_checks(box: str = "bbox") -> list[tuple[str, str, Column]]:
    side = lambda n: F.col(f"{box}.{n}")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return [
        (box, "is not four numbers", finite(side("x0")) & finite(side("y0")) & finite(side("x1")) & finite(side("y1"))),
        (box, "x0 is over x1", side("x0") <= side("x1")),
        (box, "y0 is over y1", side("y0") <= side("y1")),
    ]


def page_errors() -> Column:
    """Errors of a span or slot row: id, type, bbox, color, size."""
    return errors([("id", "is empty", F.col("id") != ""), ("type", "is unknown", F.col("type").isin(SLOT_TYPES)), *box_checks(), ("color", "is not #rrggbb", F.col("color").rlike("^#[0-9a-fA-F]{6}$")), ("size", "is not above 0", F.col("size") > 0)])


def operation_errors() -> Column:
    """Errors of a row of a plan: op, page, bbox."""
    return errors([("op", "is unknown", F.col("op").isin(OPERATION_TYPES)), ("page", "is not a page", F.col("page") >= 0), *box_checks()])
