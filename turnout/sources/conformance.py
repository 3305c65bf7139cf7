"""Does an incoming table have the columns its kind must have?"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.cleaning import columns_not_in


@dataclass(frozen=True)
class Conformance:
    ok: bool
    missing: list[str]
    extra: list[str]

    def message(self) -> str:
        return "" if self.ok else "Error in column names: " + ", ".join(self.missing)


class ColumnMismatch(ValueError):
    """An incoming table lacks template columns, or has others."""


def compare_columns(columns: Iterable[str], template: Iterable[str], allow_extra: bool = False
                    ) -> Conformance:
    columns, template = list(columns), list(template)
    missing = columns_not_in(template, columns)
    extra = columns_not_in(columns, template)
    return Conformance(not missing and (allow_extra or not extra), missing, extra)


def tag_sheet_template(columns: Iterable[str]) -> list[str]:
    """The tag list's later form: ``Curricular`` for ``Curricula``, and ``Co-Curricular``."""
    return ["Curricular" if c == "Curricula" else c for c in columns] + ["Co-Curricular"]


def conform(df: DataFrame, *templates: Iterable[str], allow_extra: bool = False) -> DataFrame:
    """``df`` if its columns are those of one of the templates, else an error naming the gap.

    With ``allow_extra`` further columns are dropped and the order becomes the template's.
    """
    for template in templates:
        if compare_columns(df.columns, template, allow_extra).ok:
            return df.select(*[F.col(f"`{c}`") for c in template]) if allow_extra else df
    raise ColumnMismatch(compare_columns(df.columns, templates[0], allow_extra).message())
