"""What a guard is: a step from context columns to context columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..schema import added


class Guard:
    """A step of a pipeline. ``after`` runs once the steps behind it have run, in reverse order."""

    name = "guard"
    is_output = False

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def after(self, df: DataFrame) -> DataFrame:
        return df


@dataclass
class Custom(Guard):
    """A guard of the caller's: a function of the DataFrame, or one that makes an array of threats of its columns.

    To stop a row, set its ``halted`` to true.
    """

    name: str = "custom"
    function: Callable[[DataFrame], DataFrame | Column] = lambda df: df
    is_output: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.function(df)
        return out if isinstance(out, DataFrame) else added(df, out)
