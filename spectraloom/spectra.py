"""The data model: one row per sample, intensities in one array column, one shared axis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import ranges, spectrum

ID, Y = "sample_index", "y"


@dataclass(frozen=True)
class Profile:
    """Size facts of a spectra table that decide how later work is planned."""

    n: int
    incomplete: int
    reference: np.ndarray


@dataclass(frozen=True)
class Spectra:
    """``df`` holds ``sample_index``, free metadata columns and ``y ARRAY<DOUBLE>``."""

    df: DataFrame
    axis: np.ndarray
    meta: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "axis", np.asarray(self.axis, dtype=float))
        if not self.meta:
            names = tuple(c for c in self.df.columns if c not in (ID, Y))
            object.__setattr__(self, "meta", names)

    @property
    def width(self) -> int:
        return len(self.axis)

    @property
    def spark(self):
        return self.df.sparkSession

    def with_y(self, y: Column, axis=None) -> Spectra:
        return replace(
            self, df=self.df.withColumn(Y, y), axis=self.axis if axis is None else np.asarray(axis)
        )

    def filter(self, condition) -> Spectra:
        return replace(self, df=self.df.filter(condition))

    def signal(self) -> DataFrame:
        """Only the key and the array: what matrix work needs to read."""
        return self.df.select(ID, Y)

    def metadata(self) -> DataFrame:
        return self.df.select(ID, *self.meta)

    def long(self) -> DataFrame:
        """``(sample_index, pos, wn, y)``: one row per cell, for column-wise work."""
        return self.df.select(ID, F.posexplode(Y).alias("pos", "y")).select(
            ID, "pos", F.get(spectrum.literal(self.axis), F.col("pos")).alias("wn"), "y"
        )

    def keep(self, mask: np.ndarray) -> Spectra:
        positions = np.flatnonzero(mask)
        if len(positions) == self.width:
            return self
        return self.with_y(spectrum.keep_positions(F.col(Y), positions), self.axis[positions])

    def exclude(self, text: str) -> tuple[Spectra, ranges.ExclusionInfo]:
        """Hard exclusion: the cells are gone before any statistic is computed."""
        merged = ranges.merge_ranges(ranges.parse_ranges(text))
        mask = ~ranges.inside(self.axis, merged)
        if mask.sum() < 2:
            raise ValueError("Hard exclusion removes too much: at least two must remain.")
        info = ranges.ExclusionInfo(
            ranges.normalize_exclusion(text),
            tuple(merged),
            int((~mask).sum()),
            int(mask.sum()),
            self.width,
        )
        return self.keep(mask), info

    def select_rows(self, query: str, include: bool = True) -> Spectra:
        """Case-insensitive substring search over all metadata joined by blanks."""
        text = F.lower(
            F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in self.meta])
        )
        hit = text.contains(query.lower())
        return self.filter(hit if include else ~hit)

    def select_keys(
        self, include: Sequence[int] | None = None, exclude: Sequence[int] = (), least: int = 2
    ) -> Spectra:
        """Rows by sample index: those of ``include`` (all if None) less those of ``exclude``.

        An analysis needs rows to compare, so fewer than ``least`` are an error.
        """
        kept = self if include is None else self.filter(F.col(ID).isin(list(include)))
        kept = kept.filter(~F.col(ID).isin(list(exclude))) if exclude else kept
        if kept.df.limit(least).count() < least:
            raise ValueError(f"At least {least} samples must remain selected.")
        return kept

    def metadata_gaps(self) -> DataFrame:
        """``(column, missing)``: null counts of all metadata columns, in one pass."""
        counts = self.df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in self.meta])
        named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in self.meta])
        return counts.select(F.inline(named))

    def profile(self) -> Profile:
        """One pass: row count, rows with gaps, and the first sample as numeric pivot."""
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(spectrum.missing_count(F.col(Y)) > 0).alias("incomplete"),
            F.min_by(Y, ID).alias("reference"),
        ).first()
        reference = np.array(
            [np.nan if v is None else v for v in (row["reference"] or [0.0] * self.width)], dtype=float
        )
        return Profile(row["n"], row["incomplete"], np.nan_to_num(reference))


def aligned(spectra: Spectra) -> Spectra:
    """Guarantee array length equals axis length (raises inside the job otherwise)."""
    checked = F.when(F.size(Y) == spectra.width, F.col(Y)).otherwise(
        F.raise_error(F.lit("Wavenumber axis length does not match the spectral matrix."))
    )
    return spectra.with_y(checked)
