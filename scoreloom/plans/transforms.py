"""Transforms by name, and chains of them as one lazy plan."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from scoreloom.operators import doublings, merges, meter, order, slices

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register `f` under its name; a name can't be taken twice."""
    if f.__name__ in TRANSFORMS:
        raise ValueError(f"transform {f.__name__} exists")
    TRANSFORMS[f.__name__] = f
    return f


for _f in (
    meter.infer_barlines, meter.quantize_df, meter.scale_df, order.crop_df, order.sort_df, merges.dedouble, merges.merge_notes, merges.merge_repeated_notes, merges.detremolo,
    slices.salami_slice, slices.undo_salami_slice, slices.slice_into_uniform_steps, slices.slice_df, slices.split_notes_at_barlines, slices.subdivide_notes,
    doublings.dedouble_unisons_across_instruments, doublings.remove_repeated_bars,
):
    transform(_f)


def get_transform_params(name: str) -> list[str]:
    """Parameters of a transform besides its table, which comes first."""
    return list(inspect.signature(TRANSFORMS[name]).parameters)[1:]


def apply_transforms(df: DataFrame, steps: list[dict[str, dict]]) -> DataFrame:
    """Apply [{name: parameters}, …] in turn. Unknown names are KeyErrors, steps of several names ValueErrors."""
    for step in steps:
        if len(step) != 1:
            raise ValueError("a step has one name")
        (name, params), = step.items()
        df = TRANSFORMS[name](df, **(params or {}))
    return df
