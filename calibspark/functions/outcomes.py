"""Outcome flags and the labels encoded in result paths and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_flag(status: Column, exit_code: Column) -> Column:
    """1 iff the run status is ``OK`` and the exit code is 0; null counts as 0."""
    return F.when((status == F.lit("OK")) & (exit_code == F.lit(0)), 1).otherwise(0).cast("int")


def path_model(segment: Column) -> Column:
    """Model from a ``<model>b-<quantization>`` folder name: text before the
    first ``b-`` plus ``b``, with ``converted-`` removed."""
    return F.replace(F.concat(F.split_part(segment, F.lit("b-"), F.lit(1)), F.lit("b")),
                     F.lit("converted-"), F.lit(""))


def path_quantization(segment: Column) -> Column:
    """Quantization: the piece between the first and second ``b-``."""
    return F.split_part(segment, F.lit("b-"), F.lit(2))


def path_language(segment: Column) -> Column:
    """Language: a run-folder name up to its first ``_``."""
    return F.split_part(segment, F.lit("_"), F.lit(1))


def path_dimensions(rel_path: Column) -> tuple[Column, Column, Column]:
    """(model, quantization, language) from a path relative to the result root:
    segment 1 names model and quantization, segment 2 the run folder."""
    model_seg = F.split_part(rel_path, F.lit("/"), F.lit(1))
    run_seg = F.split_part(rel_path, F.lit("/"), F.lit(2))
    return path_model(model_seg), path_quantization(model_seg), path_language(run_seg)


def model_label(name: Column) -> Column:
    """Part after the first ``/`` (``cut -d/ -f2``); the whole name if none."""
    return F.when(F.instr(name, "/") == 0, name).otherwise(F.split_part(name, F.lit("/"), F.lit(2)))


def safe_name(name: Column, override: Column | None = None) -> Column:
    """``/`` and ``-`` become ``_``; a non-empty override wins."""
    derived = F.translate(name, "/-", "__")
    if override is None:
        return derived
    return F.when(override.isNotNull() & (override != ""), override).otherwise(derived)


def temperature_tag(temperature: Column) -> Column:
    """Temperature with the decimal point replaced by ``_`` (0.2 -> 0_2)."""
    return F.replace(temperature.cast("string"), F.lit("."), F.lit("_"))


def run_dir_label(language: Column, temperature: Column, label: Column) -> Column:
    """``<lang>_benchmark_temperature_<t>_<label>``."""
    return F.concat_ws("_", language, F.lit("benchmark"), F.lit("temperature"),
                       temperature.cast("string"), label)


def cleaned_path(path: Column) -> Column:
    """Append ``_cleaned`` to the third ``/``-segment (index 2) of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda s, i: F.when(i == 2, F.concat(s, F.lit("_cleaned")))
                                    .otherwise(s)), "/")


def pass_report_name(label: Column, language: Column, temperature: Column) -> Column:
    """``pass_result_temp_<t>_<lang>_<label>.csv``."""
    return F.concat(F.lit("pass_result_temp_"), temperature_tag(temperature), F.lit("_"),
                    language, F.lit("_"), label, F.lit(".csv"))


def label_startswith(label: Column, prefix: str) -> Column:
    """The label begins with ``prefix``."""
    return label.startswith(prefix)


def prefix_family(label: Column, prefixes: list[str]) -> Column:
    """The first of ``prefixes`` that the label begins with, else the empty text."""
    return F.coalesce(*[F.when(label_startswith(label, p), F.lit(p)) for p in prefixes], F.lit(""))


def precision_label(bits: Column, recipe: Column | None = None, finetuned: Column | None = None) -> Column:
    """``<bits>bit[-<recipe>][-finetuned]``; a null or empty recipe is left out."""
    label = F.concat(bits.cast("string"), F.lit("bit"))
    if recipe is not None:
        label = F.concat(label, F.when(F.coalesce(recipe, F.lit("")) == "", "").otherwise(F.concat(F.lit("-"), recipe)))
    if finetuned is not None:
        label = F.concat(label, F.when(finetuned, "-finetuned").otherwise(""))
    return label
