"""From raw signals to a model frame, a prediction and its score.

The steps up to the dense position share one partitioning (series, bucket), the
features one more (series, chunk), so a whole preparation shuffles the wide rows
twice however many columns it adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from signalloom.functions.scalar import named, tag_matches
from signalloom.operators.clean import forward_fill
from signalloom.operators.project import add_residual
from signalloom.operators.score import Score, baseline, score
from signalloom.operators.series import BUCKET, SeriesSpec, add_features, bucketed, with_position
from signalloom.operators.rolling import rolling_bundle
from signalloom.operators.shift import shift_features


def filled(signals: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Gaps filled over the whole series, before any run is picked; in all columns but the keys by default."""
    return forward_fill(bucketed(signals, spec), spec, columns)


def measurement_run(signals: DataFrame, spec: SeriesSpec, pattern: str, columns: Sequence[str] | None = None,
                    keep: Column | None = None, write: bool = False, tag: str = "tag", target: str = "fr",
                    parts: tuple[str, str] | None = ("fm", "fb")) -> DataFrame:
    """Filled rows whose tag matches, with the residual target, position `pos` and run length `n_rows`.

    `columns` names the signals wanted, the target among them; no others are read,
    shuffled or written. `parts` are the two columns whose difference is the target, or
    none if the target is measured itself. With `write` the run is written once, which
    suits a run that several steps read.
    """
    if columns is not None:
        base = {*spec.keys, spec.order, *spec.tie, tag, *columns}
        if parts and target in columns:
            base |= set(parts)
        signals = signals.select(*[named(c) for c in signals.columns if c in base])
    run = filled(signals, spec).filter(tag_matches(named(tag), pattern))
    if keep is not None:
        run = run.filter(keep)
    if parts and set(parts) <= set(run.columns):
        run = add_residual(run, *parts, target)
    if columns is not None:
        kept = [*spec.keys, spec.order, *spec.tie, BUCKET, *columns]
        run = run.select(*[named(c) for c in dict.fromkeys(kept)])
    return with_position(run, spec, length="n_rows", write=write).drop(BUCKET)


def model_frame(run: DataFrame, spec: SeriesSpec, lags: int = 3, both: bool = False,
                sizes: Sequence[int] = (64,)) -> tuple[DataFrame, list[str]]:
    """Run plus rolling and shifted features, and the names of the feature columns."""
    features = rolling_bundle("v", "a", sizes) + shift_features(["v", "a"], lags, both)
    return add_features(run, spec, features), ["v", "a", *[f.name for f in features]]


def baseline_score(run: DataFrame, spec: SeriesSpec, threshold: float = 200.0) -> Score:
    """Least-squares prediction of the residual from the velocity, per series, with its score."""
    return score(baseline(run, "fr", "v", spec.keys), "fr", "y_pred", threshold, by=spec.keys)
