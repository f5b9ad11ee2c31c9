"""Exchangeable steps: generators, detectors, selectors and recognisers as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import text_layer
from .cards import draft_cards
from .labels import detect_labels
from .spans import select_spans

Provider = Callable[[DataFrame], DataFrame]
_registry: dict[tuple[str, str], Provider] = {}
#: Setting that names the provider of each kind of step.
SETTINGS = {"cards": "card_generator", "labels": "diagram_detector", "spans": "text_span_selector", "ocr": "ocr_engine"}


def register(kind: str, name: str, provider: Provider) -> None:
    _registry[kind, name] = provider


def provider(kind: str, name: str) -> Provider:
    """The provider of a kind by name; an unknown name is an error that tells the setting."""
    found = _registry.get((kind, name))
    if found is None:
        known = ", ".join(sorted(n for k, n in _registry if k == kind)) or "none"
        raise ValueError(f"unknown {SETTINGS.get(kind, kind)} {name!r} (known: {known})")
    return found


register("cards", "rules", draft_cards)
register("labels", "rules", detect_labels)
register("spans", "rules", select_spans)
register("ocr", "layer", text_layer)


def best_effort(rows: DataFrame, step: Callable[[dict], object], schema: str, recoverable: tuple[type[Exception], ...] = (ValueError, KeyError, ArithmeticError)) -> DataFrame:
    """Apply ``step`` (a row as a dict to a value) page by page; a ``recoverable`` failure costs that page only.

    ``schema`` is the type of the value. Returns ``rows`` with ``result``, ``error`` (one of them NULL) and ``fatal``: the
    error is not a recoverable one and fails the whole deck (:func:`failed_jobs`). Pages with an error are what a quarantine
    table is made of.
    """
    names = [n for n in rows.columns if n not in ("result", "error", "fatal")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result, error, fatal = [], [], []
            for row in batch.to_dict("records"):
                try:
                    found, why, stops = step(row), None, False
                except Exception as e:  # noqa: BLE001  the policy: no failure of a provider ends the job of the cluster
                    found, why, stops = None, f"{type(e).__name__}: {e}", not isinstance(e, recoverable)
                result.append(found)
                error.append(why)
                fatal.append(stops)
            yield batch.assign(result=pd.Series(result, index=batch.index, dtype=object), error=pd.Series(error, index=batch.index, dtype=object), fatal=fatal)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names).mapInPandas(run, f"{kept}, result {schema}, error string, fatal boolean")


def failed_jobs(pages: DataFrame) -> DataFrame:
    """``job_id, error_message`` of the decks that a fatal error of a page (:func:`best_effort`) fails: that of the first such page."""
    return pages.where("fatal").groupBy("job_id").agg(F.min_by("error", "page_number").alias("error_message"))
