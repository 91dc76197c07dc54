"""Classifier models for the entailment tier: label columns by name, probabilities from logits, loading once."""

from __future__ import annotations

import math
import os
import re
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.operators.entailment import Scorer, model_available, model_scorer

#: Pairs of (premise, hypothesis) -> a row of logits each.
Logits = Callable[[list[tuple[str, str]]], Sequence[Sequence[float] | float]]


class ModelError(RuntimeError):
    """A model that can't be loaded. No other model takes its place."""


def label_column(labels: Mapping[int, str] | None, start: str) -> int | None:
    """The first column in whose label a word begins with ``start``, whatever its case."""
    return next((int(i) for i, name in (labels or {}).items() if re.search(rf"\b{start}", str(name), re.I)), None)


def softmax(logits: Sequence[float], at: int) -> float:
    top = max(logits)
    return math.exp(logits[at] - top) / sum(math.exp(x - top) for x in logits)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def probabilities(logits: Sequence[float] | float, labels: Mapping[int, str] | None) -> tuple[float, float]:
    """(entailment, contradiction) of one pair.

    A model of one column gives a sigmoid and no contradiction. Else the softmax of the column named for entailment (the
    first if none is, or it isn't there), and of the one named for contradiction, 0 for models of fewer than three labels or
    without it.
    """
    row = [logits] if isinstance(logits, (int, float)) else list(logits)
    if len(row) == 1:
        return sigmoid(float(row[0])), 0.0
    ent, con = label_column(labels, "entail") or 0, label_column(labels, "contradict")
    return softmax(row, ent if ent < len(row) else 0), softmax(row, con) if con is not None and 3 <= len(row) > con else 0.0


def softmax_at(logits: Column, at: Column) -> Column:
    """The same softmax as a column, for tables of logits."""
    top = F.array_max(logits)
    return F.exp(F.get(logits, at) - top) / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))


@dataclass
class CrossEncoder:
    """A loaded model; ``predict`` takes (claim, premise) pairs, the model reads the premise first."""

    name: str
    logits: Logits
    labels: Mapping[int, str] | None = None
    batch: int = 8

    def predict(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for i in range(0, len(pairs), self.batch):
            rows = self.logits([(premise, claim) for claim, premise in pairs[i : i + self.batch]])
            out += [probabilities(r, self.labels) for r in rows]
        return out


def model_name(given: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The argument, else the environment's name, else the default; blank ones don't count."""
    env = os.environ if env is None else env
    return next((x.strip() for x in (given, env.get(K.ENV_MODEL)) if x and x.strip()), K.DEFAULT_MODEL)


def is_local_path(name: str) -> bool:
    """A name that is surely a folder; ``owner/model`` is a hub's identifier unless it exists here."""
    if "\\" in name or name.startswith(("/", ".", "~")):
        return True
    try:
        return Path(name).exists()
    except OSError:
        return False


def transformers_logits(name: str) -> tuple[Logits, Mapping[int, str] | None]:
    """Loads a sequence classifier with the optional libraries; a local path is never looked up elsewhere."""
    import torch
    from transformers import AutoModelForSequenceClassification, AutoTokenizer

    how = {"cache_dir": os.environ.get(K.ENV_CACHE) or None, "local_files_only": is_local_path(name)}
    model, tokenizer = AutoModelForSequenceClassification.from_pretrained(name, **how).eval(), AutoTokenizer.from_pretrained(name, **how)

    def logits(pairs: list[tuple[str, str]]):
        with torch.inference_mode():
            return model(**tokenizer([p for p, _ in pairs], [h for _, h in pairs], padding=True, truncation=True, max_length=K.MODEL_TOKENS, return_tensors="pt")).logits.tolist()

    return logits, getattr(model.config, "id2label", None)


@dataclass
class _Loaded:
    models: dict = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)


_LOADED = _Loaded()


def load_model(name: str | None = None, loader: Callable[[str], tuple[Logits, Mapping[int, str] | None]] | None = None) -> CrossEncoder:
    """The model of a name, loaded once in each process; ``ModelError`` says why it can't be."""
    name = model_name(name)
    with _LOADED.lock:
        if (name, loader) not in _LOADED.models:
            if loader is None and not model_available():
                raise ModelError("the entailment models need torch and transformers, which are not installed")
            try:
                logits, labels = (loader or transformers_logits)(name)
            except Exception as e:
                raise ModelError(f"model {name!r} can't be loaded: {type(e).__name__}: {e}") from e
            _LOADED.models[name, loader] = CrossEncoder(name, logits, labels)
        return _LOADED.models[name, loader]


def named_scorer(name: str | None = None, loader: Callable | None = None) -> Scorer:
    """A scorer around the model of a name. It is loaded here once, so that a wrong name fails before any job runs."""
    name = model_name(name)
    load_model(name, loader)
    return model_scorer(lambda: load_model(name, loader).predict)
