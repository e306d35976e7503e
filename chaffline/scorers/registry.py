"""Scoring methods by name."""

from __future__ import annotations

from dataclasses import replace

from chaffline.scorers.base import (
    FEATURES,
    HIDDEN_STATES,
    PREDICTION_LOG,
    SAMPLES,
    TEXT,
    TOKEN_DISTRIBUTIONS,
    TOKEN_LOSSES,
    Scorer,
)
from chaffline.scorers.forgetting import forgetting_scores
from chaffline.scorers.geometry import density_scores, redundancy_scores
from chaffline.scorers.model_outputs import entropy_scores, perplexity_scores
from chaffline.scorers.simple import heuristic_scores, random_scores
from chaffline.scorers.spectral import correlation_scores, effective_rank_scores

_ID = ("sample_id",)
_HIDDEN = ("sample_id", "layer", "token_pos", "vector")

SCORERS = {
    s.name: s
    for s in (
        Scorer(
            "forgetting_events",
            PREDICTION_LOG,
            ("seed", "sample_id", "epoch", "step", "correct"),
            forgetting_scores,
        ),
        Scorer(
            "effective_rank",
            HIDDEN_STATES,
            _HIDDEN,
            effective_rank_scores,
            single_precision=False,
            rank_base=1,
        ),
        Scorer("intrinsic_dimensionality_twonn", FEATURES, (*_ID, "features"), density_scores),
        Scorer(
            "corr_integral",
            HIDDEN_STATES,
            _HIDDEN,
            correlation_scores,
            single_precision=False,
            rank_base=1,
        ),
        Scorer("perplexity_filtering", TOKEN_LOSSES, (*_ID, "loss"), perplexity_scores),
        Scorer("semantic_dedup", FEATURES, (*_ID, "features"), redundancy_scores),
        Scorer("heuristic_filtering", TEXT, (*_ID, "text"), heuristic_scores),
        Scorer("llm_classifier", TOKEN_DISTRIBUTIONS, (*_ID, "probs"), entropy_scores),
        Scorer("random", SAMPLES, _ID, random_scores, single_precision=False),
    )
}


def get_scorer(method: str, **options) -> Scorer:
    """The scorer of that name, with options such as `seed` for the random one."""
    if method not in SCORERS:
        raise ValueError(f"unknown scoring method {method!r}; known: {', '.join(sorted(SCORERS))}")
    return replace(SCORERS[method], options=options)


def _reads(method: str, *kinds: str) -> bool:
    return method in SCORERS and SCORERS[method].reads in kinds


def is_forgetting_method(method: str) -> bool:
    return _reads(method, PREDICTION_LOG)


def is_hidden_state_method(method: str) -> bool:
    return _reads(method, HIDDEN_STATES)


def is_feature_method(method: str) -> bool:
    return _reads(method, FEATURES)


def is_text_model_method(method: str) -> bool:
    return _reads(method, TOKEN_LOSSES, TOKEN_DISTRIBUTIONS)


def is_text_heuristic_method(method: str) -> bool:
    return _reads(method, TEXT)
