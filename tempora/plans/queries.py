"""The registered queries of the transcript operators and their SQL."""

from __future__ import annotations

from . import q_intervals, q_islands, q_models, q_pacing, q_qa, q_rank, q_readers, q_scoring, q_series, q_speakers, q_streaming, q_tracks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
