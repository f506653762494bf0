"""Defaults of the signal operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TimingOptions:
    # Frame hop and length, shortest speech, shortest pause, lead-in, least gap, costs of unmatched boundaries.
    hop_ms: float = 10
    win_ms: float = 25
    min_speech_ms: float = 60
    min_pause: float = 0.22
    pad: float = 0.06
    min_gap: float = 0.05
    skip: float = 2.0
    snap: float = 0.5
    #: Bonus for each second of a pause (up to 1.5) when verse ends are matched; rounds of inner matching.
    bonus: float = 0.4
    rounds: int = 4
