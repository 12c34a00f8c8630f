"""Rubric jobs over the answer log derived from events."""

from __future__ import annotations

from leadlens.operators import rubric as RB
from leadlens.plans.catalog import job
from leadlens.sources import adapters as A


@job("riasec_top2")
def riasec_top2(t):
    return RB.riasec_top2(A.answers(t))


@job("logic_level")
def logic_level(t):
    return RB.logic_level(A.answers(t))


@job("track_coverage")
def track_coverage(t):
    return RB.track_coverage(A.answers(t))
