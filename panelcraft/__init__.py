"""panelcraft: cohort, sampling and event-study panel operators on Spark DataFrames."""

from .params import FIXTURE_STUDY, FIXTURE_STUDY_B, FIXTURE_WIDE, StudyParams, WideParams

__all__ = ["FIXTURE_STUDY", "FIXTURE_STUDY_B", "FIXTURE_WIDE", "StudyParams", "WideParams"]
