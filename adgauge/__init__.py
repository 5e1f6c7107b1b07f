"""adgauge: advertising measurement on Spark DataFrames.

Raw ad events -> validated, classified impressions -> campaign summaries and reach ->
matched exposed/control cohorts -> survey metrics -> brand lift and report feeds.
Every operator takes DataFrames and returns DataFrames; run time, ids and thresholds
are arguments, so results do not depend on the wall clock.
"""

from adgauge.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
