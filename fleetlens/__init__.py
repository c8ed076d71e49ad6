"""fleetlens: fleet predictive-maintenance analytics on Spark DataFrames.

Every operator is a pure function ``DataFrame(s), parameters -> DataFrame``
that takes an explicit ``as_of`` date instead of reading the wall clock.
"""

__all__ = ["session", "vocab"]
