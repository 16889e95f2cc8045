"""covary: association analytics on Spark DataFrames.

Event facts are keyed by period and area, counted per category, joined with
small indicator tables and tested with correlations, one-feature linear
models and slope significance tests. Every operator takes DataFrames and
returns a DataFrame; statistics are grouped aggregates and native column
expressions, so one job covers all categories at once.
"""

from covary.session import ensure_checkpoint_dir, local_session, materialize

__all__ = ["ensure_checkpoint_dir", "local_session", "materialize"]
