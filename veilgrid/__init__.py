"""veilgrid — governed tables, audits, change events and access reports on Spark.

Everything is a DataFrame/SQL plan built from built-in functions, so Catalyst
prunes, pushes down and plans it; there are no Python UDFs and no custom
optimizer rules.
"""

from veilgrid.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
