"""cashcurve: multi-tenant startup-finance analytics as Spark DataFrame jobs.

Every operator is a DataFrame -> DataFrame function over *all* companies at once
(``company_id`` is a grouping column, never a loop variable).  Single-company
answers are a filter on top, which Catalyst pushes below joins and windows.
"""

from cashcurve.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir", "FinanceApi"]


def __getattr__(name):
    if name == "FinanceApi":            # imported lazily: it pulls in every query module
        from cashcurve.api import FinanceApi
        return FinanceApi
    raise AttributeError(name)
