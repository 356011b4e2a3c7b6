"""Registered queries: each reads the driver tables through the fixture
adapters and runs one operator (or one page's chain of operators) of the
library. ``catalog.QUERIES`` maps a name to (spark job, DuckDB SQL or None)."""

_LOADED = False


def load_all() -> None:
    """Import every query module once so each registers its queries."""
    global _LOADED
    if _LOADED:
        return
    import importlib
    for mod in ("scan_features", "energy_kpi", "forecasting", "models", "density", "keyed", "streams"):
        importlib.import_module(f"meterlake.plans.{mod}")
    _LOADED = True
