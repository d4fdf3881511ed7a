"""Registered queries, grouped like the operator inventory."""

from importlib import import_module

MODULES = ("q_sources", "q_filters", "q_scalars", "q_prices", "q_windows", "q_technical", "q_joins",
           "q_filings", "q_xsection", "q_scoring", "q_selection", "q_panel", "q_stats", "q_portfolio",
           "q_evaluate", "q_risk", "q_streaming")


def load_all() -> None:
    from pathlib import Path

    here = Path(__file__).parent
    for name in MODULES:
        if (here / f"{name}.py").exists():
            import_module(f"factorspark.catalog.{name}")
