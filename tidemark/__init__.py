"""Regime-aware time-series analytics expressed as Spark plans."""
