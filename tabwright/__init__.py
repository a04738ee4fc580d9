"""Check, clean, reconcile and report on tables with Spark."""
