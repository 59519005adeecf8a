"""Longitudinal cohort analytics over event-sourced case records, as Spark DataFrame plans."""
