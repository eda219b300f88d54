"""Whole plans: building, storing and querying a cohort."""
