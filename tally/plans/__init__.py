"""Whole-run plans: one weekly run, and many runs in one job."""
