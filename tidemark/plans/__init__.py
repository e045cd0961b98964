"""Rollup rules: gating, windows, backfill, execution, health."""
