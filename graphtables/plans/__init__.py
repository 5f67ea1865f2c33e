"""Execution plans that span several jobs: the round loop, metrics, plan checks."""
