"""Whole jobs: operators in the order their rules require."""
