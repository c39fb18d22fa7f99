"""Whole jobs: cleaning, encoding, reports, projection, outcome models and tuning."""
