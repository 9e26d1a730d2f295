"""Reusable distributed operators (ranking, quantiles, evaluation)."""
