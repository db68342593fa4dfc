"""Estimation, diagnostics, reports and registered queries."""
