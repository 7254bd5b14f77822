"""Operators on datasets; each takes Column expressions (Catalyst sees them) or a Python function (Arrow batches)."""
