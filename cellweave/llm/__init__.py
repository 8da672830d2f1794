"""Operators for preparing training text: scoring, de-duplication, scans, tokens, decontamination."""
