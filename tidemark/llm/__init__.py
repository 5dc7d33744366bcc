"""Operators for preparing training text: formatting, deduplication, filtering, mixing and output."""
