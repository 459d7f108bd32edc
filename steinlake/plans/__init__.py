"""Tests as plans, and the registered queries."""
