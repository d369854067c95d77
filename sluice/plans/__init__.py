"""Statements that the facade handles itself, and the catalogue of registered queries."""
