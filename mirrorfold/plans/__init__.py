"""Compositions: one batch, one window, the life of a store, and the queries."""
