"""Whole runs put together from sources and operators."""
