"""Longitudinal record analytics expressed as Spark DataFrame operators."""
