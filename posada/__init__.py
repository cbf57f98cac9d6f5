"""Posada: hotel-finance analytics as composable Spark DataFrame operators."""
