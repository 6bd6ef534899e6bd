"""Subscription analytics as Spark DataFrame operators."""
