"""Spark-native news and encyclopedia text analytics.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column), so Catalyst sees the whole plan.
"""
