"""Timed-transcript, interval, series and catalogue analytics as Spark DataFrame operators."""
