"""Spark-native analytics over timed, speaker-labelled speech data."""
