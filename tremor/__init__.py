"""Vibration telemetry jobs on Spark: validation, segments, windows, spectra, features, models, streams."""
