"""Position-stream analytics on Spark: noisy text to typed fixes, track
cleaning and filtering, navigation against a point-of-interest catalogue,
recognition-quality reports and labelled-data curation."""

__version__ = "0.1.0"
