"""Stateful detectors over Structured Streaming, with batch twins."""
