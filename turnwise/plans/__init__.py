"""Compositions of operators: attribution, diarization, benchmark runs and sweeps, and the driver queries."""
