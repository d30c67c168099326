"""Operators over one frame: profiling, quality, privacy, synthetic data, sessions, leak tests, guarded queries."""
