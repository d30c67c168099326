"""Streams: plans answer over bounded data, so a stream is first written to a table and then queried."""
