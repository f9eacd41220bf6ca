"""Segment detection and scoring over ordered signal streams, as Spark jobs."""
