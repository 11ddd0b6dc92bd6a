"""Spark operators over media-timeline tables (shots, subtitles, cards, outlines, call logs)."""
