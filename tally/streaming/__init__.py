"""File-triggered weekly runs with Structured Streaming."""

from tally.streaming.landing import start_weekly_stream, file_date_of

__all__ = ["start_weekly_stream", "file_date_of"]
