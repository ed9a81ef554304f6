"""Directories that keep growing, as Structured Streaming queries."""

from .follow import Reports, follow, register, stop_when_idle, tee, watch_stream

__all__ = ["Reports", "follow", "register", "stop_when_idle", "tee", "watch_stream"]
