"""Structured Streaming: appends that survive restarts and replays."""
