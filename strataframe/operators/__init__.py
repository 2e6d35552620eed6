"""Operators over pixel, scene, observation and target relations."""
