"""Telemetry operators over long ``samples``; every one groups by flight."""
