"""Recurring callbacks, triggers, message handlers and event-time windows."""
