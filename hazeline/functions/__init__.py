"""Part of the smoke-event engine."""
