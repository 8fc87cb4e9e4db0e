"""Part of the session analytics engine."""
