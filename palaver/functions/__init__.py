"""Part of the conversation-memory engine."""
