"""Conversation-journey analytics on Spark: every capability is a DataFrame plan over all conversations at once."""
