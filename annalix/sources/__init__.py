"""Tables of the journal engine."""

from .journal import Store, activity_events, conversation_events, numbered, read
from .stored import StoredJournal

__all__ = ["Store", "StoredJournal", "activity_events", "conversation_events", "numbered", "read"]
