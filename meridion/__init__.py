"""Meridion: a PySpark-native engine for context data (entities, their attributes and the attributes' history)."""
