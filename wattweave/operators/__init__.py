"""DataFrame operators over readings, weather and decoded states."""
