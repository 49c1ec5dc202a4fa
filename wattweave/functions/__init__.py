"""Column functions for calendars, temperatures and day vectors."""

from .calendar import calendar_features, clamp_box, degree_offset, dummy_code, season, time_of_day
from .vectors import square_distance, vector_sum

__all__ = [
    "calendar_features", "clamp_box", "degree_offset", "dummy_code", "season", "square_distance", "time_of_day", "vector_sum",
]
