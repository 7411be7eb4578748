"""Sources and sinks: the readings file (S1), state tables."""

from tally.sources.readings import read_readings, clean_readings
from tally.sources.store import Store, read_table

__all__ = ["read_readings", "clean_readings", "Store", "read_table"]
