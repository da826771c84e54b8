"""schedlake: schedule-export analytics on PySpark DataFrames."""
