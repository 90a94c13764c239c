"""Reading, column binding, storing."""
