"""Feature preparation, training and evaluation as table jobs."""
