"""Feature augmentation of labelled tables on Spark."""
