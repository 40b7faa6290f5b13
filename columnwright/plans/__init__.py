"""Suggestion batches, augmentation rounds and prompt experiments."""
