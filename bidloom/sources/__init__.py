"""Readers of the library's inputs, and the folder that executors share."""
