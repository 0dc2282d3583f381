"""Column functions: vectors, times and rates as text, cue text."""
