"""Reading, writing and checking the study's files."""
