"""The study's operators: DataFrames and a StudyConfig in, a DataFrame out."""
