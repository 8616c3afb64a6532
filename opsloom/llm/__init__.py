"""Operations of a training-data pipeline: language, duplicates, extraction, contamination, packing."""
