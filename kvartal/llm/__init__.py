"""Operations of a training-data pipeline: deduplication, filtering, formatting, packing."""
