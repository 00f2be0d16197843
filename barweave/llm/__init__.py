"""Operations of a training-data pipeline: archives, filters, deduplication, classifiers, packing."""
