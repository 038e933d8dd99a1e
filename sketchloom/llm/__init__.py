"""Operations of a training-data pipeline: ten operators and their thin queries (see queries.py)."""
