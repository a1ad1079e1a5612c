"""Defaults of requests that leave a number open. None of them is a cap."""

DEFAULT_POINTS = 120
DEFAULT_PAGE_SIZE = 25
DEFAULT_SEED_ROWS = 10
INSERT_BATCH = 1000
