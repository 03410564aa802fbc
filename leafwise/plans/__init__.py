"""How jobs are put together: staging, join strategy, top-k, search and summary."""
