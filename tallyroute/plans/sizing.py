"""The bound of what a join may broadcast."""

from __future__ import annotations

# Joined key rows one broadcast may hold: some 60 bytes each, so under 100 MB.
MAX_BROADCAST_ROWS = 1_200_000
