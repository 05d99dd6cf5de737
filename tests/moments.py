"""The instant that the fixtures' seconds count from."""

from datetime import datetime, timezone

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
