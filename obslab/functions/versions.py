"""Version identifiers: sortable, safe as folder names."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an id may look like, and device names that some file systems reserve in any case.
VERSION_ID = "[A-Za-z0-9][A-Za-z0-9_-]{0,95}"
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{device}{n}" for device in ("COM", "LPT") for n in range(1, 10)))
# One rule for columns and for the driver; Java and Python read it alike.
_RULE = f"(?!(?i:{'|'.join(RESERVED_NAMES)})$){VERSION_ID}"


def new_version_id(at: datetime | None = None) -> str:
    """Ids sort by the time of creation; the tail makes those of parallel jobs differ."""
    moment = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return f"{moment:%Y-%m-%d-%H%M%S-%f}-{uuid.uuid4().hex[-10:]}"


def version_is_valid(version: Column) -> Column:
    return F.coalesce(version.rlike(rf"\A(?:{_RULE})\z"), F.lit(False))


def check_version_id(version: str) -> str:
    """The id itself, before it becomes a path."""
    if isinstance(version, str) and re.fullmatch(_RULE, version):
        return version
    raise ValueError(f"not a valid version id: {version!r}")
