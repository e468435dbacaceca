"""Options of an index and settings of a session, with the order in which they hold."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "bm25."
SETTINGS = ("limit", "prefilter", "enable_scan")
LARGEST_LIMIT = 65535


def _flag(value: object, name: str) -> bool:
    text = str(value).lower()
    if text in ("true", "on", "1", "yes"):
        return True
    if text in ("false", "off", "0", "no"):
        return False
    raise ValueError(f"{name} must be on or off, not {value!r}")


def _limit(value: object) -> int:
    try:
        limit = int(str(value))
    except ValueError:
        raise ValueError(f"limit must be a whole number, not {value!r}") from None
    if not 0 <= limit <= LARGEST_LIMIT:
        raise ValueError(f"limit must be from 0 to {LARGEST_LIMIT}, not {limit}")
    return limit


@dataclass(frozen=True)
class IndexOptions:
    """k1 and b belong to the score, limit and prefilter to the search; None means not set."""

    k1: float = 1.2
    b: float = 0.75
    limit: int | None = None
    prefilter: bool | None = None

    def __post_init__(self) -> None:
        if not 1.2 <= self.k1 <= 2.0:
            raise ValueError(f"k1 must be from 1.2 to 2.0, not {self.k1}")
        if not 0.0 <= self.b <= 1.0:
            raise ValueError(f"b must be from 0.0 to 1.0, not {self.b}")
        if self.limit is not None:
            _limit(self.limit)

    @classmethod
    def of(cls, **given: object) -> IndexOptions:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown index option {', '.join(sorted(unknown))}")
        return cls(**given)

    def altered(self, **given: object) -> IndexOptions:
        """With other search options; k1 and b are part of what was built and need a rebuild."""
        unknown = set(given) - {"limit", "prefilter"}
        if unknown:
            raise ValueError(f"can't alter {', '.join(sorted(unknown))}")
        return replace(self, **given)


def session_setting(spark: SparkSession, name: str) -> str | None:
    """The session's value of bm25.<name>, None if it isn't set. Unknown settings under the prefix are an error."""
    unknown = [k for k in spark.conf.getAll if k.startswith(PREFIX) and k.removeprefix(PREFIX) not in SETTINGS]
    if unknown:
        raise ValueError(f"unrecognized setting {', '.join(sorted(unknown))}")
    return spark.conf.get(PREFIX + name, None)


def search_limit(spark: SparkSession, options: IndexOptions) -> int:
    """The session's limit, else the index's, else 0."""
    value = session_setting(spark, "limit")
    return _limit(value) if value is not None else options.limit or 0


def search_prefilter(spark: SparkSession, options: IndexOptions) -> bool:
    value = session_setting(spark, "prefilter")
    return _flag(value, "prefilter") if value is not None else bool(options.prefilter)


def scan_enabled(spark: SparkSession) -> bool:
    value = session_setting(spark, "enable_scan")
    return True if value is None else _flag(value, "enable_scan")
