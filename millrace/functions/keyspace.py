"""Key-space arithmetic: midpoints and splits of string and number ranges, and ranges of keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, GREATEST = 0, 127


def midpoint(low: str, high: str) -> str:
    """A string between low and high, by halving the code points at the first place where they differ."""
    out = []
    for place in range(len(low) + len(high) + 2):
        a = ord(low[place]) if place < len(low) else LEAST
        b = ord(high[place]) if place < len(high) else GREATEST
        if a == b and place < min(len(low), len(high)):
            out.append(low[place])
            continue
        half = a + (b - a) // 2
        out.append(chr(half))
        if half != a:
            break
        # Neighbouring code points leave no room: halve what may follow low instead.
        high = high[: place + 1]
    return "".join(out)


def split_strings(low: str, high: str, count: int, left_first: bool = False) -> list[str]:
    """count strings spread over the range, ends excluded; an odd remainder goes right and left in turn by depth."""
    if count <= 0:
        return []
    middle, rest = midpoint(low, high), count - 1
    left = rest // 2 + (rest % 2 if left_first else 0)
    return [*split_strings(low, middle, left, not left_first), middle, *split_strings(middle, high, rest - left, not left_first)]


def bisect(low: str, high: str) -> str:
    """A string m with low <= m <= high, staying within ASCII where it can."""
    if low == high:
        return low
    low, high = low + "\0", high + "\0"
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    if same == min(len(low), len(high)):
        return low[:same]
    total = ord(low[same]) + ord(high[same])
    out = low[:same] + chr(total // 2)
    if total % 2:
        following = ord(low[same + 1]) if same + 1 < len(low) else 0
        out += chr(((GREATEST if following < GREATEST else 0xFFFF) + following) // 2)
    return out


def split_id(low: int | str, high: int | str, batch: int = 0, keep_small: bool = False) -> int | str:
    """An id or name between two; ids come before names."""
    if isinstance(low, int) and isinstance(high, int):
        return low if keep_small and high - low <= batch else (low + high) // 2
    if isinstance(low, str) and isinstance(high, str):
        return bisect(low, high)
    if isinstance(low, str):
        raise ValueError(f"wrong key order: {low!r}, {high!r}")
    return (low + (1 << 63) - 1) // 2 if high == "\0" else "\0"


Path = tuple[int | str, ...]


def split_paths(low: Path, high: Path, batch: int = 0) -> Path:
    """A key path (kind, id, kind, id, ...) between two."""
    out: list[int | str] = []
    pairs = min(len(low), len(high)) // 2
    for i in range(pairs):
        (kind, a), (other, b) = low[2 * i : 2 * i + 2], high[2 * i : 2 * i + 2]
        if kind != other:
            return (*out, bisect(str(kind), str(other)), "\0")
        middle = split_id(a, b, batch, len(low) == len(high) == 2 * (i + 1))
        out += [kind, middle]
        if middle != a:
            break
    return tuple(out)


@dataclass(frozen=True)
class KeyRange:
    """Keys from start to end; None is unbounded. direction orders a scan of the range."""

    start: int | str | None = None
    end: int | str | None = None
    include_start: bool = True
    include_end: bool = False
    direction: str = "ASC"
    namespace: str | None = None

    def predicate(self, key: Column, namespace: Column | None = None) -> Column:
        """The range as a filter that a Parquet scan can push down."""
        out = F.lit(True)
        if self.start is not None:
            out = out & (key >= self.start if self.include_start else key > self.start)
        if self.end is not None:
            out = out & (key <= self.end if self.include_end else key < self.end)
        if self.namespace is not None and namespace is not None:
            out = out & (namespace == self.namespace)
        return out

    def order(self, key: Column) -> Column:
        return key.asc() if self.direction == "ASC" else key.desc()

    def split(self, batch: int = 0) -> list[KeyRange]:
        """One or two ranges that cover this one, halved at the middle key."""
        if self.start is None:
            return [replace(self, direction="ASC")]
        if self.end is None:
            return [replace(self, direction="DESC")]
        middle = split_id(self.start, self.end, batch, True)
        first = replace(self, end=middle, include_end=self.include_start or middle != self.start, direction="DESC")
        second = replace(self, start=middle, include_start=False, include_end=self.include_end and middle != self.end, direction="ASC")
        return [first, second]

    def after(self, key: int | str) -> KeyRange:
        """What is left of the range once key has been delivered."""
        return replace(self, start=key, include_start=False)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> KeyRange:
        return cls(**json.loads(text))


def guess_end_key(df, key: str):  # noqa: ANN001, ANN201
    """The greatest key; Parquet footers make this cheap."""
    return df.agg(F.max(key)).first()[0]
