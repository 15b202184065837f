"""A recorded vessel feed as a source of its own for batch and stream: one JSON message a line, in files whose names follow time.

A position in the feed is a file's name and a byte in it; files with smaller names are done, and only the last one may
still grow. A batch ends at the last line that is whole. What lies between two positions is cut into spans of bytes
that tasks read apart, so a repeat of a batch reads the same lines.

    spark.dataSource.register(feed.Feed)
    spark.readStream.format("vessel_feed").option("path", ...).option("box", "30,6,46,36").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The message types that are asked for, with the class that sends each.
TYPES = {"PositionReport": "A", "StandardClassBPositionReport": "B", "ExtendedClassBPositionReport": "B", "ShipStaticData": "A"}
SCHEMA = "mmsi string, message_type string, class string, ts timestamp, ship_name string, lat double, lon double, course double, speed double, heading double, imo long, ship_type int, destination string"
SPAN = 1 << 24  # bytes that a task reads


@dataclass
class Span(InputPartition):
    file: str
    begin: int
    end: int
    whole: bool  # whether begin is where a line begins


def number(x, kind=float):  # noqa: ANN001, ANN201
    try:
        return None if x is None or x == "" else kind(x)
    except (TypeError, ValueError):
        return None


def time_of(text: str | None) -> datetime | None:
    """A time such as 2024-01-01 10:00:00.123456789 +0000 UTC or ISO; without a zone it is UTC."""
    try:
        at = datetime.fromisoformat(str(text).strip().replace(" +0000 UTC", "").replace("Z", "")[:26])
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def row_of(line: bytes, types: set[str], box: tuple[float, float, float, float] | None) -> tuple | None:
    """A message as a row of SCHEMA; None for what does not parse, has no MMSI, is not asked for or lies outside the box (south, west, north, east)."""
    try:
        m = json.loads(line)
        kind, meta = m.get("MessageType"), m.get("MetaData") or {}
        body = (m.get("Message") or {}).get(kind) or {}
        mmsi = str(meta.get("MMSI") or "").strip()
    except (ValueError, AttributeError):
        return None
    if kind not in types or not mmsi:
        return None
    lat, lon = (number(body.get(c)) or number(meta.get(c.lower())) for c in ("Latitude", "Longitude"))
    if box and (lat is None or lon is None or not (box[0] <= lat <= box[2] and box[1] <= lon <= box[3])):
        return None
    course, speed, heading = number(body.get("Cog")), number(body.get("Sog")), number(body.get("TrueHeading"))
    name = str(body.get("Name") or meta.get("ShipName") or "").strip() or None
    return (
        mmsi, kind, TYPES.get(kind), time_of(meta.get("time_utc")), name, lat, lon, course if course is None or course < 360 else None,
        speed if speed is None or speed < 102.3 else None, None if heading == 511 else heading, number(body.get("ImoNumber"), int) or None, number(body.get("Type"), int), str(body.get("Destination") or "").strip() or None,
    )


class Files:
    """The files of a feed, in any store that pyarrow reaches."""

    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(options["path"] if "://" in options["path"] else f"file://{options['path']}")
        self.types = set(filter(None, options.get("types", ",".join(TYPES)).split(",")))
        self.box = tuple(float(x) for x in options["box"].split(",")) if options.get("box") else None
        self.span = int(options.get("span", SPAN))

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and not f.base_name.startswith(("_", "."))}

    def last_line_end(self, file: str, size: int) -> int:
        """The byte after the last line end of a file's first size bytes."""
        with self.store.open_input_file(f"{self.root}/{file}") as f:
            at = size
            while at:
                begin = max(0, at - (1 << 16))
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return 0

    def end(self) -> tuple[str, int]:
        """Past the last whole line. A file that is not the last one is done, so its last line needs no end."""
        sizes = self.sizes()
        if not sizes:
            return "", 0
        last = next(reversed(sizes))
        return last, self.last_line_end(last, sizes[last])

    def spans(self, begin: tuple[str, int], end: tuple[str, int]) -> list[Span]:
        out = []
        for file, size in self.sizes().items():
            if begin[0] <= file <= end[0]:
                start = begin[1] if file == begin[0] else 0
                stop = end[1] if file == end[0] else size
                out += [Span(file, at, min(stop, at + self.span), at == start) for at in range(start, stop, self.span)]
        return out

    def lines(self, span: Span) -> Iterator[bytes]:
        """The lines that begin in a span."""
        with self.store.open_input_file(f"{self.root}/{span.file}") as f:
            at = span.begin if span.whole else span.begin - 1
            f.seek(at)
            data = f.read(span.end - at)
            while not data.endswith(b"\n"):  # the last line goes on
                more = f.read(1 << 16)
                if not more:
                    break
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
            lines = data.split(b"\n")
            yield from lines if span.whole else lines[1:]

    def rows(self, span: Span) -> Iterator[tuple]:
        for line in self.lines(span):
            row = row_of(line, self.types, self.box) if line.strip() else None
            if row is not None:
                yield row


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Span]:
        files = Files(self.options)
        return files.spans(("", 0), files.end())

    def read(self, partition: Span) -> Iterator[tuple]:
        return Files(self.options).rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        file, byte = Files(self.options).end()
        return {"file": file, "byte": byte}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return Files(self.options).spans((start["file"], start["byte"]), (end["file"], end["byte"]))

    def read(self, partition: Span) -> Iterator[tuple]:
        return Files(self.options).rows(partition)

    def commit(self, end: dict) -> None:
        """Recorded files stay."""


class Feed(DataSource):
    """Options: path; box (south,west,north,east); types (names of messages, by comma); span (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "vessel_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))
