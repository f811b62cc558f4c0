"""A source of posts by account, as a table and as a stream, that reads in executors and keeps a cursor for each account.

Each account has one JSON-lines file, which only grows. The cursor of an account is the length of its file that has been
read; a trigger lists the folder once, and the driver holds a name and a number for each account, never a post. What lies
between two cursors is cut into ranges of bytes, packed into partitions of even size, and read by tasks. A line belongs to the
range that its last byte lies in, so ranges may be cut anywhere, a long file is shared by many tasks, and a line that is still
being written is left for a later trigger.

Spark commits the cursors with the checkpoint after the sink has written, so a failed batch is read again between the same
cursors. A file that cannot be read, or was shortened, costs its own posts and no others. Malformed lines, and lines
without a numeric id, are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a partition, and of a step in the search for a line's start.
PARTITION_BYTES, STEP_BYTES = 32 << 20, 1 << 16


class AccountPosts(DataSource):
    """``format("account_posts")``: option ``path`` names the folder, ``accounts`` a comma-separated choice (default: all files)."""

    @classmethod
    def name(cls) -> str:
        return "account_posts"

    def schema(self) -> str:
        return "account string, id long, text string, created_at string, conversation_id string"

    def reader(self, schema) -> DataSourceReader:
        return AccountReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return AccountStream(self.options)


@dataclass
class Ranges(InputPartition):
    """Ranges (account, start, end) of files that one task reads."""

    value: list[tuple[str, int, int]]


def accounts_of(options) -> list[str]:
    """Distinct account names in lower case without a leading @."""
    names = (a.strip().lstrip("@").lower() for a in options.get("accounts", "").split(","))
    return list(dict.fromkeys(filter(None, names)))


class Folder:
    """The files of accounts below a path of any file system that Arrow opens by its address."""

    def __init__(self, options):
        self.path, self.accounts = options["path"], set(accounts_of(options))
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def lengths(self) -> dict[str, int]:
        """The length of each account's file, from one listing."""
        system, root = self.opened()
        files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = {f.base_name.removesuffix(".jsonl"): f.size for f in files if f.base_name.endswith(".jsonl") and f.is_file}
        return {a: n for a, n in sorted(found.items()) if not self.accounts or a in self.accounts}

    def packed(self, start: dict[str, int], end: dict[str, int]) -> list[Ranges]:
        """Ranges of what lies between two cursors, in partitions of at most ``most`` bytes."""
        packs, room = [], 0
        for account, upto in end.items():
            at = start.get(account, 0)
            while at < upto:
                if room <= 0:
                    packs.append(Ranges([]))
                    room = self.most
                step = min(room, upto - at)
                packs[-1].value.append((account, at, at + step))
                at, room = at + step, room - step
        return packs

    def posts(self, ranges: Ranges) -> Iterator[tuple]:
        system, root = self.opened()
        for account, start, end in ranges.value:
            try:
                with system.open_input_file(f"{root}/{account}.jsonl") as file:
                    for line in lines_that_end(file, start, end):
                        if post := parsed(account, line):
                            yield post
            except OSError:
                continue


def lines_that_end(file, start: int, end: int) -> Iterator[bytes]:
    """Lines whose last byte, a line feed, lies in [start, end); their beginnings may lie before."""
    first = start
    while first > 0:  # back to the end of the line before
        step = max(0, first - STEP_BYTES)
        file.seek(step)
        at = file.read(first - step).rfind(b"\n")
        first = step + at + 1 if at >= 0 else step
        if at >= 0:
            break
    file.seek(first)
    rest, left = b"", end - first
    while left > 0 and (block := file.read(min(left, STEP_BYTES))):
        left -= len(block)
        *whole, rest = (rest + block).split(b"\n")
        yield from whole


def parsed(account: str, line: bytes) -> tuple | None:
    try:
        post = json.loads(line)
        number = int(post["id"])
    except (ValueError, KeyError, TypeError):
        return None
    text = lambda name: None if post.get(name) is None else str(post[name])
    return account, number, text("text"), text("created_at"), text("conversation_id")


class AccountReader(DataSourceReader):
    """All posts that have been written in full."""

    def __init__(self, options):
        self.folder = Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.packed({}, self.folder.lengths()) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        yield from self.folder.posts(partition)


class AccountStream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.folder.lengths()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.packed(start, end)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        yield from self.folder.posts(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the cursors."""
