"""Source archives: a fetcher that the caller injects gives gzip-compressed tar bytes, an archive becomes rows.

Each archive is unpacked in one task, file by file; links and devices are passed over, and a path that leaves the
archive's folder fails the read."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fetcher = Callable[[str, str], bytes]
SCHEMA = "source string, path string, content binary, commit string"


class UnsafePath(ValueError):
    """A member that would be written outside the checkout."""


def unpack(archive: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(commit, files): the commit is the archive's comment, else what follows the last hyphen of its folder."""
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:gz") as tar:
        files, commit = [], tar.pax_headers.get("comment", "")
        for member in tar:
            wrapper, _, path = member.name.partition("/")
            commit = commit or member.pax_headers.get("comment", "") or wrapper.rpartition("-")[2]
            if member.name.startswith("/") or ".." in member.name.split("/"):
                raise UnsafePath(member.name)
            if member.isfile() and path:
                files.append((path, tar.extractfile(member).read()))
    return commit, sorted(files)


def checkouts(sources: DataFrame, fetch: Fetcher) -> DataFrame:
    """source, path, content, commit of every regular file of sources (source, slug, ref)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, slug, ref in zip(batch["source"], batch["slug"], batch["ref"], strict=True):
                commit, files = unpack(fetch(slug, ref))
                for first in range(0, len(files), 100):
                    yield pd.DataFrame([(source, p, c, commit) for p, c in files[first : first + 100]], columns=["source", "path", "content", "commit"])

    return sources.select("source", "slug", "ref").mapInPandas(run, SCHEMA)
