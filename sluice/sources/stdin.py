"""Standard input, spooled to a file that goes when it is done with."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from typing import BinaryIO


@contextlib.contextmanager
def spooled(stream: BinaryIO) -> Iterator[str]:
    """A file with all that the stream holds; raises ValueError if that is nothing."""
    fd, path = tempfile.mkstemp(suffix=".txt")
    try:
        with os.fdopen(fd, "wb") as f:
            shutil.copyfileobj(stream, f)
            empty = f.tell() == 0
        if empty:
            raise ValueError("standard input is empty")
        yield path
    finally:
        os.unlink(path)
