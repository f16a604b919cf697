"""Files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file named by a URI or an absolute path.

    An absolute path is one of the machine that opens it, so on a cluster it has to lie in the folder that all
    executors share, as paths from ``scratch`` do.
    """
    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + urlsplit(uri).path.lstrip("/")
    return pafs.FileSystem.from_uri(quote(uri, safe=":/@%?=&"))
