"""Files of shared storage beyond what Spark's readers and writers offer."""

from __future__ import annotations

from pyarrow import fs


def remove_folder(path: str) -> None:
    """Remove a folder of shared storage with all that is in it, if it is there."""
    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)


def folders(path: str) -> list[str]:
    """Names of the folders in a folder."""
    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [item.base_name for item in found if item.type == fs.FileType.Directory]
