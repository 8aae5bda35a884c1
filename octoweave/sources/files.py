"""Files of any store that pyarrow can open: mounted folders, and stores named by a URI (hdfs, s3, gs and so on)."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files of that suffix, in order of name and without hidden ones; of a file, itself."""
    store, inner = located(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, size_of(path))]
    root = path.rstrip("/")
    found = store.get_file_info(fs.FileSelector(inner))
    return sorted((f"{root}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith("."))


def size_of(path: str) -> int:
    store, inner = located(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def reading(path: str):
    store, inner = located(path)
    return store.open_input_file(inner)


def writing(path: str):
    store, inner = located(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


def move(old: str, new: str) -> None:
    store, inner = located(old)
    store.move(inner, located(new)[1])


def remove(path: str) -> None:
    store, inner = located(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        store.delete_file(inner)
