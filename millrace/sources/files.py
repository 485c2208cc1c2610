"""Files of Python data sources: opened through pyarrow's file systems, committed by a manifest.

A task writes files under names of its own. The commit writes a manifest of those of successful tasks, and a folder with
manifests is read as what they list: what a dead or repeated task left behind is never read."""

from __future__ import annotations

import json
import uuid


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def commit_manifest(path: str, files: list[str]) -> None:
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
        out.write(json.dumps({"files": sorted(files)}).encode())


def committed(path: str, suffixes: tuple[str, ...]) -> dict[str, int]:
    """Files to read under a path, with their sizes: a file itself, those of a folder's manifests, or those with a suffix."""
    from pyarrow import fs as pafs

    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:  # named itself, so its name doesn't matter
        return {root: info.size}
    found = {x.path: x.size for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file}
    manifests = sorted(p for p in found if p.rsplit("/", 1)[1].startswith("manifest-"))
    if not manifests:
        return {p: s for p, s in sorted(found.items()) if p.endswith(suffixes)}
    names = []
    for m in manifests:
        with fs.open_input_stream(m) as f:
            names += [f"{m.rsplit('/', 1)[0]}/{x}" for x in json.loads(f.read())["files"]]
    return {n: found[n] for n in sorted(names)}
